"""Agent sessions: which leaves matter, which findings are plausible, and how values spread through a session."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.session import cut_lineage

from .skew import hot_keys, salted_join

# Keys whose values are identifiers or encodings, keys of natural text, shared accounts, classes that never spread.
STRUCTURAL = ["id", "parentId", "timestamp", "type", "role", "toolCallId", "toolName", "model", "modelId", "provider", "api", "stopReason", "mimeType", "version", "customType", "responseId", "thinkingLevel", "thinkingSignature", "signature", "encrypted_content", "textSignature"]
PROSE = ["text", "thinking", "summary", "message"]
GENERIC_ACCOUNTS = ["root", "admin", "administrator", "user", "guest", "nobody", "daemon", "www-data", "ubuntu", "debian", "ec2-user", "runner", "vscode", "node", "app", "codespace", "jovyan", "postgres", "mysql", "git", "localhost", "raspberrypi", "sudo", "system"]
NO_SPREAD = ["date", "time", "url", "unix_path", "uuid", "number", "age", "gender"]
CANDIDATE = r"\b\p{Lu}[\p{Ll}\p{M}]+[ \t]+\p{Lu}[\p{Ll}\p{M}]+|\b[0-9]{4,5}[ \t]+\p{Lu}[\p{Ll}\p{M}]+|\b\p{Lu}\.[ \t]*\p{Lu}[\p{Ll}\p{M}]+|(?i:\b(?:user(?:name)?|login|handle|account|author|owner|contact)\s*[:=])"
PROSE_CANDIDATE = r"[\p{Ll}\p{N},;:)][ \t]+\p{Lu}[\p{Ll}\p{M}]+"
LINE_BYTES = 2000


def leaf_kind(key: Column, parent_type: Column, parent_has_mime: Column, role: Column) -> Column:
    """Image, skip, prose or other."""
    image = (key == "data") & (parent_has_mime | (parent_type == "image"))
    return F.when(F.coalesce(image, F.lit(False)), "image").when(key.isin(STRUCTURAL), "skip").when(key.isin(PROSE) & F.coalesce(~role.isin("toolResult"), F.lit(True)), "prose").otherwise("other")


def candidate_line(line: Column, prose: Column) -> Column:
    """A line worth a look by a recogniser; too long lines are data."""
    return (F.octet_length(line) <= LINE_BYTES) & (line.rlike("(?U)" + CANDIDATE) | (prose & line.rlike(PROSE_CANDIDATE)))


def trimmed(value: Column) -> tuple[Column, Column]:
    """(characters to skip at the start, value) without delimiters at the edges."""
    edge = r"[\s;,:!?.\"'`|()\[\]{}<>=]"
    lead = F.length(F.regexp_extract(value, rf"(?U)^{edge}*", 0))
    return lead, F.regexp_replace(value, rf"(?U)^{edge}+|{edge}+$", "")


def account_of(path: Column) -> Column:
    """The account of a home path: its last segment."""
    return F.regexp_extract(path, r"[^/\\]+$", 0)


def digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def plausible(name: Column, value: Column) -> Column:
    """Shape rules of the classes patterns find: a number that is no phone, card or id is dropped."""
    n, numeric = digits(value), value.rlike(r"(?U)^[0-9\s+\-.:/()]*$")
    low = F.lower(value)
    domain = F.lower(F.regexp_replace(F.substring_index(value, "@", -1), r"\.+$", ""))
    reserved = domain.isin("example.com", "example.org", "example.net", "localhost") | domain.rlike(r"\.(example|test|invalid|localhost|example\.com|example\.org|example\.net)$")
    return (
        F.when(low.isin(GENERIC_ACCOUNTS), False)
        .when(name.isin("date", "time", "organization", "company"), False)
        .when(name == "email", ~reserved)
        .when(name == "ipv4", ~(value.startswith("127.") | value.isin("0.0.0.0", "255.255.255.255")))
        .when(name.isin("phone_us", "phone_intl", "phone_ner"), (n >= 7) & value.rlike(r"[+ \-.()]"))
        .when(name.isin("credit_card", "credit_card_nodash"), n.between(13, 19) & F.call_function("luhn_check", F.regexp_replace(value, "[^0-9]", "")))
        .when(name.isin("ssn", "ssn_nodash"), n == 9)
        .when(name == "mac", value.rlike("^([^:-]{2}[:-]){5}[^:-]{2}$"))
        .otherwise(~numeric | (n >= 6))
    )


def person_like(value: Column, before: Column, after: Column) -> Column:
    """P10: capitalised, and not a member of code (``x.Name``, ``Name(``)."""
    return value.rlike(r"\p{Lu}") & ~(after.rlike(r"(?U)^\.[\p{L}\p{N}]|^\(") | before.rlike(r"\.$"))


def url_like(value: Column) -> Column:
    """P10: a scheme, or a dotted host that does not end like a file."""
    low = F.lower(value)
    host = F.regexp_extract(low, r"^([^/?#:]*)", 1)
    return low.contains("://") | low.startswith("www.") | (host.rlike(r"^(?:[a-z0-9-]+\.)+[a-z]{2,}$") & ~host.rlike(r"\.(md|rs|toml|json|jsonl|yaml|yml|sh|py|js|ts|tsx|jsx|txt|html|css|lock)$"))


def spreads(name: Column, value: Column) -> Column:
    """A value worth looking for elsewhere in its session."""
    return ~name.isin(NO_SPREAD) & (F.length(value) >= 4) & (value.rlike(r"\p{L}") | (F.length(value) >= 7))


_ALNUM = r"[\p{L}\p{N}]+"


def _longest_run(value: Column) -> Column:
    """The longest run of letters and digits of a value, the first of equals; empty where it has none."""
    runs = F.regexp_extract_all(value, F.lit(_ALNUM), F.lit(0))
    return F.aggregate(runs, F.lit(""), lambda a, r: F.when(F.char_length(r) > F.char_length(a), r).otherwise(a))


def value_form(value: Column) -> Column:
    """A value as a form: itself, at word edges where it begins or ends with a letter or digit."""
    quoted = F.regexp_replace(value, r"([^\p{L}\p{N}\s])", r"\\$1")
    left = F.when(value.rlike(r"^[\p{L}\p{N}]"), r"(?<![\p{L}\p{N}])").otherwise("")
    right = F.when(value.rlike(r"[\p{L}\p{N}]$"), r"(?![\p{L}\p{N}])").otherwise("")
    return F.concat(left, quoted, right)


def propagated(values: DataFrame, leaves: DataFrame, session: str, text: str, key: str) -> DataFrame:
    """(key, value, occurrences): every value of a session in every leaf of it, at word edges where the value ends in letters or digits.

    Edges make each run of letters and digits of a value a whole run of the text, so texts and values meet on
    session and run (the value's longest) only; runs that are common in a large session are spread over tasks.
    Distinct texts are searched, each under its digest.  Values without letters and digits meet all texts of
    their session.  Null texts and values give nothing.
    """
    v = values.select(session, "value").filter("value is not null and value <> ''").distinct().withColumn("_r", _longest_run(F.col("value")))
    texts = leaves.filter(F.col(text).isNotNull()).select(session, text).distinct().withColumn("_h", F.md5(text))
    at = lambda r: F.xxhash64(session, r)
    wanted = v.select(at("_r").alias("_k"), F.col(session).alias("_vs"), "value").distinct()
    runs = texts.select(session, "_h", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(_ALNUM), F.lit(0))))).alias("_r"))
    met = runs.select(at("_r").alias("_k"), session, "_h").join(wanted.select("_k").distinct(), "_k", "left_semi")
    n = cut_lineage(met.groupBy("_k").agg(F.count("*").alias("n")))
    hot = hot_keys(n, "_k", "n", n.agg(F.sum("n")).first()[0] or 0)
    pairs = salted_join(met, wanted, "_k", "_h", hot).filter(F.col(session) == F.col("_vs")).select(session, "_h", "value").distinct()
    j = pairs.join(texts, [session, "_h"]).filter(F.col(text).contains(F.col("value")))
    found = j.withColumn("occurrences", F.size(F.regexp_extract_all(F.col(text), value_form(F.col("value")), F.lit(0)))).filter("occurrences > 0")
    found = found.groupBy(session, "_h").agg(F.collect_list(F.struct("value", "occurrences")).alias("_f"))  # the values of one text
    rows = leaves.select(key, session, F.md5(text).alias("_h")).join(found, [session, "_h"])
    return rows.select(key, F.explode("_f").alias("f")).select(key, "f.value", "f.occurrences")


def first_classes(df: DataFrame, space: str, value: str, cls: str, order: str) -> DataFrame:
    """(space, value, class, first): the class a value had first."""
    return df.groupBy(space, value).agg(F.min_by(cls, F.struct(order, cls)).alias(cls), F.min(order).alias("first"))


def value_counts(df: DataFrame, space: str, value: str, n: str) -> DataFrame:
    """(space, value, n): occurrences, times their multiplicity."""
    return df.groupBy(space, value).agg(F.sum(n).alias("n"))


def allowed(df: DataFrame, value: str, words: DataFrame) -> DataFrame:
    """Rows whose value is on no list, whatever its case."""
    return df.join(words.select(F.lower("word").alias("_w")).distinct(), F.lower(value) == F.col("_w"), "left_anti")


#: Signals of a chunk worth labelling, with their weights, as forms.
SIGNALS = [("@[a-z0-9.-]+\\.[a-z]{2,}", 3), ("\\+?[0-9][0-9 ()./-]{8,}[0-9]", 2), ("(?i)\\b(name|address|phone|e-?mail)\\b", 2), ("/(?:home|users)/", 2), ("(?i)\\b(password|token|secret)\\b", 3), ("\\b[A-Z][a-z]+ [A-Z][a-z]+\\b", 1), ("https?://", 1), ("[0-9]{4}-[0-9]{2}-[0-9]{2}", 1)]


def interest(text: Column) -> Column:
    """The weights of the signals a text shows, 12 at most."""
    return F.least(F.lit(12), reduce(lambda a, b: a + b, (F.when(text.rlike(f"(?U){p}"), w).otherwise(0) for p, w in SIGNALS)))
