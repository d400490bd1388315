"""Session records: context, completion and suppression of findings, decoding of given scores, plans and the whole flow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.functions import replacements as R

from .extract import findings
from .sessions import plausible, propagated, spreads, value_form
from .spans import greedy, not_contained

# Words of technical prose that recognisers take for names, hosts of public references, cues of private matters.
BENIGN = ["api", "json", "http", "https", "linux", "docker", "python", "rust", "java", "github", "readme", "todo", "main", "null", "true", "false"]
PUBLIC_HOSTS = ["github.com", "docs.rs", "crates.io", "python.org", "wikipedia.org", "stackoverflow.com", "w3.org", "ietf.org"]
PRIVATE_CUES = ["password", "ssn", "born", "address", "phone", "mobile", "patient", "customer", "employee", "my name"]


def context(text: Column, start: Column, end: Column, reach: int = 60) -> Column:
    """a finding with ``reach`` characters on each side, an ellipsis where more was cut."""
    low = F.greatest(F.lit(0), start - reach)
    left = F.when(low > 0, "…").otherwise("")
    right = F.when(F.char_length(text) > end + reach, "…").otherwise("")
    return F.concat(left, F.substring(text, low + 1, end + reach - low), right)


def suppressed(value: Column, text: Column, start: Column, end: Column, reach: int = 96) -> Column:
    """A recogniser's finding that is a benign word, a public reference or a technical value, without a private cue beside it on its line."""
    before = F.regexp_extract(F.substring(text, F.greatest(F.lit(1), start + 1 - reach), F.least(start, F.lit(reach))), r"[^\n]*$", 0)
    after = F.regexp_extract(F.substring(text, end + 1, F.lit(reach)), r"^[^\n]*", 0)
    low, around = F.lower(value), F.lower(F.concat(before, F.lit(" "), after))
    public = reduce(lambda a, b: a | b, (low.rlike(rf"^(?:https?://)?(?:[a-z0-9-]+\.)*{h.replace('.', chr(92) + '.')}(?:/|$)") for h in PUBLIC_HOSTS))
    technical = low.rlike(r"^v?[0-9]+(?:\.[0-9]+)*$|^[0-9a-f]{7,40}$|^[a-z0-9_]+\(\)$|^[a-z0-9]+(?:_[a-z0-9]+)+$")
    private = reduce(lambda a, b: a | b, (around.contains(c) for c in PRIVATE_CUES))
    return (low.isin(BENIGN) | public | technical) & ~private


def completed(found: DataFrame, key: list[str], text: str, most: int = 64) -> DataFrame:
    """X11: names grown to the whole token they are joined to by ``-`` or ``_``, of at most ``most`` bytes; findings swallowed by one are dropped."""
    t = F.col(text)
    left = F.regexp_extract(F.substring(t, F.lit(1), F.col("start_cp")), r"(?:[\p{L}\p{N}]+[-_])+$", 0)
    right = F.regexp_extract(F.substring(t, F.col("end_cp") + 1, F.char_length(t)), r"^(?:[-_][\p{L}\p{N}]+)+", 0)
    size = F.octet_length(left) + F.octet_length(right) + F.octet_length(F.substring(t, F.col("start_cp") + 1, F.col("end_cp") - F.col("start_cp")))
    fits = size <= most
    d = found.withColumn("_l", F.when(fits, F.char_length(left)).otherwise(0)).withColumn("_r", F.when(fits, F.char_length(right)).otherwise(0))
    d = d.withColumn("start_cp", F.col("start_cp") - F.col("_l")).withColumn("end_cp", F.col("end_cp") + F.col("_r"))
    return not_contained(d.drop("_l", "_r", text).distinct(), key)


def packed(text: Column, most: int) -> Column:
    """Sentences packed into chunks of at most ``most`` characters; a longer sentence is cut at its last blank that fits, else at the limit.

    The chunks put together are the text.
    """
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)[^.!?\n]{{1,{most}}}[.!?\n]*|[.!?\n]+"), F.lit(0))
    cut = F.flatten(F.transform(parts, lambda s: F.regexp_extract_all(s, F.lit(rf"(?s).{{1,{most}}}(?:(?<=\s)|$)|.{{1,{most}}}"), F.lit(0))))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("open"))
    step = lambda a, s: F.when(F.char_length(a["open"]) + F.char_length(s) <= most, F.struct(a["done"].alias("done"), F.concat(a["open"], s).alias("open"))).otherwise(
        F.struct(F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))).alias("done"), s.alias("open")))
    return F.aggregate(cut, start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


def token_tags(logits: Column, tags: list[str]) -> Column:
    """(tag, p) of a token: the tag of its largest logit, and that tag's share by softmax."""
    top = F.array_max(logits)
    p = F.lit(1.0) / F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top.cast("double")))
    return F.struct(F.element_at(F.array(*map(F.lit, tags)), F.array_position(logits, top).cast("int")).alias("tag"), p.alias("p"))


def decoded_spans(scored: DataFrame, key: str, score: str, threshold: float = 0.5) -> DataFrame:
    """(key, start_cp, end_cp, label, p): spans whose sigmoid score passes, the likeliest first, none overlapping one taken; a fold a text."""
    d = scored.withColumn("p", 1 / (1 + F.exp(-F.col(score)))).filter(F.col("p") >= threshold)
    item = F.struct((-F.col("p")).alias("np"), "start_cp", "end_cp", "label")
    got = d.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_x"))
    kind = got.schema["_x"].dataType.simpleString()
    free = lambda acc, x: ~F.exists(acc, lambda y: (y["start_cp"] < x["end_cp"]) & (y["end_cp"] > x["start_cp"]))
    taken = F.aggregate("_x", F.expr(f"cast(array() as {kind})"), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return got.select(key, F.explode(taken).alias("x")).select(key, "x.start_cp", "x.end_cp", "x.label", (-F.col("x.np")).alias("p"))


def plans(candidates: DataFrame, session: str) -> DataFrame:
    """K6: (session, candidates): each session's values with class and count, most frequent first; the rows of its plan file."""
    n = candidates.groupBy(session, "value", "pattern_name").agg(F.count("*").alias("n"))
    item = F.struct((-F.col("n")).alias("k"), "value", "pattern_name", "n")
    rows = n.groupBy(session).agg(F.array_sort(F.collect_list(item)).alias("c"))  # distinct values of one session: its plan
    return rows.select(session, F.transform("c", lambda c: F.struct(c["value"].alias("value"), c["pattern_name"].alias("pattern_name"), c["n"].alias("n"))).alias("candidates"))


def session_pipeline(rows: DataFrame, key: str, session: str, text: str, secret: bytes) -> DataFrame:
    """(key, cleaned, n_replaced): detect, keep what is plausible, spread each session's values through it, replace.

    Values found anywhere in a session are replaced in all its texts, longest first where they overlap, by keyed
    placeholders of the class that the value had first.  Null texts stay null.
    """
    f = findings(rows, [key, session], text).filter(plausible(F.col("pattern_name"), F.col("matched_text")))
    direct = f.select(key, "start_cp", "end_cp", "pattern_name", F.col("matched_text").alias("value"))
    first = f.groupBy(session, F.col("matched_text").alias("value")).agg(F.min_by("pattern_name", F.struct(key, "start_cp", "pattern_name")).alias("pattern_name"))
    values = first.filter(spreads(F.col("pattern_name"), F.col("value")))
    met = propagated(values, rows, session, text, key).select(key, "value").join(rows.select(key, session, text), key).join(values, [session, "value"])
    # where each value stands: the lengths of the pieces between its occurrences
    pieces = F.split(text, value_form(F.col("value")), -1)
    ends = F.aggregate(F.slice("_g", F.lit(1), F.size("_g") - 1), F.expr("cast(array() as array<int>)"), lambda a, g: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)) + F.char_length("value"), F.lit(0)) + F.char_length(g))))
    spread = met.withColumn("_g", pieces).filter("size(_g) > 1").select(key, "value", "pattern_name", F.explode(ends).alias("start_cp"))
    spread = spread.select(key, "start_cp", (F.col("start_cp") + F.char_length("value")).alias("end_cp"), "pattern_name", "value")
    chosen = greedy(direct.union(spread).distinct(), [key], carry=["pattern_name", "value"])
    spans = chosen.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_cp", "end_cp", R.corpus_placeholder(F.col("pattern_name"), F.col("value"), secret).alias("replacement")))).alias("_s"))
    from .replace import rendered

    out = rows.select(key, text).join(spans, key, "left")
    return out.select(key, F.when(F.col("_s").isNotNull(), rendered(F.col(text), F.col("_s"))).otherwise(F.col(text)).alias("cleaned"), F.coalesce(F.size("_s"), F.lit(0)).alias("n_replaced"))


def reconciled(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, leaves, same_structure, changed): whether a record kept its leaves, paths and kinds, and how many values changed."""
    b = before.select(*key, "ordinal", F.col("path").alias("bp"), F.col("kind").alias("bk"), F.col("value").alias("bv"))
    a = after.select(*key, "ordinal", F.col("path").alias("ap"), F.col("kind").alias("ak"), F.col("value").alias("av"))
    j = b.join(a, [*key, "ordinal"], "full")
    same = F.col("bp").eqNullSafe(F.col("ap")) & F.col("bk").eqNullSafe(F.col("ak"))
    return j.groupBy(*key).agg(F.count("*").alias("leaves"), F.min(same).alias("same_structure"), F.count(F.when(~F.col("bv").eqNullSafe(F.col("av")), 1)).alias("changed"))


def noisy(text: Column, seed: str, one_in: int = 16) -> Column:
    """seeded noise: about one character in ``one_in`` is misread, doubled, capitalised or dropped, as its place and the text's digest say."""
    mac = F.md5(F.concat(F.lit(seed), text))
    # Characters that scanners take for another.
    read, wrong = "lO0S5B8", "1001S88"

    def one(c: Column, i: Column) -> Column:
        n = F.conv(F.md5(F.concat(mac, F.lit(":"), i.cast("string"))).substr(1, 4), 16, 10).cast("int")
        kind = F.floor(n / one_in) % 4
        return F.when(n % one_in != 0, c).when(kind == 0, F.translate(c, read, wrong)).when(kind == 1, F.concat(c, c)).when(kind == 2, F.upper(c)).otherwise(F.lit(""))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def rendered_template(rows: DataFrame, template: str, slots: dict[str, str]) -> DataFrame:
    """Rows with ``rendered`` (the template with each ``{slot}`` filled from its column) and ``spans`` of what was filled in.

    ``slots``: slot name to column.  A null value makes the text null.
    """
    import re

    parts = re.split(r"\{(\w+)\}", template)
    text, spans = F.lit(parts[0]), []
    for slot, tail in zip(parts[1::2], parts[2::2]):
        value = F.col(slots[slot]).cast("string")
        start = F.char_length(text)
        spans.append(F.struct(start.alias("start_cp"), (start + F.char_length(value)).alias("end_cp"), F.lit(slot).alias("label")))
        text = F.concat(text, value, F.lit(tail))
    return rows.withColumn("rendered", text).withColumn("spans", F.array(*spans))


def family_splits(rows: DataFrame, family: str, shares: list[tuple[str, float]], seed: str) -> DataFrame:
    """Rows with ``split``: whole families in seeded hash order, cut at the shares of all families."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(family).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
    out, upto = F, 0.0
    for name, share in shares[:-1]:
        upto += share
        out = out.when(h < upto, name)
    return rows.withColumn("split", out.otherwise(shares[-1][0]))
