"""Evaluation, review and catalogue steps over tables: labels, samples, parity, plans and saved runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.functions.replacements import entropy

# Labels that are told apart in annotations and are one in scoring.
COARSE = {"first_name": "person", "last_name": "person", "phone_us": "phone", "phone_intl": "phone"}


def kept_reason(entities: Column, complete: Column, least: int = 3) -> Column:
    """P20: why a real text is left out: no entities, annotated in part, a span too short; else ``kept``."""
    short = F.exists(entities, lambda e: (e["end_cp"] - e["start_cp"]) < least)
    return F.when(entities.isNull() | (F.size(entities) == 0), "no_entities").when(~complete, "incomplete").when(short, "short_span").otherwise("kept")


def coarse(label: Column) -> Column:
    """The label of scoring."""
    out = F
    for to in dict.fromkeys(COARSE.values()):
        out = out.when(label.isin([k for k, v in COARSE.items() if v == to]), to)
    return out.otherwise(label)


def high_entropy(texts: DataFrame, text: str, least: int = 16, bits: float = 3.5) -> DataFrame:
    """(token): distinct long tokens of more than ``bits`` of entropy a character."""
    form = rf"[A-Za-z0-9+/=_-]{{{least},}}"
    return texts.select(F.explode(F.regexp_extract_all(text, F.lit(form), F.lit(0))).alias("token")).distinct().filter(entropy(F.col("token")) > bits)


def planned(rows: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """Rows with their session's plan; a row whose session no plan names ends the query."""
    j = rows.join(plan.withColumn("_there", F.lit(True)), key, "left")
    return j.filter(F.assert_true(F.col("_there"), F.lit("a plan names an unknown session")).isNull()).drop("_there")


def with_labels(rows: DataFrame, spans: str, field: str, labels: list[str]) -> DataFrame:
    """Rows that hold a span of one of the labels."""
    return rows.filter(F.arrays_overlap(F.transform(spans, lambda s: s[field]), F.array(*map(F.lit, labels))))


def hits(gold: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """(gold, hit, missed): gold spans met exactly."""
    g = gold.join(found.select(*on).distinct().withColumn("_h", F.lit(1)), on, "left")
    return g.agg(F.count("*").alias("gold"), F.count("_h").alias("hit"), (F.count("*") - F.count("_h")).alias("missed"))


def distinct_by(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n): distinct values a source."""
    return rows.select(by, value).distinct().groupBy(by).agg(F.count(value).alias("n"))


def tallied(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Counts of proposals by class and basis."""
    return rows.groupBy(*cols).agg(F.count("*").alias("n"))


def recognised_first(shortlist: DataFrame, recognised: Column, strength: str) -> DataFrame:
    """O3: a shortlist of bounded length ranked anew: what a recogniser also names first, the stronger the earlier."""
    match = F.when(recognised, F.col(strength)).otherwise(-1)
    return shortlist.select("term", F.row_number().over(Window.orderBy(match.desc(), "rank")).alias("rank"))  # over the shortlist


def distinct_texts(rows: DataFrame, text: str, key: str) -> DataFrame:
    """(text, key, copies): each text once, under its first key."""
    return rows.filter(F.col(text).isNotNull()).groupBy(text).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def literal_union(parts: list[DataFrame], value: str) -> DataFrame:
    """(literal): the values of several lists in small letters, each once."""
    out = parts[0].select(value)
    for p in parts[1:]:
        out = out.union(p.select(value))
    return out.filter(F.col(value).isNotNull()).select(F.lower(value).alias("literal")).distinct()


def not_among(seen: DataFrame, known: list[str], column: str) -> DataFrame:
    """Distinct classes that were seen and that nobody asked for."""
    return seen.select(column).distinct().filter(~F.col(column).isin(known))


def listed(sessions: DataFrame, by: str, key: str) -> DataFrame:
    """Sessions of each source, and the first of them."""
    return sessions.groupBy(by).agg(F.count("*").alias("sessions"), F.min(key).alias("first"))


def text_blocks(leaves: DataFrame) -> DataFrame:
    """The text blocks of session records."""
    return leaves.filter("kind = 'string' and key = 'text'").withColumnRenamed("value", "block")


def freshness(rows: DataFrame, key: str, text: str, digest: str, complete: str) -> DataFrame:
    """(key, fresh, complete): whether a gold row's digest is that of its text, and whether it is annotated in full."""
    return rows.select(key, (F.lower(digest) == F.sha2(text, 256)).alias("fresh"), F.col(complete).alias("complete"))


def parity(pairs: DataFrame, by: str, ours: str, theirs: str, threshold: float) -> DataFrame:
    """V3: (by, n, worst, disagree): largest difference of two scores, and decisions at a threshold that differ one way."""
    return pairs.groupBy(by).agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col(ours) - F.col(theirs))), 6).alias("worst"), F.count(F.when((F.col(ours) > threshold) & (F.col(theirs) <= threshold), 1)).alias("disagree"))


def adjudication(rows: DataFrame, by: str, hard: Column, said: Column) -> DataFrame:
    """V4: (by, recall, utility, unsafe): sensitive rows caught, harmless rows kept, sensitive rows let through."""
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy(by).agg(F.round(n(hard & said) / F.nullif(n(hard), F.lit(0)), 6).alias("recall"), F.round(n(~hard & ~said) / F.nullif(n(~hard), F.lit(0)), 6).alias("utility"), n(hard & ~said).alias("unsafe"))


def abstention(rows: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """V5: (threshold, kept, bound): rows at or above each threshold, and the accuracy that no error among them proves at 95 %."""
    e = rows.select(value, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).filter(F.col(value) >= F.col("threshold"))
    return e.groupBy("threshold").agg(F.count("*").alias("kept"), F.round(1 - F.pow(F.lit(0.05), 1.0 / F.count("*")), 9).alias("bound"))


def label_pairs(rows: DataFrame, key: str, label: str, value: str, dropped: list[str]) -> DataFrame:
    """V6: distinct (key, label, value) without dropped labels and null values."""
    return rows.filter(~F.col(label).isin(dropped) & F.col(value).isNotNull()).select(key, F.col(label).alias("label"), F.col(value).alias("value")).distinct()


def name_corpus(values: DataFrame, value: str, least: int = 2) -> DataFrame:
    """V8: (v, n): names met often enough and written as names."""
    return values.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n")).filter((F.col("n") >= least) & F.col("v").rlike(r"^\p{Lu}[\p{Ll}\p{M}]+$"))


def selected_runs(runs: DataFrame, key: str, started: str, prefix: str = "", n: int = 1) -> DataFrame:
    """The ``n`` latest runs whose digest starts with ``prefix``; a prefix of under 4 characters is no name, only a filter."""
    return runs.filter(F.sha2(key, 256).startswith(prefix)).orderBy(F.desc(started), key).limit(n).select(key)


def run_named(runs: DataFrame, key: str, prefix: str) -> DataFrame:
    """The one run whose digest starts with a prefix of at least 4 hex digits; several or none is an error."""
    if len(prefix) < 4 or set(prefix) - set("0123456789abcdef"):
        raise ValueError("a run is named by at least 4 hex digits")
    hit = runs.filter(F.sha2(key, 256).startswith(prefix)).select(key).limit(2)
    if hit.count() != 1:
        raise ValueError("no run, or several, have this name")
    return hit


def session_status(sessions: DataFrame, texts: DataFrame, key: str, folder: str, text: str, least: int = 3) -> DataFrame:
    """(key, status): missing (no folder), unavailable (no texts), incomplete (under ``least``) or ready."""
    n = texts.groupBy(key).agg(F.count(text).alias("_n"))
    s = sessions.join(n, key, "left")
    return s.select(key, F.when(F.col(folder).isNull(), "missing").when(F.col("_n").isNull(), "unavailable").when(F.col("_n") < least, "incomplete").otherwise("ready").alias("status"))


def prelabelled(rows: DataFrame, lines: DataFrame, on: str) -> DataFrame:
    """V9: rows with the output line of their ordinal; a row without one is skipped."""
    return rows.join(lines, on)


def catalogue(cached: DataFrame, built_in: DataFrame, valid: Column) -> DataFrame:
    """The cached models if every one is valid and there is one, else the built-in list."""
    good = cached.agg(((F.count("*") > 0) & (F.count(F.when(~F.coalesce(valid, F.lit(False)), 1)) == 0)).alias("_good"))
    a = cached.crossJoin(F.broadcast(good)).filter("_good").drop("_good")  # one row
    b = built_in.crossJoin(F.broadcast(good)).filter("not _good").drop("_good")
    return a.unionByName(b)


def diverse(rows: DataFrame, key: str, kinds: Column, n: int, seed: str) -> DataFrame:
    """V7: (key): the first row in seeded hash order of each kind, then rows in that order up to ``n``; none twice."""
    h = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    d = rows.select(key, h.alias("_h"), F.explode(kinds).alias("_kind"))
    first = d.groupBy("_kind").agg(F.min(F.struct("_h", F.col(key).alias("_x"))).alias("_f")).select(F.col("_f._x").alias(key)).distinct()  # one row a kind
    ranked = rows.select(key, h.alias("_h")).join(F.broadcast(first.withColumn("_must", F.lit(1))), key, "left")
    return ranked.orderBy(F.col("_must").desc_nulls_last(), "_h").limit(n).select(key)


def autopsy(covered: DataFrame, label: str) -> DataFrame:
    """V2: (label, kind, n): gold spans under half covered, as ``split`` (touched) or ``blind`` (untouched); others are ``found``."""
    kind = F.when(2 * F.col("covered") >= F.col("length"), "found").when(F.col("covered") > 0, "split").otherwise("blind")
    return covered.groupBy(label, kind.alias("kind")).agg(F.count("*").alias("n"))


def with_canary(rows: DataFrame, text: str, at: Column, canary: Column, prefix: str = " ", suffix: str = " ") -> DataFrame:
    """V1: rows with a planted value: ``planted`` (the new text) and its ``start_cp`` and ``end_cp`` there; null texts stay null."""
    put = F.concat(F.lit(prefix), canary, F.lit(suffix))
    new = F.concat(F.substring(text, F.lit(1), at), put, F.substring(text, at + 1, F.char_length(text)))
    return rows.withColumn("planted", new).withColumn("start_cp", at + len(prefix)).withColumn("end_cp", at + len(prefix) + F.char_length(canary))
