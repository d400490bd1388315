"""Scoring, sampling and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .skew import running


def exact_scores(gold: DataFrame, found: DataFrame, cols: list[str], by: str) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1) of exact spans."""
    g, f = (d.select(*cols).distinct() for d in (gold, found))
    j = g.withColumn("_g", F.lit(1)).join(f.withColumn("_f", F.lit(1)), cols, "full")
    s = j.groupBy(by).agg(F.count(F.col("_g") + F.col("_f")).alias("tp"), F.count(F.when(F.col("_g").isNull(), 1)).alias("fp"), F.count(F.when(F.col("_f").isNull(), 1)).alias("fn"))
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return s.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), 6)})


def keep_set(counts: DataFrame, value: str, n: str, share: float) -> DataFrame:
    """The smallest prefix of most frequent values that reaches ``share`` of all."""
    whole = counts.agg(F.sum(n)).first()[0] or 0
    return running(counts, [F.desc(n), F.col(value)], F.col(n)).filter(F.col("upto") < F.lit(float(whole * share))).select(value, n)


def nearest_rank(df: DataFrame, by: str, value: str, q: list[float]) -> DataFrame:
    """Nearest-rank percentiles and the maximum of each group, by counts of equal values."""
    c = df.groupBy(by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by).orderBy(value)
    c = c.withColumn("_upto", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(by)))
    return c.groupBy(by).agg(*(F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * x), F.col(value))).alias(f"p{round(x * 100)}") for x in q), F.max(value).alias("most"))


def leaking(df: DataFrame, key: Column, split: str) -> DataFrame:
    """Keys that occur in more than one split."""
    return df.filter(F.col(split).isNotNull()).groupBy(key.alias("key")).agg(F.count_distinct(split).alias("splits")).filter("key is not null and splits > 1")


def stratified_top(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows of each stratum in seeded hash order."""
    h = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(h))).filter(F.col("_r") <= n).drop("_r")


def weighted_precision(strata: DataFrame, votes: DataFrame, stratum: str) -> DataFrame:
    """Precision from a stratified sample: each stratum's vote share weighted by its size; lower and upper bounds leave open votes out or in."""
    v = votes.groupBy(stratum).agg(F.count("*").alias("_n"), F.count(F.when(F.col("vote") == "yes", 1)).alias("_y"), F.count(F.when(F.col("vote") == "no", 1)).alias("_no"))
    j = strata.join(v, stratum)
    return j.agg((F.sum(F.col("n") * F.col("_y") / F.col("_n")) / F.sum("n")).alias("low"), (F.sum(F.col("n") * (F.col("_n") - F.col("_no")) / F.col("_n")) / F.sum("n")).alias("high"))


def gate(before: DataFrame, after: DataFrame, cls: str) -> DataFrame:
    """(class, before, after, regressed): recall by class before and after; a missing class counts 0."""
    j = before.select(cls, F.col("recall").alias("before")).join(after.select(cls, F.col("recall").alias("after")), cls, "full")
    j = j.select(cls, F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after"))
    return j.withColumn("regressed", F.col("after") < F.col("before"))


def decided(candidates: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """The verdict of each candidate: hard sources are redacted whatever the answer, a ``keep`` becomes ``flag``, no answer means redact."""
    j = candidates.join(answers, key, "left")
    verdict = F.when(F.col("hard"), "redact").when(F.col("answer") == "keep", "flag").when(F.col("answer") == "redact", "redact").otherwise("redact")
    return j.withColumn("verdict", verdict)


def budgeted(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` of each group are to be judged, the others keep the careful verdict; none is dropped."""
    return df.withColumn("judged", F.row_number().over(Window.partitionBy(by).orderBy(*order)) <= n)


def windows(words: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of ``size`` words."""
    step, n = size - overlap, F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int") * step), F.lit(step))
    return F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, size), " "))


def word_split(text: Column) -> Column:
    """Words, joined at ``-`` and ``_``, and every other character that is no blank by itself."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+(?:[-_]\w+)*|\S"), F.lit(0))
