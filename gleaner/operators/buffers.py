"""Sentence buffers, tiers and review of what was replaced."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Lines a sentence unit takes at most.
MAX_LINES = 50

def line_form(line: Column) -> Column:
    """empty, heading, key_value or prose; letters and blanks of any script count."""
    return (
        F.when(line.rlike(r"(?U)^[\s&&[^\f\x0b]]*$"), "empty")
        .when(line.rlike(r"(?U)^\s*(#+\s|=+\s*$|-+\s*$)"), "heading")
        .when(line.rlike(r"(?U)^\s*[\w.-]+\s*[:=]\s*\S"), "key_value")
        .otherwise("prose")
    )


def sentence_units(lines: DataFrame, key: str, order: str, line: str, most: int = MAX_LINES) -> DataFrame:
    """(key, unit, text): prose lines joined up to one that ends a sentence, ``most`` at most; other lines stand alone."""
    w = Window.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("_f", line_form(F.col(line)))
    ends = F.col(line).rlike(r"[.!?]\s*$")
    flush = (F.lag("_f").over(w) != "prose") | (F.col("_f") != "prose") | F.lag(ends).over(w) | F.lag("_f").over(w).isNull()
    d = d.withColumn("_b", F.sum(flush.cast("int")).over(upto))
    at = Window.partitionBy(key, "_b").orderBy(order)
    d = d.withColumn("_k", (F.row_number().over(at) - 1) % most == 0)
    d = d.withColumn("unit", F.sum((F.col("_k") & (F.col("_f") != "empty")).cast("int")).over(upto).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.trim(line).alias("_t")))), lambda x: x["_t"]), " ")
    return d.filter("_f != 'empty'").groupBy(key, "unit").agg(text.alias("text"))


def tiered(df: DataFrame, tiers: list[tuple[str, Column]], by: str, order: Column, n: int) -> DataFrame:
    """``n`` rows of each group, of the first tier first, in ``order`` within a tier."""
    tier = reduce(lambda a, t: a.when(t[1][1], t[0]), enumerate(tiers[1:], 1), F.when(tiers[0][1], 0)).otherwise(len(tiers))
    d = df.withColumn("tier", tier)
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("tier", order))).filter(F.col("_r") <= n).drop("_r")


def not_restored(residual: DataFrame, restored: DataFrame, key: str) -> DataFrame:
    """Residual spans that lie in no restored span of the same text."""
    on = (F.col(f"h.{key}") == F.col(f"r.{key}")) & (F.col("r.start_cp") <= F.col("h.start_cp")) & (F.col("r.end_cp") >= F.col("h.end_cp"))
    return residual.alias("h").join(restored.alias("r"), on, "left_anti")


def shared_components(parts: DataFrame) -> DataFrame:
    """(alias, n): component aliases that stand for more than one original, whatever their case."""
    return parts.groupBy(F.lower("alias").alias("alias")).agg(F.count_distinct("original").alias("n")).filter("n > 1")


def segments(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Leaves that differ, side by side."""
    j = before.select(*key, F.col(value).alias("original")).join(after.select(*key, F.col(value).alias("anonymized")), key)
    return j.filter(~F.col("original").eqNullSafe(F.col("anonymized")))


def cache_misses(texts: DataFrame, cache: DataFrame, text: str, secret: str) -> DataFrame:
    """(key, text) of distinct texts whose keyed digest the cache lacks."""
    d = texts.select(text).filter(F.col(text).isNotNull()).distinct().withColumn("key", F.sha2(F.concat(F.lit(secret), F.col(text)), 256))
    return d.join(cache.select("key"), "key", "left_anti")
