"""Value-free summaries of findings, and what blocks a release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from gleaner.functions import patterns as P
from gleaner.session import cut_lineage

CATEGORIES = ["contact", "identity", "financial", "network", "authentication", "social", "other"]


def summary(findings: DataFrame, by: list[str]) -> DataFrame:
    """A1: counts by pattern, by category and in total for each group, in one pass of grouping sets."""
    keys = [F.col(c) for c in by]
    sets = [[*keys, F.col("pattern_name")], [*keys, F.col("category")], keys]
    return findings.groupingSets(sets, *keys, "pattern_name", "category").agg(F.count("*").alias("n")).select(*by, "pattern_name", "category", "n")


def fail_on(findings: DataFrame, names: list[str]) -> DataFrame:
    """Findings whose pattern or category is listed; an unknown name is an error."""
    unknown = set(names) - set(P.BY_NAME) - set(CATEGORIES)
    if unknown:
        raise ValueError(f"unknown names: {sorted(unknown)}")
    return findings.filter(F.col("pattern_name").isin(names) | F.col("category").isin(names))


def blockers(findings: DataFrame, order: list[str], names: list[str]) -> DataFrame:
    """(pattern_name, first_seen): the blocking patterns in the order they are first met.

    The texts are searched once; the ordinal of a pattern's first finding is the number of findings up to it,
    one conditional count a pattern, of which there are at most as many as patterns.
    """
    hit = cut_lineage(fail_on(findings, names).select("pattern_name", F.struct(*order, (-F.col("end_cp")).alias("_e"), F.col("pattern_name").alias("_p")).alias("_k")))
    first = hit.groupBy("pattern_name").agg(F.min("_k").alias("_k")).collect()  # one row a pattern
    spark = findings.sparkSession
    if not first:
        return spark.createDataFrame([], "pattern_name string, first_seen long")
    kind = hit.schema["_k"].dataType
    bound = lambda k: F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(k, kind.fields)))
    counts = hit.agg(*(F.count(F.when(F.col("_k") <= bound(r["_k"]), 1)).alias(r.pattern_name) for r in first))
    return counts.select(F.explode(F.map_from_arrays(F.array(*(F.lit(r.pattern_name) for r in first)), F.array(*(F.col(r.pattern_name) for r in first)))).alias("pattern_name", "first_seen"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """A2: partial summaries ``n`` of several runs put together."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"))


def progress(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """``df`` unchanged, and an observation that has ``counts`` once ``df`` has been computed: no pass of its own, counts only."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(k) for k, c in counts.items())), seen
