"""Corpus review: units under a plan, deny rules, field joins, dropped members, tallies and the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.operators.extract import spans
from gleaner.operators.literals import contained
from gleaner.operators.replace import anonymized_text


def path_form(pattern: str) -> str:
    """A slash pattern, ``*`` for exactly one segment, as an anchored form."""
    import re

    return "^" + "/".join("[^/]*" if s == "*" else re.escape(s) for s in pattern.split("/")) + "$"


def denied_by(text: Column, rules: list[str]) -> Column:
    """The index of the first rule that matches, else null."""
    return F.coalesce(*(F.when(text.rlike(r), F.lit(i)) for i, r in enumerate(rules)), F.lit(None).cast("int"))


def occurrences(units: DataFrame, values: DataFrame, key: str, text: str) -> DataFrame:
    """(key, value) for every reviewed value a unit contains, inside words too."""
    return contained(units, key, text, values.select("value").filter("value <> ''").distinct()).distinct()


def whole_values(units: DataFrame, replaced: DataFrame, space: str, value: str) -> DataFrame:
    """Units whose whole value is a replaced field value of the same namespace."""
    return units.join(replaced.select(space, value).distinct(), [space, value], "left_semi")


def under(units: DataFrame, members: DataFrame, path: str) -> DataFrame:
    """Units that lie under a dropped member: one of their ancestors, or they themselves, is dropped."""
    steps = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    hit = units.select(path, F.explode(above).alias("_a")).join(members.select(F.col("member").alias("_a")), "_a", "left_semi")
    return units.join(hit.select(path).distinct(), path, "left_semi")


def with_sibling(units: DataFrame, parent: str, key: str, value: str, sibling: str) -> DataFrame:
    """Units with the value of the sibling named ``sibling`` under the same parent."""
    s = units.filter(F.col(key) == sibling).groupBy(parent).agg(F.min(value).alias("sibling_value"))
    return units.join(s, parent, "left")


def zipped(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows paired by ordinal; ``missing`` tells the side that lacks one (a gate wants none)."""
    j = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), on, "full")
    return j.withColumn("missing", F.when(F.col("_l").isNull(), "left").when(F.col("_r").isNull(), "right")).drop("_l", "_r")


def rule_tally(edits: DataFrame, rule: str, n: str) -> DataFrame:
    """Units and characters changed by each rule."""
    return edits.groupBy(rule).agg(F.count("*").alias("units"), F.sum(n).alias("chars"))


def approved(units: DataFrame, classes: list[str]) -> DataFrame:
    """``approved`` where all classes of a proposal are among the approved ones."""
    return units.withColumn("approved", (F.size("classes") > 0) & F.forall("classes", lambda c: c.isin(classes)))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, values): what is in one of two sets only; both empty means equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def manifest(outputs: DataFrame, group: str, n: str) -> DataFrame:
    """K8: the public manifest: counts and sizes only."""
    return outputs.groupBy(group).agg(F.count("*").alias("files"), F.sum(n).alias("bytes"))


def proposed(units: DataFrame, key: str, text: str, approved: list[str], secret: bytes) -> DataFrame:
    """(key, status, classes, applied): the corpus flow in one pass: propose, approve by class, apply.

    ``status`` is ``clean`` (nothing proposed), ``approved`` (every class of its findings is approved; ``applied`` has
    them replaced) or ``open`` (a class is not; nothing is applied, ``applied`` is null, so that no unit goes out in part).
    """
    d = units.select(key, text, spans(text).alias("_f")).withColumn("classes", F.array_sort(F.array_distinct(F.transform("_f", lambda f: f["pattern_name"]))))
    ok = F.forall("classes", lambda c: c.isin(approved))
    status = F.when(F.coalesce(F.size("_f"), F.lit(0)) <= 0, "clean").when(ok, "approved").otherwise("open")
    d = anonymized_text(d.withColumn("status", status), text, "corpus", secret)
    return d.select(key, "status", F.coalesce("classes", F.array().cast("array<string>")).alias("classes"), F.when(F.col("status") != "open", F.col("anonymized")).alias("applied"))


def verified(applied: DataFrame, key: str, classes: list[str]) -> DataFrame:
    """(key, n): approved findings that are still in an applied text; a release wants none."""
    f = applied.filter("applied is not null").select(key, F.explode(spans("applied", classes)).alias("f"))
    return f.groupBy(key).agg(F.count("*").alias("n"))
