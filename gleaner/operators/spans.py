"""Span algebra: selection, union, containment, numbering and coverage of half-open spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def greedy(df: DataFrame, key: list[str], start: str = "start_cp", end: str = "end_cp", carry: list[str] | None = None) -> DataFrame:
    """Leftmost, then longest spans that overlap none chosen before, per key; a fold in the JVM.

    Spans of no length or with null ends are left out.  Equal spans keep the smallest carried values.
    """
    carry = carry or []
    spans = df.filter(F.col(start) < F.col(end))
    item = F.struct(F.col(start).alias("s"), (-F.col(end)).alias("ne"), *carry)
    got = spans.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    kind = got.schema["xs"].dataType.simpleString()
    empty = F.struct(F.lit(-1).cast("int").alias("last"), F.expr(f"cast(array() as {kind})").alias("out"))
    step = lambda acc, x: F.when(x["s"] >= acc["last"], F.struct((-x["ne"]).cast("int").alias("last"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc)
    chosen = got.select(*key, F.explode(F.aggregate("xs", empty, step)["out"]).alias("x"))
    return chosen.select(*key, F.col("x.s").alias(start), (-F.col("x.ne")).alias(end), *(F.col(f"x.{c}").alias(c) for c in carry))


def islands(df: DataFrame, key: list[str], start: str = "start_cp", end: str = "end_cp", label: str | None = None, touching: bool = False) -> DataFrame:
    """Unions of overlapping spans (also of touching ones, if asked); the longest span, then the first, names the union."""
    w = Window.partitionBy(*key).orderBy(F.col(start), F.col(end).desc(), *([F.col(label)] if label else []))
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(upto)
    new = reach.isNull() | (F.col(start) > reach if touching else F.col(start) >= reach)
    marked = df.filter(F.col(start) < F.col(end)).withColumn("_n", new.cast("int"))
    marked = marked.withColumn("_i", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    named = [F.max_by(F.col(label), F.struct(F.col(end) - F.col(start), -F.col(start), F.lit(0))).alias(label)] if label else []
    return marked.groupBy(*key, "_i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"), *named).drop("_i")


def overlap(a: str, b: str, start: str = "start_cp", end: str = "end_cp") -> Column:
    return (F.col(f"{a}.{start}") < F.col(f"{b}.{end}")) & (F.col(f"{a}.{end}") > F.col(f"{b}.{start}"))


def without_overlap(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Spans of ``left`` that overlap nothing in ``right`` of the same key."""
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in key]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.alias("l").join(right.alias("r"), cond & overlap("l", "r"), "left_anti")


def not_contained(df: DataFrame, key: list[str]) -> DataFrame:
    """Spans that lie in no longer span of the same key."""
    on = F.lit(True)
    for k in key:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    longer = (F.col("r.end_cp") - F.col("r.start_cp")) > (F.col("l.end_cp") - F.col("l.start_cp"))
    inside = (F.col("r.start_cp") <= F.col("l.start_cp")) & (F.col("r.end_cp") >= F.col("l.end_cp"))
    return df.alias("l").join(df.alias("r"), on & longer & inside, "left_anti")


def numbered(df: DataFrame, space: list[str], value: str, order: list[str]) -> DataFrame:
    """(space..., value, number): values numbered from 1 by first occurrence within their space."""
    first = df.groupBy(*space, value).agg(F.min(F.struct(*order)).alias("_f"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(*space).orderBy("_f", value))).drop("_f")


def joined_fragments(df: DataFrame, key: list[str], label: str, text: str) -> DataFrame:
    """Neighbouring spans of one label with nothing but blanks between become one."""
    w = Window.partitionBy(*key).orderBy("start_cp", "end_cp")
    last_end, last_label = F.lag("end_cp").over(w), F.lag(label).over(w)
    gap = F.expr(f"substring({text}, _le + 1, start_cp - _le)")
    d = df.withColumn("_le", last_end).withColumn("_ll", last_label)
    new = F.col("_le").isNull() | (F.col("_ll") != F.col(label)) | (F.col("start_cp") < F.col("_le")) | (F.trim(gap) != "")
    d = d.withColumn("_i", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*key, label, "_i").agg(F.min("start_cp").alias("start_cp"), F.max("end_cp").alias("end_cp"), F.count("*").alias("n")).drop("_i")


def bio_spans(tokens: DataFrame, key: list[str], order: str, tag: str) -> DataFrame:
    """Runs of ``B-X I-X ...`` tags as (key, label, first, last); an ``I-`` without a matching run before it opens one."""
    label, begins = F.regexp_extract(tag, "^[BI]-(.*)$", 1), F.col(tag).startswith("B-")
    w = Window.partitionBy(*key).orderBy(order)
    d = tokens.withColumn("label", label).withColumn("_l", F.lag(F.regexp_extract(tag, "^[BI]-(.*)$", 1)).over(w))
    new = begins | F.col("_l").isNull() | (F.col("_l") != F.col("label"))
    d = d.withColumn("_i", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.filter("label != ''").groupBy(*key, "label", "_i").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("_i")


def best_duplicates(df: DataFrame, key: list[str], rank: list[Column]) -> DataFrame:
    """One row for each key, the best by ``rank``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*rank))).filter("_r = 1").drop("_r")


def coverage(gold: DataFrame, found: DataFrame, key: list[str], unit: list[str]) -> DataFrame:
    """(unit..., length, covered, verdict): how much of each gold span the union of findings covers."""
    union = islands(found, key).select(*key, F.col("start_cp").alias("_s"), F.col("end_cp").alias("_e"))
    g = gold.select(*key, *unit, "start_cp", "end_cp")
    part = F.greatest(F.lit(0), F.least("end_cp", "_e") - F.greatest("start_cp", "_s"))
    out = g.join(union, key, "left").groupBy(*key, *unit, "start_cp", "end_cp").agg(F.coalesce(F.sum(part), F.lit(0)).alias("covered"))
    length = F.col("end_cp") - F.col("start_cp")
    return out.withColumn("length", length).withColumn("verdict", F.when(F.col("covered") >= length, "full").when(F.col("covered") > 0, "partial").otherwise("missed"))


def ranked(df: DataFrame, key: list[str]) -> DataFrame:
    """O1: findings in order: start, then longer first."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*key).orderBy("start_cp", F.desc("end_cp"), "label")))


def byte_offset(text: Column, cp: Column) -> Column:
    """the UTF-8 byte at a code point offset."""
    return F.octet_length(F.substring(text, F.lit(1), cp))
