"""Joins and ranks that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.session import cut_lineage

#: A key counts as hot from this share of all rows; so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 1 / 500
#: Below so many rows a key never needs splitting.
HOT_ROWS = 200_000
#: Parts into which the rows of a hot key are split.
HOT_PARTS = 64


def hot_keys(counts: DataFrame, key: str, n: str, total: int, min_rows: int = HOT_ROWS) -> DataFrame:
    """Keys of ``counts(key, n)`` with at least HOT_SHARE of ``total`` rows: at most 500 rows, safe to broadcast."""
    return counts.filter(F.col(n) >= max(total * HOT_SHARE, min_rows)).select(key)


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right`` (few rows a key) on ``key``; rows of hot keys are spread by ``spread``.

    ``hot(key)`` holds at most 500 rows (see :func:`hot_keys`).  ``right`` is repeated
    HOT_PARTS times for these keys only.  Null keys match nothing.
    """
    mark = F.broadcast(hot.select(F.col(key), F.lit(True).alias("_hot")))
    lt = left.join(mark, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(HOT_PARTS))).otherwise(0).cast("int")).drop("_hot")
    rt = (
        right.join(mark, key, "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))))
        .drop("_hot")
    )
    return lt.join(rt, [key, "_salt"], how).drop("_salt")


def running(df: DataFrame, order: list[Column], total: Column | None = None) -> DataFrame:
    """``df`` with ``ordinal`` (from 1, in ``order``) and, if ``total`` is given, ``upto`` (its sum over the rows before).

    In two levels: rows are sorted in ranges, a task each, and each range starts from the sums of those before it.
    ``order`` should tell all rows apart; no task holds more than its range.
    """
    d = df.withColumn("_x", total if total is not None else F.lit(0)).repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    d = cut_lineage(d)  # so that a range's number is data
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = d.groupBy("_p").agg(F.count("*").alias("_n"), F.sum("_x").alias("_s"))
    starts = starts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    w = Window.partitionBy("_p").orderBy(*order)
    d = d.join(F.broadcast(starts), "_p").withColumn("ordinal", F.col("_n0") + F.row_number().over(w))
    if total is not None:
        d = d.withColumn("upto", F.col("_s0") + F.coalesce(F.sum("_x").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.drop("_p", "_x", "_n0", "_s0")
