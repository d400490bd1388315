"""Problem 4: the most frequent values of a column, in bounded memory.

Iceberg multi-hash filtering: exact coarse bucket counts under several hashes, values
kept whose every bucket reaches the threshold, survivors counted exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

#: Coarse buckets a hash; memory of the first pass is HASHES * BUCKETS counters a task, whatever the data.
BUCKETS, HASHES = 16_384, 3


def frequent_values(df: DataFrame, column: str, one_in: int) -> DataFrame:
    """(value, n): each exact non-null value of ``column`` that makes up at least one in ``one_in`` rows.

    No value is missed: a value's buckets hold at least its own count.  At most ``one_in``
    buckets of each hash can reach the threshold, so the second pass filters by at most
    HASHES * one_in bucket numbers.  Ties at the threshold are kept; blank strings are
    values; an empty or all-null column gives no rows.
    """
    h = F.xxhash64(F.lit(11), column)
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("value"), *(F.pmod(F.shiftrightunsigned(h, 20 * i), F.lit(BUCKETS)).cast("int").alias(f"b{i}") for i in range(HASHES)))
    counts = (
        values.select(F.posexplode(F.array(*(f"b{i}" for i in range(HASHES)))).alias("hash", "bucket"))
        .groupBy("hash", "bucket").agg(F.count("*").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("hash"))  # BUCKETS rows a hash
    heavy = counts.withColumn("total", total).filter(F.col("n") * one_in >= F.col("total")).collect()  # at most HASHES * one_in rows of four numbers
    if not heavy:
        return df.sparkSession.createDataFrame([], "value string, n long")
    total = heavy[0].total
    keep = reduce(lambda a, b: a & b, (F.col(f"b{i}").isin([r.bucket for r in heavy if r.hash == i]) for i in range(HASHES)))
    return values.filter(keep).groupBy("value").agg(F.count("*").alias("n")).filter(F.col("n") * one_in >= F.lit(total))
