"""Lines from the words of a recognised page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def lines(words: DataFrame) -> DataFrame:
    """(doc, line, text, top, bottom): words whose boxes overlap vertically are one line, left to right."""
    w = Window.partitionBy("doc").orderBy("y", "x", "text")
    reach = F.max(F.col("y") + F.col("h")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = words.withColumn("_n", (reach.isNull() | (F.col("y") >= reach)).cast("int"))
    d = d.withColumn("line", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word_no", "text"))), lambda s: s["text"]), " ")
    return d.groupBy("doc", "line").agg(text.alias("text"), F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"))
