"""Word lists and term lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def words(lines: DataFrame) -> DataFrame:
    """(word) of lines ``value``: first token, flags after ``/`` dropped, comments skipped, two characters at least, small letters."""
    t = F.trim("value")
    token = F.lower(F.substring_index(F.regexp_extract(t, r"(?U)^[\s&&[^\x00-\x7f]]*([^\s]+)", 1), "/", 1))
    return lines.filter(~F.col("value").startswith("#") & (t != "")).select(token.alias("word")).filter(F.length("word") >= 2)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """The distinct words of a file; a first line of digits only is a count, not a word."""
    first = F.monotonically_increasing_id() == 0
    lines = spark.read.text(path).filter(~(first & F.col("value").rlike("^[0-9]+$")))
    return words(lines).distinct()


def terms(lines: DataFrame) -> DataFrame:
    """(term) of lines ``value``: trimmed, blank lines and comments dropped, each once."""
    t = F.trim("value")
    return lines.select(t.alias("term")).filter((F.col("term") != "") & ~F.col("term").startswith("#")).distinct()
