"""Streams driven to their end over the given tables, as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.session import ensure_checkpoint_dir, read_table
from gleaner.streaming import text as T

from gleaner.functions import patterns as P

from .detect import extraction_sql
from .more_queries import SQL as _MORE
from .replace_queries import _CORPUS, _text_sql

_JSON_SQL = "select event_id, props, props as anonymized from events where props is not null and trim(props) <> ''"
SQL_W7 = _MORE["w7_sentence_units"]
QUERIES: dict = {}
SQL: dict[str, str] = {}
NAMES = [p.name for p in P.ALL]
KEY = b"a key for tests only"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = read_table(spark, sf_dir, table).schema
    reader = spark.readStream.schema(schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf_dir}/{table}.parquet")
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)  # a stream reads folders


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """All that the stream yields until its input is used up, written to the shared folder and read again."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"
    put = lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    got = spark.read.schema(stream.schema.add("batch", "long")).parquet(out)
    if mode == "complete":
        last = got.agg(F.max("batch")).first()[0]
        got = got.filter(F.col("batch") == last)
    return got.drop("batch")


@query(f"select text, pattern_name, matched_text from ({extraction_sql('challenge', NAMES)}) join challenge using (id)")
def t3_detect_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(T.detected(_stream(spark, sf_dir, "challenge"), "text"), "append")


@query(f"select pattern_name, count(*) as n from ({extraction_sql('challenge', NAMES)}) group by 1")
def t3_running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(T.counted(_stream(spark, sf_dir, "challenge"), "text"), "complete")


@query(_text_sql(_CORPUS).replace("select id, coalesce", "select id, text, coalesce"))
def t1_anonymized_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(T.anonymized(_stream(spark, sf_dir, "challenge").select("id", "text"), "text", KEY), "append")


def _mapped(spark: SparkSession) -> None:
    spark.conf.set(*T.STORE)


@query("select session, count(distinct nym_prediction) as numbers, count(distinct nym_prediction) as last from label_sessions where nym_prediction is not null group by 1")
def t1_numbered_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many numbers each session gave out, and the last: as many as distinct values, whatever the order of arrival."""
    _mapped(spark)
    values = _stream(spark, sf_dir, "label_sessions").select("session", F.col("nym_prediction").alias("value"))
    out = _drained(T.numbered(values), "append")
    return out.groupBy("session").agg(F.count_distinct("value", "number").alias("numbers"), F.max("number").cast("long").alias("last"))


@query(_JSON_SQL)
def t2_json_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(T.json_lines(_stream(spark, sf_dir, "events").select("event_id", "props"), "props", KEY), "append")


@query(SQL_W7)
def t4_sentence_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    _mapped(spark)
    t = _stream(spark, sf_dir, "label_sessions").filter("_text is not null")
    lines = t.select("row_id", F.posexplode(F.split(F.regexp_replace("_text", "\r", ""), "\n")).alias("line_no", "line"), F.size(F.split("_text", "\n")).alias("_n"))
    units = T.sentence_units(lines.withColumn("last", F.col("line_no") + 1 == F.col("_n")), "row_id", "line_no", "line", "last")
    return _drained(units, "append").withColumnRenamed("key", "row_id")


@query("select event_type, count(*) as n from events group by 1")
def t5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(_stream(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")), "complete")
