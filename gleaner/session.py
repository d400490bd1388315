"""Session helpers: reading tables, the shared checkpoint folder, cutting lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work that costs much more than a row's move.

    Only an input of fewer partitions (one small or unsplittable file) is dealt anew, by hash of ``key``;
    a large table, read in many splits, is left as it is and not shuffled.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, key) if df.rdd.getNumPartitions() < n else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; a temporary one only in a local session that names none.

    In a local session driver and executors are one process.  On a cluster a missing setting is an error,
    as a machine's own folder is lost with it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gleaner-"))


def cut_lineage(df: DataFrame, fresh: bool = False) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder; survives lost executors.

    A checkpointed plan keeps its size estimate, which a join multiplies; in loops it grows to numbers that
    alone take minutes.  ``fresh`` drops it, and all else but rows and schema, for loops over joins.
    """
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    if not fresh:
        return done
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.toJavaRDD(), done._jdf.schema()), spark)
