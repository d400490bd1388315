"""Files in: folders of texts and sessions, office documents; files out: all or nothing."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, sha256, bytes, content): files of a folder and its subfolders, each once."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return d.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), "content").dropDuplicates(["path"])


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(session, value): lines of ``*.jsonl`` files, the session named by its file."""
    d = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").text(path)
    return d.select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.jsonl$", 1).alias("session"), "value")


def read_key_map(spark: SparkSession, path: str) -> DataFrame:
    """(original, replacement, pattern_name) of a key file; a wrong version or an ambiguous pair is an error."""
    from gleaner.operators.replace import ambiguous

    d = spark.read.schema("version int, original string, replacement string, pattern_name string").json(path, mode="FAILFAST")
    if d.filter("version is not null").select("version").distinct().count() != 1 or d.filter("version = 1").limit(1).count() != 1:
        raise ValueError("the key file has no header of a known version")
    keys = d.filter("original is not null").select("original", "replacement", "pattern_name")
    if ambiguous(keys).limit(1).count():
        raise ValueError("the key file is ambiguous")
    return keys


def write_key_map(keys: DataFrame, path: str) -> None:
    """K4: the map with its header, into a new folder."""
    header = keys.sparkSession.createDataFrame([(1,)], "version int")
    header.unionByName(keys, allowMissingColumns=True).write.mode("errorifexists").json(path)


def write_lines(df: DataFrame, line: str, order: str, path: str) -> None:
    """K1, K2: lines in their order, published as a whole; an existing folder is left alone."""
    df.orderBy(order).select(F.col(line).alias("value")).write.mode("errorifexists").text(path)


def write_findings(found: DataFrame, path: str) -> None:
    """K3: findings of JSON lines, their path led by the record."""
    out = found.withColumn("path", F.concat(F.lit("record["), F.col("line_no") - 1, F.lit("]."), F.col("path")))
    out.write.mode("errorifexists").json(path)


# Parts of office files that hold text, and the tags of their paragraphs and runs.
_PARTS = [("word/document.xml", "p", "t"), ("xl/sharedStrings.xml", "si", "t"), ("content.xml", "p", None)]


def office_runs(content: bytes) -> list[tuple[str, int, int, str]]:
    """(part, group_no, run_no, text) of an office file; nothing where it is none."""
    out = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            slides = sorted(n for n in names if n.startswith("ppt/slides/slide"))
            for part, group, run in [*_PARTS, *((s, "p", "t") for s in slides)]:
                if part not in names:
                    continue
                root = ElementTree.fromstring(z.read(part))
                tag = lambda e: e.tag.rpartition("}")[2]
                for g, p in enumerate(e for e in root.iter() if tag(e) == group):
                    texts = ["".join(p.itertext())] if run is None else [e.text or "" for e in p.iter() if tag(e) == run]
                    out += [(part, g, k, t) for k, t in enumerate(texts) if t]
    except (zipfile.BadZipFile, ElementTree.ParseError):
        return []
    return out


def read_office(files: DataFrame) -> DataFrame:
    """(path, part, group_no, run_no, text) of ``files(path, content)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *r) for p, c in zip(pdf["path"], pdf["content"]) for r in office_runs(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "part", "group_no", "run_no", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, part string, group_no int, run_no int, text string")
