"""Span extraction: findings of all patterns with offsets, one pass over each text, Arrow batches in and out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions import patterns as P

from .scan import Scanner

SPAN = "struct<pattern_name:string,start_cp:int,end_cp:int,byte_start:int,byte_end:int,matched_text:string>"
SPANS = f"array<{SPAN}>"


def scan_batch(texts: pa.Array, scanner: Scanner) -> pa.Array:
    """The findings of a batch of texts as a list array of SPAN structs; null texts give null."""
    names, starts, ends, bytes_, sizes, values = [], [], [], [], [], []
    offsets, valid = [0], []
    for text in texts.to_pylist():
        valid.append(text is not None)
        if text:
            for name, a, b in scanner.scan(text):
                value = text[a:b]
                names.append(name)
                starts.append(a)
                ends.append(b)
                values.append(value)
                bytes_.append(a if text.isascii() else len(text[:a].encode()))
                sizes.append(len(value) if value.isascii() else len(value.encode()))
        offsets.append(len(names))
    first = np.array(bytes_, np.int32)
    fields = [pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(first), pa.array(first + np.array(sizes, np.int32)), pa.array(values, pa.string())]
    flat = pa.StructArray.from_arrays(fields, ["pattern_name", "start_cp", "end_cp", "byte_start", "byte_end", "matched_text"])
    at = pa.array([o if ok else None for o, ok in zip(offsets, [*valid, True])], pa.int32())
    return pa.ListArray.from_arrays(at, flat)


def spans(text: str | Column, names: list[str] | None = None, private_ipv4: bool = False) -> Column:
    """Every finding of ``names`` (all by default) in a text, as an array; null for a null text."""
    scanner = Scanner(names, private_ipv4)

    def run(texts: pa.Array) -> pa.Array:
        return scan_batch(texts, scanner)

    return F.arrow_udf(run, SPANS)(text)


def spans_of_each(texts: str | Column, names: list[str] | None = None) -> Column:
    """The findings of every text of an array, each by itself: an array of arrays."""
    scanner = Scanner(names)

    def run(lists: pa.Array) -> pa.Array:
        flat = scan_batch(lists.flatten(), scanner)
        sizes = lists.value_lengths().to_pylist()
        offsets = np.concatenate([[0], np.cumsum([n or 0 for n in sizes])])
        at = pa.array([int(o) if n is not None else None for o, n in zip(offsets, [*sizes, 0])], pa.int32())
        return pa.ListArray.from_arrays(at, flat)

    return F.arrow_udf(run, f"array<{SPANS}>")(texts)


def findings(df: DataFrame, key: list[str], text: str, names: list[str] | None = None, private_ipv4: bool = False) -> DataFrame:
    """(key..., pattern_name, confidence, category, start_cp, end_cp, byte_start, byte_end, matched_text): all findings of ``names``.

    The text is read once, whatever the number of patterns, and nothing is shuffled.  Findings of
    different patterns may overlap; null and empty texts have none; whole texts are searched.
    """
    m = lambda field: F.create_map(*(F.lit(x) for p in P.ALL for x in (p.name, getattr(p, field))))
    f = df.select(*key, F.explode(spans(text, names, private_ipv4)).alias("f"))
    return f.select(
        *key, F.col("f.pattern_name").alias("pattern_name"), m("confidence")[F.col("f.pattern_name")].alias("confidence"), m("category")[F.col("f.pattern_name")].alias("category"),
        "f.start_cp", "f.end_cp", "f.byte_start", "f.byte_end", "f.matched_text",
    )
