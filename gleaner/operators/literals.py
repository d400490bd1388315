"""Matching of long lists of literal values: all occurrences, or leftmost longest ones, with edge rules."""

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from gleaner.session import cut_lineage

from .spans import greedy

_HIT = T.ArrayType(T.StructType([T.StructField("start_cp", T.IntegerType()), T.StructField("end_cp", T.IntegerType()), T.StructField("literal", T.StringType())]))

#: Literals of one automaton, about; a longer list is searched in shards.
LIST_ROWS = 200_000


def _edge(text: str, i: int, j: int) -> bool:
    """No letter or digit goes on across either edge of text[i:j]; an escaped line end (``\\n``) is an edge."""
    before = text[i - 1] if i else " "
    if before == "n" and i > 1 and text[i - 2] == "\\":
        before = " "
    left = not text[i].isalnum() or not (before.isalnum() or before == "_")
    after = text[j] if j < len(text) else " "
    return left and (not text[j - 1].isalnum() or not (after.isalnum() or after == "_"))


def _low(text: str) -> str:
    """Small letters, character by character, so that offsets stay."""
    return text.lower() if text.isascii() else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


class Matcher:
    """An Aho-Corasick automaton over literals; one a Python worker."""

    def __init__(self, literals: list[tuple[str, bool]], ignore_case: bool = True):
        import ahocorasick

        self.fold = ignore_case
        self.a = ahocorasick.Automaton()
        for w, anywhere in literals:
            if w:
                self.a.add_word(_low(w) if ignore_case else w, (w, anywhere))
        self.empty = not len(self.a)
        if not self.empty:
            self.a.make_automaton()

    def every(self, text: str) -> list[tuple[int, int, str]]:
        """All occurrences, overlapping ones too; literals marked ``anywhere`` need no edges."""
        if self.empty or not text:
            return []
        low = _low(text) if self.fold else text
        out = []
        for end, (w, anywhere) in self.a.iter(low):
            i, j = end + 1 - len(w), end + 1
            if anywhere or _edge(text, i, j):
                out.append((i, j, w))
        return sorted(out)

    def longest(self, text: str) -> list[tuple[int, int, str]]:
        """Leftmost, then longest occurrences, chosen after the edge rule."""
        out, last = [], -1
        for i, j, w in sorted(self.every(text), key=lambda h: (h[0], -h[1])):
            if i >= last:
                out.append((i, j, w))
                last = j
        return out


def _finder(literals, longest: bool, ignore_case: bool):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Matcher(literals.value, ignore_case)
        for s in batches:
            yield pd.Series([[dict(zip(("start_cp", "end_cp", "literal"), h)) for h in (m.longest(t) if longest else m.every(t))] for t in s], dtype=object)

    return F.pandas_udf(run, _HIT)


def _shards(literals: DataFrame) -> list[list[tuple[str, bool]]]:
    """The distinct literals in shards of about LIST_ROWS, by hash; each is held by a worker at a time."""
    d = cut_lineage(literals.filter("literal <> ''").groupBy("literal").agg(F.max("anywhere").alias("anywhere")))
    n = d.count() // LIST_ROWS + 1
    return [[(r.literal, bool(r.anywhere)) for r in d.filter(F.pmod(F.xxhash64("literal"), F.lit(n)) == i).collect()] for i in range(n)]  # about LIST_ROWS each


def contained(units: DataFrame, key: str, text: str, values: DataFrame) -> DataFrame:
    """(key, value): the distinct values a unit contains anywhere, inside words too, in their own case.

    Each shard of the values is an automaton that reads all texts.
    """
    parts = []
    for rows in _shards(values.select(F.col("value").alias("literal"), F.lit(True).alias("anywhere"))):
        find = _finder(units.sparkSession.sparkContext.broadcast(rows), False, False)
        parts.append(units.select(key, F.explode(F.array_distinct(F.transform(find(text), lambda h: h["literal"]))).alias("value")))
    return reduce(DataFrame.union, parts)


def matches(texts: DataFrame, text: str, literals: DataFrame, longest: bool = False, ignore_case: bool = True) -> DataFrame:
    """(text, start_cp, end_cp, literal): occurrences of ``literals(literal, anywhere)`` in the distinct texts.

    A list of any length is searched, in shards of LIST_ROWS; with several, the leftmost and longest are chosen
    over the hits of all.
    """
    distinct = texts.select(text).filter(F.col(text).isNotNull()).distinct()
    shards, parts = _shards(literals), []
    for rows in shards:
        find = _finder(texts.sparkSession.sparkContext.broadcast(rows), longest and len(shards) == 1, ignore_case)
        parts.append(distinct.select(text, F.explode(find(text)).alias("h")).select(text, "h.*"))
    out = reduce(DataFrame.union, parts)
    return greedy(out, [text], carry=["literal"]) if longest and len(shards) > 1 else out
