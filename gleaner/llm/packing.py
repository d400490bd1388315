"""Problem 8: filling containers of fixed capacity.

Bulk-synchronous best-fit.  Sizes and gaps are whole numbers up to the capacity, so both are
range-sorted by counting: items into classes of equal size, containers into classes of equal
gap.  A sweep over the sizes, largest first, matches each class to its successor among the
gaps (the smallest gap that takes it), as many items at once as there are; conflicts inside a
class are resolved by the items' ranks; the gaps are updated and the sweep goes on.  The plan
grows with the capacity and never with the number of items; ranks are found and looked up by
all tasks.  The outcome is exactly that of best-fit decreasing, one item at a time.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from gleaner.session import cut_lineage

#: Items a bucket in which ranks are found; a size held by any share of all items is spread over buckets.
RANK_ROWS = 200_000


@dataclass
class Bins:
    """``count`` containers numbered from ``first`` with equal contents: for every (size, rank) the container first + i holds the item of that size and rank + i."""

    first: int
    count: int
    slots: list[tuple[int, int]]

    def split(self, n: int) -> Bins:
        """Keep the first ``n``; give back the others."""
        rest = Bins(self.first + n, self.count - n, [(s, r + n) for s, r in self.slots])
        self.count = n
        return rest


def plan(sizes: dict[int, int], capacity: int) -> list[Bins]:
    """Best-fit decreasing over ``sizes`` (size: items), whole classes at a time."""
    gaps: list[int] = []  # sorted gaps that have containers
    at: dict[int, list[Bins]] = {}
    done: list[Bins] = []
    opened = 0

    def put(bins: Bins, gap: int) -> None:
        if not bins.count:
            return
        if not gap:
            done.append(bins)
        elif gap in at:
            at[gap].append(bins)
        else:
            insort(gaps, gap)
            at[gap] = [bins]

    for size in sorted(sizes, reverse=True):
        n, rank = sizes[size], 0
        while rank < n:
            k = bisect_left(gaps, size)
            if k < len(gaps):
                gap = gaps[k]
                bins = at[gap].pop()
                if not at[gap]:
                    del at[gap]
                    gaps.pop(k)
            else:
                gap, bins = capacity, Bins(opened, math.ceil((n - rank) / (capacity // size)), [])
                opened += bins.count
            each = min(gap // size, n - rank)  # best-fit goes on with the container it has begun
            take = min(bins.count, (n - rank) // each)
            if take < bins.count:
                put(bins.split(take), gap)
            bins.slots += [(size, rank + j * take) for j in range(each)]
            rank += each * take
            put(bins, gap - each * size)
    return done + [b for bs in at.values() for b in bs]


def pack(sized: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(key, piece_no, start_token, piece_tokens, container): every item in a container, none above ``capacity``.

    An item above the capacity, and only such, is divided: into full containers and one rest, which
    is packed like any item.  Items of size 0 or null take no room and get a null container, start 0
    and size 0.  Equal sizes are ranked by hash of key and piece; repeated keys are packed each for itself.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    items = sized.select(F.col(key), n.alias("_n")).select(key, "_n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"cast((_n - 1) div {capacity} as int)")))).alias("piece_no"))
    items = items.select(key, "piece_no", (F.col("piece_no").cast("long") * capacity).alias("start_token"), F.least(F.lit(capacity), F.col("_n") - F.col("piece_no") * capacity).cast("int").alias("piece_tokens"))
    items = cut_lineage(items)
    hist = {r.piece_tokens: r["count"] for r in items.filter("piece_tokens > 0").groupBy("piece_tokens").count().collect()}  # at most capacity rows
    buckets = max(1, math.ceil(sum(hist.values()) / RANK_ROWS))
    h = F.xxhash64(F.lit(3), key, "piece_no")
    ranked = items.filter("piece_tokens > 0").withColumn("_h", h).withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int"))
    w = Window.partitionBy("piece_tokens", "_b").orderBy("_h", key, "piece_no")
    ranked = ranked.withColumn("_r", F.row_number().over(w) - 1)
    counts = items.filter("piece_tokens > 0").groupBy("piece_tokens", F.pmod(h, F.lit(buckets)).cast("int").alias("_b")).count()
    before = Window.partitionBy("piece_tokens").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("piece_tokens", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    ranked = ranked.join(offsets, ["piece_tokens", "_b"]).withColumn("_rank", F.col("_o") + F.col("_r"))
    rows = [(s, r, r + b.count, b.first) for b in plan(hist, capacity) for s, r in b.slots]
    table = F.broadcast(sized.sparkSession.createDataFrame(rows, "_s int, _from long, _to long, _bin long"))
    placed = ranked.join(table, (F.col("piece_tokens") == F.col("_s")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    placed = placed.select(key, "piece_no", "start_token", "piece_tokens", (F.col("_bin") + F.col("_rank") - F.col("_from")).alias("container"))
    return placed.union(items.filter("piece_tokens <= 0").select(key, "piece_no", "start_token", F.lit(0).alias("piece_tokens"), F.lit(None).cast("long")))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, share of the containers' room in use."""
    return packed.filter("container is not null").agg(
        F.count_distinct("container").alias("containers"), F.sum("piece_tokens").alias("tokens"),
        (F.sum("piece_tokens") / (F.count_distinct("container") * F.lit(capacity))).alias("fill"),
    )
