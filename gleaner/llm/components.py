"""Problem 6: splits that keep related records together.

Connected components by alternating large-star and small-star over the graph of
records that share a source, or an author or entity of their sources; then the
component identifier is hashed into ranges proportional to the wanted split sizes.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.operators.skew import hot_keys, salted_join
from gleaner.session import cut_lineage

# Author ids (after settling the spelling) that name nobody.
FILLERS = ["", "-", "--", "?", "??", ".", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "unknown", "unk", "not known", "unnamed", "undefined", "anonymous", "anon", "nobody", "no-author", "tbd", "various", "n.n.", "xxx"]

#: Hash ranges are cut on so many buckets, on the best of so many hash lines.
RANGE_BUCKETS, SALTS = 4_096, 16


def settled(c: Column) -> Column:
    """An id without differences of case, outer blanks and ``_`` for ``-``; null where blank."""
    x = F.translate(F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")), "_", "-")
    return F.when(x != "", x)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over ``edges(u, v)`` with u > v."""
    around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    low = cut_lineage(low, fresh=True)
    total = low.agg(F.sum("n")).first()[0] or 0
    hot = hot_keys(low, "u", "n", total)
    side = around.filter("v > u") if large else around
    linked = salted_join(side, low.select("u", "m"), "u", "v", hot).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        linked = linked.union(low.select("u", F.col("m").alias("v")))
    return cut_lineage(linked.filter("u != v").distinct(), fresh=True)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)`` (bigints, any order, loops and repeats allowed).

    The component is its smallest node.  Nulls tie nothing.  An empty input gives no rows.
    Ends when a round changes nothing, after O(log^2) rounds; every round is cut into the
    shared checkpoint folder.
    """
    e = edges.filter("a is not null and b is not null and a != b")
    e = cut_lineage(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    before = mark(e)
    while before[0]:
        e = _star(_star(e, True), False)
        now = mark(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def record_groups(records: DataFrame, links: DataFrame) -> DataFrame:
    """(record_id, group_id): the smallest record_id among all that must share a split.

    ``records(record_id, source_id)``, ``links(source_id, author_id, entity_ref)``; other
    columns are ignored.  Records are tied by their source, or by an author or entity of
    their sources, spelling settled.  Null or filler authors, null entities and sources
    without records tie nothing; a record without source is its own group; a repeated
    record_id comes out as often as it comes in.
    """
    r = records.select("record_id", settled(F.col("source_id")).alias("sid"))
    sources = cut_lineage(r.filter("sid is not null").groupBy("sid").agg(F.min("record_id").alias("rep"), F.count("*").alias("n")))
    ln = links.select(settled(F.col("source_id")).alias("sid"), settled(F.col("author_id")).alias("au"), settled(F.col("entity_ref")).alias("en"))
    ties = ln.filter("sid is not null").select(
        "sid",
        F.explode(F.array(F.when(~F.col("au").isin(FILLERS), F.concat(F.lit("a:"), "au")), F.when(~F.col("en").isin(FILLERS), F.concat(F.lit("e:"), "en")))).alias("tie"),
    )
    ties = cut_lineage(ties.filter("tie is not null").distinct().join(sources.select("sid", "rep"), "sid").select("tie", "rep"))
    hub = ties.groupBy("tie").agg(F.min("rep").alias("b"), F.count("*").alias("n"))
    total = ties.count()
    edges = salted_join(ties, hub.select("tie", "b"), "tie", "rep", hot_keys(hub, "tie", "n", total)).select(F.col("rep").alias("a"), "b")
    comp = connected_components(edges)
    groups = sources.join(comp, sources.rep == comp.node, "left").select("sid", "n", F.coalesce("component", "rep").alias("group_id"))
    groups = cut_lineage(groups)
    n_all = groups.agg(F.sum("n")).first()[0] or 0
    tied = salted_join(r.filter("sid is not null"), groups.select("sid", "group_id"), "sid", "record_id", hot_keys(groups, "sid", "n", n_all))
    return tied.select("record_id", "group_id").union(r.filter("sid is null").select("record_id", F.col("record_id").alias("group_id")))


def group_splits(groups: DataFrame, shares: dict[str, float] | None = None, seed: int = 7) -> DataFrame:
    """(record_id, group_id, split) from ``groups(record_id, group_id)``: whole groups, sizes near ``shares``.

    The group's identifier is hashed; the hash line is cut into one range a split, where the sizes summed in
    RANGE_BUCKETS ranges reach the wanted shares.  A large group can't be cut, so SALTS hash lines are summed at
    once, and the one whose cuts come nearest to the shares is used, with the splits in their best order on it.
    The same group lands in the same split for the same data, shares and seed.  An empty input gives no rows.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    sizes = cut_lineage(groups.groupBy("group_id").agg(F.count("*").alias("n")))
    bucket = lambda salt: F.pmod(F.xxhash64(F.lit(seed), salt, "group_id"), F.lit(RANGE_BUCKETS)).cast("int")
    lines = sizes.select("n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "group_id").groupBy("salt", bucket(F.col("salt")).alias("bucket")).agg(F.sum("n").alias("n"))
    sums: dict[int, list] = {}
    for r in lines.collect():  # at most SALTS x RANGE_BUCKETS rows of three numbers
        sums.setdefault(r.salt, []).append((r.bucket, r.n))
    best = min(((*line_cuts(sorted(own), order, shares), salt, order) for salt, own in sums.items() for order in permutations(shares)), default=(0.0, [], 0, tuple(shares)), key=lambda x: (x[0], x[2], x[3]))
    _, cuts, salt, order = best
    split = F.lit(order[-1])
    for c, s in reversed(list(zip(cuts, order))):
        split = F.when(bucket(F.lit(salt)) < c, s).otherwise(split)
    return groups.select("record_id", "group_id").withColumn("split", split)  # the group's hash is in the row: nothing is joined


def line_cuts(line: list[tuple[int, int]], order: tuple, shares: dict[str, float]) -> tuple[float, list[int]]:
    """(largest error of a split's share, bucket at which each split but the last ends) on a line of (bucket, records)."""
    total, weight = sum(n for _, n in line), sum(shares.values())
    cuts, got, at, want, k = [], [], 0, 0.0, 0
    for s in order[:-1]:
        want += shares[s] / weight * total
        start = at
        while k < len(line) and abs(at + line[k][1] - want) <= abs(at - want):
            at += line[k][1]
            k += 1
        cuts.append(line[k][0] if k < len(line) else RANGE_BUCKETS)
        got.append(at - start)
    got.append(total - at)
    return max((abs(g / total - shares[s] / weight) for g, s in zip(got, order)), default=0.0), cuts


def split_report(splits: DataFrame) -> DataFrame:
    """(split, n_records, n_groups, share): the split sizes really reached."""
    out = splits.groupBy("split").agg(F.count("*").alias("n_records"), F.count_distinct("group_id").alias("n_groups"))
    return out.withColumn("share", F.col("n_records") / F.sum("n_records").over(Window.partitionBy()))  # one row a split
