"""Problem 9: mixing sources to target weights.

Hierarchical budgeting: weights go down a tree (domain, source, language); what a node can't use is shared
among its siblings before it goes up to the ancestors; every leaf gives a prefix, in tokens, of its documents
in seeded epochs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.session import cut_lineage

#: Bits of the hash by which a leaf's prefix is narrowed at a time, and how often.
BITS, LEVELS = 12, 5
# What kind of writing a source is; sources not listed are a domain each.
DOMAINS = {"conversation": "chat mail ticket transcript", "document": "form note ocr wiki", "machine": "trace"}
_DOMAIN = {s: d for d, ss in DOMAINS.items() for s in ss.split()}


@dataclass
class Node:
    """A weighted node; a leaf holds what it has (``tokens``) and how often it may be used."""

    weight: float
    tokens: float = 0.0
    repeats: int = 1
    children: dict[str, Node] = field(default_factory=dict)

    def capacity(self) -> float:
        return sum(c.capacity() for c in self.children.values()) if self.children else self.tokens * self.repeats


def allocate(node: Node, budget: float, path: tuple = ()) -> dict[tuple, float]:
    """Tokens each leaf must give.  A child's shortage goes to its siblings by weight, and leaves the node only when all are used up."""
    if not node.children:
        return {path: min(budget, node.capacity())}
    left, open_, given = min(budget, node.capacity()), dict(node.children), dict.fromkeys(node.children, 0.0)
    while open_ and left > 1e-9:
        total = sum(c.weight for c in open_.values())
        if total <= 0:
            break
        short = {k for k, c in open_.items() if given[k] + left * c.weight / total >= c.capacity()}
        if not short:
            for k, c in open_.items():
                given[k] += left * c.weight / total
            break
        for k in short:
            left -= open_[k].capacity() - given[k]
            given[k] = open_.pop(k).capacity()
    return {p: b for k, c in node.children.items() for p, b in allocate(c, given[k], (*path, k)).items()}


def settled_source(c: Column) -> Column:
    """A source without differences of case and outer blanks."""
    return F.lower(F.trim(c))


def _root(have: list, goal: dict) -> Node:
    """The tree of domains, sources and languages; a source weighs its target, a domain what its sources weigh, a language what it holds."""
    root = Node(1.0)
    for r in have:
        top = root.children.setdefault(_DOMAIN.get(r.source, r.source), Node(0.0))
        if r.source not in top.children:
            top.weight += goal[r.source].share
            top.children[r.source] = Node(goal[r.source].share)
        top.children[r.source].children[r.lang] = Node(float(r.tokens), float(r.tokens), max(0, goal[r.source].repeats or 0))
    return root


def even_total(root: Node) -> float:
    """The most tokens for which every source can give exactly its share."""
    sources = [c for d in root.children.values() for c in d.children.values()]
    weight = sum(c.weight for c in sources)
    return min((c.capacity() * weight / c.weight for c in sources if c.weight > 0), default=0.0)


def _cuts(docs: DataFrame, rests: dict[tuple, float]) -> dict[tuple, tuple[int, float]]:
    """{(source, lang): (hash below which documents are taken, tokens left over)}: the longest prefix in hash order that fits each rest.

    Each level sums the tokens of BITS bits more of the hash, in the range that the level before cut; so a level
    brings at most leaves x 2^BITS sums to the driver, and documents are never sorted or moved.
    """
    cut = {leaf: [0, rest] for leaf, rest in rests.items() if rest > 0}
    for level in range(LEVELS):
        if not cut:
            break
        low = 64 - BITS * (level + 1)
        rows = docs.sparkSession.createDataFrame([(*leaf, c[0]) for leaf, c in cut.items()], "source string, lang string, _from long")
        here = docs.join(F.broadcast(rows), ["source", "lang"])  # one row a leaf
        if level:
            here = here.filter(F.shiftrightunsigned("_h", low + BITS) == F.shiftrightunsigned("_from", low + BITS))
        sums = here.groupBy("source", "lang", F.shiftrightunsigned("_h", low).alias("_b")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()
        for leaf, c in cut.items():
            own = sorted((r["_b"], r.t) for r in sums if (r.source, r.lang) == leaf)
            for b, t in own:
                if t > c[1]:
                    c[0] = _signed(b << low)
                    break
                c[1] -= t
            else:
                c[0] = _signed((((c[0] & _ALL) >> (low + BITS)) + 1) << (low + BITS)) if level and own else -1
    return {leaf: (c[0], c[1]) for leaf, c in cut.items()}


_ALL = (1 << 64) - 1


def _signed(x: int) -> int:
    """An unsigned number of 64 bits as a long; one beyond the range as the largest."""
    x = min(x, _ALL)
    return x - (1 << 64) if x >> 63 else x


def _below(h: Column, bound: Column) -> Column:
    """Whether a hash is below a bound, both read as unsigned."""
    flip = F.lit(-(1 << 63))
    return h.bitwiseXOR(flip) < bound.bitwiseXOR(flip)


def _fillers(free: DataFrame, lacks: dict[str, float]) -> DataFrame:
    """(source, lang, doc_id) of unused documents that fill what prefixes left over in a source: largest that fits first.

    A lack is smaller than a document, so there are at most so many sizes, counted before any document is chosen.
    """
    spark = free.sparkSession
    rows = spark.createDataFrame([(s, float(x)) for s, x in lacks.items() if x >= 1], "source string, _lack double")
    fit = free.join(F.broadcast(rows), "source").filter("n_tokens <= _lack")
    sizes: dict[str, list] = {}
    for r in fit.groupBy("source", "n_tokens").count().collect():  # at most a document's tokens a source
        sizes.setdefault(r.source, []).append((r.n_tokens, r["count"]))
    wanted = []
    for source, own in sizes.items():
        left = lacks[source]
        for size, n in sorted(own, reverse=True):
            k = min(n, int(left // size))
            if k:
                wanted.append((source, size, k))
                left -= k * size
    plan = spark.createDataFrame(wanted, "source string, n_tokens long, _k long")
    w = Window.partitionBy("source", "n_tokens").orderBy(F.col("_h").bitwiseXOR(F.lit(-(1 << 63))), "doc_id")
    chosen = fit.join(F.broadcast(plan), ["source", "n_tokens"]).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= F.col("_k"))
    return chosen.select("source", "lang", "doc_id")


def mix(sized: DataFrame, targets: DataFrame, total: float | None = None, even: bool = False, seed: int = 17) -> DataFrame:
    """(doc_id, source, lang, n_tokens, times): the documents used, and how often each.

    ``sized(doc_id, source, lang, n_tokens)``, ``targets(source, target_share, max_repeats)``.
    ``total``: tokens wanted; by default all tokens of the documents of target sources.  A source that can't give its
    share of that in ``max_repeats`` uses passes its shortage on: to the sources of its domain, then to other domains.
    ``even`` asks instead for the most tokens of which every source present can give exactly its share.  Sources without target, and null sources, give nothing; a source without tokens can't be
    used, so its share falls to the others and the report shows 0 for it; repeated targets count once.  Languages
    under a source weigh as much as they hold.  Epochs before the last use every document of a leaf; the last uses
    a prefix in hash order; what is left for want of a document that fits is filled with documents of the source
    that do.  Documents of 0 tokens are never used; equal ids are used alike.  An empty input gives no rows.
    """
    from .language import label_language

    spark = sized.sparkSession
    goal = {r.source: r for r in targets.groupBy(settled_source(F.col("source")).alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).collect() if r.source is not None and r.share}
    docs = sized.select("doc_id", settled_source(F.col("source")).alias("source"), F.coalesce(label_language(F.col("lang")), F.lit("other")).alias("lang"), "n_tokens")
    docs = docs.filter(F.col("source").isin(list(goal)) & (F.col("n_tokens") > 0))
    have = docs.groupBy("source", "lang").agg(F.sum("n_tokens").alias("tokens")).collect()  # at most sources x (languages + 1) rows
    if not have:
        return docs.withColumn("times", F.lit(0))
    root = _root(have, goal)
    budgets = {path[1:]: b for path, b in allocate(root, total if total is not None else even_total(root) if even else float(sum(r.tokens for r in have))).items()}
    whole = {(r.source, r.lang): int(budgets[r.source, r.lang] // r.tokens) for r in have}
    most = {s: max(0, g.repeats or 0) for s, g in goal.items()}
    leaves = spark.createDataFrame([(*leaf, n, most[leaf[0]]) for leaf, n in whole.items()], "source string, lang string, _whole int, _most int")
    docs = cut_lineage(docs.join(F.broadcast(leaves), ["source", "lang"]).withColumn("_h", F.xxhash64(F.lit(seed), "_whole", "doc_id")))  # one row a leaf
    rests = {(r.source, r.lang): budgets[r.source, r.lang] - whole[r.source, r.lang] * r.tokens for r in have if whole[r.source, r.lang] < most[r.source]}
    cuts = _cuts(docs, rests)
    bounds = spark.createDataFrame([(*leaf, c) for leaf, (c, _) in cuts.items()], "source string, lang string, _cut long")
    docs = docs.join(F.broadcast(bounds), ["source", "lang"], "left")
    docs = docs.withColumn("_more", F.coalesce(_below(F.col("_h"), F.col("_cut")), F.lit(False)))
    lacks: dict[str, float] = {}
    for (source, _), (_, left) in cuts.items():
        lacks[source] = lacks.get(source, 0.0) + left
    fill = _fillers(docs.filter(~F.col("_more") & (F.col("_whole") < F.col("_most"))), lacks).distinct().withColumn("_fill", F.lit(1))
    docs = docs.join(fill, ["source", "lang", "doc_id"], "left")
    times = F.least("_most", F.col("_whole") + F.col("_more").cast("int") + F.coalesce("_fill", F.lit(0)))
    return docs.withColumn("times", times).filter("times > 0").select("doc_id", "source", "lang", "n_tokens", "times")


def share_report(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, share, most_times): what each source of ``targets`` really gives."""
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.max("times").alias("most_times"))
    t = targets.select(settled_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    out = t.join(got, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_times", F.lit(0)).alias("most_times"))
    return out.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))  # one row a source
