"""Problem 10: subject areas of documents.

Passages (sentences) become normalised vectors of subject evidence; bisecting k-means over all
of them gives leaves; leaves are labelled by their discriminative terms; a document's subjects
are those with enough weight in its mixture of leaves.

What a term says about a subject is learned from the hand-labelled documents, whose labels hold
for the document and not for each sentence: expectation-maximisation deals every sentence to one of
its document's subjects or to none.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from gleaner.session import cut_lineage

from .language import ABBREVIATION

#: Hand-labelled documents learned from, at most; chosen by hash of their id.
LABELLED = 6_000
#: Leaves of the clustering, passes a level, terms that label a leaf.
LEAVES, PASSES, LEAF_TERMS = 96, 4, 40
#: Share of a document's sentences from which a subject counts; no subject lies between 1/8 and 1/4.
SHARE = 0.1875
#: Prior of a sentence being of no subject; exponent that keeps evidence graded.
NONE, TEMPER = 0.15, 0.7

_LABEL = re.compile(r"^\s*[^\W\d_][\w-]{0,14}(?: \w{1,6})?\s?:\s+(.*)$", re.S)
_STOP = re.compile(r"(?<=[.!?।])[\"'»”)\]]*\s+")
_WORD = re.compile(r"[^\W\d_]{3,}")
_INNER = re.compile(r'"text"\s*:\s*"((?:[^"\\]|\\.)*)"')


def _strings(x) -> list[str]:
    if isinstance(x, dict):
        return [s for k, v in x.items() for s in ([v] if k == "text" and isinstance(v, str) else _strings(v))]
    return [s for v in x for s in _strings(v)] if isinstance(x, list) else []


def sentences(text: str) -> list[str]:
    """The sentences of a document: without headings, field names, speaker marks and the wrapping of traces."""
    blocks, open_ = [], False
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        s = line.strip()
        if not s or s.startswith(("#", "==", "---")):
            open_ = False
        elif s[0] in "{[" and '"' in s:
            try:
                blocks += _strings(json.loads(s))
            except ValueError:
                blocks += [re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else {"n": "\n", "t": "\t"}.get(m[2], m[2]), b) for b in _INNER.findall(s)]
            open_ = False
        elif m := _LABEL.match(s):
            blocks.append(m[1])
            open_ = True
        elif open_:
            blocks[-1] = blocks[-1][:-1] + s if blocks[-1].endswith("-") and s[:1].islower() else blocks[-1] + " " + s
        else:
            blocks.append(s)
            open_ = True
    out = []
    for b in blocks:
        start = 0
        for m in [*_STOP.finditer(b), None]:
            end = m.start() if m else len(b)
            if m and ABBREVIATION.search(b, start, end):
                continue
            if sum(1 for w in b[start:end].split() if "@" not in w and _WORD.search(w)) >= 3:
                out.append(b[start:end])
            start = m.end() if m else end
    return out


def terms(sentence: str) -> list[str]:
    """Words of three letters or more, in small letters without accents."""
    s = unicodedata.normalize("NFKD", sentence.lower()) if not sentence.isascii() else sentence.lower()
    if not s.isascii():
        s = "".join(c for c in s if not unicodedata.combining(c))
    return _WORD.findall(s)


def learn(docs: list[tuple[list[list[str]], set[str] | None]], described: dict[str, str], rounds: int = 12) -> tuple[dict[str, np.ndarray], list[str]]:
    """(log P(term | class) of each term, classes): from labelled documents, unlabelled ones (None) and the subjects' descriptions; the last class is none.

    Sentences of an unlabelled document may be of any subject, and keep to those of the sentences beside them.
    """
    subjects = sorted(described)
    k = len(subjects) + 1
    number: dict[str, int] = {}
    rows, cols, allowed, of_doc = [], [], [], []
    for d, (sents, labels) in enumerate(docs):
        prior = np.full(k, 0.004)
        own = [subjects.index(s) for s in labels if s in described] if labels else list(range(k - 1))
        of_doc += [d if not labels else -1] * len(sents)
        prior[own] = (1 - NONE) / max(1, len(own))
        prior[-1] = NONE
        for ts in sents:
            cols += [number.setdefault(t, len(number)) for t in ts]
            rows += [len(allowed)] * len(ts)
            allowed.append(prior)
    seeds = [(number.setdefault(t, len(number)), i) for i, s in enumerate(subjects) for t in terms(f"{s} {described[s] or ''}")]
    n = len(number)
    r, c, prior = np.array(rows, int), np.array(cols, int), np.array(allowed).reshape(-1, k)
    uniform = np.append(np.full(k - 1, (1 - NONE) / (k - 1)), NONE)
    seen = np.bincount(c, minlength=n) / max(1, len(c))
    base = np.zeros((n, k))
    for t, i in seeds:
        base[t, i] += 0.5
    of_doc = np.array(of_doc, int)
    free = of_doc >= 0
    resp = prior.copy()
    resp[resp < 0.01] = 0
    resp[free] *= 0.02  # says nothing at first
    for step in range(rounds):
        count = base + 0.05 * np.maximum(seen, 1 / max(1, len(c)))[:, None]
        for j in range(k):
            count[:, j] += np.bincount(c, resp[r, j] if len(r) else None, minlength=n)
        if step == 0:
            count[:, -1] = seen + 1e-6
        logp = np.log(count) - np.log(count.sum(0))
        logp *= _sharpness(count)[:, None]
        score = np.zeros((len(prior), k))
        for j in range(k):
            score[:, j] = np.bincount(r, logp[c, j] if len(r) else None, minlength=len(prior))
        score += np.log(prior if step > 3 else np.where(prior < 0.01, 1e-9, prior))
        score -= score.max(1, keepdims=True) if len(score) else 0
        resp = np.exp(score)
        resp /= resp.sum(1, keepdims=True) if len(resp) else 1
        if free.any():
            theme = np.zeros((len(docs), k))
            np.add.at(theme, of_doc[free], resp[free])
            theme /= np.maximum(theme.sum(1, keepdims=True), 1e-9)
            prior[free] = 0.3 * uniform + 0.7 * theme[of_doc[free]]
            resp[free] *= min(1.0, 0.15 * (step + 1)) if step < rounds - 1 else 1
    return {t: logp[i].astype(np.float32) for t, i in number.items()}, subjects


def _sharpness(count: np.ndarray) -> np.ndarray:
    """0 for terms spread evenly over the classes (patterns of speech) to 1 for terms of one class; rare terms count less."""
    share = count / count.sum(0) * count.sum() / count.shape[1] + 0.4
    p = share / share.sum(1, keepdims=True)
    return (1 + (p * np.log(p)).sum(1) / np.log(count.shape[1])) ** 0.75


class Evidence:
    """Sentences as normalised vectors of subject evidence, the last number for none."""

    def __init__(self, table: dict[str, np.ndarray], subjects: list[str]):
        self.subjects, self.number = subjects, {t: i for i, t in enumerate(table)}
        k = len(subjects) + 1
        self.logp = np.array(list(table.values()), np.float32).reshape(-1, k)
        self.prior = np.log(np.append(np.full(k - 1, (1 - NONE) / (k - 1)), NONE)).astype(np.float32)

    def vectors(self, sents: list[list[str]]) -> np.ndarray:
        get = self.number.get
        ids = [[i for t in ts if (i := get(t)) is not None] for ts in sents]
        r = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        c = np.array([i for x in ids for i in x], int)
        score = np.zeros((len(ids), self.logp.shape[1]), np.float32)
        np.add.at(score, r, self.logp[c])
        if not len(score):
            return score
        own = np.exp(score + self.prior - (score + self.prior).max(1, keepdims=True))
        theme = (own / own.sum(1, keepdims=True)).mean(0)  # a document's sentences keep to its subjects
        score = score - score.max(1, keepdims=True) + np.log(0.4 * np.exp(self.prior) + 0.6 * theme)
        p = np.exp(TEMPER * (score - score.max(1, keepdims=True)))
        return p / np.sqrt((p * p).sum(1, keepdims=True))


def evidence(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> Evidence:
    """Learn from at most LABELLED documents of ``labels(doc_id, subject)``; unknown subjects are ignored."""
    described = {r.subject: r.description for r in areas.select("subject", "description").collect() if r.subject}  # the fixed table of subjects
    own = labels.filter(F.col("subject").isin(list(described))).groupBy("doc_id").agg(F.collect_set("subject").alias("s"))
    own = own.orderBy(F.xxhash64(F.lit(2), "doc_id"), "doc_id").limit(LABELLED)
    texts = documents.select("doc_id", "text").filter("text is not null")
    rows = texts.join(F.broadcast(own), "doc_id")  # at most LABELLED rows
    split = F.pandas_udf(lambda s: s.map(lambda t: [" ".join(terms(x)) for x in sentences(t)]), T.ArrayType(T.StringType()))
    docs = [([x.split() for x in r.w], set(r.s)) for r in rows.select(split("text").alias("w"), "s").collect()]  # bounded by LABELLED
    return Evidence(*learn(docs, described))


def analysed(documents: DataFrame, ev: Evidence) -> DataFrame:
    """(doc_id, terms, vectors): for each sentence its known terms by number and its vector; the texts are read here only."""
    kind = T.StructType([T.StructField("terms", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("vectors", T.ArrayType(T.ArrayType(T.FloatType())))])

    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            sents = [terms(s) for s in sentences(t)] if t else []
            out.append(([[i for w in ts if (i := ev.number.get(w)) is not None] for ts in sents], list(ev.vectors(sents)) if sents else []))
        return pd.DataFrame(out, columns=["terms", "vectors"])

    return cut_lineage(documents.select("doc_id", F.pandas_udf(run, kind)("text").alias("_a")).select("doc_id", "_a.*"))


def leaf_centres(read: DataFrame, ev: Evidence) -> np.ndarray:
    """Centres of the leaves of bisecting k-means over the vectors of all sentences of all documents."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    points = read.select(F.explode("vectors").alias("v")).select(F.transform("v", lambda x: F.round(x, 2)).alias("v")).groupBy("v").agg(F.count("*").cast("double").alias("n"))
    points = cut_lineage(points.select(array_to_vector(F.col("v").cast("array<double>")).alias("features"), "n"))
    if points.limit(1).count() == 0:
        return np.zeros((0, len(ev.subjects) + 1), np.float32)
    model = BisectingKMeans(k=LEAVES, maxIter=PASSES, seed=1, distanceMeasure="cosine", weightCol="n").fit(points)
    return np.array(model.clusterCenters(), np.float32)


def with_leaves(read: DataFrame, centres: np.ndarray) -> DataFrame:
    """``read`` with ``leaves``: the leaf of each sentence; a projection over whole batches."""
    k = centres.shape[1]

    def run(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        leaf = (flat @ centres.T).argmax(1).astype(np.int32) if len(flat) else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]), pa.int32()), pa.array(leaf))

    return read.withColumn("leaves", F.arrow_udf(run, "array<int>")("vectors"))


def leaf_labels(read: DataFrame, ev: Evidence) -> dict[int, str | None]:
    """The subject (or none) of each leaf: what its discriminative terms, counted over all documents, say together."""
    words = len(ev.number)

    def count(batches):
        for batch in batches:
            leaves, sents = batch.column(0).combine_chunks() if isinstance(batch.column(0), pa.ChunkedArray) else batch.column(0), batch.column(1)
            flat = sents.flatten()
            leaf = np.repeat(leaves.flatten().to_numpy(zero_copy_only=False).astype(np.int64), flat.value_lengths().to_numpy(zero_copy_only=False))
            ids, n = np.unique(leaf * words + flat.flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((ids // words).astype(np.int32)), pa.array((ids % words).astype(np.int32)), pa.array(n)], ["leaf", "term", "n"])

    counts = cut_lineage(read.select("leaves", "terms").mapInArrow(count, "leaf int, term int, n long").groupBy("leaf", "term").agg(F.sum("n").alias("n")))
    per_term, per_leaf = counts.groupBy("term").agg(F.sum("n").alias("t")), F.broadcast(counts.groupBy("leaf").agg(F.sum("n").alias("l")))  # at most LEAVES rows
    total = counts.agg(F.sum("n")).first()[0] or 1
    lift = F.log(F.col("n") * F.lit(float(total)) / (F.col("t") * F.col("l")))
    best = Window.partitionBy("leaf").orderBy(F.desc("score"), "term")
    top = counts.join(per_term, "term").join(per_leaf, "leaf").withColumn("score", F.col("n") / F.col("l") * lift).filter("score > 0")
    out: dict[int, np.ndarray] = {}
    for r in top.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= LEAF_TERMS).collect():  # at most LEAVES x LEAF_TERMS rows
        out[r.leaf] = out.get(r.leaf, 0) + r.score * ev.logp[r.term]
    names = [*ev.subjects, None]
    return {leaf: names[int(np.argmax(s))] for leaf, s in out.items()}


def document_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, mixture): ``mixture`` maps each subject to its share of the document's sentences.

    Null, empty and blank texts, and texts without sentences, have 0 sentences and an empty mixture.
    Very long texts are read whole; repeated rows get equal mixtures.
    """
    ev = evidence(documents, labels, areas)
    read = analysed(documents, ev)
    centres = leaf_centres(read, ev)
    n = F.size("terms").alias("n_sentences")
    if not len(centres):
        return read.select("doc_id", n, F.expr("cast(map() as map<string,double>)").alias("mixture"))
    read = cut_lineage(with_leaves(read, centres))
    of = leaf_labels(read, ev)
    # one array slot a leaf, so that a leaf's subject is looked up by position
    names = F.array(*(F.lit(of.get(i)).cast("string") for i in range(len(centres))))
    subjects = F.filter(F.transform("leaves", lambda i: F.get(names, i)), lambda x: x.isNotNull())
    share = lambda s: F.size(F.filter("_s", lambda x: x == s)) / F.size("terms")
    return read.withColumn("_s", subjects).select("doc_id", n, F.map_from_entries(F.transform(F.array_distinct("_s"), lambda s: F.struct(s.alias("key"), share(s).alias("value")))).alias("mixture"))


def found_subjects(mixtures: DataFrame) -> DataFrame:
    """(doc_id, subject): subjects with at least SHARE of the document's sentences."""
    return mixtures.select("doc_id", F.explode("mixture").alias("subject", "share")).filter(F.col("share") >= SHARE).select("doc_id", "subject")


def corpus_by_subject(mixtures: DataFrame) -> DataFrame:
    """(subject, n_documents, n_sentences): the corpus summed up by subject."""
    rows = mixtures.select("n_sentences", F.explode("mixture").alias("subject", "share"))
    return rows.groupBy("subject").agg(F.count(F.when(F.col("share") >= SHARE, 1)).alias("n_documents"), F.sum(F.round(F.col("share") * F.col("n_sentences")).cast("long")).alias("n_sentences"))
