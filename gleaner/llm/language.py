"""Problem 3: missing or wrong document language labels.

A byte convolutional network (byte embedding, filters of several widths, max pooling,
softmax) is trained in numpy on labelled text and applied to batched windows of fixed length.
Sentences get the mean of their windows; neighbouring sentences of one language make a segment.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .confusables import skeleton

#: Labelled rows the network is trained on, at most; chosen by hash of their id.
TRAIN_ROWS = 4_000
#: Bytes a window, distance of windows, bytes' embedding, filter widths, filters a width.
WINDOW, STRIDE, DIM, WIDTHS, FILTERS = 64, 40, 12, (2, 3, 4, 5), 24
#: Bytes that go through the filters at a time, about.
STREAM = 4_096
#: A further language needs a sentence of so many words, so much confidence, and so many times that of the text's main language.
SENTENCE_WORDS, CONFIDENT, MARGIN = 4, 0.75, 5

# Codes and names by which labels name a language.
LABELS = {
    "en": "en eng english anglais englisch", "de": "de deu ger german deutsch allemand", "fr": "fr fra fre french français francais französisch",
    "es": "es spa spanish español espanol castellano", "it": "it ita italian italiano", "nl": "nl nld dut dutch nederlands", "pt": "pt por portuguese português portugues",
    "ru": "ru rus russian русский", "hi": "hi hin hindi हिन्दी हिंदी",
}
LANGUAGES = list(LABELS)
_CODES = {name: code for code, names in LABELS.items() for name in names.split()}

_BREAK = re.compile(r"[\r\n]+\s*|(?<=[.!?।…])[\"'»”)\]]*\s+(?:[—–>*•-]\s+)?")
# Abbreviations whose point ends no sentence; a single letter is an initial.
ABBREVIATION = re.compile(r"(?:^|[\s(])(?:[^\W\d_]|no|nr|ref|réf|rif|az|st|soc|sec|esq|tel|str|dr|mr|mrs|ms|bzw|ca|av)\.$", re.I)
_NOISE = re.compile(r"\S*[@\d]\S*")  # addresses and numbers are of no language
_WORD = re.compile(r"[^\W\d_]{2,}(?:[ऀ-ॿ]*)")
_CASED = re.compile(r"[^\W\d_]")
_MARKS = re.compile("[̀-ͯ]")


def label_language(c: Column) -> Column:
    """The two-letter code a label names in any spelling (``EN``, ``en-US``, ``eng``, ``English``); null if it names none known."""
    first = F.regexp_extract(F.lower(F.trim(c)), r"^([^\s_\-,;/()]+)", 1)
    known = F.create_map(*(F.lit(x) for kv in _CODES.items() for x in kv))
    return F.try_element_at(known, first)


def sentences(text: str) -> list[tuple[int, int]]:
    """[start, end) of the sentences of ``text``: cut at line ends and after stops that no small letter follows."""
    spans, start = [], 0
    all_small = text == text.lower()
    for m in _BREAK.finditer(text):
        nxt = text[m.end() : m.end() + 1]
        if "\n" not in m.group() and "\r" not in m.group() and (not all_small and nxt.islower() or ABBREVIATION.search(text, start, m.start())):
            continue
        if m.start() > start:
            spans.append((start, m.start()))
        start = m.end()
    if start < len(text):
        spans.append((start, len(text)))
    return spans


def plain(text: str) -> bytes:
    """What the network reads: look-alikes settled, small letters, no accents on Latin letters."""
    return " ".join(_NOISE.sub(" ", _MARKS.sub("", skeleton(text)).lower()).split()).encode("utf-8", "replace")


def window_starts(size: int) -> list[int]:
    last = max(0, size - WINDOW)
    return [*range(0, last, STRIDE), last]


def windows(data: bytes) -> list[bytes]:
    return [data[s : s + WINDOW].ljust(WINDOW, b"\0") for s in window_starts(len(data))]


@dataclass
class ByteNetwork:
    """Weights of the network: embedding, one filter bank a width, softmax layer."""

    emb: np.ndarray
    banks: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(classes: int, seed: int = 3) -> ByteNetwork:
        r = np.random.default_rng(seed)
        n = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
        return ByteNetwork(
            n(256, DIM, k=0.5), [n(w * DIM, FILTERS, k=(2 / (w * DIM)) ** 0.5) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            n(FILTERS * len(WIDTHS), classes, k=0.1), np.zeros(classes, np.float32),
        )

    def params(self) -> list[np.ndarray]:
        return [self.emb, *self.banks, *self.bias, self.out, self.out_bias]

    def pooled(self, x: np.ndarray, keep: bool = False):
        e = self.emb[x].reshape(len(x), -1)
        feats, kept = [], []
        for w, bank, b in zip(WIDTHS, self.banks, self.bias):
            cols = np.lib.stride_tricks.as_strided(e, (len(x), WINDOW - w + 1, w * DIM), (e.strides[0], 4 * DIM, 4))
            z = np.ascontiguousarray(cols).reshape(-1, w * DIM) @ bank
            z = z.reshape(len(x), WINDOW - w + 1, FILTERS)
            feats.append(np.maximum(z.max(1) + b, 0))
            if keep:
                kept.append((z.argmax(1), cols))
        return np.concatenate(feats, 1), kept

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(x), 256):
            s = self.pooled(x[at : at + 256])[0] @ self.out + self.out_bias
            s -= s.max(1, keepdims=True)
            out.append(s - np.log(np.exp(s).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.out_bias)), np.float32)

    def stream_log_probs(self, datas: list[bytes]) -> np.ndarray:
        """The log-probabilities of all windows of ``datas`` in order, as :func:`windows` cuts them.

        Each byte goes through the filters once, whatever windows it is in: the pieces are laid in a row with zeros
        between, all widths are one product, and windows are maxima over ranges of positions.
        """
        widest, gap = max(WIDTHS), max(WIDTHS) - 1
        bank = np.zeros((widest * DIM, FILTERS * len(WIDTHS)), np.float32)
        for k, (w, own) in enumerate(zip(WIDTHS, self.banks)):
            bank[: w * DIM, k * FILTERS : (k + 1) * FILTERS] = own
        bias, nothing = np.concatenate(self.bias), np.tile(self.emb[0], widest) @ bank
        out, at = [], 0
        while at < len(datas):
            k, size = at, 0
            while k < len(datas) and size < STREAM:
                size += len(datas[k]) + gap
                k += 1
            part, at = datas[at:k], k
            sizes = [len(d) for d in part]
            bases = np.concatenate([[0], np.cumsum(np.array(sizes[:-1], int) + gap)]).tolist()
            row = np.frombuffer((b"\0" * gap).join(part) + b"\0" * (2 * gap), np.uint8)
            e = self.emb[row]
            z = np.ascontiguousarray(np.lib.stride_tricks.as_strided(e, (len(row) - gap, widest * DIM), (4 * DIM, 4))) @ bank
            cut = [(b + s, min(WINDOW, n - s)) for b, n in zip(bases, sizes) for s in window_starts(n)]
            start, held = np.array([c[0] for c in cut]), np.array([c[1] for c in cut])
            feats = np.empty((len(cut), bank.shape[1]), np.float32)
            for j, w in enumerate(WIDTHS):
                cols = slice(j * FILTERS, (j + 1) * FILTERS)
                ends = start + np.minimum(held, WINDOW - w + 1)
                top = np.maximum.reduceat(z[:, cols], np.stack([start, ends], 1).ravel(), axis=0)[::2]
                short = held < WINDOW - w + 1  # the rest of the window is padding
                top[short] = np.maximum(top[short], nothing[cols])
                top[held == 0] = nothing[cols]
                feats[:, cols] = top
            q = np.maximum(feats + bias, 0) @ self.out + self.out_bias
            q -= q.max(1, keepdims=True)
            out.append(q - np.log(np.exp(q).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.out_bias)), np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        h, kept = self.pooled(x, True)
        s = h @ self.out + self.out_bias
        s = np.exp(s - s.max(1, keepdims=True))
        d = s / s.sum(1, keepdims=True)
        d[np.arange(len(x)), y] -= 1
        d *= (weight / len(x))[:, None]
        dh = (d @ self.out.T) * (h > 0)
        demb, dbanks, dbias = np.zeros_like(self.emb), [], []
        rows = np.arange(len(x))[:, None]
        for k, (w, bank) in enumerate(zip(WIDTHS, self.banks)):
            at, cols = kept[k]
            g = dh[:, k * FILTERS : (k + 1) * FILTERS]
            top = cols[rows, at]  # (n, FILTERS, w * DIM): what each filter's maximum saw
            dbanks.append(np.einsum("nf,nfi->if", g, top))
            dbias.append(g.sum(0))
            back = (g[:, :, None] * bank.T[None]).reshape(-1, DIM)
            np.add.at(demb, x[rows[:, :, None], at[:, :, None] + np.arange(w)].ravel(), back)
        return [demb, *dbanks, *dbias, h.T @ d, d.sum(0)]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int = 5, rate: float = 4e-3) -> None:
        r = np.random.default_rng(seed)
        share = np.bincount(y, minlength=len(self.out_bias)) / max(1, len(y))
        weight = (1 / np.sqrt(np.maximum(share, 1e-3)))[y].astype(np.float32)
        weight /= weight.mean() if len(weight) else 1
        ps = self.params()
        m, v, t = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps], 0
        for _ in range(epochs):
            for ids in np.array_split(r.permutation(len(x)), max(1, len(x) // 96)):
                t += 1
                for p, g, a, b in zip(ps, self.gradients(x[ids], y[ids], weight[ids]), m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)


def train_network(texts: list[str], labels: list[str]) -> tuple[ByteNetwork, list[str]]:
    """Train on whole texts with noisy labels: once on all, then on windows whose sentence the first round doesn't contradict."""
    langs = [c for c in LANGUAGES if c in set(labels)] or ["en"]
    xs, ys, groups = [], [], []
    for text, label in zip(texts, labels):
        for a, b in sentences(text):
            if len(_WORD.findall(text[a:b])) >= 3:
                ws = windows(plain(text[a:b]))
                xs += ws
                ys += [langs.index(label)] * len(ws)
                groups += [len(groups)] * len(ws)
    x = np.frombuffer(b"".join(xs), np.uint8).reshape(-1, WINDOW)
    y, net = np.array(ys, int), ByteNetwork.fresh(len(langs))
    epochs = int(np.clip(60_000 / max(1, len(x)), 2, 12))
    net.train(x, y, epochs)
    lp = net.log_probs(x)
    said = lp.argmax(1)
    sure = lp.max(1) > np.log(0.8)
    y2 = np.where(sure, said, y)  # a confident network outvotes a label
    good = sure | (said == y)
    net.train(x[good], y2[good], max(1, epochs // 2), seed=6, rate=2e-3)
    return net, langs


def fit(examples: DataFrame, text: str = "text", label: str = "language", key: str = "example_id") -> tuple[ByteNetwork, list[str]]:
    """Train on at most TRAIN_ROWS rows whose label names a language, chosen by hash of ``key``."""
    rows = examples.select(key, F.col(text).alias("t"), label_language(F.col(label)).alias("l")).filter("t is not null and l is not null")
    rows = rows.orderBy(F.xxhash64(F.lit(9), key), key).limit(TRAIN_ROWS).collect()  # bounded by TRAIN_ROWS
    return train_network([r.t for r in rows], [r.l for r in rows])


_SEGMENT = T.ArrayType(T.StructType([T.StructField("start_cp", T.IntegerType()), T.StructField("end_cp", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())]))


def segment_texts(texts: list[str], net: ByteNetwork, langs: list[str]) -> list[list[tuple]]:
    """The language segments of each text: see :func:`language_segments`."""
    spans = [[(a, b, len(_WORD.findall(t[a:b]))) for a, b in sentences(t)] for t in texts]
    datas, sizes = [], []
    for t, ss in zip(texts, spans):
        for a, b, n in ss:
            if n:
                datas.append(plain(t[a:b]))
            sizes.append(len(window_starts(len(datas[-1]))) if n else 0)
    lp = net.stream_log_probs(datas)
    ends = np.cumsum(sizes)
    out, k = [], 0
    for t, ss in zip(texts, spans):
        scored = []
        for a, b, n in ss:
            own = lp[ends[k] - sizes[k] : ends[k]]
            k += 1
            if n:
                total = own.sum(0) * (STRIDE / WINDOW)  # windows overlap
                p = np.exp(total - total.max())
                scored.append((a, b, n, p / p.sum()))
        if sum(n for _, _, n, _ in scored) < 3:
            out.append([])
            continue
        weight = sum(min(n, 20) * p for _, _, n, p in scored)
        main = int(weight.argmax())
        full = {c for _, _, n, p in scored if n >= SENTENCE_WORDS and p[c := int(p.argmax())] >= CONFIDENT and p[c] >= MARGIN * p[main]} | {main}
        rows: list[list] = []
        for a, b, n, p in scored:
            best = max(full, key=lambda c: p[c])
            if n < SENTENCE_WORDS or p[best] < CONFIDENT:  # too little to say: as the sentence before
                best = rows[-1][2] if rows else best if n >= SENTENCE_WORDS else main
            if rows and rows[-1][2] == best:
                rows[-1][1] = b
                rows[-1][3] += n * float(p[best])
                rows[-1][4] += n
            else:
                rows.append([a, b, best, n * float(p[best]), n])
        out.append([(a, b, langs[c], s / n) for a, b, c, s, n in rows])
    return out


def language_segments(examples: DataFrame, net: ByteNetwork, langs: list[str], text: str = "text") -> DataFrame:
    """``examples`` with ``segments``: [(start_cp, end_cp, lang, confidence)] in the order of the text.

    A text in one language has one segment.  Null, empty and blank texts, and texts with fewer than
    three words, have none.  Very long texts are read whole, sentence by sentence.
    """

    def run(ts: pd.Series) -> pd.Series:
        out = pd.Series([[]] * len(ts), dtype=object)
        there = np.flatnonzero(ts.notna())
        for at in range(0, len(there), 200):
            ids = there[at : at + 200]
            for i, rows in zip(ids, segment_texts([ts.iat[i] for i in ids], net, langs)):
                out.iat[i] = [dict(zip(("start_cp", "end_cp", "lang", "confidence"), r)) for r in rows]
        return out

    return examples.withColumn("segments", F.pandas_udf(run, _SEGMENT)(text))


def mislabelled(segmented: DataFrame) -> DataFrame:
    """(example_id, lang): one row per language really in the text, where the label is missing or wrong or the text has several."""
    said = label_language(F.col("language"))
    langs = F.array_distinct(F.transform("segments", lambda s: s["lang"]))
    case = said.isNull() | (F.size(langs) > 1) | (langs[0] != said)
    return segmented.filter(F.size("segments") > 0).filter(case).select("example_id", F.explode(langs).alias("lang"))
