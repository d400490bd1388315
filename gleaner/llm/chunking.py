"""Problem 1: splitting oversized items at natural boundaries.

Lexical-cohesion segmentation: at every gap between words the blocks of words before and
after it are compared; valleys of that similarity mark topic boundaries.  Within each size
window the piece ends at the deepest valley at which the text pauses (a sentence or line ends;
if none does there, a word ends), and the next piece starts the stated overlap before that end.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

#: Words in a block.
BLOCK = 16
#: Pauses from this strength on end a sentence, line or paragraph.
SENTENCE = 2

_UNIT = re.compile(r"\s*\S+\s*")
_STOPS, _PAUSES, _JOINTS = frozenset(".!?…。।"), frozenset(",;:"), frozenset(",;:&|/\\)]}>\"'=+-_.")
_TRIM = ".,;:!?()[]{}\"'<>…"


def valley_depths(ids: np.ndarray) -> np.ndarray:
    """For every gap before word k: how deep the similarity of the blocks around it lies below its surroundings."""
    w, n = BLOCK, len(ids)
    if n == 0:
        return np.zeros(0, np.float32)
    pad = np.concatenate([-1 - np.arange(w), ids, -1 - w - np.arange(2 * w)]).astype(np.int64)  # padding matches nothing
    gaps = np.arange(n) + w
    cross, inside = np.zeros(n, np.float32), np.full(len(pad) - w + 1, w, np.float32)
    starts = np.arange(len(inside))
    for d in range(1, 2 * w):
        same = np.zeros(len(pad) + 1, np.int32)
        np.cumsum(pad[:-d] == pad[d:], out=same[1 : len(pad) - d + 1])
        same[len(pad) - d + 1 :] = same[len(pad) - d]
        lo, hi = (gaps - d, gaps) if d <= w else (gaps - w, gaps + w - d)
        cross += same[hi] - same[lo]
        if d < w:
            inside += 2 * (same[starts + w - d] - same[starts])
    sim = cross / np.sqrt(inside[gaps - w] * inside[gaps])
    left, right, reach = sim.copy(), sim.copy(), 1
    while reach < w:
        left[reach:] = np.maximum(left[reach:], left[:-reach].copy())
        right[:-reach] = np.maximum(right[:-reach], right[reach:].copy())
        reach *= 2
    return left + right - 2 * sim


def _strength(unit: str) -> int:
    body = unit.rstrip()
    white = unit[len(body) :]
    if not white:
        return -1
    breaks = white.count("\n") or white.count("\r")
    if breaks:
        return 4 if breaks > 1 else 3
    last = body[-1:] if body[-1:] not in "\"')]»”" else body[-2:-1]
    return 2 if last in _STOPS else 1 if last in _PAUSES else 0


def _hard_cut(text: str, start: int, end: int) -> int:
    """No pause at all: after a joint of the run's second half, else at the limit, never inside a character."""
    for k in range(end, start + (end - start) // 2, -1):
        if text[k - 1] in _JOINTS:
            return k
    k = end
    while k > start + 1 and (unicodedata.combining(text[k]) or text[k] in "‍️" or text[k - 1] == "‍" or text[k - 1 : k + 1] == "\r\n"):
        k -= 1
    return k if k > start + 1 else end


def _spans(text: str, ends: list[int], strength: np.ndarray, depth: np.ndarray, cap: int, overlap: int) -> list[tuple[int, int]]:
    spans, start = [], 0
    while len(text) - start > cap:
        limit, least = start + cap, start + overlap
        cut = None
        for low in (max(start + cap // 2, least), least):
            i, j = bisect_right(ends, low), bisect_right(ends, limit)
            if i < j and (top := strength[i:j].max()) >= 0:
                at = np.flatnonzero(strength[i:j] >= min(top, SENTENCE))
                # the deepest valley; of equally deep ones the stronger pause, then the last
                cut = ends[i + at[np.lexsort((at, strength[i:j][at], depth[i:j][at]))[-1]]]
                break
        if cut is None:
            cut = limit if text[limit - 1].isspace() and text[limit - 1 : limit + 1] != "\r\n" else _hard_cut(text, least, limit)
        spans.append((start, cut))
        start = cut - overlap
    return [*spans, (start, len(text))]


def split_spans(texts: list[str], cap: int, overlap: int) -> list[list[tuple[int, int]]]:
    """[(start, end)] code points of the pieces of each text: see :func:`split_oversized`."""
    if not 0 <= overlap < cap // 2:
        raise ValueError("the overlap must be less than half of the capacity")
    units = [_UNIT.findall(t) for t in texts]
    words = [u.strip().lower().strip(_TRIM) for us in units for u in us]
    ids = pd.factorize(np.asarray(words, dtype=object))[0] if words else np.zeros(0, int)
    strengths = np.fromiter((_strength(u) for us in units for u in us), np.int8, len(words))
    out, k = [], 0
    # words of different texts must not match: one number range a text
    offsets = np.repeat(np.arange(len(units), dtype=np.int64) * (len(words) + 1), [len(us) for us in units])
    depth = valley_depths(ids + offsets)
    for text, us in zip(texts, units):
        n = len(us)
        ends = np.cumsum([len(u) for u in us]).tolist()
        # the gap after unit i is the gap before unit i + 1
        d = np.append(depth[k + 1 : k + n], 0.0) if n else np.zeros(0)
        out.append(_spans(text, ends, strengths[k : k + n], d, cap, overlap))
        k += n
    return out


_RUN = re.compile(r"[^ \t\r\n]+")


def _span_udf(cap: int, overlap: int):
    span = T.ArrayType(T.StructType([T.StructField("start_cp", T.IntegerType()), T.StructField("end_cp", T.IntegerType())]))
    kind = T.StructType([T.StructField("spans", span), T.StructField("longest", T.IntegerType())])

    def spans(texts: pd.Series) -> pd.DataFrame:
        out, longest = pd.Series([None] * len(texts), dtype=object), np.zeros(len(texts), np.int32)
        there = np.flatnonzero(texts.notna())
        for at in range(0, len(there), 500):  # bounds memory
            rows = there[at : at + 500]
            own = [texts.iat[i] for i in rows]
            for i, t, s in zip(rows, own, split_spans(own, cap, overlap)):
                out.iat[i] = [{"start_cp": a, "end_cp": b} for a, b in s]
                longest[i] = max(map(len, _RUN.findall(t)), default=0)
        return pd.DataFrame({"spans": out, "longest": longest})

    return F.pandas_udf(spans, kind)


def piece_spans(df: DataFrame, text: str, cap: int, overlap: int) -> DataFrame:
    """``df`` with ``spans`` (null unless the text is above ``cap`` code points) and ``no_boundary``.

    ``no_boundary``: the splitter met more than ``cap`` consecutive code points without a pause.
    Only oversized texts reach Python; nothing is shuffled.
    """
    d = df.withColumn("_p", _span_udf(cap, overlap)(F.when(F.length(text) > cap, F.col(text))))
    return d.withColumn("spans", F.col("_p.spans")).withColumn("no_boundary", F.coalesce(F.col("_p.longest") > cap, F.lit(False))).drop("_p")


def cut_kinds(pieces: DataFrame, text: str) -> DataFrame:
    """(kind, n): how the pieces of :func:`split_oversized` end inside their texts: at a paragraph, line, sentence, word, or in a run."""
    end = F.col(text)
    kind = (
        F.when(end.rlike(r"(?U)(\n[ \t\r]*){2}\s*$"), "paragraph").when(end.rlike(r"(?U)[\n\r]\s*$"), "line")
        .when(end.rlike(r"(?U)[.!?…。।][\"')\]»”]?\s+$"), "sentence").when(end.rlike(r"(?U)\s$"), "word").otherwise("run")
    )
    return pieces.filter("piece_no < n_pieces - 1").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def split_oversized(df: DataFrame, key: str, text: str, index: str, cap: int, overlap: int) -> DataFrame:
    """(key, index, piece_no, n_pieces, start_cp, end_cp, text): pieces of at most ``cap`` code points.

    Pieces are numbered on from the row's own index (0 where that is null).  Consecutive
    pieces share exactly ``overlap`` code points; together they give back the whole text.  A text
    of at most ``cap``, empty or blank ones too, is its own only piece; a null text gives one row
    with null text.  Repeated rows are split each by itself, with equal results.
    """
    if not 0 <= overlap < cap // 2:
        raise ValueError("the overlap must be less than half of the capacity")
    whole = F.array(F.struct(F.lit(0).alias("start_cp"), F.length(text).alias("end_cp")))
    pieces = piece_spans(df.select(key, index, text), text, cap, overlap).withColumn("spans", F.coalesce("spans", whole)).withColumn("n_pieces", F.size("spans"))
    out = pieces.select(key, F.coalesce(F.col(index), F.lit(0)).alias("_base"), F.col(text).alias("_whole"), "n_pieces", F.posexplode("spans").alias("piece_no", "_s"))
    return out.select(
        key, (F.col("_base") + F.col("piece_no")).alias(index), "piece_no", "n_pieces", "_s.start_cp", "_s.end_cp",
        F.expr("substring(_whole, _s.start_cp + 1, _s.end_cp - _s.start_cp)").alias(text),
    )
