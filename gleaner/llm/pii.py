"""Problem 5: personal information inside free text.

Weak supervision.  Labelers vote on candidate spans: the form (patterns), gazetteers of names
and streets, the words before and after, and the weak annotations.  Expectation-maximisation over
the counts of vote patterns of all rows estimates how reliable each labeler is, and so how likely
each candidate is real; a span classifier is trained on those likelihoods and decides.

Gazetteers and contexts are counted over all annotated rows; only the classifier is trained on a
sample.  The commonest names and streets are broadcast, the rest are joined to the texts they occur in.
"""

from __future__ import annotations

import re
import zlib
from collections import ChainMap, Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from gleaner.session import cut_lineage

from .pii_candidates import CLASSES, PARTICLES, _RUN, _TOKEN, Streets, candidates, fold, folded, lowered, street_key

#: Annotated rows of each table that the classifier is trained on, at most; chosen by hash of their key.
FIT_ROWS = 4_000
#: Hashed features of the classifier, passes over the sample, its step.
DIM, EPOCHS, RATE = 1 << 15, 12, 0.25
#: Most names and streets broadcast, the rest is joined; a name must be annotated so often, and in this share of its occurrences.
NAMES, STREETS, NAME_ROWS, NAME_SHARE = 20_000, 2_000, 2, 0.2
#: A context must occur this often, and at least once in so many candidates, which bounds the contexts by four times that number.
CONTEXT_ROWS, CONTEXTS = 6, 100_000
LABELERS = ("form", "gazetteer", "before", "after", "hint")

# The types of the two tables, and the class each stands for.
TYPES = {
    "email": "email", "phone": "phone", "phone_us": "phone", "phone_intl": "phone", "ssn": "id_number", "eu_id": "id_number", "passport_us": "id_number",
    "drivers_license": "id_number", "street_address": "address", "person": "person", "first_name": "person", "last_name": "person",
}

_SPLIT = re.compile(r"\w+|[^\w\s]")
_DIGITS = re.compile(r"\d+")


@dataclass
class Finder:
    """What was learned: gazetteers, contexts, labelers' reliabilities and the classifier's weights."""

    names: dict[str, str] = field(default_factory=dict)
    streets: list[str] = field(default_factory=list)
    before: dict[tuple, int] = field(default_factory=dict)
    after: dict[tuple, int] = field(default_factory=dict)
    weights: np.ndarray | None = None
    likely: dict[tuple, float] = field(default_factory=dict)
    #: Names and streets that are not broadcast, as (key, entry, kind); null where there are none.
    rest: DataFrame | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_known"} | {"rest": None}

    def joined(self, entries) -> Finder:
        """This finder, with the entries joined to one text."""
        if entries is None or not len(entries):
            return self
        streets = sorted({e["entry"] for e in entries if e["kind"] == "S"})
        own = Finder(ChainMap({e["entry"]: e["kind"] for e in entries if e["kind"] != "S"}, self.names), self.streets + streets)
        own.__dict__["_known"] = Streets(own.streets) if streets else self.known
        return own

    @property
    def known(self) -> Streets:
        if "_known" not in self.__dict__:
            self.__dict__["_known"] = Streets(self.streets)
        return self.__dict__["_known"]

    def candidates(self, text: str, notes) -> list[dict]:
        """The candidates of a text with what the labelers see of them but the learned contexts, in the form of CANDIDATE."""
        f, at = fold(text)
        hints = hint_spans(text, f, at, [(n["kind"], n["value"], n["start"]) for n in notes if n is not None]) if notes is not None and len(notes) else None
        low, out = lowered(f), []
        for a, b, cls, strength in candidates(f, self.names, self.known):
            left = [_DIGITS.sub("0", w) for w in _SPLIT.findall(low[max(0, a - 40) : a])[-3:]]
            right = [_DIGITS.sub("0", w) for w in _SPLIT.findall(low[b : b + 30])[:2]]
            if cls == "person":
                gaz = 1 if strength == 2 or self.names.get(low[a:b]) else 0
            elif cls == "address":
                gaz = 1 if any(s in low[a:b] for s in self.known.in_text(low[a:b])) else 0
            else:
                gaz = 0
            hint = 0
            if hints is not None:
                over = [k for s, e, k in hints if s < b and e > a]
                hint = 1 if cls in over else -1 if over else 0
            end = at[b - 1] + 1
            while end < len(text) and "\u0300" <= text[end] <= "\u036f":
                end += 1
            shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", _DIGITS.sub(lambda m: str(len(m.group())), f[a:b])))[:24] if cls in ("phone", "id_number") else ""
            out.append(dict(zip(_FIELDS, (a, b, at[a], end, cls, strength - 1, gaz, hint, left, right, shape))))
        return out

    def votes(self, c) -> tuple:
        """The labelers' votes on a candidate: -1, 0 or 1, in the order of LABELERS."""
        cls, left, right = c["cls"], list(c["before"]), list(c["after"])
        pre = self.before.get((cls, *left[-2:]), self.before.get((cls, *left[-1:]), 0))
        post = self.after.get((cls, *right[:2]), self.after.get((cls, *right[:1]), 0))
        return c["form"], c["gazetteer"], pre, post, c["hint"]

    def features(self, c, v: tuple) -> list[int]:
        cls, left, right = c["cls"], list(c["before"]), list(c["after"])
        raw = [(cls,), (cls, "s", c["shape"] or v[0]), (cls, "v", *v[:4]), *((cls, k, x) for k, x in enumerate(v[:4])), (cls, "l", *left[-1:]), (cls, "ll", *left[-2:]), (cls, "lll", *left), (cls, "r", *right[:1]), (cls, "rr", *right)]
        return [_hash(x) for x in raw]

    def chosen(self, cands) -> list[tuple[int, int, str]]:
        """(start_cp, end_cp, class) of the personal information among a text's candidates, without overlaps, in order."""
        scored = []
        for c in cands:
            v = self.votes(c)
            score = float(self.weights[self.features(c, v)].sum())
            if score > 0:
                # an address, number or mail is taken before a name inside it; then the likelier, then the longer
                person = c["cls"] == "person"
                scored.append(((person, -v[0] if c["cls"] == "address" else 0, -min(score, 4.0), c["a"] - c["b"], CLASSES.index(c["cls"])), c))
        taken: list = []
        for _, c in sorted(scored, key=lambda x: x[0]):
            if not any(c["a"] < o["b"] and c["b"] > o["a"] for o in taken):
                taken.append(c)
        return sorted((c["start"], c["end"], c["cls"]) for c in taken)

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start_cp, end_cp, class) of the personal information in ``text``."""
        return self.chosen(self.candidates(text, None))


#: A candidate: folded and original offsets, class, the labelers' own votes, words around it, its shape.
_FIELDS = ("a", "b", "start", "end", "cls", "form", "gazetteer", "hint", "before", "after", "shape")
CANDIDATES = "array<struct<a:int,b:int,start:int,end:int,cls:string,form:int,gazetteer:int,hint:int,before:array<string>,after:array<string>,shape:string>>"


def _hash(x: tuple) -> int:
    return zlib.crc32("\x1f".join(map(str, x)).encode()) % DIM


def hint_spans(text: str, f: str, at, notes: list[tuple]) -> list[tuple[int, int, str]]:
    """Weak annotations (type, value, start or None) as spans of folded text; unusable ones are left out."""
    out = []
    for kind, value, start in notes:
        cls, v = TYPES.get(kind or ""), folded(value or "")
        if not cls or len(v) < 2:
            continue
        k = f.find(v)
        while k >= 0:
            anywhere = start is None or start != start
            if anywhere or abs(at[k] - start) <= 3:
                out.append((k, k + len(v), cls))
                if not anywhere:
                    break
            k = f.find(v, k + 1)
    return out


def occurrences(f: str, notes: list[tuple]) -> Counter:
    """{(word or street, kind): times} of one annotated folded text: kind O for any occurrence of a word, F, L or N for a name, S for a street."""
    seen: Counter = Counter()
    for m in _TOKEN.finditer(f):
        if f[m.end() : m.end() + 1] != "@" and f[max(0, m.start() - 1) : m.start()] not in ("@", ".", "_", "-", "+"):
            seen[m.group().lower(), "O"] += 1
    for kind, value, *_ in notes:
        v = folded(value or "")
        if TYPES.get(kind) == "person" and not any(c.isdigit() or c == "@" for c in v):
            ws = [w for w in (m.group().lower() for m in _TOKEN.finditer(v)) if len(w) > 1 and w not in PARTICLES and w not in ("dell", "d")]
            order = "FL" if "," not in v else "LF"
            for i, w in enumerate(ws):
                seen[w, "F" if kind == "first_name" else "L" if kind == "last_name" else (order[0] if i == 0 else order[1] if i == len(ws) - 1 else "N")] += 1
        elif TYPES.get(kind) == "address" and any(c.isdigit() for c in v):
            name = re.split(r",|\bn\.|№", re.sub(r"\b(?:n\.?\s?[º°o]|bis)\b", " ", re.sub(r"^\D{0,12}\d+\s*,\s*(?=\D)|^\d+\s?(?:bis|[a-z])?\b,?\s*", "", re.sub(r"^\s*(?:flat|apt\.?|\S+)\s+\d+,\s*", "", v, flags=re.I), flags=re.I), flags=re.I))[0]
            name = " ".join(re.split(r"\d", name)[0].lower().split()).strip(" .,")
            if len(name) > 5 and "box" not in name and "@" not in name and not name.endswith("haus"):
                seen[name, "S"] += 1
    return seen


def _keys(text: str | None) -> list[str]:
    """What a name or street must be keyed by to occur in the text: its words, and runs of letters in them."""
    low = folded(text or "").lower()
    return sorted({"", *(m.group().lower() for m in _TOKEN.finditer(folded(text or ""))), *_RUN.findall(low)})


def gazetteers(there: DataFrame) -> DataFrame:
    """(key, entry, kind, n) of the names (kind F, L or N) and streets (S) of all annotated rows."""

    def count(batches):
        for pdf in batches:
            total: Counter = Counter()
            for text, notes in zip(pdf["text"], pdf["notes"]):
                total.update(occurrences(folded(text), [(n["kind"], n["value"]) for n in notes if n is not None]))
            yield pd.DataFrame([(w, k, n) for (w, k), n in total.items()], columns=["entry", "of", "n"])

    counted = there.select("text", "notes").mapInPandas(count, "entry string, of string, n long").groupBy("entry")
    times = counted.agg(*(F.sum(F.when(F.col("of") == k, F.col("n")).otherwise(0)).alias(k) for k in "OFLNS"))
    named = F.col("F") + F.col("L") + F.col("N")
    names = times.filter((named >= NAME_ROWS) & (F.col("O") >= NAME_ROWS) & (named >= NAME_SHARE * F.col("O"))).select(
        F.col("entry").alias("key"), "entry", F.when(F.col("F") > 4 * F.col("L"), "F").when(F.col("L") > 4 * F.col("F"), "L").otherwise("N").alias("kind"), named.alias("n"))
    key = F.udf(lambda s: street_key(s), "string")
    streets = times.filter("S >= 2").select(key("entry").alias("key"), "entry", F.lit("S").alias("kind"), F.col("S").alias("n"))
    return cut_lineage(names.unionByName(streets))


def _commonest(entries: DataFrame, most: int) -> tuple[list, DataFrame | None]:
    """The ``most`` commonest entries, and all others or null."""
    rows = entries.orderBy(F.desc("n"), "entry").limit(most + 1).collect()  # bounded by NAMES and STREETS
    if len(rows) <= most:
        return rows, None
    last = rows[most - 1]
    return rows[:most], entries.filter((F.col("n") < last.n) | (F.col("n") == last.n) & (F.col("entry") > last.entry))


def with_rest(texts: DataFrame, rest: DataFrame | None) -> DataFrame:
    """``texts`` with ``entries``: the entries of ``rest`` that may occur in each, or null."""
    if rest is None:
        return texts.withColumn("entries", F.lit(None).cast("array<struct<entry:string,kind:string>>"))
    keys = F.udf(lambda t: _keys(t), "array<string>")
    words = texts.select(F.col("tab").alias("_tab"), F.col("row_key").alias("_row_key"), F.explode(keys("text")).alias("key"))
    held = words.join(rest, "key").groupBy("_tab", "_row_key").agg(F.collect_set(F.struct("entry", "kind")).alias("entries"))
    return texts.join(held, F.expr("tab <=> _tab and row_key <=> _row_key"), "left").select(*texts.columns, "entries")


def with_candidates(texts: DataFrame, finder: Finder) -> DataFrame:
    """(tab, row_key, h, annotated, cands) of every text, ``h`` its digest: its candidates, searched once; null for a null text."""
    bc = texts.sparkSession.sparkContext.broadcast(finder)  # bounded by NAMES and STREETS

    def run(s: pd.Series, notes: pd.Series, entries: pd.Series) -> pd.Series:
        return pd.Series([bc.value.joined(e).candidates(t, n) if t is not None else None for t, n, e in zip(s, notes, entries)], dtype=object)

    searched = texts.select("tab", "row_key", F.md5("text").alias("h"), (F.col("text").isNotNull() & (F.size("notes") > 0)).alias("annotated"), F.pandas_udf(run, CANDIDATES)("text", "notes", "entries").alias("cands"))
    return cut_lineage(searched)


def contexts(searched: DataFrame) -> tuple[dict[tuple, int], dict[tuple, int]]:
    """Votes by the words on each side, over all annotated rows: 1 where most candidates so placed are annotated, -1 where hardly any."""
    c = searched.filter("annotated").select(F.explode("cands").alias("c")).select("c.cls", "c.before", "c.after", (F.col("c.hint") == 1).cast("long").alias("good"))
    last = lambda n: F.slice("before", F.greatest(F.lit(1), F.size("before") - n + 1), n)
    sides = F.array(*(F.struct(F.lit(side).alias("side"), words.alias("words")) for side, words in ((0, last(1)), (0, last(2)), (1, F.slice("after", 1, 1)), (1, F.slice("after", 1, 2)))))
    counted = c.select("cls", "good", F.explode(sides).alias("s")).groupBy("s.side", "cls", "s.words").agg(F.sum("good").alias("good"), F.count("*").alias("n")).filter(F.col("n") >= CONTEXT_ROWS)
    total = c.count()
    out: tuple[dict, dict] = {}, {}
    for r in counted.filter(F.col("n") >= total / CONTEXTS).collect():  # at most 4 x CONTEXTS rows: a candidate counts in four
        out[r.side][r.cls, *r.words] = 1 if r.good >= 0.45 * r.n else -1 if r.good <= 0.05 * r.n else 0
    return out


def expectation_maximisation(counts: dict[tuple, int], rounds: int = 25) -> dict[tuple, float]:
    """{(class, votes): likelihood} from {(class, votes): candidates}: two hidden states a class, labelers independent given the state."""
    out: dict[tuple, float] = {}
    for cls in CLASSES:
        keys = [k for k in counts if k[0] == cls]
        if not keys:
            continue
        v, n = np.array([k[1] for k in keys]) + 1, np.array([counts[k] for k in keys], float)
        start = (v - 1) @ np.array([0.8, 0.8, 1.0, 0.6, 2.5])
        p = 1 / (1 + np.exp(-(start - 0.4)))
        for _ in range(rounds):
            prior = float(np.clip((p * n).sum() / n.sum(), 0.02, 0.98))
            log_odds = np.full(len(keys), np.log(prior / (1 - prior)))
            for j in range(len(LABELERS)):
                for value in range(3):
                    at = v[:, j] == value
                    yes, no = ((p * n)[at].sum() + 0.5) / ((p * n).sum() + 1.5), (((1 - p) * n)[at].sum() + 0.5) / (((1 - p) * n).sum() + 1.5)
                    log_odds[at] += np.log(yes / no)
            p = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        for k, x in zip(keys, p):
            out[k] = float(x)
    return out


def train_classifier(features: list[list[int]], target: np.ndarray) -> np.ndarray:
    """Logistic regression over hashed features towards the likelihoods, by adaptive gradient steps."""
    w, g2 = np.zeros(DIM, np.float32), np.full(DIM, 1e-3, np.float32)
    if not features:
        return w
    x, r = np.array(features), np.random.default_rng(1)
    for _ in range(EPOCHS):
        for ids in np.array_split(r.permutation(len(x)), max(1, len(x) // 64)):
            err = (1 / (1 + np.exp(-np.clip(w[x[ids]].sum(1), -30, 30))) - target[ids])[:, None]
            g = np.zeros(DIM, np.float32)
            np.add.at(g, x[ids].ravel(), np.broadcast_to(err, (len(ids), x.shape[1])).ravel())
            g2 += g * g
            w -= RATE * g / np.sqrt(g2)
    return w


def texts_of(examples: DataFrame, challenge: DataFrame) -> DataFrame:
    """(tab, row_key, text, notes): both tables in one form; ``notes`` are weak annotations or null."""
    e = examples.select(F.lit("training_examples").alias("tab"), F.col("example_id").cast("string").alias("row_key"), "text", F.transform("annotations", lambda a: F.struct(a["entity_type"].alias("kind"), a["value"].alias("value"), a["start_cp"].alias("start"))).alias("notes"))
    c = challenge.select(F.lit("challenge").alias("tab"), F.col("id").alias("row_key"), "text", F.transform("spans", lambda a: F.struct(a["class"].alias("kind"), a["value"].alias("value"), F.lit(None).cast("int").alias("start"))).alias("notes"))
    return e.unionByName(c)


def fit(texts: DataFrame) -> tuple[Finder, DataFrame]:
    """What was learned, and the candidates of all texts (see :func:`with_candidates`).

    Gazetteers and contexts are counted over all annotated rows, vote patterns over all rows; the classifier
    is fitted on at most FIT_ROWS annotated rows of each table.
    """
    annotated = "text is not null and size(notes) > 0"
    entries = gazetteers(texts.filter(annotated))
    names, more_names = _commonest(entries.filter("kind <> 'S'"), NAMES)
    streets, more_streets = _commonest(entries.filter("kind = 'S'"), STREETS)
    finder = Finder({r.entry: r.kind for r in names}, [r.entry for r in streets])
    more = [d for d in (more_names, more_streets) if d is not None]
    finder.rest = more[0].unionByName(more[1]) if len(more) == 2 else more[0] if more else None
    searched = with_candidates(with_rest(texts, finder.rest), finder)
    finder.before, finder.after = contexts(searched)

    def patterns(batches):
        total: Counter = Counter()
        for pdf in batches:
            for cands in pdf["cands"]:
                for c in cands if cands is not None else ():
                    total[c["cls"], finder.votes(c)] += 1
        yield pd.DataFrame([(c, [int(x) for x in v], n) for (c, v), n in total.items()], columns=["cls", "votes", "n"])

    found = searched.select("cands").mapInPandas(patterns, "cls string, votes array<int>, n long").groupBy("cls", "votes").agg(F.sum("n").alias("n"))
    finder.likely = expectation_maximisation({(r.cls, tuple(r.votes)): r.n for r in found.collect()})  # at most classes x 3^labelers rows
    feats, target = [], []
    for tab in ("training_examples", "challenge"):
        rows = searched.filter((F.col("tab") == tab) & F.col("annotated")).orderBy(F.xxhash64(F.lit(4), "row_key"), "row_key").limit(FIT_ROWS).select("cands")
        for r in rows.collect():  # bounded by FIT_ROWS
            for c in r.cands:
                v = finder.votes(c)
                feats.append(finder.features(c, v))
                target.append(finder.likely.get((c["cls"], v), 0.5))
    finder.weights = train_classifier(feats, np.array(target, np.float32))
    return finder, searched


_FOUND = "array<struct<start_cp:int,end_cp:int,pii_class:string>>"


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced by its typed placeholder, everything else as it was."""
    out, end = [], 0
    for a, b, cls in spans:
        out += [text[end:a], f"<{cls.upper()}>"]
        end = b
    return "".join([*out, text[end:]])


def find_personal(searched: DataFrame, finder: Finder) -> DataFrame:
    """(tab, row_key, h, spans): the personal information among the candidates of each text.

    Null and empty texts give no spans.  Whole texts were read.  Repeated rows give equal results.
    """
    bc = searched.sparkSession.sparkContext.broadcast(finder)  # bounded by NAMES, STREETS, CONTEXTS and DIM

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([[{"start_cp": a, "end_cp": b, "pii_class": c} for a, b, c in bc.value.chosen(cands)] if cands is not None else [] for cands in s], dtype=object)

    return searched.select("tab", "row_key", "h", F.pandas_udf(run, _FOUND)("cands").alias("spans"))


def masked(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(tab, row_key, masked): each text with its spans as typed placeholders, everything else as it was; null for a null text."""
    put = F.pandas_udf(lambda t, s: pd.Series([redact(x, [(y["start_cp"], y["end_cp"], y["pii_class"]) for y in (z if z is not None else ())]) if x is not None else None for x, z in zip(t, s)], dtype=object), T.StringType())
    spans = found.select(F.col("tab").alias("_t"), F.col("row_key").alias("_k"), F.col("h").alias("_h"), "spans").dropDuplicates(["_t", "_k", "_h"])
    out = texts.select("tab", "row_key", "text").join(spans, F.expr("tab = _t and row_key <=> _k and md5(text) = _h"), "left")
    return out.select("tab", "row_key", put("text", "spans").alias("masked"))
