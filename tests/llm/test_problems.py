"""Each problem's operator against brute force, round trips, and odd rows."""

import random
import unicodedata
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import chunking, components, confusables, heavy, language, mixing, overlap, packing, pii, pii_candidates as pc, subjects

R = random.Random(5)
WORDS = "amber valley ledger harbour minute folder signal copper lantern orchid meadow garden window silver river".split()


@pytest.fixture(autouse=True)
def seeded():
    """Every test has the same numbers, whatever ran before."""
    R.seed(5)


def prose(n):
    return " ".join(R.choice(WORDS) + R.choice(["", "", ",", ".", ".\n"]) for _ in range(n))


# ---------------------------------------------------------------- 1


@pytest.mark.parametrize("text", ["", "short", "x" * 2000, prose(400), "a\r\n" * 500, "é" * 700, " " * 900, prose(60) + "y" * 700 + prose(60)])
def test_pieces_cover_share_and_fit(text):
    spans = chunking.split_spans([text], 300, 40)[0]
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 <= b - a <= 300 for a, b in spans)
    assert all(c == b - 40 for (_, b), (c, _) in zip(spans, spans[1:]))
    whole = text[spans[0][0] : spans[0][1]] + "".join(text[a + 40 : b] for a, b in spans[1:])
    assert whole == text


def test_cuts_lie_at_pauses():
    text = prose(500)
    for (_, b), _ in zip(chunking.split_spans([text], 300, 40)[0], range(10**6)):
        assert b == len(text) or text[b - 1].isspace()


def test_valleys_mark_a_change_of_topic():
    ids = np.array([i % 5 for i in range(60)] + [10 + i % 5 for i in range(60)])
    assert abs(int(chunking.valley_depths(ids).argmax()) - 60) <= 1


def test_the_deepest_valley_wins_among_pauses():
    topic = lambda ws, n: " ".join(" ".join(R.choice(ws) for _ in range(8)) + "." for _ in range(n)) + " "
    first = topic(WORDS[:4], 4)
    text = first + topic(WORDS[8:12], 8)
    cut = chunking.split_spans([text], 320, 10)[0][0][1]
    assert text[cut - 2] == "." and abs(cut - len(first)) <= 60


def test_split_oversized_rows(spark):
    d = spark.createDataFrame([(1, "a" * 700, 3, "x"), (2, None, 1, "x"), (3, "b", None, "x"), (3, "b", None, "x")], "row_id long, _text string, chunk_index int, piece_no string")
    out = chunking.split_oversized(d, "row_id", "_text", "chunk_index", 300, 40).orderBy("row_id", "piece_no").collect()
    assert [(r.row_id, r.chunk_index, r.n_pieces) for r in out] == [(1, 3, 3), (1, 4, 3), (1, 5, 3), (2, 1, 1), (3, 0, 1), (3, 0, 1)]
    assert out[3]._text is None
    assert chunking.split_oversized(d.limit(0), "row_id", "_text", "chunk_index", 300, 40).count() == 0
    with pytest.raises(ValueError):
        chunking.split_oversized(d, "row_id", "_text", "chunk_index", 300, 200)


# ---------------------------------------------------------------- 2


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_word_edits_are_the_plain_ones():
    for _ in range(300):
        a, b = ([R.choice("abcd") for _ in range(R.randint(0, 14))] for _ in range(2))
        want = plain_edits(a, b)
        assert overlap.word_edits(a, b, 20) == want
        assert overlap.word_edits(a, b, 2) == min(want, 3)


def test_overlaps_against_brute_force(spark):
    base = [[R.choice(WORDS) + str(R.randint(0, 3)) for _ in range(R.randint(4, 60))] for _ in range(60)]
    data = []
    for i, ws in enumerate(base):
        data.append((i, "s", " ".join(ws), "train" if i % 2 else "holdout"))
        other = list(ws)
        for _ in range(R.randint(0, len(ws) // 6)):
            k = R.randrange(len(other))
            other[k : k + 1] = R.choice([[], ["neu"], [other[k], "dazu"]])
        data.append((1000 + i, None, R.choice([str.upper, str.title, str])(" ,".join(other)), "selection" if i % 2 else "train"))
    data += [(5000, "s", None, "train"), (5001, "s", "", "holdout"), (5002, "s", "...", "train"), (5003, "s", data[0][2], None), (5004, "s", data[2][2], "train")]
    d = spark.createDataFrame([(*r, "clash") for r in data], "record_id long, source_id string, text string, split string, words string")
    got = {(r.record_a, r.record_b) for r in overlap.overlapping_pairs(d).collect()}
    rows = [(i, (overlap.normalised(t) or "").split(), s) for i, _, t, s in data if overlap.normalised(t)]
    want = set()
    for i, a, s in rows:
        for j, b, t in rows:
            if s == "train" and t in ("selection", "holdout") and plain_edits(a, b) <= overlap.LIMIT * max(len(a), len(b)):
                want.add((min(i, j), max(i, j)))
    assert got == want and want
    rep = overlap.overlap_report(d).collect()
    assert sum(r.n_records for r in rep) == sum(1 for _, _, s in rows if s in ("selection", "holdout"))
    assert overlap.overlapping_pairs(d.limit(0)).count() == 0
    links = {r.record_id: r.n_links for r in overlap.linked_records(d).collect()}
    assert set(links) == {i for i, _, s in rows if s} and sum(1 for n in links.values() if n) > 0


def test_shards_and_blocks_copy_no_texts(spark, tmp_path, monkeypatch):
    base = [[R.choice(WORDS) + str(R.randint(0, 30)) for _ in range(R.randint(30, 60))] for _ in range(600)]
    base += [list(base[i]) for i in range(0, 600, 20)]
    data = []
    for i, ws in enumerate(base):
        data.append((i, "s", " ".join(ws), "holdout" if i % 3 else "train"))
        other = list(ws)
        other[R.randrange(len(other))] = "neu"
        data.append((1000 + i, "s", " ".join(other), "selection" if i % 3 == 0 else "train"))
    spark.createDataFrame(data, "record_id long, source_id string, text string, split string").write.parquet(str(tmp_path / "t"))
    records, bus, store = spark.read.parquet(str(tmp_path / "t")), spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()

    def run():
        """The pairs, and the bytes that finding them shuffled and checkpointed."""
        from gleaner.session import ensure_checkpoint_dir

        ensure_checkpoint_dir(spark)
        folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
        used = lambda: (bus.waitUntilEmpty(30_000), store.executorSummary("driver").totalShuffleWrite() + sum(p.stat().st_size for p in folder.rglob("part-*")))[1]
        before = used()
        pairs = sorted(tuple(r) for r in overlap.overlapping_pairs(records).collect())
        return pairs, used() - before

    pairs, written = run()
    assert len(pairs) >= 600
    monkeypatch.setattr(overlap, "SHARD", 1_500)
    monkeypatch.setattr(overlap, "BLOCK", 10_000)
    again, more = run()
    assert again == pairs and more < 1.5 * written


def test_shards_hold_texts_of_like_length(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SHARD", 100)
    d = spark.createDataFrame([(f"{n}-{i}", "e", n) for n, many in ((3, 5), (10, 9), (20, 16), (90, 1), (400, 1)) for i in range(many)] + [("x", "t", 7), ("3-0", "e", 3)], "class string, side string, n_words int")
    of, n = overlap._shards_by_length(d)
    assert of == {3: (0, 1), 10: (1, 1), 20: (2, 4), 90: (6, 1), 400: (7, 5)} and n == 12
    assert overlap._shards_by_length(d.filter("side = 't'")) == ({}, 0)


def test_there_are_more_passages_than_edits():
    for n in range(1, 4000):
        parts = overlap.passages(["w"] * n)
        assert len(parts) > overlap.most_edits(n) and sum(p.count(" ") + 1 for p in parts) == n


def test_a_square_of_tasks_is_a_join(spark):
    a = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(200)] + [(None, 1)], "k int, v int")
    b = spark.createDataFrame([(i % 4, i) for i in range(100)] + [(None, 2)], "k int, w int")
    hot = spark.createDataFrame([(0,), (2,)], "k int")
    got = overlap.grid_join(a, b, "k", "v", "w", hot)
    assert sorted(map(tuple, got.select("k", "v", "w").collect())) == sorted(map(tuple, a.join(b, "k").select("k", "v", "w").collect()))


# ---------------------------------------------------------------- 3

SENTENCES = {
    "en": ["The {} was left in the back room yesterday.", "Please send the {} before the end of the week.", "Nobody has looked at the {} since Monday."],
    "de": ["Die {} wurde gestern im Hinterzimmer gelassen.", "Bitte schicken Sie die {} vor dem Ende der Woche.", "Seit Montag hat niemand auf die {} geschaut."],
    "fr": ["La {} est restée hier dans la pièce du fond.", "Merci d'envoyer la {} avant la fin de la semaine.", "Personne n'a regardé la {} depuis lundi."],
}


def test_network_on_held_out_text():
    data = [(s.format(R.choice(WORDS)), c) for _ in range(60) for c, ss in SENTENCES.items() for s in ss]
    R.shuffle(data)
    net, langs = language.train_network([t for t, _ in data[:300]], [c if R.random() > 0.05 else "en" for _, c in data[:300]])
    held = data[300:]
    got = language.segment_texts([t for t, _ in held], net, langs)
    assert sum(g[0][2] == c for g, (_, c) in zip(got, held)) >= 0.97 * len(held)
    both = language.segment_texts([SENTENCES["en"][0].format("folder") + " " + SENTENCES["de"][1].format("Mappe")], net, langs)[0]
    assert [s[2] for s in both] == ["en", "de"]
    pieces = [b"", b"a", b"abc" * 25, b"x" * 63, b"y" * 64, b"z" * 61, b"word and " * 40]
    cut = np.frombuffer(b"".join(w for p in pieces for w in language.windows(p)), np.uint8).reshape(-1, language.WINDOW)
    assert np.allclose(net.stream_log_probs(pieces), net.log_probs(cut), atol=1e-4)
    assert language.segment_texts(["", "12 34", "a b"], net, langs) == [[], [], []]


def test_label_spellings(spark):
    said = ["EN", "en-US", "eng", "English", "fr_FR", "German", "", None, "und", "??", "nld"]
    d = spark.createDataFrame([(s,) for s in said], "l string")
    assert [r[0] for r in d.select(language.label_language(F.col("l"))).collect()] == ["en", "en", "en", "en", "fr", "de", None, None, None, None, "nl"]


# ---------------------------------------------------------------- 4


def test_frequent_values_miss_nothing(spark):
    values = ["hot"] * 300 + ["warm"] * 40 + [f"v{i}" for i in range(500)] + [None] * 50 + [""] * 30
    d = spark.createDataFrame([(v,) for v in values], "_text string")
    got = {r.value: r.n for r in heavy.frequent_values(d, "_text", 40).collect()}
    assert got == {"hot": 300, "warm": 40, "": 30}
    assert heavy.frequent_values(d.limit(0), "_text", 40).count() == 0


# ---------------------------------------------------------------- 5


def test_folding_maps_back():
    for text in ["plain", "Ј​ürg﻿en ｆｕｌｌ ﬁne", "José Straße"]:
        f, at = pc.fold(text)
        assert len(f) == len(at) and all(0 <= i < len(text) for i in at)
    assert pc.folded("Јürgen ｆｕｌｌ") == "Jurgen full"


def test_candidates_of_each_class():
    names = {"ann": "F", "lee": "L", "marsh": "L"}
    f = "Ann van Lee, 12 Upper Mill Road, +44 7700 900123, a.lee [at] mail dot example, no. 912-34-5678, logo@2x.png, Marsh, Ann"
    got = {(f[a:b], c) for a, b, c, _ in pc.candidates(f, names, pc.Streets([]))}
    assert {("Ann van Lee", "person"), ("12 Upper Mill Road", "address"), ("+44 7700 900123", "phone"), ("912-34-5678", "id_number"), ("Marsh, Ann", "person")} <= got
    assert not any("png" in v for v, _ in got)


@pytest.mark.parametrize("text", ["Musterstr.12", "C/Mayor, 12", "Musterstraße12", "Calle Mayor 12"])
def test_streets_need_no_blank(text):
    f = pc.folded(text)
    assert (0, len(f), "address", 1) in pc.candidates(f, {}, pc.Streets([]))


def test_estimation_trusts_the_reliable_labeler():
    counts = {("phone", (1, 0, 1, 1, 1)): 500, ("phone", (1, 0, 1, 1, 0)): 80, ("phone", (0, 0, -1, -1, 0)): 300, ("phone", (0, 0, -1, -1, -1)): 100}
    p = pii.expectation_maximisation(counts)
    assert p["phone", (1, 0, 1, 1, 0)] > 0.9 and p["phone", (0, 0, -1, -1, 0)] < 0.1


def test_masking_keeps_the_rest():
    assert pii.redact("call Ann on 123 now", [(5, 8, "person"), (12, 15, "phone")]) == "call <PERSON> on <PHONE> now"
    assert pii.redact("", []) == ""


def _annotated(spark):
    first, last = ["Orvel", "Tamsin", "Quillon", "Brisa", "Yorick"], ["Dunmore", "Ashgrove", "Pelham", "Vantongeren", "Kestrel"]
    rows = []
    for i in range(120):
        name = f"{first[i % 5]} {last[i // 5 % 5]}"
        rows.append(("training_examples", str(i), f"Dear {name}, your order {i} has been sent.", [("person", name, 5)]))
    for i in range(3):
        rows.append(("training_examples", f"r{i}", "Dear Zephyrine Oakhollow, your order has been sent.", [("person", "Zephyrine Oakhollow", 5)]))
        rows.append(("challenge", f"s{i}", f"ship to 1{i} Nethercot Hollow, please", [("street_address", f"1{i} Nethercot Hollow", None)]))
        rows.append(("challenge", f"q{i}", f"ship to 2{i} Overcot Meadowside, please", [("street_address", f"2{i} Overcot Meadowside", None)]))
    return spark.createDataFrame(rows, "tab string, row_key string, text string, notes array<struct<kind:string,value:string,start:int>>")


def test_gazetteers_cover_all_annotated_rows_whatever_the_sample(spark, monkeypatch):
    monkeypatch.setattr(pii, "FIT_ROWS", 20)
    texts = _annotated(spark)
    finder, searched = pii.fit(texts)
    assert {"zephyrine", "oakhollow", "orvel", "kestrel"} <= set(finder.names) and {"nethercot hollow", "overcot meadowside"} <= set(finder.streets)
    # 126 first candidates after "dear": all annotated rows count, not 20
    assert finder.before["person", "dear"] == 1
    found = {r.row_key: [r.text[s.start_cp : s.end_cp] for s in r.spans] for r in pii.find_personal(searched, finder).join(texts.select("row_key", "text"), "row_key").collect()}
    assert all(found[f"r{i}"] == ["Zephyrine Oakhollow"] for i in range(3)) and all(len(found[str(i)]) == 1 for i in range(120))


def test_entries_beyond_the_broadcast_are_joined(spark, monkeypatch):
    texts = _annotated(spark)
    out = lambda finder, searched: {(r.tab, r.row_key): r.masked for r in pii.masked(texts, pii.find_personal(searched, finder)).collect()}
    whole = out(*pii.fit(texts))
    monkeypatch.setattr(pii, "NAMES", 2)
    monkeypatch.setattr(pii, "STREETS", 1)
    finder, searched = pii.fit(texts)
    assert len(finder.names) == 2 and len(finder.streets) == 1 and finder.rest.count() == 11
    assert out(finder, searched) == whole


# ---------------------------------------------------------------- 6


def test_components_against_union_find(spark):
    edges = [(R.randint(0, 80), R.randint(0, 80)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(12)] + [(300, 300), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_groups_and_splits(spark):
    rec = spark.createDataFrame([(1, "A_b", 0), (2, " a-B ", 0), (3, "c", 0), (4, None, 0), (5, "d", 0), (6, "e", 0), (6, "e", 0)], "record_id long, source_id string, group_id int")
    links = spark.createDataFrame([("a-b", "au1", None), ("C", "AU1 ", None), ("d", "n/a", "x"), ("e", "n/a", None), ("d", None, None), ("zz", "au1", "x")], "source_id string, author_id string, entity_ref string")
    got = sorted((r.record_id, r.group_id) for r in components.record_groups(rec, links).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (6, 6)]
    groups = spark.range(20_000).select(F.col("id").alias("record_id"), F.when(F.col("id") < 4000, 0).otherwise(F.col("id") - F.col("id") % 3).cast("long").alias("group_id"))
    split = components.group_splits(groups)
    assert split.groupBy("group_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    sizes = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert sum(sizes.values()) == 20_000 and abs(sizes["train"] - 16_000) < 60 and abs(sizes["test"] - 2_000) < 60
    assert {r.split: round(r.share, 1) for r in components.split_report(split).collect()} == {"train": 0.8, "validation": 0.1, "test": 0.1}
    assert components.group_splits(groups.limit(0)).count() == 0


def test_cuts_on_a_line():
    line = [(0, 40), (5, 10), (9, 10), (12, 40)]
    assert components.line_cuts(line, ("a", "b", "c"), {"a": 0.4, "b": 0.2, "c": 0.4}) == (0.0, [5, 12])
    error, cuts = components.line_cuts(line, ("a", "b"), {"a": 0.9, "b": 0.1})
    assert cuts == [components.RANGE_BUCKETS] and abs(error - 0.1) < 1e-9


# ---------------------------------------------------------------- 7


def test_skeletons():
    same = ["paypal ﬁne", "pаypаl fine", "ｐａｙｐａｌ fine", "pay​pal fine"]
    assert len({confusables.skeleton(s) for s in same}) == 1
    assert confusables.skeleton("é") == confusables.skeleton("é")
    assert len({confusables.skeleton(s) for s in ["Paypal", "paypal", "paypál", "paypal.", "x²", "x2"]}) == 6
    assert confusables.skeleton(None) is None and unicodedata.is_normalized("NFD", confusables.skeleton("ÀÉ"))


def test_look_classes(spark):
    d = spark.createDataFrame([(1, "abc", None), (2, "\u0430bc", None), (3, "abc", None), (4, None, None), (5, "x", None)], "example_id long, text string, annotations array<struct<value:string,start_cp:int,end_cp:int>>")
    assert sorted(map(tuple, confusables.look_classes(d).collect())) == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (5, 5, 1)]


def test_look_alikes(spark):
    note = "array<struct<entity_type:string,value:string,start_cp:int,end_cp:int,category:string>>"
    rows = [(1, "abc", None), (2, "аbc", []), (3, "abc", [("p", "аb", 0, 2, "c"), ("p", "ab", 0, 2, "c"), (None, None, None, None, None)]), (4, None, None), (5, "", None), (6, "ABC", None)]
    d = spark.createDataFrame([(*r, 0) for r in rows], f"example_id long, text string, annotations {note}, t1 int")
    got = sorted(tuple(r) for r in confusables.look_alikes(d).collect())
    assert got == [(1, 2, -1), (2, 3, -1), (3, 3, 0)]
    assert confusables.look_alikes(d.limit(0)).count() == 0


# ---------------------------------------------------------------- 8


def best_fit_decreasing(sizes, cap):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(cap - s)
    return len(gaps)


def test_plan_is_best_fit_decreasing():
    for cap in (10, 37, 100):
        for _ in range(40):
            sizes = [R.randint(1, cap) for _ in range(R.randint(1, 120))]
            hist = {s: sizes.count(s) for s in set(sizes)}
            bins = packing.plan(hist, cap)
            assert sum(b.count for b in bins) == best_fit_decreasing(sizes, cap)
            assert all(sum(s for s, _ in b.slots) <= cap for b in bins)
            assert {s: sum(b.count for b in bins for t, _ in b.slots if t == s) for s in hist} == hist


def test_packing_rows(spark):
    sizes = [R.choice([3, 3, 3, R.randint(1, 250)]) for _ in range(400)] + [0, None]
    d = spark.createDataFrame([(i, s, 9) for i, s in enumerate(sizes)], "doc_id long, n_tokens long, container int")
    out = packing.pack(d, 100).collect()
    fill = {}
    for r in out:
        if r.container is not None:
            fill[r.container] = fill.get(r.container, 0) + r.piece_tokens
    assert max(fill.values()) <= 100 and sum(fill.values()) == sum(s or 0 for s in sizes)
    pieces = {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append((r.start_token, r.piece_tokens))
    for i, s in enumerate(sizes):
        ps = sorted(pieces[i])
        assert len(ps) == (1 if not s or s <= 100 else -(-s // 100)) and sum(n for _, n in ps) == (s or 0)
    assert len(fill) <= sum(s or 0 for s in sizes) / 100 * 1.05 + 1
    assert packing.pack(d.limit(0), 100).count() == 0


# ---------------------------------------------------------------- 9


def test_budget_goes_to_siblings_first():
    n = mixing.Node
    tree = n(1, children={"a": n(0.5, children={"x": n(1, 10), "y": n(1, 1000)}), "b": n(0.5, children={"z": n(1, 1000)})})
    assert mixing.allocate(tree, 200) == {("a", "x"): 10, ("a", "y"): 90, ("b", "z"): 100}
    tree.children["a"].children["y"].tokens = 20
    assert mixing.allocate(tree, 200) == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 170}


def test_mix_reaches_its_shares(spark):
    rows = [(i, R.choice(["Mail ", "mail", "chat", "wiki", None, "other"]), R.choice(["en", "de", None]), R.choice([0, *range(5, 40)])) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens long")
    t = spark.createDataFrame([("mail", 0.5, 2), ("chat", 0.3, 3), ("wiki", 0.2, 4), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    out = mixing.mix(d, t, even=True)
    rep = {r.source: r for r in mixing.share_report(out, t).collect()}
    for r in (rep["mail"], rep["chat"], rep["wiki"]):
        assert abs(r.share - r.target_share) < 0.005
    assert rep["mail"].most_times <= 2 and rep["chat"].most_times <= 3
    assert mixing.mix(d.limit(0), t).count() == 0
    assert out.filter("times < 1").count() == 0 and 0 < out.count() < 3000


def test_lacks_stay_in_their_domain(spark):
    rows = [(i, s, "en", 10) for i, s in enumerate(["mail"] * 10 + ["chat"] * 500 + ["wiki"] * 500)]
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens long")
    t = spark.createDataFrame([("mail", 0.25, 1), ("chat", 0.25, 1), ("wiki", 0.5, 1)], "source string, target_share double, max_repeats int")
    rep = {r.source: r.tokens for r in mixing.share_report(mixing.mix(d, t, total=2000), t).collect()}
    assert rep == {"mail": 100, "chat": 900, "wiki": 1000}
    assert mixing.mix(d, t).agg(F.sum("n_tokens")).first()[0] == 10_100


def test_prefixes_fill_what_is_left(spark):
    rows = [(i, "mail", "en", n) for i, n in enumerate([997, 400, 400, 150, 40, 7, 7])]
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens long")
    t = spark.createDataFrame([("mail", 1.0, 1)], "source string, target_share double, max_repeats int")
    used = {r.doc_id: r.n_tokens for r in mixing.mix(d, t, total=954).collect()}
    left = 954 - sum(used.values())
    assert 0 <= left and all(n > left for i, n in enumerate([997, 400, 400, 150, 40, 7, 7]) if i not in used)


# ---------------------------------------------------------------- 10


def test_sentences_without_wrapping():
    text = 'Ticket #5\nStatus: open\n\nWe fixed the broken build. See no. 5 of the list.\nuser: A chat line with words.\n{"m": [{"text": "One traced\\u00e9 sentence here."}]}\nThe page was meas-\nured by the reader.'
    assert subjects.sentences(text) == ["We fixed the broken build.", "See no. 5 of the list.", "A chat line with words.", "One tracedé sentence here.", "The page was measured by the reader."]
    assert subjects.sentences("") == []


def test_subjects_of_mixed_documents(spark):
    own = {
        "law": ["The court heard the claim", "The judge signed the contract", "An appeal reached the tribunal", "Their lawyer filed the statute"],
        "sport": ["The team won the match", "The coach praised the runner", "A striker scored the goal", "Their league opened the stadium"],
        "none": ["Please see the next passage", "Nothing else was changed here", "More follows later this week", "Kindly answer before the weekend"],
    }
    docs, labels = [], []
    for i in range(160):
        s = [["law"], ["sport"], ["law", "sport"]][i % 3]
        sents = [R.choice(own[x]) for x in s for _ in range(6)] + [R.choice(own["none"])]
        R.shuffle(sents)
        docs.append((i, ". ".join(sents) + ".", 0))
        labels += [(i, x) for x in s] if i < 80 else []
    docs += [(900, None, 0), (901, "", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, mixture int")
    lab = spark.createDataFrame(labels, "doc_id long, subject string")
    areas = spark.createDataFrame([("law", "Courts"), ("sport", "Matches")], "subject string, description string")
    m = subjects.document_subjects(d, lab, areas)
    got = {}
    for r in subjects.found_subjects(m).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    want = {i: {"law"} if i % 3 == 0 else {"sport"} if i % 3 == 1 else {"law", "sport"} for i in range(160)}
    assert sum(got.get(i) == w for i, w in want.items()) >= 0.95 * len(want)
    assert {r.doc_id for r in m.filter("n_sentences = 0").collect()} == {900, 901}
