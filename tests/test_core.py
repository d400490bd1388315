import io
import zipfile

import pytest
from pyspark.sql import functions as F

from gleaner.functions import patterns as P, replacements as R, rulesets
from gleaner.operators import replace as X, spans as S, units as U
from gleaner.operators.extract import findings
from gleaner.operators.literals import Matcher
from gleaner.operators.scan import Scanner
from gleaner.operators.skew import hot_keys, running, salted_join
from gleaner.operators.summary import fail_on
from gleaner.sources import files

from .conftest import rows


def test_there_are_36_patterns():
    assert len(P.ALL) == 36 and len(P.BY_NAME) == 36


def test_findings_slice_back_and_survive_odd_rows(spark):
    texts = ["mail ä@b.example.org and jörg.x@y.example.org", None, "", "x" * 50_000 + " a@b.example.net", "mail a@b.example.net a@b.example.net"]
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, text string, pattern_name string")
    f = findings(d, ["id"], "text", ["email"]).collect()
    assert all(texts[r.id][r.start_cp : r.end_cp] == r.matched_text for r in f)
    assert all(texts[r.id].encode()[r.byte_start : r.byte_end].decode() == r.matched_text for r in f)
    assert sorted(r.id for r in f) == [0, 3, 4, 4]
    assert findings(d.limit(0), ["id"], "text", ["email"]).count() == 0


def test_texts_are_read_once_and_not_moved(spark):
    d = spark.createDataFrame([(1, "a@b.example.net")], "id int, text string")
    plan = findings(d, ["id"], "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_runs_of_any_length_are_read_whole():
    inside = lambda t: [n for n, *_ in Scanner(["ssn_nodash"]).scan(t)]
    assert inside("x-" + "1." * 400 + "-123456789") == []  # a letter 800 characters before
    assert inside("see 123456789 here") == ["ssn_nodash"] and inside("password=ab-12345678-123456789") == ["ssn_nodash"]


def test_addresses_by_number():
    from gleaner.operators.scan import is_local

    assert all(map(is_local, ["10.1.2.3", "127.0.0.1", "172.31.9.9", "192.168.0.7", "100.64.0.1", "169.254.1.1", "203.0.113.9", "198.19.0.1", "224.0.0.1", "255.255.255.255"]))
    assert not any(map(is_local, ["8.8.4.4", "172.32.0.1", "100.128.0.1", "192.0.3.1", "198.20.0.1", "11.0.0.1"]))


def test_greedy_and_islands_on_touching_and_equal_spans(spark):
    d = spark.createDataFrame([(1, 0, 5, "a"), (1, 0, 9, "b"), (1, 5, 7, "c"), (1, 9, 12, "d"), (1, 9, 12, "d"), (1, 3, 3, "e"), (2, None, 4, "f")], "k int, start_cp int, end_cp int, label string")
    assert rows(S.greedy(d, ["k"], carry=["label"])) == rows(spark.createDataFrame([(1, 0, 9, "b"), (1, 9, 12, "d")], "k int, start_cp int, end_cp int, label string"))
    assert [(r.start_cp, r.end_cp) for r in S.islands(d, ["k"]).filter("k = 1").orderBy("start_cp").collect()] == [(0, 9), (9, 12)]
    assert [(r.start_cp, r.end_cp) for r in S.islands(d, ["k"], touching=True).filter("k = 1").collect()] == [(0, 12)]


@pytest.mark.parametrize("strategy", X.STRATEGIES)
def test_replacement_keeps_the_rest(spark, strategy):
    d = spark.createDataFrame([(1, "to a@b.example.net, cc c@d.example.net, a@b.example.net!"), (2, "nothing"), (3, None)], "id int, text string")
    out = {r.id: r.anonymized for r in X.anonymized(d, "id", "text", strategy, b"k", ["email"]).collect()}
    assert out[2] == "nothing" and out[3] is None
    assert out[1].startswith("to ") and out[1].endswith("!") and ", cc " in out[1] and "a@b" not in out[1]


def test_restoration_is_the_identity_and_leaves_nothing(spark):
    d = spark.createDataFrame([(1, "to a@b.example.net, cc c@d.example.net"), (2, "plain <X_1>"), (3, None), (4, ""), (1, "a@b.example.net again")], "id int, text string")
    f = findings(d, ["id"], "text", ["email"])
    gone = X.anonymized(d, "id", "text", "corpus", b"k", ["email"])
    keys = X.key_map(f, R.corpus_placeholder(F.col("pattern_name"), F.col("matched_text"), b"k"), ["id", "start_cp"])
    assert X.ambiguous(keys).count() == 0
    back = X.restored(gone, keys, "id", "anonymized")
    assert sorted((r.id, r.restored or "") for r in back.collect()) == sorted((r.id, r.text or "") for r in d.collect())
    assert back.filter("restored is null").count() == 1
    assert [r.kind for r in X.residuals(back, keys, "id", "restored").collect()] == ["unknown"]


def test_hmac_agrees_with_the_library(spark):
    import hashlib
    import hmac

    got = spark.range(1).select(R.hmac_hex(F.lit("wert ß"), b"key")).first()[0]
    assert got == hmac.new(b"key", "wert ß".encode(), hashlib.sha256).hexdigest()


def test_leaves_keep_order_and_lexemes():
    got = U.leaves_of('{"b": [1.50, {"a": "x"}], "a": null, "e": {}, "t": true}')
    assert [(p, k, v) for _, p, _, k, v, *_ in got] == [("b[0]", "number", "1.50"), ("b[1].a", "string", "x"), ("a", "null", None), ("e", "empty_object", None), ("t", "boolean", "true")]
    assert U.leaves_of("{broken") == [] and U.leaves_of(None) == []


def test_selectors_refuse_what_they_cannot_read():
    for bad in ("", "a[", "a[x]"):
        with pytest.raises(ValueError):
            U.selector(bad)


def test_a_bad_record_ends_the_query_without_its_text(spark):
    d = spark.createDataFrame([("d", '{"a": 1}\n\n{secret')], "k string, text string")
    with pytest.raises(Exception) as e:
        U.checked(U.records(d, "k", "text")).collect()
    assert "record 3" in str(e.value) and "secret" not in str(e.value)


def test_literals_overlap_and_respect_edges():
    m = Matcher([("aa", True), ("anna", False), ("anna lee", False)])
    assert [(i, j) for i, j, _ in m.every("aaa")] == [(0, 2), (1, 3)]
    assert m.longest("Anna Lee, hanna, anna") == [(0, 8, "anna lee"), (17, 21, "anna")]
    assert Matcher([]).every("x") == [] and m.every("") == []


def test_unknown_names_are_refused(spark):
    with pytest.raises(ValueError):
        fail_on(spark.createDataFrame([], "pattern_name string, category string"), ["nothing"])
    with pytest.raises(ValueError):
        rulesets.resolve(None, "nothing", None)


def test_salted_join_is_a_join(spark):
    a = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(300)] + [(None, 1)], "k int, v int")
    b = a.groupBy("k").agg(F.count("*").alias("n"))
    hot = hot_keys(b, "k", "n", 300, min_rows=100)
    assert hot.count() == 1
    assert rows(salted_join(a, b, "k", "v", hot)) == rows(a.join(b, "k"))


def test_running_ordinals_and_sums(spark):
    d = spark.createDataFrame([(i * 7 % 50, i % 5) for i in range(50)], "k int, n int")
    got = sorted((r.k, r.ordinal, r.upto) for r in running(d, [F.col("k")], F.col("n")).collect())
    n = dict((r.k, r.n) for r in d.collect())
    assert got == [(k, k + 1, sum(n[j] for j in range(k))) for k in range(50)]


def test_values_spread_through_a_large_session(spark):
    from gleaner.operators.sessions import propagated

    values = spark.createDataFrame([("s", v) for v in ("Ann Lee", r"a\Eb+c", "--", "lee", None, "")] + [("t", "Ann Lee")], "session string, value string")
    texts = ["Ann Lee met Ann Lee", "Ann Leeson", r"x a\Eb+c -- y", "lee lee", None, ""]
    rows = [(i, "s", t) for i, t in enumerate(texts)] + [(100 + i, "s", "Ann Lee met Ann Lee") for i in range(300)] + [(900, "t", "by Ann Lee"), (901, "u", "Ann Lee")]
    got = {(r.k, r.value): r.occurrences for r in propagated(values, spark.createDataFrame(rows, "k int, session string, t string"), "session", "t", "k").collect()}
    want = {(0, "Ann Lee"): 2, (2, r"a\Eb+c"): 1, (2, "--"): 1, (3, "lee"): 2, (900, "Ann Lee"): 1} | {(100 + i, "Ann Lee"): 2 for i in range(300)}
    assert got == want


def test_session_flow_cleans_every_text_of_a_session(spark):
    from gleaner.operators.traces import session_pipeline

    rows = [(1, "s", "write to ann.lee@mail.acme.net now"), (2, "s", "ann.lee@mail.acme.net, ann.lee@mail.acme.net!"), (3, "s", None), (4, "t", "xann.lee@mail.acme.net"), (5, "s", "xann.lee@mail.acme.net")]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "k int, session string, t string, value string")
    out = {r.k: (r.cleaned, r.n_replaced) for r in session_pipeline(d, "k", "session", "t", b"k").collect()}
    alias = out[1][0].split()[2]
    assert out[1] == (f"write to {alias} now", 1) and out[2] == (f"{alias}, {alias}!", 2) and out[3] == (None, 0)
    assert alias not in out[5][0] and out[5][1] == 1 and out[4][0] == out[5][0]


def test_layers_of_settings_fail_closed():
    from gleaner.config import layered

    assert layered({"strategy": "mask"}, environment={"GLEANER_STRATEGY": "hash"})["strategy"] == "hash"
    for bad in ({"strategy": "none"}, {"colour": "red"}):
        with pytest.raises(ValueError):
            layered(bad, environment={})


def test_a_catalogue_with_a_bad_entry_is_not_used(spark):
    from gleaner.operators.review import catalogue, run_named

    c, b = (spark.createDataFrame(x, "model string, n long") for x in ([("a", 1), ("b", 0)], [("z", 9)]))
    ok = F.col("n") > 0
    assert [r.model for r in catalogue(c, b, ok).collect()] == ["z"] and [r.model for r in catalogue(c.limit(1), b, ok).collect()] == ["a"] and [r.model for r in catalogue(c.limit(0), b, ok).collect()] == ["z"]
    with pytest.raises(ValueError):
        run_named(c, "model", "ab")


def test_json_keeps_all_but_its_values(spark):
    rows = [(1, '{"a": "mail x@y.example.net", "n": 1.50, "b": [true, null, "p@q.example.net", {}]}'), (2, None), (3, "{bad"), (4, '{"k":  "plain"}'), (5, "[]"), (6, '"solo@x.example.net"')]
    d = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.anonymized for r in X.json_anonymized(d, "text", "placeholder", names=["email"], compact=True).collect()}
    assert got == {1: '{"a":"mail <EMAIL>","n":1.50,"b":[true,null,"<EMAIL>",{}]}', 2: None, 3: None, 4: '{"k":  "plain"}', 5: "[]", 6: '"<EMAIL>"'}
    pretty = {r.id: r.anonymized for r in X.json_anonymized(d, "text", "placeholder", names=["email"]).collect()}
    assert pretty[4] == '{\n  "k": "plain"\n}' and pretty[5] == "[]"


def test_names_inside_handles_follow_their_people(spark):
    values = spark.createDataFrame([("ann.lee@x.example",), ("@ANN_99",), ("https://x.example/AnnLee",), (None,)], "v string")
    parts = spark.createDataFrame([("Ann", "Edda"), ("Lee", "Birk")], "component string, alias string")
    assert {r.v: r.linked for r in X.linked(values, parts, "v").collect()} == {"ann.lee@x.example": "edda.birk@x.example", "@ANN_99": "@EDDA_99", "https://x.example/AnnLee": "https://x.example/AnnLee"}


def test_long_lists_are_searched_in_shards(spark, monkeypatch):
    from gleaner.operators import literals

    texts = spark.createDataFrame([("ann lee and anna",), (None,), ("",)], "t string")
    lits = spark.createDataFrame([(w, False) for w in ("ann", "ann lee", "anna", "and", "zoe", "lee")], "literal string, anywhere boolean")
    one = sorted(map(tuple, literals.matches(texts, "t", lits, longest=True).collect()))
    monkeypatch.setattr(literals, "LIST_ROWS", 2)
    assert sorted(map(tuple, literals.matches(texts, "t", lits, longest=True).collect())) == one and len(one) == 3


def test_a_sentence_goes_on_over_batches(spark, tmp_path):
    from gleaner.streaming.text import STORE, sentence_units

    spark.conf.set(*STORE)
    src = tmp_path / "in"
    src.mkdir()
    s = spark.readStream.schema("k string, n int, line string, last boolean").json(str(src))
    put = lambda: sentence_units(s, "k", "n", "line", "last").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(100)
    (src / "1.json").write_text('{"k": "a", "n": 1, "line": "One that", "last": false}\n')
    assert put()
    (src / "2.json").write_text('{"k": "a", "n": 2, "line": "goes on.", "last": false}\n{"k": "a", "n": 3, "line": "key: v", "last": false}\n{"k": "a", "n": 4, "line": "", "last": false}\n{"k": "a", "n": 5, "line": "end", "last": true}\n')
    assert put()
    assert sorted((r.unit, r.text) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "One that goes on."), (2, "key: v"), (3, "end")]


def test_files_round_trip(spark, tmp_path):
    keys = spark.createDataFrame([("a", "<X_1>", "email"), ("b", "<X_2>", "email")], "original string, replacement string, pattern_name string")
    files.write_key_map(keys, f"{tmp_path}/keys")
    assert rows(files.read_key_map(spark, f"{tmp_path}/keys")) == rows(keys)
    with pytest.raises(Exception):
        files.write_key_map(keys, f"{tmp_path}/keys")
    spark.createDataFrame([("a", "<X_1>", "e"), ("b", "<X_1>", "e")], keys.schema).write.json(f"{tmp_path}/bad")
    with pytest.raises(ValueError):
        files.read_key_map(spark, f"{tmp_path}/bad")
    (tmp_path / "s").mkdir()
    (tmp_path / "s/one.jsonl").write_text('{"a": 1}\n')
    (tmp_path / "s/two.txt").write_text("x")
    assert [r.session for r in files.read_sessions(spark, f"{tmp_path}/s").collect()] == ["one"]
    assert files.read_folder(spark, f"{tmp_path}/s").count() == 2


def test_office_runs():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:r><w:t>Ann</w:t></w:r><w:r><w:t>a Lee</w:t></w:r></w:p><w:p><w:t>x</w:t></w:p></w:d>')
    assert files.office_runs(buf.getvalue()) == [("word/document.xml", 0, 0, "Ann"), ("word/document.xml", 0, 1, "a Lee"), ("word/document.xml", 1, 0, "x")]
    assert files.office_runs(b"no zip") == []


def test_numbered_stream_keeps_state(spark, tmp_path):
    from gleaner.streaming.text import STORE, numbered

    src = tmp_path / "in"
    src.mkdir()
    schema = "session string, value string"
    spark.conf.set(*STORE)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    (src / "1.json").write_text('{"session": "a", "value": "x"}\n{"session": "a", "value": "y"}\n')
    put = lambda: numbered(s).writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(100)
    assert put()
    (src / "2.json").write_text('{"session": "a", "value": "y"}\n{"session": "b", "value": "y"}\n{"session": "a", "value": null}\n')
    assert put()
    assert sorted((r.session, r.value, r.number) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", "x", 1), ("a", "y", 2), ("a", "y", 2), ("b", "y", 1)]


def test_every_pattern_runs_over_every_text_table():
    from gleaner.plans import detect as D

    assert set(D.EVERY) == {p.name for p in P.ALL} and {f"s24_all_{t}" for t in D.TEXTS} <= set(D.QUERIES) & set(D.SQL)


def test_contained_values_may_start_and_end_inside_words(spark, monkeypatch):
    from gleaner.operators import corpus, literals

    units = spark.createDataFrame([(1, "Dear Pavlinka Marisella"), (2, "pavlin"), (3, "x-Ann Lee, Ann Lee"), (4, None), (5, "")], "k int, t string")
    values = spark.createDataFrame([(v,) for v in ("Pavlin", "linka Mar", "Ann Lee", "sella", "absent", "", None)], "value string")
    want = {(1, "Pavlin"), (1, "linka Mar"), (1, "sella"), (3, "Ann Lee")}
    assert sorted(map(tuple, corpus.occurrences(units, values, "k", "t").collect())) == sorted(want)
    monkeypatch.setattr(literals, "LIST_ROWS", 2)
    assert sorted(map(tuple, corpus.occurrences(units, values, "k", "t").collect())) == sorted(want)


def test_whole_queries_keep_texts_beyond_ascii(spark, tmp_path):
    from gleaner import catalog

    at, q = str(tmp_path), catalog.queries()
    texts = ["Имя: Анна\n\u00a0\nЭто первая\nстрока.", "# Größe\nCafé-Bar émile@mail.example", "हिन्दी शब्द", "plain words", None]
    spark.createDataFrame(list(enumerate(texts)), "row_id int, _text string").write.parquet(f"{at}/label_sessions.parquet")
    notes = [[("person", "Zoë Müller"), ("person", "Анна Кедрова"), ("person", "İpek Ada"), ("person", " «José» "), ("email", "a@b.example")]]
    spark.createDataFrame([(1, notes[0])], "example_id int, annotations array<struct<entity_type:string,value:string>>").write.parquet(f"{at}/training_examples.parquet")
    spark.createDataFrame([(1, "ask ZOË MÜLLER or İpek Ada"), (2, "анна кедрова, a@b.example")], "id int, text string").write.parquet(f"{at}/challenge.parquet")
    spark.createDataFrame([(1, "Dr Zoë Müllers"), (2, "Анна Кедрова"), (3, None)], "record_id int, text string").write.parquet(f"{at}/gold_ner.parquet")
    got = lambda name: sorted(tuple(r) for r in q[name](spark, at).collect())

    tokens = {i: [t for k, t in got("x10_word_split") if k == i] for i in range(4)}
    assert tokens[2] == sorted(["हिन्दी", "शब्द"]) and tokens[1] == sorted(["#", "Größe", "Café-Bar", "émile", "@", "mail", ".", "example"])
    assert got("f22_line_forms") == [(0, 1, "key_value"), (0, 2, "empty"), (0, 3, "prose"), (0, 4, "prose"), (1, 1, "heading"), (1, 2, "prose"), (2, 1, "prose"), (3, 1, "prose")]
    assert {t for _, _, t in got("w7_sentence_units")} == {"Имя: Анна", "Это первая строка.", "# Größe", "Café-Bar émile@mail.example", "हिन्दी शब्द", "plain words"}
    assert [k for k, _ in got("filter_p21_interest")] == [0, 1, 2, 3] and dict(got("filter_p21_interest"))[1] == 3
    assert dict(got("s12_word_list")) == {"имя:": 1, "это": 1, "строка.": 1, "café-bar": 1, "हिन्दी": 1, "plain": 1}
    assert {v for v, _, _ in got("filter_p15_trimmed_edges")} == {v for _, v in notes[0]}
    want = {("ask ZOË MÜLLER or İpek Ada", "zoë müller"), ("ask ZOË MÜLLER or İpek Ada", "İpek ada"), ("анна кедрова, a@b.example", "анна кедрова"), ("анна кедрова, a@b.example", "a@b.example")}
    assert {(t, w.replace("i̇", "İ").replace("İpek Ada", "İpek ada")) for t, w, _ in got("x1_all_literals")} == want
    assert {(r.text, r.literal.replace("İpek Ada", "İpek ada")) for r in q["x2_longest_literals"](spark, at).collect()} == want
    assert got("j6_reviewed_values") == [(1, "Zoë Müller"), (2, "Анна Кедрова")]
