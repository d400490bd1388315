"""Queries of corpus review, scoring and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions import patterns as P
from gleaner.operators import corpus as C, replace as X, review as V, scoring as Q
from gleaner.operators.extract import findings
from gleaner.session import read_table, spread

from .detect import WORDS, extraction_sql, quoted
from .session_queries import _RECORDS, _TREE, _leaves
from .span_queries import _GOLD, gold

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("select session, cwd, regexp_matches(cwd, '^/home/[^/]*/work/[^/]*$') as matches from trace_sessions where cwd is not null")
def filter_p6_path_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "trace_sessions").filter("cwd is not null").select("session", "cwd", F.col("cwd").rlike(C.path_form("/home/*/work/*")).alias("matches"))


_RULES = ["(?i)password", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "@[a-z.-]+\\.(test|invalid)"]


@query(f"select doc_id, case {' '.join(f'when regexp_matches(text, {quoted(r)}) then {i}' for i, r in enumerate(_RULES))} end as denied_by from documents")
def filter_p13_denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", C.denied_by(F.col("text"), _RULES).alias("denied_by"))


_VAL = "(select distinct a.value as value from (select unnest(annotations) as a from training_examples) where a.entity_type in ('person', 'email') and length(a.value) >= 6)"


@query(f"select record_id, value from gold_ner join {_VAL} v on contains(text, value)")
def j6_reviewed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "training_examples").select(F.explode("annotations").alias("a"))
    v = a.filter("a.entity_type in ('person', 'email') and length(a.value) >= 6").select(F.col("a.value").alias("value")).distinct()
    g = spread(read_table(spark, sf_dir, "gold_ner").select("record_id", "text").filter("text is not null"), "record_id")
    return C.occurrences(g, v, "record_id", "text")


@query(f"select doc_id, line_no, path, value from {_TREE} t where type = 'VARCHAR' and (doc_id, value) in (select (doc_id, value) from {_TREE} where key = 'role')")
def j7_equal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _leaves(spark, sf_dir).filter("kind = 'string'")
    return C.whole_values(l, l.filter("key = 'role'"), "doc_id", "value").select("doc_id", "line_no", "path", "value")


@query("select cwd from (select distinct cwd from trace_sessions where cwd is not null) where exists (select 1 from (values ('/home/okko'), ('/home/wren/work/keymap')) m(member) where cwd = member or starts_with(cwd, member || '/'))")
def j8_under_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.createDataFrame([("/home/okko",), ("/home/wren/work/keymap",)], "member string")
    return C.under(read_table(spark, sf_dir, "trace_sessions").select("cwd").filter("cwd is not null").distinct(), m, "cwd")


@query(f"with t as (select *, regexp_replace(path, '\\.?[^.]*$', '') as parent from {_TREE} where type = 'VARCHAR') select doc_id, line_no, path, (select min(s.value) from t s where s.doc_id = t.doc_id and s.line_no = t.line_no and s.parent = t.parent and s.key = 'type') as sibling_value from t")
def j9_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _leaves(spark, sf_dir).filter("kind = 'string'")
    l = l.withColumn("parent", F.concat_ws("/", "doc_id", "line_no", F.regexp_replace("path", r"\.?[^.]*$", "")))
    return C.with_sibling(l, "parent", "key", "value", "type").select("doc_id", "line_no", "path", "sibling_value")


@query("select o_orderkey as ordinal, case when l.k is null then 'right' end as missing from orders left join (select distinct l_orderkey as k from lineitem where l_linenumber = 2) l on l.k = o_orderkey union all select l_orderkey, 'left' from (select distinct l_orderkey from lineitem where l_linenumber = 2) where l_orderkey not in (select o_orderkey from orders)")
def j10_positional_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"))
    l = read_table(spark, sf_dir, "lineitem").filter("l_linenumber = 2").select(F.col("l_orderkey").alias("ordinal")).distinct()
    return C.zipped(o, l, "ordinal").select("ordinal", "missing")


_E = f"(select pattern_name as rule, end_cp - start_cp as n from ({extraction_sql('challenge', ['email', 'phone_us', 'phone_intl', 'ssn'])}))"


@query(f"select rule, count(*) as units, sum(n)::bigint as chars from {_E} group by 1")
def a11_rule_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(read_table(spark, sf_dir, "challenge"), ["id"], "text", ["email", "phone_us", "phone_intl", "ssn"])
    return C.rule_tally(f.select(F.col("pattern_name").alias("rule"), (F.col("end_cp") - F.col("start_cp")).alias("n")), "rule", "n")


_U = "(select id, list_distinct(list_transform(spans, lambda s: s.class)) as classes from challenge where spans is not null)"


@query(f"select id, len(classes) > 0 and len(list_filter(classes, lambda c: c not in ('person', 'email', 'phone_us', 'phone_intl'))) = 0 as approved from {_U}")
def filter_p19_approved_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = read_table(spark, sf_dir, "challenge").filter("spans is not null").select("id", F.array_distinct(F.transform("spans", lambda s: s["class"])).alias("classes"))
    return C.approved(u, ["person", "email", "phone_us", "phone_intl"]).select("id", "approved")


@query("select entity_type as class, category as basis, count(*) as n from (select a.entity_type, a.category from (select unnest(annotations) as a from training_examples)) group by 1, 2")
def a12_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "training_examples").select(F.explode("annotations").alias("a"))
    return V.tallied(a.select(F.col("a.entity_type").alias("class"), F.col("a.category").alias("basis")), ["class", "basis"])


@query("select class from (select distinct s.class as class from (select unnest(spans) as s from challenge)) where class not in ('person', 'email')")
def u7_unknown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.not_among(read_table(spark, sf_dir, "challenge").select(F.explode("spans").alias("s")).select("s.class"), ["person", "email"], "class")


@query("select session, 'left' as side from (select session from trace_sessions except select session from label_sessions) union all select session, 'right' from (select distinct session from label_sessions except select session from trace_sessions)")
def u6_session_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.difference(read_table(spark, sf_dir, "trace_sessions").select("session"), read_table(spark, sf_dir, "label_sessions").select("session").distinct())


@query("select lower(trim(source)) as source, count(*) as files, sum(strlen(text))::bigint as bytes from documents group by 1")
def k8_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select(F.lower(F.trim("source")).alias("source"), F.octet_length("text").cast("long").alias("n"))
    return C.manifest(d, "source", "n")


@query(f"select doc_id, line_no, count(*) as leaves, count(case when type = 'VARCHAR' then 1 end) as strings from {_TREE} group by 1, 2")
def s8_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaves(spark, sf_dir).groupBy("doc_id", "line_no").agg(F.count("*").alias("leaves"), F.count(F.when(F.col("kind") == "string", 1)).alias("strings"))


# ------------------------------------------------------------------ scoring

_FE = f"(select record_id, start_cp, end_cp, case pattern_name when 'email' then 'EMAIL' when 'ssn' then 'ID_NUMBER' else 'PHONE' end as label from ({extraction_sql('gold_ner', ['email', 'phone_us', 'phone_intl', 'ssn'])}))"


@query(f"""with j as (select g.label as gl, f.label as fl from (select distinct * from {_GOLD}) g full join (select distinct * from {_FE}) f using (record_id, start_cp, end_cp, label)),
s as (select coalesce(gl, fl) as label, count(case when gl is not null and fl is not null then 1 end) as tp, count(case when gl is null then 1 end) as fp, count(case when fl is null then 1 end) as fn from j group by 1)
select *, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from s""")
def a10_exact_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(read_table(spark, sf_dir, "gold_ner"), ["record_id"], "text", ["email", "phone_us", "phone_intl", "ssn"])
    f = f.withColumn("label", F.when(F.col("pattern_name") == "email", "EMAIL").when(F.col("pattern_name") == "ssn", "ID_NUMBER").otherwise("PHONE"))
    return Q.exact_scores(gold(spark, sf_dir), f, ["record_id", "start_cp", "end_cp", "label"], "label")


@query("select p_type, n from (select *, coalesce(sum(n) over (order by n desc, p_type rows between unbounded preceding and 1 preceding), 0) as b, sum(n) over () as t from (select p_type, count(*) as n from part group by 1)) where b < t * 0.8")
def a18_keep_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.keep_set(read_table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n")), "p_type", "n", 0.8)


@query("with r as (select event_type, value, row_number() over (partition by event_type order by value) as k, count(*) over (partition by event_type) as c from events where value is not null) select event_type, min(case when k >= ceil(c * 0.5) then value end) as p50, min(case when k >= ceil(c * 0.95) then value end) as p95, max(value) as most from r group by 1")
def a19_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.nearest_rank(read_table(spark, sf_dir, "events").filter("value is not null"), "event_type", "value", [0.5, 0.95])


@query("select sha256(text) as key, count(distinct split) as splits from gold_ner where split is not null group by 1 having splits > 1")
def a21_leaking_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.leaking(read_table(spark, sf_dir, "gold_ner"), F.sha2("text", 256), "split")


@query("select source_id as key, count(distinct split) as splits from gold_ner where split is not null and source_id is not null group by 1 having splits > 1")
def a21_leaking_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.leaking(read_table(spark, sf_dir, "gold_ner"), F.col("source_id"), "split")


@query("select event_type, event_id from (select *, row_number() over (partition by event_type order by sha256('s1' || event_id)) as r from events) where r <= 25")
def w8_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.stratified_top(read_table(spark, sf_dir, "events"), "event_type", "event_id", 25, "s1").select("event_type", "event_id")


_VOTES = "(select o_orderpriority as stratum, case o_orderstatus when 'F' then 'no' when 'O' then 'yes' else 'open' end as vote from orders)"


@query(f"select round(sum(n * y / c) / sum(n), 9) as low, round(sum(n * (c - o) / c) / sum(n), 9) as high from (select o_orderpriority as stratum, count(*) as n from orders group by 1) join (select stratum, count(*) as c, count(case when vote = 'yes' then 1 end) as y, count(case when vote = 'no' then 1 end) as o from {_VOTES} group by 1) using (stratum)")
def a17_weighted_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "stratum")
    votes = o.select("stratum", F.when(F.col("o_orderstatus") == "F", "no").when(F.col("o_orderstatus") == "O", "yes").otherwise("open").alias("vote"))
    return Q.weighted_precision(o.groupBy("stratum").agg(F.count("*").alias("n")), votes, "stratum").select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("select * from (values ('a', 0.5, 0.6, false), ('b', 0.9, 0.8, true), ('c', 0.7, 0.0, true), ('d', 0.0, 0.4, false)) as t(class, before, after, regressed)")
def r21_promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", 0.7)], "class string, recall double")
    a = spark.createDataFrame([("a", 0.6), ("b", 0.8), ("d", 0.4)], "class string, recall double")
    return Q.gate(b, a, "class")


_CAND = "(select row_id, nym_prediction as answer, n_spans >= 4 as hard from label_sessions)"


@query(f"select row_id, case when coalesce(hard, false) then 'redact' when answer = 'not_sensitive' then 'flag' else 'redact' end as verdict from {_CAND}")
def r12_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read_table(spark, sf_dir, "label_sessions")
    answers = l.filter("nym_prediction is not null").select("row_id", F.when(F.col("nym_prediction") == "not_sensitive", "keep").otherwise("redact").alias("answer"))
    return Q.decided(l.select("row_id", F.coalesce(F.col("n_spans") >= 4, F.lit(False)).alias("hard")), answers, "row_id").select("row_id", "verdict")


@query("select row_id, row_number() over (partition by session order by recorded_at, row_id) <= 5 as judged from label_sessions")
def o9_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.budgeted(read_table(spark, sf_dir, "label_sessions"), "session", [F.col("recorded_at"), F.col("row_id")], 5).select("row_id", "judged")


@query("select row_id, array_to_string(w[s + 1:s + 20], ' ') as window_text from (select row_id, w, unnest(range(0, greatest(0, ceil((len(w) - 20) / 15.0)::int * 15) + 1, 15)) as s from (select row_id, string_split(_text, ' ') as w from label_sessions where _text is not null))")
def x8_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read_table(spark, sf_dir, "label_sessions").filter("_text is not null")
    return l.select("row_id", F.explode(Q.windows(F.split("_text", " "), 20, 5)).alias("window_text"))


@query("select distinct token from (select unnest(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{16,}')) as token from challenge) where list_sum(list_transform(list_distinct(string_split(token, '')), lambda c: -(len(list_filter(string_split(token, ''), lambda x: x = c)) / length(token)) * log2(len(list_filter(string_split(token, ''), lambda x: x = c)) / length(token)))) > 3.5")
def x4_high_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.high_entropy(read_table(spark, sf_dir, "challenge"), "text")


_WD = f"[{WORDS}]"
_NOT = "[^" + P.to_re2(r"[\s]")[1:-1] + "]"


@query(f"select row_id, unnest(regexp_extract_all(_text, '{_WD}+(?:[-_]{_WD}+)*|{_NOT}')) as token from label_sessions where _text is not null")
def x10_word_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read_table(spark, sf_dir, "label_sessions").filter("_text is not null")
    return l.select("row_id", F.explode(Q.word_split(F.col("_text"))).alias("token"))


@query("select entity_type as label, case entity_type when 'first_name' then 'person' when 'last_name' then 'person' when 'phone_us' then 'phone' when 'phone_intl' then 'phone' else entity_type end as coarse, count(*) as n from (select a.entity_type from (select unnest(annotations) as a from training_examples)) group by 1, 2")
def filter_p22_coarse_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "training_examples").select(F.explode("annotations").alias("a")).select(F.col("a.entity_type").alias("label"))
    return V.tallied(a.withColumn("coarse", V.coarse(F.col("label"))), ["label", "coarse"])


@query("select distinct example_id, a.entity_type as label, a.value as value from (select example_id, unnest(annotations) as a from training_examples) where a.entity_type <> 'date' and a.value is not null")
def v6_label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "training_examples").select("example_id", F.explode("annotations").alias("a")).select("example_id", "a.*")
    return V.label_pairs(a, "example_id", "entity_type", "value", ["date"])


@query("select session from trace_sessions where starts_with(sha256(session), 'a') order by started_at desc, session limit 5")
def v11_latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.selected_runs(read_table(spark, sf_dir, "trace_sessions"), "session", "started_at", "a", 5)


@query("select session, case when cwd is null then 'missing' when n is null then 'unavailable' when n < 3 then 'incomplete' else 'ready' end as status from trace_sessions left join (select session, count(_text) as n from label_sessions group by 1) using (session)")
def v12_session_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.session_status(read_table(spark, sf_dir, "trace_sessions"), read_table(spark, sf_dir, "label_sessions"), "session", "cwd", "_text")


@query("select _text, min(row_id) as row_id, count(*) as copies from label_sessions where _text is not null group by 1")
def o6_distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.distinct_texts(read_table(spark, sf_dir, "label_sessions"), "_text", "row_id")


@query("select term, row_number() over (order by length(term) desc, term) as ordinal from (select distinct s.value as term from (select unnest(spans) as s from challenge))")
def o7_alias_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "challenge").select(F.explode("spans").alias("s")).select(F.col("s.value").alias("term")).distinct()
    return X.alias_order(t, "term")
