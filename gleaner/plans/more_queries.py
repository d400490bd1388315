"""Queries of literal lists, buffers, gates and evaluation extras."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions import patterns as P
from gleaner.operators import buffers as B, literals as L, review as V, sessions as S
from gleaner.session import read_table

from .detect import WORDS
from .session_queries import _TREE, _leaves
from .span_queries import ANN, _GOLD, annotated, gold

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


#: Small letters, code point by code point, so that offsets stay.
_LOW = "array_to_string(list_transform(range(1, length({0}) + 1), lambda i: case when length(lower(substr({0}, i, 1))) = 1 then lower(substr({0}, i, 1)) else substr({0}, i, 1) end), '')"
_LITS = "(select distinct case when length(lower(a.value)) = length(a.value) then lower(a.value) else a.value end as literal from (select unnest(annotations) as a from training_examples) where a.entity_type in ('email', 'person') and length(a.value) >= 5)"
_HITS = f"""(select text, literal, unnest(list_filter(range(1, length(text) - length(literal) + 2), lambda i: substr(low, i, length(literal)) = key)) as i from (
select text, {_LOW.format('text')} as low from (select distinct text from challenge where text is not null)) join (select literal, {_LOW.format('literal')} as key from {_LITS}) on contains(low, key))"""


def _literals(spark: SparkSession, sf_dir: str, anywhere: bool) -> DataFrame:
    a = read_table(spark, sf_dir, "training_examples").select(F.explode("annotations").alias("a")).filter("a.entity_type in ('email', 'person') and length(a.value) >= 5")
    low = F.lower("a.value")
    return a.select(F.when(F.length(low) == F.length("a.value"), low).otherwise(F.col("a.value")).alias("literal")).distinct().withColumn("anywhere", F.lit(anywhere))


@query(f"select text, literal, count(*) as n from {_HITS} group by 1, 2")
def x1_all_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.matches(read_table(spark, sf_dir, "challenge"), "text", _literals(spark, sf_dir, True)).groupBy("text", "literal").agg(F.count("*").alias("n"))


_WORDY = "regexp_matches({0}, '[\\p{{L}}\\p{{N}}]')"
_EDGED = f"""(select text, literal, i - 1 as s, i - 1 + length(literal) as e from {_HITS}
where (not {_WORDY.format('substr(text, i, 1)')} or not regexp_matches(substr(text, i - 1, case when i > 1 then 1 else 0 end), '[\\p{{L}}\\p{{N}}_]') or (i > 2 and substr(text, i - 2, 2) = '\\n'))
and (not {_WORDY.format('substr(text, i + length(literal) - 1, 1)')} or not regexp_matches(substr(text, i + length(literal), 1), '[\\p{{L}}\\p{{N}}_]')))"""


@query(f"""with recursive h as materialized (select *, row_number() over (partition by text order by s, e desc) as k from {_EDGED}),
g(text, k, last, taken) as (select text, 1::bigint, e, true from h where k = 1 union all select h.text, h.k, case when h.s >= g.last then h.e else g.last end, h.s >= g.last from g join h on h.text = g.text and h.k = g.k + 1)
select text, s as start_cp, e as end_cp, literal from g join h using (text, k) where taken""")
def x2_longest_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.matches(read_table(spark, sf_dir, "challenge"), "text", _literals(spark, sf_dir, False), longest=True)


_SP = P.to_re2(r"\s")
_SPI = P.to_re2(r"[\s]")[1:-1]
_FORMS = f"""select row_id, line_no, case when regexp_matches(line, '^[{_SPI.replace(chr(92) + 'x{0b}', '').replace(chr(92) + 's', chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r ')}]*$') then 'empty' when regexp_matches(line, '^{_SP}*(#+{_SP}|=+{_SP}*$|-+{_SP}*$)') then 'heading'
when regexp_matches(line, '^{_SP}*[{WORDS}.-]+{_SP}*[:=]{_SP}*[^{_SPI}]') then 'key_value' else 'prose' end as form, line
from (select row_id, i as line_no, l[i] as line from (select row_id, l, unnest(range(1, len(l) + 1)) as i from (select row_id, string_split(replace(_text, chr(13), ''), chr(10)) as l from label_sessions where _text is not null)))"""


@query(f"select row_id, line_no, form from ({_FORMS})")
def f22_line_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("row_id", "line_no", B.line_form(F.col("line")).alias("form"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "label_sessions").filter("_text is not null")
    return t.select("row_id", F.posexplode(F.split(F.regexp_replace("_text", "\r", ""), "\n")).alias("_i", "line")).withColumn("line_no", F.col("_i") + 1)


@query(f"""with f as ({_FORMS}), g as (select *, coalesce(form <> 'prose' or lag(form) over w <> 'prose' or lag(regexp_matches(line, '[.!?]\\s*$')) over w, true) as flush from f window w as (partition by row_id order by line_no)),
b as (select *, sum(flush::int) over (partition by row_id order by line_no rows unbounded preceding)::int as b from g),
k as (select *, (row_number() over (partition by row_id, b order by line_no) - 1) % {B.MAX_LINES} = 0 and form <> 'empty' as k from b),
u as (select *, sum(k::int) over (partition by row_id order by line_no rows unbounded preceding)::int as unit from k)
select row_id, unit, string_agg(trim(line), ' ' order by line_no) as text from u where form <> 'empty' group by 1, 2""")
def w7_sentence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sentence_units(_lines(spark, sf_dir), "row_id", "line_no", "line")


@query("select session, row_id, tier from (select *, row_number() over (partition by session order by tier, sha256('t' || row_id)) as r from (select session, row_id, case when n_spans >= 3 then 0 when nym_prediction = 'sensitive' then 1 else 2 end as tier from label_sessions)) where r <= 4")
def w9_tiered_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read_table(spark, sf_dir, "label_sessions")
    tiers = [("spans", F.col("n_spans") >= 3), ("said", F.col("nym_prediction") == "sensitive")]
    return B.tiered(l, tiers, "session", F.sha2(F.concat(F.lit("t"), F.col("row_id")), 256), 4).select("session", "row_id", "tier")


@query("select session, _text as value, min(row_id) as first, any_value(role) is null as dummy from label_sessions where _text is not null group by 1, 2".replace(", any_value(role) is null as dummy", ""))
def w10_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read_table(spark, sf_dir, "label_sessions").filter("_text is not null").withColumnRenamed("_text", "value")
    return S.first_classes(l, "session", "value", "role", "row_id").select("session", "value", "first")


@query(f"select record_id, g.start_cp, g.end_cp from {_GOLD} g where not exists (select 1 from (select record_id, m.start_cp as s, m.end_cp as e from (select record_id, unnest(masked_spans) as m from gold_ner)) m where m.record_id = g.record_id and m.s <= g.start_cp and m.e >= g.end_cp)")
def j15_unmasked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read_table(spark, sf_dir, "gold_ner").select("record_id", F.explode("masked_spans").alias("m")).select("record_id", "m.*")
    return B.not_restored(gold(spark, sf_dir), m, "record_id").select("record_id", "start_cp", "end_cp")


@query(f"select lower(split_part(value, ' ', 1)) as alias, count(distinct value) as n from (select a.value from (select unnest(annotations) as a from training_examples) where a.entity_type = 'person') group by 1 having n > 1")
def j16_shared_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "training_examples").select(F.explode("annotations").alias("a")).filter("a.entity_type = 'person'")
    return B.shared_components(a.select(F.split_part("a.value", F.lit(" "), F.lit(1)).alias("alias"), F.col("a.value").alias("original")))


@query("select id from challenge where list_has_any(list_transform(spans, lambda s: s.class), ['person', 'street_address'])")
def j17_label_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.with_labels(read_table(spark, sf_dir, "challenge"), "spans", "class", ["person", "street_address"]).select("id")


@query("select count(*) as candidates, count(nym_prediction) as answered, count(*) - count(nym_prediction) as missing from label_sessions")
def j18_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read_table(spark, sf_dir, "label_sessions")
    j = l.select("row_id").join(l.filter("nym_prediction is not null").select("row_id", "nym_prediction"), "row_id", "left")
    return j.agg(F.count("*").alias("candidates"), F.count("nym_prediction").alias("answered"), (F.count("*") - F.count("nym_prediction")).alias("missing"))


@query("select value, arg_min(class, (o, class)) as class from (select s.value, s.class, id as o from (select id, unnest(spans) as s from challenge) union all select a.value, a.entity_type, 'zz' || example_id from (select example_id, unnest(annotations) as a from training_examples) where a.value is not null) group by 1")
def u1_reviewed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "challenge").select("id", F.explode("spans").alias("s")).select(F.col("s.value").alias("value"), F.col("s.class").alias("class"), F.col("id").alias("o"))
    t = read_table(spark, sf_dir, "training_examples").select("example_id", F.explode("annotations").alias("a")).filter("a.value is not null")
    return S.first_classes(c.union(t.select("a.value", "a.entity_type", F.concat(F.lit("zz"), "example_id"))).withColumn("z", F.lit(0)), "z", "value", "class", "o").select("value", "class")


@query("select lower(w) as literal from (select source as w from documents union all select source from label_sessions union all select source from trace_sessions) where w is not null group by 1")
def u2_literal_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [read_table(spark, sf_dir, t).select("source") for t in ("documents", "label_sessions", "trace_sessions")]
    return V.literal_union(parts, "source")


@query(f"select 'both' as side, count(*) as n from (select distinct example_id, start_cp, end_cp from {ANN} where label = 'person' intersect select distinct example_id, start_cp, end_cp from {ANN} where label <> 'first_name') union all select 'left', count(*) from (select distinct example_id, start_cp, end_cp from {ANN} where label = 'person' except select distinct example_id, start_cp, end_cp from {ANN} where label <> 'person')")
def u5_set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annotated(spark, sf_dir).select("example_id", "start_cp", "end_cp", "label")
    cut = lambda c: a.filter(c).drop("label").distinct()
    both = cut("label = 'person'").intersect(cut("label != 'first_name'")).agg(F.count("*").alias("n")).select(F.lit("both").alias("side"), "n")
    return both.union(cut("label = 'person'").exceptAll(cut("label != 'person'").join(cut("label = 'person'"), ["example_id", "start_cp", "end_cp"], "left_semi")).agg(F.count("*").alias("n")).select(F.lit("left").alias("side"), "n"))


@query(f"select record_id, g.start_cp, g.label from {_GOLD} g join gold_ner using (record_id) where label = 'PERSON' and regexp_matches(substr(text, g.start_cp + 1, g.end_cp - g.start_cp), '\\p{{Lu}}') and not (regexp_matches(substr(text, g.end_cp + 1, 2), '^\\.[\\p{{L}}\\p{{N}}]|^\\(') or substr(text, g.start_cp, 1) = '.')")
def filter_p10_person_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gold(spark, sf_dir).filter("label = 'PERSON'").join(read_table(spark, sf_dir, "gold_ner").select("record_id", "text"), "record_id")
    cut = lambda e: F.expr(e)
    ok = S.person_like(cut("substring(text, start_cp + 1, end_cp - start_cp)"), cut("if(start_cp > 0, substring(text, start_cp, 1), '')"), cut("substring(text, end_cp + 1, 2)"))
    return g.filter(ok).select("record_id", "start_cp", "label")


@query("select * from (values ('https://a.example/x', true), ('www.b.example', true), ('readme.md', false), ('host.example.org/path', true), ('drwxr-xr-x', false), ('a.b', false), ('lib.rs', false)) as t(value, url)")
def filter_p10_url_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ["https://a.example/x", "www.b.example", "readme.md", "host.example.org/path", "drwxr-xr-x", "a.b", "lib.rs"]
    d = spark.createDataFrame([(x,) for x in v], "value string")
    return d.select("value", S.url_like(F.col("value")).alias("url"))


@query(f"select example_id, start_cp, end_cp, label from {ANN} a where not exists (select 1 from {ANN} k where k.example_id = a.example_id and k.label = 'email' and a.start_cp < k.end_cp and a.end_cp > k.start_cp)")
def filter_p17_keep_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.operators.spans import without_overlap

    a = annotated(spark, sf_dir)
    return without_overlap(a, a.filter("label = 'email'"), ["example_id"]).select("example_id", "start_cp", "end_cp", "label")


@query("select record_id, case when entities is null or len(entities) = 0 then 'no_entities' when not annotation_complete then 'incomplete' when len(list_filter(entities, lambda e: e.end_cp - e.start_cp < 3)) > 0 then 'short_span' else 'kept' end as reason from gold_ner where annotation_complete is not null")
def filter_p20_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read_table(spark, sf_dir, "gold_ner").filter("annotation_complete is not null")
    return g.select("record_id", V.kept_reason(F.col("entities"), F.col("annotation_complete")).alias("reason"))


@query("select event_type, count(*) as n, round(max(abs(value - m)), 6) as worst, count(case when value > 20 and m <= 20 then 1 end) as disagree from (select *, avg(value) over (partition by event_type) as m from events where value is not null) group by 1")
def v3_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").filter("value is not null")
    j = e.join(e.groupBy("event_type").agg(F.avg("value").alias("m")), "event_type")
    return V.parity(j, "event_type", "value", "m", 20)


@query("select role, round(count(case when hard and said then 1 end) / nullif(count(case when hard then 1 end), 0), 6) as recall, round(count(case when not hard and not said then 1 end) / nullif(count(case when not hard then 1 end), 0), 6) as utility, count(case when hard and not said then 1 end) as unsafe from (select role, n_spans > 0 as hard, nym_prediction = 'sensitive' as said from label_sessions where n_spans is not null and nym_prediction is not null) group by 1")
def v4_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read_table(spark, sf_dir, "label_sessions").filter("n_spans is not null and nym_prediction is not null")
    return V.adjudication(l, "role", F.col("n_spans") > 0, F.col("nym_prediction") == "sensitive")


@query("select t as threshold, count(*) as kept, round(1 - pow(0.05, 1.0 / count(*)), 9) as bound from events, (values (10.0), (20.0), (40.0)) x(t) where value >= t group by 1")
def v5_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.abstention(read_table(spark, sf_dir, "events"), "value", [10.0, 20.0, 40.0])


@query("select v, n from (select a.value as v, count(*) as n from (select unnest(annotations) as a from training_examples) where a.entity_type = 'first_name' group by 1) where n >= 2 and regexp_matches(v, '^\\p{Lu}[\\p{Ll}\\p{M}]+$')")
def v8_name_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "training_examples").select(F.explode("annotations").alias("a")).filter("a.entity_type = 'first_name'")
    return V.name_corpus(a.select("a.value"), "value")


@query("select sha256('k' || _text) as key from (select distinct _text from label_sessions where _text is not null) where length(_text) > 20")
def r17_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read_table(spark, sf_dir, "label_sessions").select("_text")
    cache = l.filter("length(_text) <= 20").distinct().select(F.sha2(F.concat(F.lit("k"), F.col("_text")), 256).alias("key"))
    return B.cache_misses(l, cache, "_text", "k").select("key")


@query(f"select doc_id, line_no, path, value as original, regexp_replace(value, '[0-9]', '0', 'g') as anonymized from {_TREE} where type = 'VARCHAR' and regexp_matches(value, '[1-9]')")
def r18_changed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _leaves(spark, sf_dir).filter("kind = 'string'")
    after = l.withColumn("value", F.regexp_replace("value", "[0-9]", "0"))
    return B.segments(l, after, ["doc_id", "line_no", "path"], "value")


@query("select record_id, lower(text_sha256) = sha256(text) as fresh, annotation_complete as complete from gold_ner")
def r20_gold_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.freshness(read_table(spark, sf_dir, "gold_ner"), "record_id", "text", "text_sha256", "annotation_complete")


@query(f"select doc_id, line_no, value as block from {_TREE} where type = 'VARCHAR' and key = 'text'")
def r19_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.text_blocks(_leaves(spark, sf_dir)).select("doc_id", "line_no", "block")


@query("select source, count(*) as sessions, min(session) as first from trace_sessions group by 1")
def r15_session_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.listed(read_table(spark, sf_dir, "trace_sessions"), "source", "session")


@query("select l.row_id, l.session, s.source as header_source from label_sessions l join trace_sessions s using (session)")
def j5_plan_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, s = read_table(spark, sf_dir, "label_sessions").select("row_id", "session"), read_table(spark, sf_dir, "trace_sessions").select("session", F.col("source").alias("header_source"))
    return V.planned(l, s, "session")
