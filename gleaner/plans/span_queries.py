"""Queries of the span algebra over annotations and gold spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.operators import review as V, spans as S
from gleaner.operators.extract import findings
from gleaner.session import read_table, spread

from .detect import extraction_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, start_cp, end_cp, label, text): the weak annotations as spans."""
    t = read_table(spark, sf_dir, "training_examples")
    a = t.select("example_id", "text", F.explode("annotations").alias("a"))
    return a.select("example_id", F.col("a.start_cp").alias("start_cp"), F.col("a.end_cp").alias("end_cp"), F.col("a.entity_type").alias("label"), "text").filter("start_cp < end_cp")


ANN = """(select example_id, a.start_cp as start_cp, a.end_cp as end_cp, a.entity_type as label, text
from (select example_id, text, unnest(annotations) as a from training_examples) where a.start_cp < a.end_cp)"""


@query(f"""with recursive s as (select example_id, start_cp, end_cp, label, row_number() over (partition by example_id order by start_cp, end_cp desc, label) as k from {ANN}),
g(example_id, k, last, taken) as (
  select example_id, 1::bigint, end_cp, true from s where k = 1
  union all select s.example_id, s.k, case when s.start_cp >= g.last then s.end_cp else g.last end, s.start_cp >= g.last from g join s on s.example_id = g.example_id and s.k = g.k + 1)
select s.example_id, s.start_cp, s.end_cp, s.label from g join s using (example_id, k) where taken""")
def w1_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.greedy(annotated(spark, sf_dir), ["example_id"], carry=["label"])


def _islands_sql(op: str) -> str:
    return f"""with o as (select *, max(end_cp) over (partition by example_id order by start_cp, end_cp desc, label rows between unbounded preceding and 1 preceding) as reach from {ANN}),
i as (select *, sum(case when reach is null or start_cp {op} reach then 1 else 0 end) over (partition by example_id order by start_cp, end_cp desc, label rows unbounded preceding) as n_i from o)
select example_id, min(start_cp) as start_cp, max(end_cp) as end_cp, count(*) as n from i group by example_id, n_i"""


@query(_islands_sql(">="))
def w2_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.islands(annotated(spark, sf_dir), ["example_id"], label="label").drop("label")


@query(_islands_sql(">"))
def w2_islands_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.islands(annotated(spark, sf_dir), ["example_id"], label="label", touching=True).drop("label")


@query(f"""with f as ({extraction_sql('training_examples', ['email', 'phone_intl'])})
select example_id, start_cp, end_cp, label from {ANN} a where not exists (select 1 from f where f.example_id = a.example_id and a.start_cp < f.end_cp and a.end_cp > f.start_cp)""")
def j1_ner_beside_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spread(read_table(spark, sf_dir, "training_examples"), "example_id"), ["example_id"], "text", ["email", "phone_intl"])
    return S.without_overlap(annotated(spark, sf_dir), f, ["example_id"]).select("example_id", "start_cp", "end_cp", "label")


@query(f"""select example_id, start_cp, end_cp, label from {ANN} l where not exists (select 1 from {ANN} r where r.example_id = l.example_id
and r.end_cp - r.start_cp > l.end_cp - l.start_cp and r.start_cp <= l.start_cp and r.end_cp >= l.end_cp)""")
def j2_not_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.not_contained(annotated(spark, sf_dir), ["example_id"]).select("example_id", "start_cp", "end_cp", "label")


_VALUES = """(select source, a.entity_type as class, a.value as value, example_id, a.start_cp as start_cp from (select source, example_id, unnest(annotations) as a from training_examples) where a.value is not null)"""


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "training_examples").select("source", "example_id", F.explode("annotations").alias("a"))
    return t.select("source", F.col("a.entity_type").alias("class"), F.col("a.value").alias("value"), "example_id", F.col("a.start_cp").alias("start_cp")).filter("value is not null")


@query(f"""select source, class, value, row_number() over (partition by source, class order by f, value) as number from (
select source, class, value, min((example_id, start_cp)) as f from {_VALUES} group by 1, 2, 3)""")
def w3_numbered_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.numbered(_values(spark, sf_dir), ["source", "class"], "value", ["example_id", "start_cp"])


@query(f"""with o as (select *, lag(end_cp) over w as le from {ANN} where label in ('first_name', 'last_name') window w as (partition by example_id order by start_cp, end_cp)),
i as (select *, sum(case when le is null or start_cp < le or trim(substr(text, le + 1, start_cp - le), ' ') <> '' then 1 else 0 end) over (partition by example_id order by start_cp, end_cp rows unbounded preceding) as k from o)
select example_id, min(start_cp) as start_cp, max(end_cp) as end_cp, count(*) as n from i group by example_id, k""")
def w4_joined_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annotated(spark, sf_dir).filter(F.col("label").isin("first_name", "last_name")).withColumn("kind", F.lit("name"))
    return S.joined_fragments(a, ["example_id"], "kind", "text").drop("kind")


_TAGS = [(1, 1, "B-PER"), (1, 2, "I-PER"), (1, 3, "O"), (1, 4, "I-LOC"), (1, 5, "I-LOC"), (1, 6, "B-LOC"), (2, 1, "I-PER"), (2, 2, "B-PER"), (2, 3, "I-ORG"), (2, 4, "O"), (2, 5, "O"), (3, 1, "O")]


@query("select * from (values (1, 'PER', 1, 2), (1, 'LOC', 4, 5), (1, 'LOC', 6, 6), (2, 'PER', 1, 1), (2, 'PER', 2, 2), (2, 'ORG', 3, 3)) as t(doc, label, first, last)")
def w5_bio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bio_spans(spark.createDataFrame(_TAGS, "doc int, pos int, tag string"), ["doc"], "pos", "tag")


@query(f"""select example_id, start_cp, end_cp, label from (select *, row_number() over (partition by example_id, start_cp, end_cp order by length(label) desc, label) as r from {ANN}) where r = 1""")
def w6_same_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.best_duplicates(annotated(spark, sf_dir), ["example_id", "start_cp", "end_cp"], [F.length("label").desc(), F.col("label")]).select("example_id", "start_cp", "end_cp", "label")


_GOLD = "(select record_id, e.start_cp as start_cp, e.end_cp as end_cp, e.label as label from (select record_id, unnest(entities) as e from gold_ner))"


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read_table(spark, sf_dir, "gold_ner").select("record_id", F.explode("entities").alias("e"))
    return g.select("record_id", F.col("e.start_cp").alias("start_cp"), F.col("e.end_cp").alias("end_cp"), F.col("e.label").alias("label"))


_COVER = ["email", "phone_us", "phone_intl", "ssn", "date"]


@query(f"""with f as ({extraction_sql('gold_ner', _COVER)}),
o as (select *, max(end_cp) over (partition by record_id order by start_cp, end_cp desc, pattern_name rows between unbounded preceding and 1 preceding) as reach from f),
i as (select *, sum(case when reach is null or start_cp >= reach then 1 else 0 end) over (partition by record_id order by start_cp, end_cp desc, pattern_name rows unbounded preceding) as k from o),
u as (select record_id, min(start_cp) as s, max(end_cp) as e from i group by record_id, k),
c as (select g.record_id, g.label, g.start_cp, g.end_cp, coalesce(sum(greatest(0, least(g.end_cp, u.e) - greatest(g.start_cp, u.s))), 0)::bigint as covered from (select distinct * from {_GOLD}) g left join u using (record_id) group by 1, 2, 3, 4)
select record_id, label, start_cp, end_cp, covered, end_cp - start_cp as length, case when covered >= end_cp - start_cp then 'full' when covered > 0 then 'partial' else 'missed' end as verdict from c""")
def a9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spread(read_table(spark, sf_dir, "gold_ner"), "record_id"), ["record_id"], "text", _COVER)
    return S.coverage(gold(spark, sf_dir).distinct(), f, ["record_id"], ["label"])


@query(f"select record_id, start_cp, end_cp, label, row_number() over (partition by record_id order by start_cp, end_cp desc, label) as ordinal from {_GOLD}")
def o1_finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ranked(gold(spark, sf_dir), ["record_id"])


@query(f"select g.record_id, g.start_cp, strlen(left(t.text, g.start_cp)) as byte_start, g.end_cp, strlen(left(t.text, g.end_cp)) as byte_end from {_GOLD} g join gold_ner t using (record_id)")
def f18_byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "gold_ner").select("text", "record_id", F.explode("entities").alias("e"))
    at = lambda c: S.byte_offset(F.col("text"), F.col(c))
    return t.select("record_id", F.col("e.start_cp").alias("start_cp"), at("e.start_cp").alias("byte_start"), F.col("e.end_cp").alias("end_cp"), at("e.end_cp").alias("byte_end"))


@query(f"""with p as (select label, start_cp, end_cp, record_id from {_GOLD}), f as ({extraction_sql('gold_ner', ['email'])})
select count(*) as gold, count(f.record_id) as hit, count(*) - count(f.record_id) as missed from p left join (select distinct record_id, start_cp, end_cp from f) f using (record_id, start_cp, end_cp) where label = 'EMAIL'""")
def j19_exact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spread(read_table(spark, sf_dir, "gold_ner"), "record_id"), ["record_id"], "text", ["email"])
    return V.hits(gold(spark, sf_dir).filter("label = 'EMAIL'"), f, ["record_id", "start_cp", "end_cp"])
