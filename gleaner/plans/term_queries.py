"""Queries of the vocabulary operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.operators import review as E, terms as V
from gleaner.session import read_table, spread

from .detect import quoted

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_W = quoted(V.WORD)
_PH = f"""(select record_id, source_id, text, i, m, g from (select *, unnest(range(1, len(m) + 1)) as i from (select record_id, source_id, text, regexp_extract_all(text, {_W}) as m, string_split_regex(text, {_W}) as g from gold_ner where text is not null)))"""
_TERMS = f"""(select record_id, source_id, text, term from (
select record_id, source_id, text, m[i] as term from {_PH}
union all select record_id, source_id, text, m[i] || g[i + 1] || m[i + 1] from {_PH} where i < len(m) and regexp_matches(g[i + 1], '^ +$')
union all select record_id, source_id, text, m[i] || g[i + 1] || m[i + 1] || g[i + 2] || m[i + 2] from {_PH} where i + 1 < len(m) and regexp_matches(g[i + 1], '^ +$') and regexp_matches(g[i + 2], '^ +$'))
where length(term) between 2 and 120)"""
_COUNTS = f"(select term, count(*) as occurrences, count(distinct text) as distinct_texts, count(distinct source_id) as sources from {_TERMS} group by 1)"


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "gold_ner"), "record_id")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.counted(_gold(spark, sf_dir), "text", "source_id")


@query(f"select * from {_COUNTS}")
def a3_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


@query(f"select record_id, count(*) as terms, count(distinct term) as distinct_terms from {_TERMS} group by 1")
def x5_terms_per_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _gold(spark, sf_dir).select("record_id", F.explode(V.phrases(F.col("text"))).alias("term")).filter(V.valid(F.col("term")))
    return t.groupBy("record_id").agg(F.count("*").alias("terms"), F.count_distinct("term").alias("distinct_terms"))


_ST = " union all ".join(f"select record_id, unnest(regexp_extract_all(text, {quoted(p.replace(chr(92) + chr(34), chr(34)))})) as s from gold_ner" for p in V.STRUCTURED)


@query(f"select term, count(*) as n from (select regexp_replace(s, '[.,;)\\]}}]+$', '') as term from ({_ST})) group by 1")
def x5_structured_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir).select(F.explode(V.structured(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


_NOISE = "(regexp_matches(term, '^[0-9._:/-]*[0-9][0-9._:/-]*$') or (strlen(term) >= 7 and regexp_matches(term, '^[0-9A-Fa-f]+$')) or regexp_matches(term, '^[vV]?[0-9]+(?:\\.[0-9]+)+$'))"


@query(f"select term, {_NOISE} as noise from {_COUNTS} where not contains(term, ' ')")
def f11_noise_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).filter(~F.col("term").contains(" ")).select("term", V.noise_shape(F.col("term")).alias("noise"))


_PARTS = r"list_filter(regexp_split_to_array(regexp_replace(term, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '[\s_.\-'']+'), lambda s: s <> '')"


@query(f"select term, array_to_string({_PARTS}, '|') as parts from {_COUNTS} where not contains(term, ' ')")
def f12_compound_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).filter(~F.col("term").contains(" ")).select("term", F.array_join(V.parts(F.col("term")), "|").alias("parts"))


_S = "(select count(distinct source_id) from gold_ner where text is not null)"
_SPEC = f"(select *, ln(1.0 + distinct_texts) * ln(({_S} + 1.0) / (sources + 1.0)) as score from {_COUNTS})"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _gold(spark, sf_dir).filter("text is not null").agg(F.count_distinct("source_id")).first()[0]
    return _counts(spark, sf_dir).withColumn("score", V.specificity(F.col("distinct_texts"), F.col("sources"), n))


@query(f"select term, occurrences, sources, round(score, 6) as score from {_SPEC} where occurrences >= 5")
def o4_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).filter("occurrences >= 5").select("term", "occurrences", "sources", F.round("score", 6).alias("score"))


@query(f"select term, rank from (select term, row_number() over (order by round(score, 9) desc, sources desc, occurrences desc, term) as rank from {_SPEC} where occurrences >= 3) where rank <= 200")
def o2_vocabulary_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ranked(_scored(spark, sf_dir).withColumn("score", F.round("score", 9)), 200, 3).select("term", "rank")


@query(f"""select term, rank from (select term, row_number() over (order by case when regexp_matches(term, '[0-9]') then 1 else 0 end, distinct_texts desc, sources desc, occurrences desc, term) as rank from {_COUNTS}) where rank <= 100""")
def o2_demoted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counts(spark, sf_dir)
    return V.ranked(c.withColumn("score", F.col("distinct_texts").cast("double")), 100, 1, c.filter(F.col("term").rlike("[0-9]"))).select("term", "rank")


@query(f"""select term, row_number() over (order by case when length(term) > 12 then distinct_texts else -1 end desc, r) as rank from (
select term, distinct_texts, row_number() over (order by distinct_texts desc, sources desc, occurrences desc, term) as r from {_COUNTS} qualify r <= 100)""")
def o3_recognised_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = V.ranked(_counts(spark, sf_dir).withColumn("score", F.col("distinct_texts").cast("double")), 100)
    return E.recognised_first(top, F.length("term") > 12, "distinct_texts")


_BG = f"(select term, count(*) as n from (select unnest(regexp_extract_all(text, {_W})) as term from documents) where length(term) between 2 and 120 group by 1)"


@query(f"""with t as (select * from {_COUNTS} where not contains(term, ' ')), b as {_BG}, j as (select * from t full join b using (term)),
s as (select sum(distinct_texts) as ft, sum(n) as bt, count(*) as v from j)
select term, round(ln(((distinct_texts + 1.0) / (ft + v)) / ((coalesce(n, 0) + 1.0) / (bt + v))) * ln(1.0 + distinct_texts), 6) as score from j, s where distinct_texts is not null""")
def j11_background_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    bg = read_table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(V.WORD), F.lit(0))).alias("term")).filter(V.valid(F.col("term"))).groupBy("term").agg(F.count("*").alias("n"))
    return V.log_lift(_counts(spark, sf_dir).filter(~F.col("term").contains(" ")), bg).select("term", F.round("score", 6).alias("score"))


_LIST = f"(select lower(term) as w from {_BG} where n >= 40 group by 1)"
_LOW = f"list_transform({_PARTS}, lambda p: lower(p))"
_KNOWN = f"(select term, occurrences, list_contains(l, lower(term)) or (len({_PARTS}) > 1 and list_has_all(l, {_LOW})) as known from {_COUNTS}, (select list(w) as l from {_LIST}))"


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    bg = read_table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(V.WORD), F.lit(0))).alias("word")).filter(V.valid(F.col("word"))).groupBy("word").count().filter("count >= 40")
    return V.known(_counts(spark, sf_dir).select("term", "occurrences"), bg)


@query(f"select term, known from {_KNOWN}")
def j13_known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, sf_dir).select("term", "known")


@query(f"with k as {_KNOWN} select term from k where not known or (term <> lower(term) and lower(term) not in (select term from k where known and term = lower(term)))")
def j12_case_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.case_aware(_known(spark, sf_dir)).select("term")


_FREQ = f"(select term from {_COUNTS} where occurrences >= 20 and not contains(term, ' '))"


@query(f"""select term, source_id, record_id from (select *, row_number() over (partition by term order by r, source_id nulls first, record_id) as k from (
select *, row_number() over (partition by term, source_id order by record_id) as r from (select distinct term, source_id, record_id from (select source_id, record_id, m[i] as term from {_PH}) where term in {_FREQ}))) where k <= 3""")
def a4_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = _counts(spark, sf_dir).filter("occurrences >= 20 and not contains(term, ' ')")
    return V.examples(_gold(spark, sf_dir), "record_id", "text", "source_id", freq)


@query(f"select term, count(*) as n from (select unnest(regexp_extract_all(_text, {_W})) as term from label_sessions) group by 1 order by n desc, term limit 50")
def a5_heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.heavy_terms(read_table(spark, sf_dir, "label_sessions"), "_text", 50)


@query(f"select source_id, count(distinct term) as n from {_TERMS} group by 1")
def a6_distinct_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _gold(spark, sf_dir).select("source_id", F.explode(V.phrases(F.col("text"))).alias("term")).filter(V.valid(F.col("term")))
    return E.distinct_by(t, "source_id", "term")


@query(f"select sha256(term) as id, term, 'sensitive' as choice from {_COUNTS} where occurrences >= 20 and occurrences % 2 = 0")
def j20_reviewed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counts(spark, sf_dir).filter("occurrences >= 20").select(F.sha2("term", 256).alias("id"), "term", "occurrences")
    d = c.select(F.col("id").alias("candidate_id"), F.when(F.col("occurrences") % 2 == 0, "sensitive").otherwise("benign").alias("choice"))
    return V.reviewed(c.select("id", "term"), d)


@query("""select sha256(count(*) || '|' || sum(('0x' || substr(h, 1, 15))::bigint) || '|' || sum(('0x' || substr(h, 16, 15))::bigint) || '|' || sum(('0x' || substr(h, 31, 15))::bigint) || '|' || sum(('0x' || substr(h, 46, 15))::bigint)) as fingerprint from (
select sha256(length(record_id::varchar) || ':' || record_id || '|' || length(coalesce(text, '')) || ':' || coalesce(text, '')) as h from gold_ner)""")
def a14_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.fingerprint(_gold(spark, sf_dir), ["record_id", "text"])
