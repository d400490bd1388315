"""Queries of replacement, key maps, restoration and the functions they use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions import patterns as P, replacements as R
from gleaner.operators import replace as X
from gleaner.operators.extract import findings
from gleaner.operators.skew import running
from gleaner.session import read_table, spread

from .detect import extraction_sql, quoted

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEY = b"a key for tests only"
NAMES = [p.name for p in P.ALL]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "challenge"), "id")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(_texts(spark, sf_dir), ["id"], "text", NAMES)


_LABEL = "case pattern_name " + " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in P.LABELS.items()) + " else '<PII>' end"
_IN, _OUT = R.pads(KEY)
_MAC = f"sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || encode(matched_text))))"
_TOKEN = f"translate(to_base64(unhex(substr({_MAC}, 1, 16))), '+/=', '-_')"
_HASH = f"case pattern_name when 'email' then 'user_' || substr({_TOKEN}, 1, 6) || '@example.com' when 'phone_us' then '555-' || substr({_TOKEN}, 1, 3) || '-' || substr({_TOKEN}, 4, 4) when 'ssn' then 'XXX-XX-' || substr({_TOKEN}, 1, 4) else '<' || substr({_TOKEN}, 1, 8) || '>' end"
_CORPUS = f"regexp_replace({_LABEL}, '>$', '_') || substr({_MAC}, 1, 12) || '>'"
_MASK = r"regexp_replace(matched_text, '[\p{L}\p{N}]', 'X', 'g')"
FOUND = f"({extraction_sql('challenge', NAMES)})"
GREEDY = f"""recursive s as (select *, row_number() over (partition by id order by start_cp, end_cp desc, pattern_name, matched_text) as k from {FOUND}),
g(id, k, last, taken) as (select id, 1::bigint, end_cp, true from s where k = 1 union all
  select s.id, s.k, case when s.start_cp >= g.last then s.end_cp else g.last end, s.start_cp >= g.last from g join s on s.id = g.id and s.k = g.k + 1),
c as (select s.* from g join s using (id, k) where taken)"""


def _text_sql(replacement: str, extra: str = "", source: str = "c") -> str:
    return f"""with {GREEDY}{extra},
n as (select id, {replacement} as r, start_cp, end_cp, lag(end_cp, 1, 0) over (partition by id order by start_cp) as prev, row_number() over (partition by id order by start_cp desc) = 1 as final from {source}),
o as (select n.id, string_agg(substr(text, prev + 1, start_cp - prev) || r || case when final then substr(text, end_cp + 1) else '' end, '' order by start_cp) as anonymized from n join challenge using (id) group by n.id)
select id, coalesce(anonymized, text) as anonymized from challenge left join o using (id)"""


@query(f"select distinct pattern_name, {_LABEL} as label from {FOUND}")
def f1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("pattern_name", R.label(F.col("pattern_name")).alias("label")).distinct()


@query(f"select id, start_cp, {_MASK} as masked from {FOUND}")
def f2_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("id", "start_cp", R.mask(F.col("matched_text")).alias("masked"))


@query(f"select id, start_cp, {_HASH} as token from {FOUND}")
def f3_hash_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("id", "start_cp", R.hash_token(F.col("pattern_name"), F.col("matched_text"), KEY).alias("token"))


@query(f"select id, start_cp, {_CORPUS} as token from {FOUND}")
def f4_corpus_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("id", "start_cp", R.corpus_placeholder(F.col("pattern_name"), F.col("matched_text"), KEY).alias("token"))


_NORMAL = "translate(replace(replace(replace(replace(lower(v), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), 'áàâãéèêëíìîïóòôõúùûñç', 'aaaaeeeeiiiioooouuunc')"
_ANN_VALUES = "(select distinct a.value as v from (select unnest(annotations) as a from training_examples) where a.value is not null)"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "training_examples").select(F.explode("annotations").alias("a")).select(F.col("a.value").alias("v")).filter("v is not null").distinct()


@query(f"select v, {_NORMAL} as normal from {_ANN_VALUES}")
def f7_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).select("v", R.normal_form(F.col("v")).alias("normal"))


@query(f"""select v, case when v = '' then 'maRina' when not regexp_matches(regexp_replace(v, '[^\\p{{L}}]', '', 'g'), '[^\\p{{Lu}}]') then 'MARINA' when not regexp_matches(regexp_replace(v, '[^\\p{{L}}]', '', 'g'), '[^\\p{{Ll}}]') then 'marina'
when regexp_matches(v, '^\\p{{Lu}}') and not regexp_matches(substr(v, 2), '[\\p{{Lu}}\\p{{Lt}}]') then 'Marina' else 'maRina' end as alias from {_ANN_VALUES}""")
def f8_case_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).select("v", R.like_case(F.col("v"), F.lit("maRina")).alias("alias"))


@query(r"""select k, substr(regexp_replace(lower(regexp_replace(regexp_replace(k, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')), '^_+|_+$', '', 'g'), 1, 64) as class from (select distinct event_type || 'Key.' || user_id as k from events)""")
def f19_key_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = read_table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("Key."), "user_id").alias("k")).distinct()
    return k.select("k", R.key_class(F.col("k")).alias("class"))


@query("select distinct event_type, case when regexp_matches(event_type, '^[a-z][a-z0-9_]*$') then '<' || upper(event_type) || '>' end as label from events")
def f20_class_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_type", R.class_label(F.col("event_type")).alias("label")).distinct()


@query("select session, printf('f%05d.jsonl', (row_number() over (order by session))::int) as file from trace_sessions")
def f21_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = running(read_table(spark, sf_dir, "trace_sessions").select("session"), [F.col("session")])
    return s.select("session", R.opaque_file_name(F.col("ordinal"), "jsonl").alias("file"))


@query("select record_id, start_cp, case when n <= 4 then '1-4' when n <= 8 then '5-8' when n <= 16 then '9-16' when n <= 32 then '17-32' else '33+' end as bin from (select record_id, e.start_cp as start_cp, e.end_cp - e.start_cp as n from (select record_id, unnest(entities) as e from gold_ner))")
def f23_length_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "gold_ner").select("record_id", F.explode("entities").alias("e"))
    return e.select("record_id", "e.start_cp", R.length_bin(F.col("e.end_cp") - F.col("e.start_cp")).alias("bin"))


@query(f"select v, case when contains(v, '@') then 'email' when contains(v, ' ') then 'organization' else 'username' end as class from {_ANN_VALUES}")
def f24_term_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).select("v", R.term_class(F.col("v")).alias("class"))


@query(f"select id, start_cp, {_LABEL} as placeholder, {_MASK} as mask, {_HASH} as hash from {FOUND}")
def r2_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _found(spark, sf_dir)
    return f.select("id", "start_cp", *(X.replacement_of(s, KEY).alias(s) for s in ("placeholder", "mask", "hash")))


@query(_text_sql(_LABEL))
def r1_placeholder_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.anonymized(_texts(spark, sf_dir), "id", "text", "placeholder", names=NAMES)


@query(_text_sql(_MASK))
def r1_masked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.anonymized(_texts(spark, sf_dir), "id", "text", "mask", names=NAMES)


@query(_text_sql("regexp_replace(label, '>$', '_') || number || '>'", f""",
l as (select *, {_LABEL} as label from c), d as (select id, label, matched_text, row_number() over (partition by id, label order by min(start_cp), matched_text) as number from l group by 1, 2, 3),
z as (select l.*, number from l join d using (id, label, matched_text))""", "z"))
def r3_numbered_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.anonymized(_texts(spark, sf_dir), "id", "text", "numbered", names=NAMES)


_MAP = f"(select matched_text as original, arg_min({_CORPUS}, (id, start_cp, pattern_name)) as replacement, arg_min(pattern_name, (id, start_cp, pattern_name)) as pattern_name from {FOUND} group by 1)"


def _map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.key_map(_found(spark, sf_dir), R.corpus_placeholder(F.col("pattern_name"), F.col("matched_text"), KEY), ["id", "start_cp", "pattern_name"])


@query(f"select * from {_MAP}")
def r4_key_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir)


@query(f"select 'original' as side, original as value, count(distinct replacement) as n from {_MAP} group by 2 having n > 1 union all select 'replacement', replacement, count(distinct original) as n from {_MAP} group by 2 having n > 1")
def a16_bijection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.ambiguous(_map(spark, sf_dir))


@query("select 'replacement' as side, '<A_1>' as value, 2 as n union all select 'original', 'x', 2")
def r11_collapsing_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.ambiguous(spark.createDataFrame([("x", "<A_1>"), ("y", "<A_1>"), ("x", "<A_2>"), ("z", "<A_3>")], "original string, replacement string"))


_OLD = "(select * from (values ('old@example.org', '<EMAIL_000000000000>', 'email')) as t(original, replacement, pattern_name))"


@query(f"select * from {_OLD} union all select original, replacement, pattern_name from {_MAP} where original not in (select original from {_OLD})")
def u3_merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = spark.createDataFrame([("old@example.org", "<EMAIL_000000000000>", "email")], "original string, replacement string, pattern_name string")
    return X.merged_maps(old, _map(spark, sf_dir))


@query(f"select replacement, original, pattern_name from {_MAP} where replacement not in (select replacement from {_MAP} where pattern_name = 'email')")
def r5_reserved_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _map(spark, sf_dir)
    return X.free_aliases(m, m.filter("pattern_name = 'email'"))


@query("select c_mktsegment, c_name, base, case when k = 1 then base else base || '-' || k end as alias from (select *, row_number() over (partition by c_mktsegment, base order by c_name) as k from (select c_mktsegment, c_name, substr(c_name, 1, 12) as base from customer))")
def f10_unique_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_mktsegment", "c_name", F.substring("c_name", 1, 12).alias("base"))
    return X.unique_aliases(c, ["c_mktsegment"], "c_name", "base")


@query("select id, text as restored from challenge")
def r7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _found(spark, sf_dir)
    gone = X.anonymized(_texts(spark, sf_dir), "id", "text", "corpus", KEY, NAMES)
    keys = f.select(F.col("matched_text").alias("original"), R.corpus_placeholder(F.col("pattern_name"), F.col("matched_text"), KEY).alias("replacement")).distinct()
    return X.restored(gone, keys, "id", "anonymized")


@query(f"with {GREEDY} select id, 'full' as kind, count(*) as n from c group by 1")
def r8_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _found(spark, sf_dir)
    gone = X.anonymized(_texts(spark, sf_dir), "id", "text", "corpus", KEY, NAMES)
    keys = f.select(R.corpus_placeholder(F.col("pattern_name"), F.col("matched_text"), KEY).alias("replacement")).distinct()
    return X.residuals(gone, keys, "id", "anonymized").filter("kind = 'full'")


_WORDS = r"(select distinct unnest(regexp_extract_all(text, '[A-Za-z0-9]{8,}')) as token from challenge)"


@query(f"select token, round((-list_sum(list_transform(list_distinct(string_split(token, '')), lambda c: (len(list_filter(string_split(token, ''), lambda x: x = c)) / length(token)) * log2(len(list_filter(string_split(token, ''), lambda x: x = c)) / length(token))))), 6) as bits from {_WORDS}")
def a15_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "challenge").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]{8,}"), F.lit(0))).alias("token")).distinct()
    return t.select("token", F.round(R.entropy(F.col("token")), 6).alias("bits"))


@query("""select o_orderkey, (list_sum(list_transform(range(1, length(d) + 1), lambda i: case when (length(d) - i) % 2 = 1 then (case when substr(d, i, 1)::int * 2 > 9 then substr(d, i, 1)::int * 2 - 9 else substr(d, i, 1)::int * 2 end) else substr(d, i, 1)::int end))) % 10 = 0 as valid
from (select o_orderkey, '4' || lpad((o_orderkey * 7919 % 1000000000)::varchar, 15, '0') as d from orders)""")
def f_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    d = F.concat(F.lit("4"), F.lpad(((F.col("o_orderkey") * 7919) % 1000000000).cast("string"), 15, "0"))
    return o.select("o_orderkey", R.luhn(d).alias("valid"))
