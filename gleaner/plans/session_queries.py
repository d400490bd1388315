"""Queries of units, JSON leaves, selectors and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gleaner.operators import sessions as S, units as U
from gleaner.operators.extract import findings
from gleaner.session import read_table

from gleaner.functions import patterns as P

from .detect import extraction_sql, quoted, seen

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").filter("lower(trim(source)) = 'trace'")


_NL = "chr(10)"
_RECORDS = f"(select doc_id, i as line_no, lines[i] as record from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from (select doc_id, regexp_split_to_array(text, '\\r?\\n') as lines from documents where lower(trim(source)) = 'trace')) where trim(lines[i]) <> '')"


@query(f"select * from {_RECORDS}")
def s4_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.records(_traces(spark, sf_dir), "doc_id", "text")


@query("select cwd, case lower(regexp_extract(regexp_extract(cwd, '[^/]*$'), '^.+\\.([^.]*)$', 1)) when 'json' then 'json' when 'jsonl' then 'jsonl' when 'ndjson' then 'jsonl' when '' then 'sniff' else 'text' end as format from (select session || case length(session) % 4 when 0 then '.jsonl' when 1 then '.JSON' when 2 then '.log' else '' end as cwd from trace_sessions)")
def s2_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "trace_sessions").select(F.concat("session", F.element_at(F.array(F.lit(".jsonl"), F.lit(".JSON"), F.lit(".log"), F.lit("")), F.length("session") % 4 + 1)).alias("cwd"))
    return s.select("cwd", U.route(F.col("cwd")).alias("format"))


@query("""select doc_id, case when not regexp_matches(h, '^[\\[{]') then 'text' when json_valid(f) and trim(regexp_replace(substr(h, length(f) + 1), '\\s', '', 'g')) <> '' then 'jsonl' else 'json' end as format
from (select doc_id, h, regexp_extract(h, '^([^\\n]*)', 1) as f from (select doc_id, ltrim(left(text, 65536), ' ') as h from documents where text is not null))""")
def s3_sniffed_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", U.sniff(F.col("text")).alias("format"))


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.leaves(U.records(_traces(spark, sf_dir), "doc_id", "text"), ["doc_id", "line_no"])


_LEAVES = f"""(select doc_id, line_no, substr(fullkey, 3) as path, atom ->> '$' as value, key, type, id, parent from (select doc_id, line_no, unnest(t) from (select doc_id, line_no, (select list(j) from json_tree(record) j where type not in ('OBJECT', 'ARRAY')) as t from {_RECORDS} where json_valid(record))))"""
_TREE = f"(select r.doc_id, r.line_no, substr(j.fullkey, 3) as path, j.key, j.type, j.atom ->> '$' as value from {_RECORDS} r, json_tree(case when json_valid(r.record) then r.record else 'null' end) j where json_valid(r.record) and j.type not in ('OBJECT', 'ARRAY'))"


@query(f"select doc_id, line_no, path, value from {_TREE} where type = 'VARCHAR'")
def s5_json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaves(spark, sf_dir).filter("kind = 'string'").select("doc_id", "line_no", "path", "value")


@query("select k || '.b[' || i || '].c' as path, regexp_matches(k || '.b[' || i || '].c', '^.*$') and (k = 'a' or i = 1) and not (k = 'z') as scanned from (values ('a'), ('z'), ('m')) t(k), range(0, 3) r(i)")
def filter_p5_selected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = spark.createDataFrame([("a",), ("z",), ("m",)], "k string").withColumn("i", F.explode(F.array(*map(F.lit, range(3)))))
    p = k.select(F.concat("k", F.lit(".b["), "i", F.lit("].c")).alias("path"))
    return p.select("path", U.should_scan(F.col("path"), ["a.**", "*.b[1].c"], ["z"]).alias("scanned"))


@query("""select * from (values ('a.b', 'a.b', true), ('a.b', 'a.b.c', false), ('a.*', 'a.b', true), ('a.*', 'a.b.c', false), ('a.**', 'a.b.c[0]', true), ('**.c', 'a.b.c', true), ('**.c', 'c', true), ('a[*].x', 'a[3].x', true), ('a[2]', 'a[3]', false), ('*', 'x.y', true), ('*.text', 'a.b.text', false)) as t(selector, path, matches)""")
def filter_p4_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [("a.b", "a.b"), ("a.b", "a.b.c"), ("a.*", "a.b"), ("a.*", "a.b.c"), ("a.**", "a.b.c[0]"), ("**.c", "a.b.c"), ("**.c", "c"), ("a[*].x", "a[3].x"), ("a[2]", "a[3]"), ("*", "x.y"), ("*.text", "a.b.text")]
    d = spark.createDataFrame(cases, "selector string, path string")
    forms = F.create_map(*(F.lit(x) for s in {s for s, _ in cases} for x in (s, U.selector(s))))
    return d.select("selector", "path", F.regexp_like("path", forms[F.col("selector")]).alias("matches"))


@query(f"select scanned, count(*) as n from (select distinct path, regexp_matches(path, '(^|\\.)text$') and not starts_with(path, 'id') as scanned from {_TREE} where type = 'VARCHAR') group by 1")
def u4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.coverage(_leaves(spark, sf_dir).filter("kind = 'string'"), ["**.text"], ["id"]).select("scanned", "n")


@query(f"select path, case when key in ({', '.join(map(quoted, S.STRUCTURAL))}) then 'skip' when key in ('text', 'thinking', 'summary', 'message') then 'prose' else 'other' end as leaf_kind, count(*) as n from {_TREE} where type = 'VARCHAR' group by 1, 2")
def filter_p7_leaf_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _leaves(spark, sf_dir).filter("kind = 'string'")
    return f.select("path", S.leaf_kind(F.col("key"), F.col("parent_type"), F.col("parent_has_mime"), F.lit("user")).alias("leaf_kind")).groupBy("path", "leaf_kind").agg(F.count("*").alias("n"))


_LINES = "(select row_id, unnest(string_split(_text, chr(10))) as line, role from label_sessions where _text is not null)"


@query(f"""select row_id, count(*) as n from {_LINES} where strlen(line) <= 2000 and (regexp_matches(line, '(?:^|[^\\p{{L}}\\p{{N}}_])\\p{{Lu}}[\\p{{Ll}}\\p{{M}}]+[ \\t]+\\p{{Lu}}[\\p{{Ll}}\\p{{M}}]+|(?:^|[^\\p{{L}}\\p{{N}}_])[0-9]{{4,5}}[ \\t]+\\p{{Lu}}[\\p{{Ll}}\\p{{M}}]+|(?:^|[^\\p{{L}}\\p{{N}}_])\\p{{Lu}}\\.[ \\t]*\\p{{Lu}}[\\p{{Ll}}\\p{{M}}]+|(?i:(?:^|[^\\p{{L}}\\p{{N}}_])(?:user(?:name)?|login|handle|account|author|owner|contact)\\s*[:=])')
or (coalesce(role <> 'toolResult', true) and regexp_matches(line, '[\\p{{Ll}}\\p{{N}},;:)][ \\t]+\\p{{Lu}}[\\p{{Ll}}\\p{{M}}]+'))) group by 1""")
def filter_p8_candidate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "label_sessions").select("row_id", F.explode(F.split("_text", "\n")).alias("line"), F.coalesce(F.col("role") != "toolResult", F.lit(True)).alias("prose"))
    return d.filter(S.candidate_line(F.col("line"), F.col("prose"))).groupBy("row_id").agg(F.count("*").alias("n"))


_NAMES = ["email", "phone_us", "phone_intl", "ssn", "ssn_nodash", "date", "ipv4"]
_F = f"({extraction_sql('label_sessions', _NAMES)})"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(read_table(spark, sf_dir, "label_sessions"), ["row_id"], "_text", _NAMES)


@query(f"""select pattern_name, count(*) as n from (select *, length(regexp_replace(matched_text, '[^0-9]', '', 'g')) as d from {_F}) where case when pattern_name = 'date' then false
when pattern_name = 'email' then not regexp_matches(lower(split_part(matched_text, '@', -1)), '(^|\\.)(example|test|invalid|localhost|example\\.com|example\\.org|example\\.net)$') when pattern_name like 'phone%' then d >= 7 and regexp_matches(matched_text, '[+ \\-.()]') when pattern_name like 'ssn%' then d = 9 else true end group by 1""")
def filter_p9_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).filter(S.plausible(F.col("pattern_name"), F.col("matched_text"))).groupBy("pattern_name").agg(F.count("*").alias("n"))


_SPACE = P.to_re2(r"[\s]")[1:-1]
_EDGE = "[" + _SPACE + ";,:!?.\"''`|()\\[\\]{}<>=]"
_AV = "(select distinct a.value as v from (select unnest(annotations) as a from training_examples) where a.value is not null)"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "training_examples").select(F.explode("annotations").alias("a"))
    return t.select(F.col("a.value").alias("v")).filter("v is not null").distinct()


@query(f"select v, length(regexp_extract(v, '^{_EDGE}*')) as skipped, regexp_replace(v, '^{_EDGE}+|{_EDGE}+$', '', 'g') as trimmed from {_AV}")
def filter_p15_trimmed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead, value = S.trimmed(F.col("v"))
    return _values(spark, sf_dir).select("v", lead.alias("skipped"), value.alias("trimmed"))


@query("select cwd, regexp_extract(regexp_extract(cwd, '^/home/[^/]+'), '[^/]+$') as account from trace_sessions where cwd is not null")
def filter_p16_home_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "trace_sessions").filter("cwd is not null")
    return s.select("cwd", S.account_of(F.regexp_extract("cwd", "^/home/[^/]+", 0)).alias("account"))


@query(f"select pattern_name, matched_text, pattern_name not in ({', '.join(map(quoted, S.NO_SPREAD))}) and length(matched_text) >= 4 and (regexp_matches(matched_text, '\\p{{L}}') or length(matched_text) >= 7) as spreads from (select distinct pattern_name, matched_text from {_F})")
def filter_p18_spreading_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("pattern_name", "matched_text").distinct().withColumn("spreads", S.spreads(F.col("pattern_name"), F.col("matched_text")))


_SV = f"(select distinct session, matched_text as value from {_F} join label_sessions using (row_id) where pattern_name <> 'date')"


def _session_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _found(spark, sf_dir).filter("pattern_name != 'date'")
    return f.join(read_table(spark, sf_dir, "label_sessions").select("row_id", "session"), "row_id").select("session", F.col("matched_text").alias("value"), "pattern_name", "row_id")


@query(f"select row_id, value, (len(string_split(_text, value)) - 1)::int as occurrences from label_sessions l join {_SV} v using (session) where contains(_text, value) and not regexp_matches(value, '^[0-9]{{1,8}}$')")
def j4_session_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.propagated(_session_values(spark, sf_dir), read_table(spark, sf_dir, "label_sessions"), "session", "_text", "row_id")


@query(f"select session, matched_text as value, arg_min(pattern_name, (row_id, pattern_name)) as pattern_name, min(row_id) as first from {_F} join label_sessions using (row_id) where pattern_name <> 'date' group by 1, 2")
def a7_first_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_classes(_session_values(spark, sf_dir), "session", "value", "pattern_name", "row_id")


@query(f"select source, matched_text as value, sum(n_spans)::bigint as n from {_F} join label_sessions using (row_id) where n_spans is not null group by 1, 2")
def a8_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read_table(spark, sf_dir, "label_sessions").filter("n_spans is not null").select("row_id", "source", F.col("n_spans").cast("long"))
    return S.value_counts(_found(spark, sf_dir).join(l, "row_id").withColumnRenamed("matched_text", "value"), "source", "value", "n_spans")


@query(f"select distinct role from label_sessions where role is not null and lower(role) not in ({', '.join(map(quoted, S.GENERIC_ACCOUNTS))})")
def j3_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([(w,) for w in S.GENERIC_ACCOUNTS], "word string")
    return S.allowed(read_table(spark, sf_dir, "label_sessions").filter("role is not null").select("role").distinct(), "role", words)


@query(f"select row_id, least(12, {' + '.join(f'case when regexp_matches(u, {quoted(p)}) then {w} else 0 end' for p, w in S.SIGNALS)}) as score from (select row_id, {seen('_text')} as u from label_sessions where _text is not null)")
def filter_p21_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "label_sessions").filter("_text is not null")
    return t.select("row_id", S.interest(F.col("_text")).alias("score"))


@query(f"select line, count(*) as n from (select lower(split_part(regexp_extract(trim(line), '^[{P.BLANKS}]*([^{_SPACE}]+)', 1), '/', 1)) as line, line as raw from (select unnest(string_split(_text, chr(10))) as line from label_sessions)) where raw not like '#%' and length(line) >= 2 group by 1")
def s12_word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.sources.lists import words

    lines = read_table(spark, sf_dir, "label_sessions").select(F.explode(F.split("_text", "\n")).alias("value"))
    return words(lines).groupBy(F.col("word").alias("line")).agg(F.count("*").alias("n"))


@query("select distinct trim(source) as term from documents where source is not null and trim(source) <> '' and not starts_with(trim(source), '#')")
def s13_term_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.sources.lists import terms

    return terms(read_table(spark, sf_dir, "documents").select(F.col("source").alias("value")))


_OCR = "(select l_orderkey as doc, l_linenumber as word_no, 'w' || l_partkey as text, l_linenumber * 40 as x, (l_partkey % 9) * 8 as y, 12 as h from lineitem)"


@query(f"""with o as (select *, max(y + h) over (partition by doc order by y, x, text rows between unbounded preceding and 1 preceding) as reach from {_OCR}),
i as (select *, sum(case when reach is null or y >= reach then 1 else 0 end) over (partition by doc order by y, x, text rows unbounded preceding) as line from o)
select doc, line::int as line, string_agg(text, ' ' order by x, word_no, text) as text, min(y) as top, max(y + h) as bottom from i group by doc, line""")
def s11_ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.sources.ocr import lines

    l = read_table(spark, sf_dir, "lineitem")
    w = l.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("word_no"), F.concat(F.lit("w"), "l_partkey").alias("text"), (F.col("l_linenumber") * 40).alias("x"), ((F.col("l_partkey") % 9) * 8).alias("y"), F.lit(12).alias("h"))
    return lines(w)


@query(r"""select * from (values (1, '{"a": "\ufffd!"}'), (2, '{"a": "\ud83d\ude00"}'), (3, '{"a": "\ufffd"}'), (4, '{}')) as t(n, line)""")
def s16_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([(1, r'{"a": "\ud83d!"}'), (2, r'{"a": "\ud83d\ude00"}'), (3, r'{"a": "\ude00"}'), (4, "{}")], "n int, line string")
    return d.select("n", U.repaired(F.col("line")).alias("line"))
