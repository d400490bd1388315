"""SQL equivalents of the pN_ queries that SQL can express on whole tables."""

from __future__ import annotations

P1_FOUND = r"""
select row_id, 'oversized' as kind from label_sessions where length(_text) > (select capacity from size_budgets where budget = 'label_chunk')
union all
select row_id, 'no_boundary' from label_sessions
where length(_text) > 300 and list_max(list_transform(regexp_split_to_array(_text, '[ \t\r\n]'), lambda x: length(x))) > 300
"""

P4_COUNTS = """
select _text as item_text, count(*) as n from label_sessions where _text is not null
group by 1 having count(*) * 200 >= (select count(_text) from label_sessions)
"""

P6_FOUND = r"""
with recursive r as (
  select record_id, nullif(replace(lower(regexp_replace(source_id, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')), '_', '-'), '') as sid from gold_ner),
s as (select sid, min(record_id) as rep from r where sid is not null group by sid),
l as (
  select nullif(replace(lower(regexp_replace(source_id, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')), '_', '-'), '') as sid,
    replace(lower(trim(author_id)), '_', '-') as au, replace(lower(trim(entity_ref)), '_', '-') as en from gold_sources),
t as (
  select distinct rep, tie from (
    select sid, 'a' || au as tie from l where au not in ('', '-', 'n/a', 'unknown', 'none', 'null', 'anonymous')
    union all select sid, 'e' || en from l where en not in ('', '-', 'n/a', 'unknown', 'none', 'null')) x join s using (sid)),
e as (select distinct a.rep as a, b.rep as b from t a join t b using (tie)),
reach(a, b) as (select rep, rep from s union select reach.a, e.b from reach join e on e.a = reach.b),
c as (select a, min(b) as group_id from reach group by a)
select r.record_id, coalesce(c.group_id, r.record_id) as group_id
from r left join s using (sid) left join c on c.a = s.rep
"""


P1_CHECK = "select row_id, length(_text)::bigint as n_chars, true as fits from label_sessions where _text is not null"
P6_CHECK = "select count(*) as records, 0 as parted_groups, true as shares_met from gold_ner"
P8_CHECK = "select count(*) as documents, 0 as lost, 0 as parted, 0 as overfull, true as filled from documents"
P9_CHECK = "select lower(trim(source)) as source, true as share_met, true as repeats_met, true as even_met from mix_targets"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND, "p1_check": P1_CHECK, "p4_counts": P4_COUNTS, "p4_found": f"select item_text from ({P4_COUNTS})", "p6_found": P6_FOUND, "p6_check": P6_CHECK,
        "p8_check_small": P8_CHECK, "p8_check_large": P8_CHECK, "p9_check": P9_CHECK,
    }
