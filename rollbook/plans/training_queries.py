"""Queries of the general training-data operators (problems 4 and 6)."""

from __future__ import annotations

from rollbook.operators import drift, packed
from rollbook.work import load

QUERIES = {
    "p4_found": lambda s, d: packed.split_packed(load(s, d, "members")),
    "p6_found": lambda s, d: drift.schema_changes(load(s, d, "dump_files")),
    "p6_unified": lambda s, d: drift.unified(load(s, d, "dump_files")),
    "p6_table": lambda s, d: drift.unified_paths(load(s, d, "dump_files")),
    "p6_paths": lambda s, d: drift.path_types(load(s, d, "dump_files")),
    "p6_changes": lambda s, d: drift.path_changes(load(s, d, "dump_files")),
    "p6_renames": lambda s, d: drift.path_renames(load(s, d, "dump_files")),
}
_NAMES = {f: ", ".join(f"'{k}'" for k in keys) for f, keys in drift.ALIASES.items()}
SQL = {
    "p6_found": f"""with d as (select dump_id, arg_min(source_url, received_at) as s, arg_min(scraped_at, received_at) as t, ltrim(replace(arg_min(body, received_at), chr(65279), ''))::json as j from dump_files group by 1),
l as (select dump_id, case when json_type(j) = 'ARRAY' then j else j->'members' end as l from d), r as (select dump_id, l->i as o from (select dump_id, l, unnest(range(0, json_array_length(l)::bigint)) as i from l)),
k as (select dump_id, 'metadata' as place, unnest(json_keys(j->'metadata')) as k, j->'metadata' as o from d where json_type(j) = 'OBJECT' union all select dump_id, 'members', unnest(json_keys(o)), o from r),
b as (select dump_id, place, k, lower(regexp_replace(k, '[-_ .]', '', 'g')) as b, case json_type(o->k) when 'VARCHAR' then 'text' when 'ARRAY' then 'list' when 'OBJECT' then 'object' when 'BOOLEAN' then 'flag' when 'NULL' then null else 'number' end as kind from k),
f as (select dump_id, k, kind, case when place = 'members' and b in ({_NAMES["category"]}) then 'category' when place = 'metadata' and b in ({_NAMES["entity_type"]}) then 'entity_type' when place = 'metadata' and b in ({_NAMES["name_field"]}) then 'name_field' end as field from b),
g as (select dump_id, field, list_sort(list(distinct k)) as keys, list_sort(list(distinct kind) filter (kind is not null)) as kinds from f where field is not null group by 1, 2),
x as (select d.dump_id, d.s, d.t, n.field, g.keys, coalesce(g.kinds, []) as kinds from d cross join (values ('category'), ('entity_type'), ('name_field')) n(field) left join g on g.dump_id = d.dump_id and g.field = n.field),
y as (select *, lag(keys) over w as was, lag(kinds) over w as wk, row_number() over w as rn from x window w as (partition by s, field order by t, dump_id)),
z as (select * from y where rn > 1)
select dump_id, field, 'added' as change from z where was is null and keys is not null union all select dump_id, field, 'removed' from z where was is not null and keys is null
union all select dump_id, field, 'renamed' from z where was <> keys union all select dump_id, field, 'retyped' from z where len(coalesce(wk, [])) > 0 and len(kinds) > 0 and wk <> kinds""",
}
