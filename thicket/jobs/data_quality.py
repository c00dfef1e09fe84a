"""Queries of the general data operators: line validation and hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.hierarchy import descendants, hierarchy
from ..plans.stages import write_stage
from ..sources.validated import split_valid, validate_lines


def _lines(spark, d):
    return validate_lines(spark.read.parquet(f"{d}/raw_lines.parquet"), spark.read.parquet(f"{d}/datasets.parquet"))


def p2_found(spark, d):
    return split_valid(_lines(spark, d))[1].select("line_id")


def p2_rejects(spark, d):
    """Rejected lines with their reasons, joined by commas."""
    return split_valid(_lines(spark, d))[1].withColumn("errors", F.array_join("errors", ","))


def p2_rows(spark, d):
    return split_valid(_lines(spark, d))[0]


def _tree(spark, d):
    return hierarchy(spark.read.parquet(f"{d}/tree_nodes.parquet"))


def p4_found(spark, d):
    return _tree(spark, d).select("tree_id", "node_id", "root_id")


def p4_paths(spark, d):
    """Every node with its root, depth, path (node ids joined by '/'), status and number of descendants."""
    t = write_stage(_tree(spark, d), "tree")
    below = descendants(t).groupBy("tree_id", "node_id").agg(F.count(F.lit(1)).alias("n_descendants"))
    return t.drop("walk").withColumn("path", F.array_join("path", "/")).join(below, ["tree_id", "node_id"], "left").withColumn("n_descendants", F.coalesce("n_descendants", F.lit(0)))


def p4_descendants(spark, d):
    return descendants(_tree(spark, d))


def queries():
    return {f.__name__: f for f in (p2_found, p2_rejects, p2_rows, p4_found, p4_paths, p4_descendants)}


_TREE = """with recursive k as (select tree_id, node_id, arg_max(struct_pack(p := parent_id, c := children), updated_at) x from tree_nodes where tree_id is not null and node_id is not null group by 1, 2),
e as (select tree_id, ch node_id, min(by_node) p from (select tree_id, node_id by_node, unnest(x.c) ch from k) where ch is not null group by 1, 2),
l as (select k.tree_id, k.node_id, case when k.x.p is null then e.p else k.x.p end p from k left join e on e.tree_id = k.tree_id and e.node_id = k.node_id),
par as (select l.tree_id, l.node_id, o.node_id p from l left join k o on o.tree_id = l.tree_id and o.node_id = l.p),
down(tree_id, node_id, root_id, depth, path) as (select tree_id, node_id, node_id, 0, [node_id] from par where p is null
  union all select par.tree_id, par.node_id, root_id, depth + 1, list_append(path, par.node_id) from down join par on par.tree_id = down.tree_id and par.p = down.node_id)"""
_UP = f"""{_TREE}, up(tree_id, s, n, d, seen) as (select tree_id, node_id, p, 1, [node_id, p] from par where p is not null and p <> node_id
  union all select par.tree_id, s, par.p, d + 1, list_append(seen, par.p) from up join par on par.tree_id = up.tree_id and par.node_id = up.n where par.p is not null and not list_contains(seen, par.p))"""
_NUM = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_LINES = rf"""with t as (select line_id, dataset_id, line, declared_count dc, file_format ff, rtrim(line, ' ' || chr(13)) tx from raw_lines left join datasets using (dataset_id)),
f as (select *, string_split_regex(tx, ' +') fs from t),
s as (select *, case when ff = 'libsvm' then fs[2:] when tx = '' then [] else fs end ft from f),
c as (select *, list_filter(ft, lambda x: not (regexp_full_match(x, '[0-9]{{1,10}}:{_NUM}') or (ff = 'libsvm' and regexp_full_match(x, '[0-9]{{1,10}}')))
    or try_cast(split_part(x, ':', 1) as bigint) > 2147483647 or not coalesce(isfinite(try_cast(case when x like '%:%' then split_part(x, ':', 2) else '1' end as double)), false)) wrong,
  regexp_replace(line, '"(\\.|[^"\\])*"', '""', 'g') bare from s),
j as (select *, case when ff = 'jsonlines' and json_valid(line) and not regexp_matches(bare, ',\s*[\]}}]') and not regexp_matches(bare, 'NaN|nan|Inf|inf|/\*|//') then line::json end js from c)"""
_FOUND = rf"""{_LINES} select line_id from j where coalesce(line is null or ff is null or case
  when ff = 'libsvm' then not (fs[1] = '' or regexp_full_match(fs[1], '[0-9]{{1,10}}(,[0-9]{{1,10}})*')) or len(list_filter(string_split(fs[1], ','), lambda x: try_cast(x as bigint) > 2147483647)) > 0
     or len(wrong) > 0 or dc <> len(ft)
  when ff = 'XY_sparse' then len(wrong) > 0 or dc <> len(ft)
  when ff = 'tree_text' then len(fs) not in (2, 3) or not regexp_full_match(fs[1], '-1|[0-9]{{1,10}}') or not regexp_full_match(fs[2], '[0-9]{{1,10}}') or (len(fs) = 3 and not regexp_full_match(fs[3], '-1|[0-9]{{1,10}}'))
     or len(list_filter(fs, lambda x: try_cast(x as bigint) > 2147483647)) > 0
  when ff = 'jsonlines' then js is null or json_type(js) <> 'OBJECT' or json_type(js, '$.title') is distinct from 'VARCHAR' or json_type(js, '$.content') is distinct from 'VARCHAR'
     or json_type(js, '$.target_ind') is distinct from 'ARRAY'
     or len(list_filter(json_extract(js, '$.target_ind[*]'), lambda x: json_type(x) not in ('UBIGINT', 'BIGINT') or not coalesce(try_cast(x::varchar as hugeint) between 0 and 2147483647, false))) > 0
     or dc <> json_array_length(js, '$.target_ind')
  else true end, false)"""
_REASONS = rf"""{_LINES}, w as (select line_id, dataset_id, ff, [
  case when line is null then 'null_line' end,
  case when ff is null or ff not in ('libsvm', 'XY_sparse', 'tree_text', 'jsonlines') then 'unknown_format' end,
  case when ff = 'libsvm' and (not (fs[1] = '' or regexp_full_match(fs[1], '[0-9]{{1,10}}(,[0-9]{{1,10}})*')) or len(list_filter(string_split(fs[1], ','), lambda x: try_cast(x as bigint) > 2147483647)) > 0) then 'bad_label' end,
  case when ff in ('libsvm', 'XY_sparse') and len(wrong) > 0 then 'bad_feature' end,
  case when ff = 'tree_text' and len(fs) not in (2, 3) then 'field_count' end,
  case when ff = 'tree_text' and len(fs) in (2, 3) and fs[1] <> '-1' and not coalesce(regexp_full_match(fs[1], '[0-9]{{1,10}}') and try_cast(fs[1] as bigint) <= 2147483647, false) then 'bad_parent' end,
  case when ff = 'tree_text' and len(fs) in (2, 3) and not coalesce(regexp_full_match(fs[2], '[0-9]{{1,10}}') and try_cast(fs[2] as bigint) <= 2147483647, false) then 'bad_node' end,
  case when ff = 'tree_text' and len(fs) = 3 and fs[3] <> '-1' and not coalesce(regexp_full_match(fs[3], '[0-9]{{1,10}}') and try_cast(fs[3] as bigint) <= 2147483647, false) then 'bad_tree_label' end,
  case when dc <> case when ff in ('libsvm', 'XY_sparse') then len(ft) when ff = 'jsonlines' and json_type(js) = 'OBJECT' and json_type(js, '$.target_ind') = 'ARRAY' then json_array_length(js, '$.target_ind') end then 'declared_count' end,
  case when ff = 'jsonlines' and line is not null and js is null then 'json_syntax' end,
  case when ff = 'jsonlines' and json_type(js) <> 'OBJECT' then 'json_not_object' end,
  case when ff = 'jsonlines' and json_type(js) = 'OBJECT' and json_type(js, '$.title') is distinct from 'VARCHAR' then 'json_title' end,
  case when ff = 'jsonlines' and json_type(js) = 'OBJECT' and json_type(js, '$.content') is distinct from 'VARCHAR' then 'json_content' end,
  case when ff = 'jsonlines' and json_type(js) = 'OBJECT' and (json_type(js, '$.target_ind') is distinct from 'ARRAY'
     or len(list_filter(json_extract(js, '$.target_ind[*]'), lambda x: json_type(x) not in ('UBIGINT', 'BIGINT') or not coalesce(try_cast(x::varchar as hugeint) between 0 and 2147483647, false))) > 0) then 'json_target_ind' end] e from j)
select line_id, dataset_id, ff file_format, array_to_string(list_filter(e, lambda x: x is not null), ',') errors from w where len(list_filter(e, lambda x: x is not null)) > 0"""


def oracle_sql():
    found = f"{_TREE} select k.tree_id, k.node_id, coalesce(root_id, -1) root_id from k left join down using (tree_id, node_id)"
    paths = f"""{_UP}, ds as (select tree_id, n node_id, count(*) c from up group by 1, 2),
        cyc as (select distinct par.tree_id, s node_id from up join par on par.tree_id = up.tree_id and par.node_id = up.n where par.p = s union select tree_id, node_id from par where p = node_id)
        select k.tree_id, k.node_id, coalesce(root_id, -1) root_id, depth, array_to_string(path, '/') path,
          case when root_id is not null then 'tree' when cyc.node_id is not null then 'cycle' else 'below_cycle' end status, coalesce(c, 0) n_descendants
        from k left join down using (tree_id, node_id) left join ds using (tree_id, node_id) left join cyc using (tree_id, node_id)"""
    return {
        "p2_found": _FOUND,
        "p2_rejects": _REASONS,
        "p4_found": found,
        "p4_paths": paths,
        "p4_descendants": f"{_UP} select tree_id, n node_id, s descendant_id, d distance from up",
    }
