"""The llm queries for the driver, and the SQL that states them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stages import write_stage
from .cooccurrence import associations
from .density import density_clusters, describe_clusters
from .mixing import draw_mixture
from .ngrams import marked_terms, sequence_counts
from .overlap import expand_pairs, overlap_report, similar_across
from .records import records
from .spans import shared_spans, span_coverage, span_pairs
from .tokenizer import decoded, encode_documents, token_counts, token_ids
from .topn import top_n_per_group


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_terms(spark, d):
    one = write_stage(records(_t(spark, d, "data_points"), "label_list", "feature_list"), "records")
    counts = sequence_counts(one, {"label": "label_list", "feature": "feature_list"})
    return marked_terms(counts, one.agg(F.count(F.lit(1)).alias("n")))


def p1_found(spark, d):
    return p1_terms(spark, d).filter("mark is not null").select("item_kind", "item", "mark")


def p1_ngrams(spark, d):
    """Runs of up to three label ids, as they follow each other in the label lists (ids joined by blanks)."""
    lists = write_stage(records(_t(spark, d, "data_points"), "label_list"), "records")
    return sequence_counts(lists, {"label": "label_list"}, 3).select("item_kind", "n", F.array_join("gram", " ").alias("gram"), "occurrences", "records")


def p3_top(spark, d):
    return top_n_per_group(_t(spark, d, "predictions"), 5)


def p3_found(spark, d):
    return p3_top(spark, d).select("run_id", "row_id", "label")


def _p5(spark, d):
    r = write_stage(records(_t(spark, d, "data_points"), "features", "subset", "dataset_id"), "records")
    side = F.when(F.col("subset") == "train", 0).when(F.col("subset").isin("test", "validation"), 1)
    pairs, members = similar_across(r.select("rec", side.alias("side"), F.col("features").alias("items")))
    return r, write_stage(pairs, "classpairs"), members


def p5_found(spark, d):
    _, pairs, members = _p5(spark, d)
    e = expand_pairs(pairs, members)
    return e.select(F.least("rec_0", "rec_1").alias("row_id_a"), F.greatest("rec_0", "rec_1").alias("row_id_b"))


def p5_report(spark, d):
    r, pairs, members = _p5(spark, d)
    return overlap_report(pairs, members, r.select("rec", "subset", "dataset_id"))


def _p6(spark, d):
    return density_clusters(_t(spark, d, "similarities"))


def p6_found(spark, d):
    return _p6(spark, d).select("point_idx", "cluster_idx")


def p6_members(spark, d):
    """Clustered points with their density and the cosine to their nearest denser neighbour (null for peaks)."""
    return _p6(spark, d).select("point_idx", "cluster_idx", "density", F.round("cosine", 6).alias("cosine"))


def p6_clusters(spark, d):
    """Clusters with their size, number of peaks and three most typical points, joined by commas."""
    return describe_clusters(_p6(spark, d)).withColumn("typical", F.array_join("typical", ","))


def _p7(spark, d, *least):
    return associations(records(_t(spark, d, "data_points"), "labels").select(F.col("labels").alias("items")), *least)


def _lifted(pairs):
    return pairs.filter(F.col("n_ab") * F.col("n") >= 5 * F.col("n_a") * F.col("n_b")).select("label_a", "label_b")


def p7_pairs(spark, d):
    return _p7(spark, d, 1)


def p7_found(spark, d):
    """Both labels together in at least 5 records; its SQL asks that of each label only."""
    return _lifted(_p7(spark, d, 1, 5))


def p7_together(spark, d):
    """As p7_found, with SQL for the same rows."""
    return p7_found(spark, d)


def p8_ids(spark, d):
    return encode_documents(_t(spark, d, "documents"))


def p8_roundtrip(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    ids = docs.select("doc_id", "text", token_ids(spark, F.col("text")).alias("ids"))
    back = ids.select("doc_id", "text", F.size("ids").alias("n_ids"), decoded(spark, F.col("ids")).alias("back"))
    return back.select("doc_id", F.coalesce("n_ids", F.lit(0)).alias("n_ids"), F.col("text").eqNullSafe(F.col("back")).alias("same"))


def p8_decoded(spark, d):
    """The texts again, from their ids."""
    docs = _t(spark, d, "documents")
    ids = docs.select("doc_id", token_ids(spark, F.col("text")).alias("ids"))
    return ids.select("doc_id", decoded(spark, F.col("ids")).alias("text"))


def _p9(spark, d):
    docs = _t(spark, d, "documents")
    # quality: complete files weigh more than fragments; unknown cue counts little
    weight = F.coalesce(F.least(F.col("n_cues") / 50.0, F.lit(1.0)), F.lit(0.1))
    sized = docs.select(F.col("doc_id").alias("id"), "source", token_counts(spark, F.col("text")).alias("size"), weight.alias("weight"))
    return draw_mixture(write_stage(sized, "sizes"), _t(spark, d, "mix_targets"))


def p9_draw(spark, d):
    return _p9(spark, d)[0].select(F.col("id").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "times")


def p9_report(spark, d):
    return _p9(spark, d)[1]


def p9_audit(spark, d):
    """The report of each source against its draw: shares, repeats, and the distance from its target."""
    draw, report = _p9(spark, d)
    got = draw.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("got"), F.max("times").alias("most"), F.max("size").alias("largest"))
    every = got.agg(F.sum("got").alias("every"))  # one row
    j = report.join(got, "source", "left").join(F.broadcast(every), how="cross").fillna(0, ["got", "most", "largest"])
    share = F.abs(F.col("actual_share") - F.coalesce(F.try_divide("got", "every"), F.lit(0.0))) < 1e-12
    # half of the last record, or all repeats used up
    near = (F.abs(F.col("got") - F.col("target")) <= F.col("largest") / 2 + 1) | (F.col("got") == F.col("available") * F.col("max_repeats"))
    return j.select("source", (share & (F.col("got") == F.col("taken"))).alias("shares_agree"), (F.col("most") <= F.col("max_repeats")).alias("within_repeats"), near.alias("target_met"))


def p10_found(spark, d):
    return span_pairs(*shared_spans(_t(spark, d, "documents")))


def p10_coverage(spark, d):
    docs = _t(spark, d, "documents")
    return span_coverage(docs, *shared_spans(docs)).withColumn("shared_chars", F.col("shared_chars").cast("int"))


def queries():
    every = (p1_found, p1_terms, p1_ngrams, p3_found, p3_top, p5_found, p5_report, p6_found, p6_clusters, p6_members, p7_found, p7_pairs, p7_together, p8_ids, p8_decoded, p8_roundtrip, p9_draw, p9_report, p9_audit, p10_found, p10_coverage)
    return {f.__name__: f for f in every}


_REC = "r as (select row_id, arg_max(struct_pack(l := labels, f := features, s := lower(trim(subset)), d := dataset_id), loaded_at) x from data_points where row_id is not null group by 1)"
_TERMS = f"""with {_REC}, i as (select 'label' item_kind, row_id, unnest(x.l) item from r union all select 'feature', row_id, unnest(x.f).idx from r),
c as (select item_kind, item::bigint item, count(*) occurrences, count(distinct row_id) records from i where item is not null group by 1, 2)
select *, case when records < 3 then 'rare' when records > 0.05 * (select count(*) from r) then 'common' end mark from c"""
_TOP = """with k as (select run_id, row_id, label, arg_max(struct_pack(s := score), scored_at).s score from predictions where label is not null group by 1, 2, 3),
s as (select *, row_number() over (partition by run_id, row_id order by score desc, label) as position from k where score is not null and not isnan(score))
select run_id, row_id, label, score, position from s where position <= 5"""
_NEAR = f"""with {_REC}, i as (select distinct row_id, x.s s, x.d d, f.idx idx from (select row_id, x, unnest(x.f) f from r) where f.idx is not null),
n as (select row_id, s, d, count(*) n from i group by 1, 2, 3 having count(*) >= 5),
p as (select a.row_id a, b.row_id b, count(*) c from i a join i b using (idx) where a.s = 'train' and b.s in ('test', 'validation') group by 1, 2),
q as (select a, b, c, na.n + nb.n - c u, nb.s subset, nb.d dataset_id from p join n na on na.row_id = a join n nb on nb.row_id = b where 5 * c >= 4 * (na.n + nb.n - c))"""
_SIM = """with recursive v as (select distinct point_idx p, s.idx i, s.val v from (select point_idx, unnest(sim_values) s from similarities) where s.val <> 0 and not isnan(s.val)),
u as (select p, i, v / sqrt(sum(v * v) over (partition by p)) v from v),
e as (select a.p a, b.p b, sum(a.v * b.v) c from u a join u b on a.i = b.i and a.p <> b.p group by 1, 2 having sum(a.v * b.v) >= 0.9),
reach(p, c) as (select distinct a, a from e union select reach.p, e.b from reach join e on e.a = reach.c),
g as (select p point_idx, min(c) cluster_idx from reach group by 1),
n as (select a p, count(*) density from e group by 1),
m as (select point_idx, cluster_idx, any_value(x.density) density, max(e.c) filter (y.density > x.density or (y.density = x.density and y.p < x.p)) cosine
  from g join n x on x.p = point_idx join e on e.a = point_idx join n y on y.p = e.b group by 1, 2)"""


def _cooc(least):
    return f"""with {_REC}, i as (select distinct row_id, item from (select row_id, unnest(x.l) item from r) where item is not null),
m as (select item, count(*) n from i group by 1 having count(*) >= {least}), k as (select count(*) n from r),
p as (select a.item label_a, b.item label_b, count(*) n_ab from i a join i b on a.row_id = b.row_id and a.item < b.item group by 1, 2)
select label_a, label_b, n_ab, a.n n_a, b.n n_b, k.n n, n_ab * k.n / (a.n::double * b.n) lift, log2(n_ab * k.n / (a.n::double * b.n)) pmi
from p join m a on a.item = label_a join m b on b.item = label_b, k"""


_COVER = """with w as (select doc_id, i, substr(text, i, 200) s from (select doc_id, text, unnest(range(1, length(text) - 198)) i from documents where length(text) >= 200)),
m as (select s from w group by 1 having count(distinct doc_id) > 1),
g as (select doc_id, least(200, coalesce(lead(i) over (partition by doc_id order by i) - i, 200)) n from w join m using (s)), c as (select doc_id, sum(n) n from g group by 1)
select doc_id, coalesce(length(text), 0)::int n_chars, coalesce(n, 0)::int shared_chars from documents left join c using (doc_id)"""
_SPANS = """with w as (select distinct doc_id, substr(text, i, 200) s from (select doc_id, text, unnest(range(1, length(text) - 198)) i from documents where length(text) >= 200)),
m as (select s from w group by 1 having count(*) > 1), h as (select w.* from w join m using (s))"""


def oracle_sql():
    return {
        "p1_terms": _TERMS,
        "p1_ngrams": f"""with {_REC}, l as (select row_id, list_filter(x.l, lambda v: v is not null) l from r),
            g as (select row_id, n::int n, array_to_string(l[i:i + n - 1], ' ') gram from l, range(1, 4) s(n), range(1, (select coalesce(max(len(l)), 0) + 1 from l)) t(i) where i + n - 1 <= len(l))
            select 'label' item_kind, n, gram, count(*) occurrences, count(distinct row_id) records from g group by 2, 3""",
        "p1_found": f"select item_kind, item, mark from ({_TERMS}) where mark is not null",
        "p3_top": _TOP,
        "p3_found": f"select run_id, row_id, label from ({_TOP})",
        "p5_found": f"{_NEAR} select least(a, b) row_id_a, greatest(a, b) row_id_b from q",
        "p5_report": f"""{_NEAR}, best as (select b, max(c / u) j from q group by 1)
            select s subset, d dataset_id, count(*) records, sum((coalesce(j, 0) = 1)::int)::bigint exact, sum((coalesce(j, 2) < 1)::int)::bigint near
            from n left join best on b = row_id where s in ('test', 'validation') group by 1, 2""",
        "p6_found": f"{_SIM} select point_idx, cluster_idx from g",
        "p6_members": f"{_SIM} select point_idx, cluster_idx, density, round(cosine, 6) cosine from m",
        "p6_clusters": f"""{_SIM}, o as (select *, row_number() over (partition by cluster_idx order by density desc, point_idx) pos from m)
            select cluster_idx, count(*) size, sum((cosine is null)::int)::bigint peaks, string_agg(point_idx::varchar, ',' order by pos) filter (pos <= 3) typical from o group by 1""",
        "p7_pairs": _cooc(1),
        "p7_found": f"select label_a, label_b from ({_cooc(5)}) where n_ab * n >= 5 * n_a * n_b",
        "p7_together": f"select label_a, label_b from ({_cooc(1)}) where n_ab >= 5 and n_ab * n >= 5 * n_a * n_b",
        "p8_decoded": "select doc_id, text from documents",
        "p9_audit": "select distinct source, true shares_agree, true within_repeats, true target_met from mix_targets where source is not null",
        "p10_coverage": _COVER,
        "p10_found": f"{_SPANS} select distinct a.doc_id doc_id_a, b.doc_id doc_id_b from h a join h b using (s) where a.doc_id < b.doc_id",
    }
