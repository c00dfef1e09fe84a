"""Queries of the file formats: records are written, read back, and stated by SQL over their origin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels
from ..plans.running import running_sums
from ..plans.stages import stage_path, write_stage
from ..sources import adapters, files, registry
from .reference import _P, newest_scores, points


def _numbered(spark, d):
    """Data points with gapless numbers in order of their ids, values in thousandths, as files hold them."""
    p = points(spark, d)
    whole = F.transform("features", lambda f: F.struct(f["idx"].alias("idx"), F.round(f["val"] * 1000).cast("int").alias("val")))
    p = p.select("row_id", F.array_compact("labels").alias("labels"), whole.alias("features"), F.lit(0).alias("_all"), F.lit(1).cast("long").alias("_one"))
    keys = running_sums(p.select("row_id", "_all", "_one"), "_all", [F.col("row_id")], "_one").select("row_id", (F.col("running") - 1).alias("no"))
    return write_stage(p.join(keys, "row_id").select("no", "labels", "features"), "numbered")


def _text(lines, path):
    lines.repartitionByRange("no").sortWithinPartitions("no").select("value").write.text(path)


def _long(d):
    return d.select("row_id", F.size("labels").alias("n_labels"), F.explode("features").alias("f")).select("row_id", "n_labels", F.col("f.idx").alias("idx"), F.col("f.val").alias("val"))


def read_libsvm_file(spark, d):
    """A file with header and a line that doesn't parse behind every hundredth; a slice of it is read."""
    path = stage_path(spark, "libsvm")
    p = _numbered(spark, d)
    good = p.select((F.col("no") * 2).alias("no"), files.libsvm_line("labels", "features", True).alias("value"))
    bad = p.filter("no % 100 = 0").select((F.col("no") * 2 + 1).alias("no"), F.lit("1,x 3:0.5").alias("value"))
    head = p.agg(F.lit(-1).cast("long").alias("no"), F.concat(F.count(F.lit(1)).cast("string"), F.lit(" 100 100")).alias("value"))
    _text(good.unionByName(bad).unionByName(head), path)
    return _long(files.read_libsvm(spark, path, raw=True, start_row=101, end_row=1010))


def read_xy_files(spark, d):
    x, y = stage_path(spark, "x"), stage_path(spark, "y")
    p = _numbered(spark, d)
    pairs = lambda c: F.concat_ws(" ", c)
    _text(p.select("no", pairs(F.transform("features", lambda f: F.concat(f["idx"].cast("string"), F.lit(":"), f["val"].cast("string")))).alias("value")), x)
    _text(p.select("no", pairs(F.transform("labels", lambda v: F.concat(v.cast("string"), F.lit(":1")))).alias("value")), y)
    return _long(files.read_xy_sparse(spark, x, y))


def read_json_file(spark, d):
    path = stage_path(spark, "json")
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("text is not null")
    docs.select(F.col("lang").alias("title"), F.col("text").alias("content"), F.array("n_cues").alias("target_ind"), "doc_id").write.option("ignoreNullFields", "false").option("compression", "gzip").json(path)
    t = files.read_json_lines(spark, path, ["title", "content"], "target_ind")
    return t.groupBy(F.md5("text").alias("digest"), F.get("labels", F.lit(0)).alias("cues")).agg(F.count(F.lit(1)).alias("rows"))


def read_vector_file(spark, d):
    path = stage_path(spark, "vector")
    files.write_vector(labels.count_labels(points(spark, d)).select("label", F.col("cnt").alias("value")), path)
    return files.read_vector(spark, path)


def read_prediction_file(spark, d):
    """Scores in thousandths, best first, one line a run and row."""
    path = stage_path(spark, "predictions")
    s = newest_scores(spark, d).filter("score is not null and not isnan(score)").select("run_id", "row_id", "label", F.round(F.col("score") * 1000).cast("long").alias("score"))
    one = s.groupBy("run_id", "row_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "label", "score"))).alias("pred"))
    keyed = one.select((F.col("row_id") * 1000 + F.col("run_id")).alias("row_id"), F.transform("pred", lambda p: F.struct(p["label"].alias("label"), p["score"].alias("score"))).alias("pred"))
    files.write_predictions(keyed, path)
    got = files.read_predictions(spark, path).select("row_id", F.posexplode("pred").alias("pos", "p"))
    return got.select("row_id", "pos", F.col("p.label").alias("label"), F.col("p.score").alias("score"))


def read_true_file(spark, d):
    path = stage_path(spark, "true")
    _text(_numbered(spark, d).select("no", files.libsvm_line("labels", "features", True).alias("value")), path)
    return files.read_true_labels(spark, path).select("row_id", F.explode("labels").alias("label")).groupBy("row_id", "label").agg(F.count(F.lit(1)).alias("times"))


def load_registered_set(spark, d):
    """A subset laid out as its registry entry says."""
    import os

    root = stage_path(spark, "data")
    m = registry.dataset_meta("EURLex-4K")
    p = _numbered(spark, d).select("no", files.libsvm_line("labels", "features", True).alias("value"))
    _text(p, os.path.join(root, f"{m['key']}_{m['format']}", "train.txt"))
    return _long(registry.load_dataset(spark, "eurlex_4k", "train", "tf-idf", root))


def csr_rows(spark, d):
    """Where each row's slice of a sparse matrix starts and how long it is."""
    return adapters.to_csr(points(spark, d)).select("row_id", "indptr", F.size("indices").alias("n"))


_ALL = [read_libsvm_file, read_xy_files, read_json_file, read_vector_file, read_prediction_file, read_true_file, load_registered_set, csr_rows]


def queries():
    return {f.__name__: f for f in _ALL}


def oracle_sql():
    no = f"with {_P}, o as (select row_id, row_number() over (order by row_id) - 1 no, x from r), v as (select row_id, idx, round(val * 1000)::int val from f)"
    size = "coalesce(len(list_filter(x.l, lambda v: v is not null)), 0)::int"
    # a bad line stands behind every hundredth record, so file rows run ahead of records
    return {
        "read_libsvm_file": f"{no}, q as (select *, no + (no + 99) // 100 place from o) select place row_id, {size} n_labels, idx, val::double val from q join v using (row_id) where place >= 101 and place < 1010",
        "read_xy_files": f"{no} select no row_id, {size} n_labels, idx, val::double val from o join v using (row_id)",
        "read_json_file": "select md5(coalesce(lang || ' ', '') || text) digest, n_cues cues, count(*) as rows from documents where text is not null group by 1, 2",
        "read_vector_file": f"with {_P} select i::int as label, coalesce(cnt, 0)::double \"value\" from range((select max(label) + 1 from c)) g(i) left join c on c.label = i",
        "read_prediction_file": """with k as (select run_id, row_id, label, arg_max(struct_pack(s := score), scored_at).s score from predictions where label is not null group by 1, 2, 3),
            s as (select run_id, row_id, label, round(score * 1000)::bigint score from k where score is not null and not isnan(score)), n as (select *, row_number() over (partition by run_id, row_id order by score desc, label) - 1 pos from s)
            select dense_rank() over (order by row_id, run_id) - 1 row_id, pos::int pos, label, score::double score from n""",
        "read_true_file": f"{no} select no row_id, label, count(*) times from (select no, unnest(x.l) as label from o) where label is not null group by 1, 2",
        "load_registered_set": f"{no} select no row_id, {size} n_labels, idx, val::double val from o join v using (row_id)",
        "csr_rows": f"with {_P}, w as (select r.row_id, count(f.idx) n from r left join f using (row_id) group by 1) select row_id, (sum(n) over (order by row_id) - n)::bigint indptr, n::int n from w",
    }
