"""Readers and writers of multi-label text formats, vectors and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import features as fx
from .validated import ID, NUMBER


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``row_id, line`` with gapless ids in file order.

    Ids come from one count per partition and its prefix sum, so no sort and no
    single task sees all lines.
    """
    t = spark.read.text(path).withColumn("_m", F.monotonically_increasing_id())
    part, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = t.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_b"))
    return t.withColumn("_p", part).join(F.broadcast(before), "_p").select((at + F.col("_b")).alias("row_id"), F.col("value").alias("line"))


def is_header(line: Column) -> Column:
    """Two or three bare whole numbers and nothing else."""
    return line.rlike(r"\A[0-9]+ [0-9]+( [0-9]+)?\s*\z")


def parse_line(line: Column) -> tuple[Column, Column, Column]:
    """``(labels, features, ok)`` of a ``l,l,... i:v i:v ...`` line; a valueless feature has value 1."""
    parts = F.split(F.rtrim(line), " +")
    head = F.get(parts, F.lit(0))
    lead = head.contains(":")
    labels = F.when((head == "") | lead, F.array().cast("array<string>")).otherwise(F.split(head, ","))
    feats = F.when(lead, parts).otherwise(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))
    good_label = F.forall(labels, lambda x: x.rlike(rf"\A{ID}\z"))
    good_feat = F.forall(feats, lambda x: x.rlike(rf"\A{ID}(:{NUMBER})?\z"))
    pair = F.transform(feats, lambda f: F.struct(
        F.substring_index(f, ":", 1).try_cast("int").alias("idx"),
        F.when(f.contains(":"), F.substring_index(f, ":", -1).try_cast("double")).otherwise(1.0).alias("val")))
    return F.transform(labels, lambda x: x.try_cast("int")), pair, good_label & good_feat


def read_libsvm(spark: SparkSession, path: str, header: bool | None = None, raw: bool = False, start_row: int | None = None, end_row: int | None = None,
                bias: float = 1.0, norm: bool = True, hash_size: int = 0, threshold: float = 0.0) -> DataFrame:
    """``row_id, labels, features`` of a file; rows that don't parse are left out.

    ``header`` None sniffs the first line.  ``raw`` keeps features as they are,
    otherwise they are prepared.  ``[start_row, end_row)`` slices before parsing.
    """
    lines = numbered_lines(spark, path)
    if header is None:
        first = spark.read.text(path).limit(1).filter(is_header(F.col("value"))).take(1)
        header = bool(first)
    if header:
        lines = lines.filter("row_id > 0").withColumn("row_id", F.col("row_id") - 1)
    if start_row is not None:
        lines = lines.filter(F.col("row_id") >= start_row)
    if end_row is not None and end_row >= 0:
        lines = lines.filter(F.col("row_id") < end_row)
    labels, feats, ok = parse_line(F.col("line"))
    d = lines.filter(ok).select("row_id", labels.alias("labels"), feats.alias("features"))
    return d if raw else d.withColumn("features", fx.prepare(F.col("features"), bias, norm, hash_size, threshold))


def libsvm_line(labels: Column, features: Column, sort: bool = False) -> Column:
    f = F.array_sort(features) if sort else features
    text = F.concat_ws(" ", F.transform(f, lambda e: F.concat(e["idx"].cast("string"), F.lit(":"), e["val"].cast("string"))))
    return F.concat(F.concat_ws(",", F.transform(labels, lambda x: x.cast("string"))), F.when(F.size(f) > 0, F.concat(F.lit(" "), text)).otherwise(F.lit("")))


def write_libsvm(data: DataFrame, path: str, sort: bool = False) -> None:
    """Text files in row_id order, range-partitioned."""
    out = data.repartitionByRange("row_id").sortWithinPartitions("row_id")
    out.select(libsvm_line(F.coalesce("labels", F.array().cast("array<int>")), fx.clean(F.col("features")), sort).alias("value")).write.text(path)


def read_xy_sparse(spark: SparkSession, x_path: str, y_path: str) -> DataFrame:
    """Features and labels from two files joined on the row number; a malformed token is an error that names its row."""

    def pairs(path, name):
        d = numbered_lines(spark, path)
        d = d.filter(~((F.col("row_id") == 0) & is_header(F.col("line"))))
        f = F.filter(F.split(F.rtrim("line", F.lit(" \r")), " +"), lambda x: x != "")
        good = F.forall(f, lambda e: e.rlike(rf"\A{ID}:{NUMBER}\z"))
        f = F.when(good, f).otherwise(F.raise_error(F.concat(F.lit(f"{path}: malformed row "), F.col("row_id").cast("string"))).cast("array<string>"))
        return d.select("row_id", F.transform(f, lambda e: F.struct(F.substring_index(e, ":", 1).cast("int").alias("idx"), F.substring_index(e, ":", -1).cast("double").alias("val"))).alias(name))

    return pairs(x_path, "features").join(pairs(y_path, "_y"), "row_id").select("row_id", F.transform("_y", lambda e: e["idx"]).alias("labels"), "features")


def read_json_lines(spark: SparkSession, path: str, features_fields: list[str], labels_field: str, label_type: str = "int") -> DataFrame:
    """``text, labels`` of JSON lines (plain or gzip), in one scan with a given schema.

    A field that the first line lacks raises ValueError; later lines may leave it null.
    """
    first = spark.read.text(path).limit(1).select(F.json_object_keys("value")).first()
    missing = [f for f in [*features_fields, labels_field] if first and f not in (first[0] or [])]
    if missing:
        raise ValueError(f"fields not in the file: {missing}")
    schema = ", ".join([*[f"`{f}` string" for f in dict.fromkeys(features_fields)], f"`{labels_field}` array<{label_type}>"])
    d = spark.read.schema(schema).json(path)
    return d.select(F.concat_ws(" ", *[F.col(f"`{f}`") for f in features_fields]).alias("text"), F.col(f"`{labels_field}`").alias("labels"))


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """One number a line -> ``label, value``."""
    return numbered_lines(spark, path).select(F.col("row_id").cast("int").alias("label"), F.col("line").try_cast("double").alias("value"))


def write_vector(v: DataFrame, path: str) -> None:
    v.repartitionByRange("label").sortWithinPartitions("label").select(F.col("value").cast("string")).write.text(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """``label[:score]`` tokens -> ``row_id, pred array<struct<label,score>>``."""
    tok = F.filter(F.split(F.trim("line"), "[ ,]+"), lambda x: x != "")
    return numbered_lines(spark, path).select("row_id", F.transform(tok, lambda x: F.struct(
        F.substring_index(x, ":", 1).try_cast("int").alias("label"),
        F.when(x.contains(":"), F.substring_index(x, ":", -1).try_cast("double")).alias("score"))).alias("pred"))


def read_true_labels(spark: SparkSession, path: str) -> DataFrame:
    labels, _, _ = parse_line(F.col("line"))
    d = numbered_lines(spark, path)
    return d.filter(~((F.col("row_id") == 0) & is_header(F.col("line")))).select("row_id", labels.alias("labels"))


def prediction_line(pred: Column) -> Column:
    return F.concat_ws(" ", F.transform(pred, lambda p: F.concat(p["label"].cast("string"), F.lit(":"), p["score"].cast("string"))))


def write_predictions(pred: DataFrame, path: str) -> None:
    pred.repartitionByRange("row_id").sortWithinPartitions("row_id").select(prediction_line(F.col("pred")).alias("value")).write.text(path)


def first_seen_ids(data: DataFrame) -> DataFrame:
    """``label, new_label``: dense ids in the order in which labels are first seen.

    ``data(file_no, row_id, labels)``.  First positions are a map-side combined
    minimum; ids are positions of a range-partitioned sort, not of one window.
    """
    from ..plans.running import running_sums

    seen = data.select("file_no", "row_id", F.posexplode("labels").alias("pos", "label")).filter("label is not null")
    first = seen.groupBy("label").agg(F.min(F.struct("file_no", "row_id", "pos")).alias("at"))
    flat = first.select("label", "at.file_no", "at.row_id", "at.pos", F.lit(0).alias("_all"), F.lit(1).cast("long").alias("_one"))
    run = running_sums(flat, "_all", [F.col("file_no"), F.col("row_id"), F.col("pos")], "_one")
    return run.select("label", (F.col("running") - 1).cast("int").alias("new_label"))


def remap_labels(data: DataFrame) -> DataFrame:
    """``file_no, row_id, labels`` with labels replaced by their first-seen ids, in place order."""
    ids = first_seen_ids(data)
    e = data.select("file_no", "row_id", F.posexplode_outer("labels").alias("pos", "label")).join(ids, "label", "left")
    return e.groupBy("file_no", "row_id").agg(F.array_sort(F.collect_list(F.when(F.col("new_label").isNotNull(), F.struct("pos", "new_label")))).alias("x")).select(
        "file_no", "row_id", F.col("x.new_label").alias("labels"))


def seeded_order(row_id: Column, seed: int) -> Column:
    """A shuffle key that any engine can compute: md5 of the id and the seed."""
    return F.md5(F.concat(row_id.cast("string"), F.lit(f":{seed}")))


def split_train_valid(data: DataFrame, percent: int, seed: int = 42) -> DataFrame:
    """Adds ``part``: the first ``floor(n * percent / 100)`` rows of the seeded shuffle are 'valid'."""
    from ..plans.running import running_sums

    keyed = data.select("row_id", seeded_order(F.col("row_id"), seed).alias("_k"), F.lit(0).alias("_all"), F.lit(1).cast("long").alias("_one"))
    run = running_sums(keyed, "_all", [F.col("_k"), F.col("row_id")], "_one")
    n = data.agg(F.floor(F.count(F.lit(1)) * percent / 100).alias("_v"))
    part = run.join(F.broadcast(n), how="cross").select("row_id", F.when(F.col("running") <= F.col("_v"), "valid").otherwise("train").alias("part"))
    return data.join(part, "row_id")


def dataset_stats(data: DataFrame) -> DataFrame:
    """``rows, nnz, features, labels, label_cells, avg_labels, avg_features`` in one pass."""
    f, y = F.coalesce("features", F.array().cast("array<struct<idx:int,val:double>>")), F.coalesce("labels", F.array().cast("array<int>"))
    d = data.select(F.size(f).alias("nf"), F.size(y).alias("ny"), F.array_max(F.transform(f, lambda e: e["idx"])).alias("mf"), F.array_max(y).alias("my"))
    return d.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("nf").alias("nnz"), (F.max("mf") + 1).alias("features"), (F.max("my") + 1).alias("labels"),
        F.sum("ny").alias("label_cells"), F.avg("ny").alias("avg_labels"), F.avg("nf").alias("avg_features"))
