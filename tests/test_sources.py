import gzip
import json

import pytest
from pyspark.sql import functions as F

from thicket import cli
from thicket.functions import features as fx
from thicket.sources import files, registry

LINES = ["5 9 8", "1,2 3:0.5 1:2 7", "4 2:1", " 3:1", "6", "x 1:2", "1 2:a", "7,8 5:1.5"]


def lib(tmp_path, lines=LINES):
    p = tmp_path / "d.txt"
    p.write_text("\n".join(lines) + "\n")
    return str(p)


def test_read_libsvm(spark, tmp_path):
    r = files.read_libsvm(spark, lib(tmp_path), raw=True).orderBy("row_id").collect()
    assert [x["row_id"] for x in r] == [0, 1, 2, 3, 6]
    assert r[0]["labels"] == [1, 2] and [tuple(f) for f in r[0]["features"]] == [(3, 0.5), (1, 2.0), (7, 1.0)]
    assert r[2]["labels"] == [] and [tuple(f) for f in r[2]["features"]] == [(3, 1.0)] and r[3]["features"] == []
    part = files.read_libsvm(spark, lib(tmp_path), raw=True, start_row=1, end_row=3).collect()
    assert sorted(x["row_id"] for x in part) == [1, 2]
    prepared = files.read_libsvm(spark, lib(tmp_path)).filter("row_id = 1").first()
    assert [tuple(f) for f in prepared["features"]] == [(-1, 1.0), (2, 1.0)]
    none = files.read_libsvm(spark, lib(tmp_path, LINES[1:3]), raw=True)
    assert none.count() == 2


def test_write_round_trip(spark, tmp_path):
    d = files.read_libsvm(spark, lib(tmp_path), raw=True)
    files.write_libsvm(d, str(tmp_path / "out"), sort=True)
    back = files.read_libsvm(spark, str(tmp_path / "out"), header=False, raw=True).orderBy("row_id").collect()
    want = d.withColumn("features", F.array_sort("features")).orderBy("row_id").collect()
    assert [(r["labels"], r["features"]) for r in back] == [(r["labels"], r["features"]) for r in want]


def test_other_formats(spark, tmp_path):
    (tmp_path / "x").write_text("2 9\n1:0.5 3:1\n\n")
    (tmp_path / "y").write_text("2 9\n4:1 6:1\n2:1\n")
    r = files.read_xy_sparse(spark, str(tmp_path / "x"), str(tmp_path / "y")).orderBy("row_id").collect()
    assert [x["labels"] for x in r] == [[4, 6], [2]] and [len(x["features"]) for x in r] == [2, 0]
    with gzip.open(tmp_path / "j.json.gz", "wt") as f:
        f.write(json.dumps({"title": "a", "content": "b", "target_ind": [1]}) + "\n")
    j = files.read_json_lines(spark, str(tmp_path / "j.json.gz"), ["title", "content"], "target_ind").first()
    assert (j["text"], j["labels"]) == ("a b", [1])
    with pytest.raises(ValueError):
        files.read_json_lines(spark, str(tmp_path / "j.json.gz"), ["nothing"], "target_ind")
    (tmp_path / "v").write_text("0.5\n1e-3\n")
    assert {tuple(x) for x in files.read_vector(spark, str(tmp_path / "v")).collect()} == {(0, 0.5), (1, 0.001)}
    (tmp_path / "p").write_text("3:0.5 4:0.25 \n7\n")
    pred = files.read_predictions(spark, str(tmp_path / "p"))
    assert [tuple(e) for e in pred.filter("row_id = 0").first()["pred"]] == [(3, 0.5), (4, 0.25)]
    files.write_predictions(pred, str(tmp_path / "po"))
    assert files.read_predictions(spark, str(tmp_path / "po")).filter("row_id = 0").first()["pred"] == pred.filter("row_id = 0").first()["pred"]


def test_remap_split_stats(spark):
    d = spark.createDataFrame([(0, 0, [5, 3]), (0, 1, None), (1, 0, [3, 9, 5])], "file_no int, row_id long, labels array<int>")
    assert {r["label"]: r["new_label"] for r in files.first_seen_ids(d).collect()} == {5: 0, 3: 1, 9: 2}
    assert [r["labels"] for r in files.remap_labels(d).orderBy("file_no", "row_id").collect()] == [[0, 1], [], [1, 2, 0]]
    s = files.split_train_valid(spark.range(101).select(F.col("id").alias("row_id")), 30)
    assert s.filter("part = 'valid'").count() == 30


def test_feature_algebra(spark):
    d = spark.createDataFrame([([(3, 3.0), (1, 4.0), (3, 0.0), (2, None), None],), (None,), ([],)], "f array<struct<idx:int,val:double>>")
    one = lambda c: [[(e["idx"], round(e["val"], 6)) for e in r[0]] for r in d.select(c).collect()]
    f = fx.combine(F.col("f"))
    assert one(f) == [[(1, 4.0), (3, 3.0)], [], []]
    assert one(fx.unit_norm(f)) == [[(1, 0.8), (3, 0.6)], [], []]
    assert one(fx.threshold_abs(f, 3.0)) == [[(1, 4.0)], [], []]
    assert one(fx.prepare(F.col("f")))[1:] == [[(-1, 1.0)]] * 2
    assert one(fx.subtract(f, f)) == [[], [], []] and one(fx.add(f, f))[0] == [(1, 8.0), (3, 6.0)]
    assert one(fx.shift(fx.add_bias(f)))[0] == [(-1, 1.0), (3, 4.0), (5, 3.0)]
    h = 2166136261
    for byte in (5, 0, 0, 0):
        h = ((h ^ byte) * 16777619) & 0xFFFFFFFF
    assert spark.range(1).select(fx.fnv1a(F.lit(5))).first()[0] == h
    assert d.select(fx.dot(f, f)).first()[0] == 25.0
    assert d.select(fx.sparse_to_dense(f, 4)).first()[0] == [0.0, 4.0, 0.0, 3.0]
    assert one(fx.hash_features(F.col("f"), 1))[0] == [(2, 7.0)]


def test_registry(spark, tmp_path):
    assert len(registry.DATASETS) == 23
    assert registry.dataset_meta("EURLex-4K", "tf-idf")["file_format"] == "libsvm"
    for bad in (("nothing", "bow"), ("yeast", "raw")):
        with pytest.raises(ValueError):
            registry.dataset_meta(*bad)
    (tmp_path / "yeast_bow").mkdir()
    (tmp_path / "yeast_bow" / "train.txt").write_text("1 2:3\n")
    assert registry.load_dataset(spark, "yeast", root=str(tmp_path)).count() == 1
    with pytest.raises(ValueError):
        registry.load_dataset(spark, "yeast", "validation", root=str(tmp_path))


def test_command_line(spark, tmp_path):
    lines = [f"{i % 3} {i % 3}:1 {3 + i % 7}:0.3" for i in range(90)]
    path, out = lib(tmp_path, lines), str(tmp_path / "model")
    assert cli.main(["train", "-i", path, "-o", out, "--treeType", "completeKaryInOrder"], spark)["rows"] == 90
    r = cli.main(["test", "-i", path, "-o", out, "--metrics", "p@1,r@1,ndcg@3,hl,c@1,microf1,macrof1"], spark)
    assert r["p@1"] == 1.0 and r["r@1"] == 1.0 and r["c@1"] == 1.0
    cli.main(["predict", "-i", path, "-o", out, "--topK", "2"], spark)
    cli.main(["ofo", "-i", path, "-o", out, "--ofoType", "mixed"], spark)
    assert files.read_vector(spark, out + "/thresholds").count() == 3
    assert 0 <= cli.main(["test", "-i", path, "-o", out, "--metrics", "hl", "--thresholds", out + "/thresholds", "--topK", "0"], spark)["hl"] <= 1
    for extra in (["-m", "oplt", "--onlineTreeAlpha", "0.7", "--threads", "4"], ["-m", "oplt", "--resume", "1"], ["-m", "extremeText", "--dims", "8", "--epochs", "5", "--eta", "0.5"]):
        own = out + extra[1]
        cli.main(["train", "-i", path, "-o", own, *extra], spark)
        assert cli.main(["test", "-i", path, "-o", own, "--metrics", "p@1"], spark)["p@1"] > 0.6
    with pytest.raises(SystemExit):
        cli.main(["train", "-i", path, "-o", out, "--resume", "1"], spark)
    assert cli.main(["version"])["version"]
