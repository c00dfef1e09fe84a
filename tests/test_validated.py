from thicket.sources.validated import split_valid, validate_lines

SETS = [(1, "libsvm"), (2, "XY_sparse"), (3, "jsonlines"), (4, "tree_text"), (5, "other")]
DEEP = "[" * 5000 + "]" * 5000
CASES = [
    # data set, declared, line, valid
    (1, None, "1,2 3:0.5 4", True),
    (1, None, "", True),
    (1, None, " 3:1e-2 ", True),
    (1, None, "5\r", True),
    (1, 2, "1 3:1  4:.5", True),
    (1, 3, "1 3:1 4:5.", False),
    (1, None, "1,,2 3:1", False),
    (1, None, "1, 3:1", False),
    (1, None, "2147483647 1:1", True),
    (1, None, "2147483648 1:1", False),
    (1, None, "00000000001", False),
    (1, None, "1 3:1e999", False),
    (1, None, "1 3:1:2", False),
    (1, None, "1 3:nan", False),
    (1, None, "1 3:+1.5E+3", True),
    (1, None, "1\t3:1", False),
    (1, None, "1 3:١", False),
    (1, None, "1 " + " ".join(f"{i}:1" for i in range(20000)), True),
    (1, None, None, False),
    (2, None, "1:2 3:4", True),
    (2, None, " ", True),
    (2, None, "1:2 3", False),
    (3, None, '{"title":"a","content":"b","target_ind":[1,2]}', True),
    (3, 2, ' {"content":"b","title":"a","target_ind":[0,2147483647],"x":{"y":null}}\r', True),
    (3, 3, '{"title":"a","content":"b","target_ind":[1,2]}', False),
    (3, None, '{"title":"a","content":"b","target_ind":[1.0]}', False),
    (3, None, '{"title":"a","content":"b","target_ind":[true]}', False),
    (3, None, '{"title":"a","content":"b","target_ind":[1e2]}', False),
    (3, None, '{"title":"a","content":"b","target_ind":[1,]}', False),
    (3, None, '{"title":"a","content":"b","target_ind":[-1]}', False),
    (3, None, '{"title":"a","content":"b","target_ind":[],"x":NaN}', False),
    (3, None, '{"title":"a\tb","content":"b","target_ind":[]}', False),
    (3, None, '{"title":null,"content":"b","target_ind":[]}', False),
    (3, None, '{"title":"\\ud800","content":"b","target_ind":[]}', True),
    (3, None, '{"title":"a","content":"b","target_ind":[],"x":' + "9" * 5000 + "}", True),
    (3, None, '{"title":"a","content":"b","target_ind":[]} x', False),
    (3, None, "[]", False),
    (3, None, "", False),
    (3, None, DEEP, False),
    (4, None, "-1 0", True),
    (4, 9, "3 4 -1", True),
    (4, None, "3 4 5 6", False),
    (4, None, "3 -1", False),
    (4, None, "3", False),
    (5, None, "1", False),
    (None, None, "1", False),
    (9, None, "1", False),
]


def _frames(spark, cases):
    lines = spark.createDataFrame([(i, d, c, t, "x", "y") for i, (d, c, t, _) in enumerate(cases)], "line_id long, dataset_id int, declared_count int, line string, errors string, _t string")
    return lines, spark.createDataFrame(SETS, "dataset_id int, file_format string")


def test_rules(spark):
    lines, sets = _frames(spark, CASES)
    good, bad = split_valid(validate_lines(lines, sets))
    ok = {r["line_id"] for r in good.collect()}
    wrong = {r["line_id"]: r["errors"] for r in bad.collect()}
    assert [(i, CASES[i]) for i in range(len(CASES)) if (i in ok) != CASES[i][3]] == []
    assert ok.isdisjoint(wrong) and len(ok) + len(wrong) == len(CASES)
    assert all(wrong.values())


def test_values(spark):
    lines, sets = _frames(spark, [(1, None, "1,2 3:0.5 4", 1), (4, None, "7 8 9", 1), (3, None, '{"title":"a","content":"b","target_ind":[4]}', 1)])
    r = {x["line_id"]: x for x in validate_lines(lines, sets).collect()}
    assert r[0]["labels"] == [1, 2] and [tuple(f) for f in r[0]["features"]] == [(3, 0.5), (4, 1.0)]
    assert (r[1]["parent_id"], r[1]["node_id"], r[1]["label"]) == (7, 8, 9)
    assert (r[2]["title"], r[2]["labels"]) == ("a", [4])


def test_empty(spark):
    lines, sets = _frames(spark, CASES)
    assert validate_lines(lines.limit(0), sets).count() == 0
    assert validate_lines(lines, sets.limit(0)).filter("size(errors) = 0").count() == 0
