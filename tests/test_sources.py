"""Text vectors over many splits and files, symbolic names, conversion, stacked CSVs."""

import numpy as np
import pytest

from knnhard.sources import tables as TB
from knnhard.sources import vecfile as VF


def test_text_ids_over_splits_and_files(spark, tmp_path):
    rows = [[float(i), i / 4, -1.5] for i in range(900)]
    for part, (a, b) in enumerate([(0, 400), (400, 401), (401, 900)]):
        (tmp_path / f"part-{part}.txt").write_text("".join("  ".join(map(str, r)) + "\n" for r in rows[a:b]))
    (tmp_path / "part-9.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = TB.read_txt(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 3
        got = {r["id"]: list(r["v"]) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: r for i, r in enumerate(rows)}


def test_names_and_roles(spark, tmp_path):
    path = str(tmp_path / "q.txt")
    TB.write_txt(spark.createDataFrame([(5, [1.0, 2.0]), (2, [0.1, float(np.float32(1e-7))])], "id long, v array<double>"), path)
    names = {"test": {"glove": path}}
    df, metric = TB.load_vectors(spark, "glove", "test", names=names)
    assert metric == "euclidean"
    assert {r["id"]: list(r["v"]) for r in df.collect()} == {0: [np.float32(0.1), np.float32(1e-7)], 1: [1.0, 2.0]}
    assert TB.resolve("glove", "train", names) == "glove"
    with pytest.raises(ValueError, match="role"):
        TB.load_vectors(spark, "glove", "both", names=names)


def test_convert_checks_the_name_and_pads(spark, tmp_path):
    rng = np.random.default_rng(5)
    text = tmp_path / "v.txt"
    mat = rng.normal(size=(40, 5)).astype(np.float32)
    text.write_text("".join(" ".join(map(str, r)) + "\n" for r in mat))
    good = str(tmp_path / "v-euclidean-8-40.bin")
    r = TB.convert(spark, str(text), good).first()
    assert (r["n_a"], r["n_b"], r["n_mismatch"]) == (40, 40, 0)
    back = {x["id"]: list(x["v"]) for x in VF.read_vectors(spark, good).collect()}
    assert all(np.allclose(back[i], list(mat[i]) + [0.0] * 3, rtol=0, atol=0) for i in range(40))
    for bad in ("v-euclidean-5-40.bin", "v-euclidean-8-41.bin", "v-angular-8-40.bin"):
        with pytest.raises(ValueError, match="is named"):
            TB.convert(spark, str(text), str(tmp_path / bad))
        assert not (tmp_path / bad).exists()
    assert TB.convert(spark, str(text), str(tmp_path / "plain-5-40.bin"), padding=False).first()["n_mismatch"] == 0
    # zero rows of an angular file go, the rest is counted and numbered anew
    raw = str(tmp_path / "raw-angular-8-3.bin")
    VF.write_vectors(spark.createDataFrame([(0, [3.0] + [0.0] * 7), (1, [0.0] * 8), (2, [0.0, 4.0] + [0.0] * 6)], "id long, v array<float>"), raw)
    assert TB.convert(spark, raw, str(tmp_path / "unit-angular-8-2.bin")).first()["n_b"] == 2


def test_emitted_queries_of_any_ids(spark, tmp_path):
    q = spark.createDataFrame([(i * 7, [float(i), 0.5]) for i in range(30)], "id long, v array<double>").repartition(4)
    r = TB.write_queries_checked(q, str(tmp_path / "q-2-30.bin")).first()
    assert (r["n_a"], r["n_b"], r["n_mismatch"]) == (30, 30, 0)
    with pytest.raises(Exception, match="non-finite"):
        TB.write_queries_checked(q.union(spark.createDataFrame([(999, [float("nan"), 0.0])], "id long, v array<double>")),
                                 str(tmp_path / "bad.bin")).first()


def test_csvs_of_many_headers(spark, tmp_path):
    files = {"dataset=a/x.csv": 'i,rc,name\n1,0.5,"SGD(rc, hard)"\n2,,plain\n',
             "dataset=a/sub/y.csv": "name,i\nz,3\n", "dataset=b/z.csv": "rc,extra,i\n1.5,9,4\n\n", "dataset=b/empty.csv": "i,rc\n"}
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "note.txt").write_text("i\n99\n")
    df = TB.read_results_csv(spark, str(tmp_path), "i long, rc double, name string")
    assert sorted(map(tuple, df.collect())) == [(1, 0.5, "SGD(rc, hard)", "a"), (2, None, "plain", "a"), (3, None, "z", "a"),
                                                (4, 1.5, None, "b")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan
