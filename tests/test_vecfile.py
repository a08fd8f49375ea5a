"""The vector file source: ranges of rows, and writes that are published whole or not at all."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from knnhard.sources import vecfile as VF


def table(spark, ids, dim=3):
    return spark.createDataFrame([(i, [float(i), float(i) / 2, -1.0][:dim]) for i in ids], "id long, v array<float>")


def ids_of(df):
    return sorted(r["id"] for r in df.collect())


def test_ranges(spark, tmp_path):
    path = str(tmp_path / "rows-euclidean-3-50.bin")
    VF.write_vectors(table(spark, range(50)), path, parts=4)
    read = VF.read_vectors(spark, path, rows_per_partition=5)
    assert ids_of(read) == list(range(50))
    some = VF.read_vectors(spark, path, rows_per_partition=5, start=12, limit=11)
    assert ids_of(some) == list(range(12, 23)) and [list(r["v"]) for r in some.where("id = 20").collect()] == [[20.0, 10.0, -1.0]]
    assert some.rdd.getNumPartitions() < read.rdd.getNumPartitions()
    assert ids_of(read.where("id > 47 OR id = 1")) == [1, 48, 49] and ids_of(read.where("id <= 3")) == [0, 1, 2, 3]
    assert ids_of(VF.read_vectors(spark, path, start=45)) == [45, 46, 47, 48, 49]
    assert ids_of(VF.read_vectors(spark, path, start=60)) == ids_of(VF.read_vectors(spark, path, start=3, limit=0)) == []


def test_overwrite_append_and_uris(spark, tmp_path):
    path = str(tmp_path / "rows-3-9.bin")
    VF.write_vectors(table(spark, range(20)), path, parts=3)
    VF.write_vectors(table(spark, range(6)), path, parts=2)
    assert ids_of(VF.read_vectors(spark, path)) == list(range(6))
    VF.write_vectors(table(spark, range(6, 9)), path, parts=1, mode="append")
    assert ids_of(VF.read_vectors(spark, "file://" + path)) == list(range(9))
    with pytest.raises(Exception, match="behind the parts"):
        VF.write_vectors(table(spark, range(3, 30)), path, parts=1, mode="append")
    assert ids_of(VF.read_vectors(spark, path)) == list(range(9))
    assert all(f.startswith("part-") for f in os.listdir(path))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "rows-3-9.bin")
    bad = table(spark, range(30)).withColumn("v", F.when(F.col("id") == 29, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="of one dimension"):
        VF.write_vectors(bad, path, parts=3)
    assert not os.path.isdir(path) or os.listdir(path) == []
    VF.write_vectors(table(spark, []), path, parts=2)
    assert os.listdir(path) == []


def test_values_are_exact(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal((40, 5)).astype("<f4")
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<float>")
    path = str(tmp_path / "x-5-40.bin")
    VF.write_vectors(df, path, parts=3)
    assert b"".join(open(os.path.join(path, f), "rb").read() for f in sorted(os.listdir(path))) == x.tobytes()
