"""Indexed appends: what is new, what is read, and what a cut-off append leaves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodia.session import fresh_folder
from episodia.streaming import key_index as K

SCHEMA = "k long, s string, v double"


def rows(spark, numbers):
    return spark.createDataFrame([(None if i == 13 else i, f"s{i % 3}", float(i)) for i in numbers], SCHEMA)


def held(spark, path):
    return sorted((r.v for r in K.read_indexed(spark, path, SCHEMA).collect()))


def test_only_new_keys_are_appended(spark):
    path = fresh_folder(spark, "indexed")
    assert held(spark, path) == []
    assert K.append_indexed(rows(spark, range(0, 60, 2)), path, ["k", "s"], 8)
    assert K.append_indexed(rows(spark, range(50)), path, ["k", "s"], 8)
    assert K.append_indexed(rows(spark, range(50)), path, ["k", "s"], 8) is None
    assert held(spark, path) == sorted(map(float, set(range(50)) | set(range(0, 60, 2))))
    twice = rows(spark, [100, 100, 1])
    K.append_indexed(twice, path, ["k", "s"], 8)
    assert held(spark, path).count(100.0) == 2 and held(spark, path).count(1.0) == 1


def test_a_cut_off_append_is_not_visible(spark, monkeypatch):
    path = fresh_folder(spark, "indexed")
    K.append_indexed(rows(spark, range(10)), path, ["k"], 4)

    monkeypatch.setattr(K, "INDEX", "not a schema")  # the data is written, the index is not
    with pytest.raises(Exception, match="not|schema|syntax|PARSE"):
        K.append_indexed(rows(spark, range(20)), path, ["k"], 4)
    monkeypatch.undo()
    assert held(spark, path) == [float(i) for i in range(10)]
    K.append_indexed(rows(spark, range(20)), path, ["k"], 4)
    assert held(spark, path) == [float(i) for i in range(20)]


def test_only_matching_parts_are_read(spark):
    path = fresh_folder(spark, "indexed")
    for start in (0, 1000, 2000):
        K.append_indexed(rows(spark, range(start, start + 300)), path, ["k"], 4)
    wide = rows(spark, [5, 7, 9000]).withColumn("_hash", F.xxhash64("k")).withColumn("_bucket", F.pmod("_hash", F.lit(4)).cast("int"))
    plan = K.split_known(wide, path, ["k"], 4)
    files = {f.split("batch=")[1].split("/part")[0] for f in plan.inputFiles() if "/data/batch=" in f}
    assert 1 <= len(files) <= 4 < 12  # of three batches with four buckets each
    assert [r.k for r in plan.collect()] == [9000]
    assert K.split_known(wide.filter("k = 9000"), path, ["k"], 4).count() == 1


def test_filters_miss_nothing_and_let_little_through():
    rng = np.random.default_rng(1)
    inside, outside = rng.integers(-2**63, 2**63, 5000), rng.integers(-2**63, 2**63, 20000)
    data = K.filter_of(inside)
    assert K.may_hold(data, inside).all() and K.may_hold(data, outside).mean() < 0.03 and len(data) < 5000 * 1.3
