"""Stored tables: whole versions for readers, only the touched buckets written, retries and writers that meet."""

import os

import pytest

from presswire.sources import versioned

SCHEMA = "id long, a string, b long"


def make(spark, tmp_path, n=200):
    path = str(tmp_path / "table")
    versioned.create(spark.range(n).selectExpr("id", "concat('a', id) as a", "id * 2 as b"), path, "id", 8)
    return path


def rows(df):
    return {r["id"]: (r["a"], r["b"]) for r in df.collect()}


def test_patches_and_versions(spark, tmp_path):
    path = make(spark, tmp_path)
    first, before = versioned.read(spark, path), set(os.listdir(f"{path}/data"))
    change = spark.createDataFrame([(3, None, 7), (1000, "new", None)], SCHEMA)
    assert versioned.patch(change, path, "one") == 1
    added = [b for f in set(os.listdir(f"{path}/data")) - before for b in os.listdir(f"{path}/data/{f}") if b.startswith("_bucket")]
    assert 1 <= len(added) <= 2  # of eight
    want = {i: (f"a{i}", 2 * i) for i in range(200)}
    assert rows(first) == want == rows(versioned.read(spark, path, 0))  # a reader keeps its version
    want |= {3: ("a3", 7), 1000: ("new", None)}
    assert rows(versioned.read(spark, path)) == want
    assert versioned.patch(change, path, "one") == 1 and versioned.versions(spark, path) == [0, 1]  # sent again
    assert versioned.patch(spark.createDataFrame([(3, "x", None)], SCHEMA), path, "two") == 2
    assert rows(versioned.read(spark, path)) == want | {3: ("x", 7)}
    assert versioned.vacuum(spark, path, keep=1) > 0 and rows(versioned.read(spark, path)) == want | {3: ("x", 7)}


def test_deletion_by_another_rule(spark, tmp_path):
    path = make(spark, tmp_path)
    versioned.patch(spark.createDataFrame([(5, None, None)], SCHEMA), path, "gone", how=lambda old, given: old.join(given.select("id"), "id", "left_anti"))
    assert set(rows(versioned.read(spark, path))) == set(range(200)) - {5}


def test_writers_that_meet(spark, tmp_path):
    """A version that appears while a patch is made is not overwritten: the patch is made again on top of it."""
    path, raced = make(spark, tmp_path), []

    def slow(old, given):
        if not raced:
            raced.append(versioned.patch(spark.createDataFrame([(1, "other", None)], SCHEMA), path, "other"))
        return versioned.store.patch(old, given, "id")

    assert versioned.patch(spark.createDataFrame([(2, "mine", None), (1, None, 9)], SCHEMA), path, "mine", how=slow) == 2
    got = rows(versioned.read(spark, path))
    assert got[1] == ("other", 9) and got[2] == ("mine", 4) and len(got) == 200


def test_what_is_not_there(spark, tmp_path):
    path = make(spark, tmp_path, 0)
    assert versioned.read(spark, path).isEmpty()
    versioned.patch(spark.createDataFrame([(1, "x", 1)], SCHEMA), path, "t")
    assert rows(versioned.read(spark, path)) == {1: ("x", 1)}
    with pytest.raises(FileNotFoundError):
        versioned.read(spark, str(tmp_path / "none"))
    with pytest.raises(FileExistsError):
        versioned.create(spark.createDataFrame([(1, "x", 1)], SCHEMA), path, "id")
