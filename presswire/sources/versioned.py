"""Stored tables that are patched in place: rows lie in buckets of their key, a patch writes only the buckets it touches, and a manifest, put there last, says
which folders a version is made of. Readers see whole versions; a patch that is tried again changes nothing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswire.operators import store

BUCKET = "_bucket"


def files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's, so that tables lie wherever Spark can write."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = files(spark, f"{path}/_versions")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """A version (the latest) and its manifest."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"{path} has no version {'at all' if version is None else version}")
    at = known[-1] if version is None else version
    return at, json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/_versions/{at:08d}").collect()))  # one number a bucket


def commit(spark: SparkSession, path: str, version: int, content: dict) -> bool:
    """Put a version's manifest there whole, by renaming; False if another writer was first."""
    fs, draft = files(spark, f"{path}/_drafts/{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content), "utf-8"))
    out.close()
    _, final = files(spark, f"{path}/_versions/{version:08d}")
    fs.mkdirs(final.getParent())
    done = not fs.exists(final) and fs.rename(draft, final)
    if not done:
        fs.delete(draft, False)
    return done


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def put(rows: DataFrame, path: str, key: str, buckets: int) -> dict[str, str]:
    """Write rows by bucket in a folder of their own; bucket -> folder for those that got rows."""
    folder = f"{path}/data/{uuid.uuid4().hex}"
    rows.withColumn(BUCKET, bucket(key, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
    fs, p = files(rows.sparkSession, folder)
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return {n.removeprefix(f"{BUCKET}="): f"{folder}/{n}" for n in names if n.startswith(f"{BUCKET}=")}


def create(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Version 0 of a table at a path that has none. Keys are unique and not null."""
    content = {"key": key, "buckets": buckets, "schema": rows.schema.json(), "applied": [], "folders": put(rows, path, key, buckets)}
    if not commit(rows.sparkSession, path, 0, content):
        raise FileExistsError(path)


def load(spark: SparkSession, content: dict, only: list[str] | None = None) -> DataFrame:
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(json.loads(content["schema"]))
    paths = [f for b, f in content["folders"].items() if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version's rows. What has been read stays as it is, whatever patches follow."""
    return load(spark, manifest(spark, path, version)[1])


def patch(changes: DataFrame, path: str, token: str, how: Callable[[DataFrame, DataFrame], DataFrame] | None = None, attempts: int = 5) -> int:
    """Apply changes (with the key) to the latest version and return the version that holds them.

    how(rows, changes) gives the new rows of the buckets that changes touch; store.patch by default: values that are not null replace, new keys are
    added. token names the change: a version that has it already is returned as it is, so a job that is run again does not apply it twice.
    If another writer commits meanwhile, the patch is made again on top of that version.
    """
    spark = changes.sparkSession
    for _ in range(attempts):
        version, content = manifest(spark, path)
        if token in content["applied"]:
            return version
        key, buckets = content["key"], content["buckets"]
        touched = [str(r[0]) for r in changes.select(bucket(key, buckets)).distinct().collect()]  # at most `buckets` numbers
        rows = load(spark, content, touched)
        new = (how or (lambda old, given: store.patch(old, given, key)))(rows, changes).select(rows.columns)
        folders = {b: f for b, f in content["folders"].items() if b not in touched} | put(new, path, key, buckets)
        if commit(spark, path, version + 1, content | {"applied": [*content["applied"], token], "folders": folders}):
            return version + 1
    raise RuntimeError(f"{path} was changed by others {attempts} times while the patch was made")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete versions but the last `keep`, and the folders that none of those needs; how many folders went. Not while others read old versions or write."""
    known = versions(spark, path)
    needed = {f for v in known[-keep:] for f in manifest(spark, path, v)[1]["folders"].values()}
    gone = {f for v in known[:-keep] for f in manifest(spark, path, v)[1]["folders"].values()} - needed
    for f in [*gone, *[f"{path}/_versions/{v:08d}" for v in known[:-keep]]]:
        fs, p = files(spark, f)
        fs.delete(p, True)
    return len(gone)
