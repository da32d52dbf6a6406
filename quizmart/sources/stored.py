"""Stored tables that change in place: Parquet files named by a manifest.

``<root>/manifest/<version>.json`` lists the files of a version (relative names) and, for a table that
is bucketed by key, the bucket of each. A change writes new files for what it touches under
``<root>/data/v=<version>`` and then the next manifest, by one rename: readers see the old version
or the new one, untouched files stay as they are, and a run that is repeated replaces its own
version. Only names go through the driver, one per file.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "__bucket"


class Manifest(NamedTuple):
    """A version of a table: its schema, key columns and bucket count (0: none), and bucket by file."""

    version: int
    schema: T.StructType
    keys: list[str]
    buckets: int
    files: dict[str, int | None]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _manifest_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/manifest/{version:010d}.json"


def latest_version(spark: SparkSession, root: str) -> int:
    fs, p = _fs(spark, f"{root.rstrip('/')}/manifest")
    return max(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(p) if f.getPath().getName().endswith(".json"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> Manifest:
    version = latest_version(spark, root) if version is None else version
    text = "\n".join(r[0] for r in spark.read.text(_manifest_path(root, version), wholetext=True).collect())
    m = json.loads(text)
    return Manifest(version, T.StructType.fromJson(m["schema"]), m["keys"], m["buckets"], m["files"])


def commit(spark: SparkSession, root: str, m: Manifest) -> None:
    """Makes ``m`` the table's version: the manifest is written aside and renamed."""
    fs, final = _fs(spark, _manifest_path(root, m.version))
    _, aside = _fs(spark, _manifest_path(root, m.version) + ".part")
    out = fs.create(aside, True)
    out.write(json.dumps({"schema": m.schema.jsonValue(), "keys": m.keys, "buckets": m.buckets, "files": m.files}).encode())
    out.close()
    if fs.exists(final):  # a repeated run replaces its own version
        fs.delete(final, False)
    if not fs.rename(aside, final):
        raise OSError(f"cannot commit {final}")


def bucket_of(keys: Iterable[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_files(rows: DataFrame, root: str, version: int, keys: list[str], buckets: int) -> dict[str, int | None]:
    """Writes ``rows`` as files of ``version`` and returns their names. A bucket's rows are spread over
    tasks by all their columns, so that a large bucket is not written by one."""
    spark, folder = rows.sparkSession, f"{root.rstrip('/')}/data/v={version}"
    if buckets:
        spread = F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if not kind.startswith("map")]), F.lit(4))
        rows = rows.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET, spread)
        rows.write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
    else:
        rows.write.mode("overwrite").parquet(folder)
    fs, p = _fs(spark, folder)
    found, names = fs.listFiles(p, True), {}
    while found.hasNext():
        name = found.next().getPath().toString()
        if name.endswith(".parquet"):
            short = "data/" + name.rsplit("/data/", 1)[1]
            names[short] = int(short.split(f"{BUCKET}=")[1].split("/")[0]) if buckets else None
    return names


def create(rows: DataFrame, root: str, keys: Iterable[str] = (), buckets: int = 0) -> Manifest:
    """Version 0 of a table; with ``buckets`` its files are dealt by the hash of ``keys``."""
    m = Manifest(0, rows.schema, list(keys), buckets, write_files(rows, root, 0, list(keys), buckets))
    commit(rows.sparkSession, root, m)
    return m


def read_files(spark: SparkSession, root: str, m: Manifest, files: Iterable[str]) -> DataFrame:
    paths = [f"{root.rstrip('/')}/{f}" for f in files]
    return spark.read.schema(m.schema).parquet(*paths) if paths else spark.createDataFrame([], m.schema)


def read(spark: SparkSession, root: str, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
    """The rows of a version (the latest); of some buckets only their files are read."""
    m = manifest(spark, root, version)
    wanted = None if buckets is None else set(buckets)
    return read_files(spark, root, m, [f for f, b in m.files.items() if wanted is None or b in wanted])


def vacuum(spark: SparkSession, root: str, keep_from: int) -> list[str]:
    """Deletes the files that no version from ``keep_from`` on names, and the manifests before it."""
    last = latest_version(spark, root)
    live = {f for v in range(keep_from, last + 1) if _fs(spark, _manifest_path(root, v))[0].exists(_fs(spark, _manifest_path(root, v))[1]) for f in manifest(spark, root, v).files}
    old = {f for v in range(keep_from) if _fs(spark, _manifest_path(root, v))[0].exists(_fs(spark, _manifest_path(root, v))[1]) for f in manifest(spark, root, v).files}
    for f in old - live:
        fs, p = _fs(spark, f"{root.rstrip('/')}/{f}")
        fs.delete(p, False)
    for v in range(keep_from):
        fs, p = _fs(spark, _manifest_path(root, v))
        fs.delete(p, False)
    return sorted(old - live)


def erase_stored(spark: SparkSession, root: str, user_ids: DataFrame, user_col: str | None = "user_id", null_cols: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """J10 on a stored table: drops the rows that ``user_col`` says belong to an erased user and clears
    the ``null_cols`` that name one.

    Only files with such a row are rewritten; all others keep their names. The erased rows are gone for
    readers at once and from storage after :func:`vacuum`. Returns (files replaced, files written).
    """
    from quizmart.operators.changes import erase_users

    m, null_cols = manifest(spark, root), list(null_cols)
    if not m.files:
        return [], []
    ids = user_ids.select("user_id").distinct()
    rows = read_files(spark, root, m, m.files)
    hit = None
    for c in [*([user_col] if user_col else []), *null_cols]:
        one = rows.select(F.col(c).alias("user_id"), F.col("_metadata.file_path").alias("__file")).join(ids, "user_id", "left_semi").select("__file")
        hit = one if hit is None else hit.unionAll(one)
    touched = {"data/" + r[0].rsplit("/data/", 1)[1] for r in hit.distinct().collect()}  # names of files, at most all
    touched = [f for f in m.files if f in touched]
    if not touched:
        return [], []
    kept = read_files(spark, root, m, touched)
    kept = erase_users(kept, ids, user_col) if user_col else kept
    kept = erase_users(kept, ids, null_cols=null_cols) if null_cols else kept
    written = write_files(kept.select(*m.schema.names), root, m.version + 1, m.keys, m.buckets)
    commit(spark, root, m._replace(version=m.version + 1, files={f: b for f, b in m.files.items() if f not in set(touched)} | written))
    return touched, sorted(written)
