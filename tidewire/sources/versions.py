"""Versioned tables: data first, the manifest that names it last, so that a reader never sees half a write."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer committed the version first."""


def _files(spark: SparkSession, path: str):  # type: ignore[no-untyped-def]
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of every committed version, oldest first; drafts that a killed writer left count for nothing."""
    where, files = _files(spark, f"{path}/_manifests")
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    found = []
    for name in sorted(n for n in names if n.endswith(".json")):
        entry = json.loads(spark.read.text(f"{path}/_manifests/{name}").first()["value"])
        found.append((entry["version"], entry["folder"]))
    return found


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version, or the one asked for."""
    known = dict(versions(spark, path))
    if not known:
        raise FileNotFoundError(f"{path} has no committed version")
    return spark.read.parquet(f"{path}/{known[max(known) if version is None else version]}")


def commit_version(df: DataFrame, path: str, base: int) -> int:
    """Write df as version base + 1 of the table that was read at version ``base`` (0: none yet); Conflict if that one is taken."""
    spark = df.sparkSession
    folder = f"data/{base + 1:012d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    if base != max((v for v, _ in versions(spark, path)), default=0):
        raise Conflict(f"version {base + 1} of {path} is taken")
    draft, files = _files(spark, f"{path}/_manifests/{uuid.uuid4().hex}.draft")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps({"version": base + 1, "folder": folder}).encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(f"{path}/_manifests/{base + 1:012d}.json")
    no_overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        hadoop.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, place, no_overwrite)  # whole, or not at all; fails where one is
    except Exception as error:
        files.delete(draft, False)
        raise Conflict(f"version {base + 1} of {path} is taken") from error
    return base + 1


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all but the newest versions, manifests first, and what no manifest names; how many versions went."""
    known = versions(spark, path)
    gone, kept = known[:-keep], {folder for _, folder in known[-keep:]}
    for number, _ in gone:
        where, files = _files(spark, f"{path}/_manifests/{number:012d}.json")
        files.delete(where, False)
    where, files = _files(spark, f"{path}/data")
    for status in files.listStatus(where):
        if f"data/{status.getPath().getName()}" not in kept:
            files.delete(status.getPath(), True)
    return len(gone)
