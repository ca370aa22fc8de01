"""Drawings in a shared folder, of which the first import wins whoever writes at the same time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["project", "stored_name"]
KEY_SCHEMA = "project string, stored_name string"


class Lost(RuntimeError):
    """Another writer took the next place of the log."""


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _entries(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(place, claim) of the log, in order: one small file a write, named by both."""
    log, fs = _folder(spark, f"{path}/_log")
    if not fs.exists(log):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(log)]
    return sorted((int(n.split("-", 1)[0]), _read(spark, f"{path}/_log/{n}")) for n in names if n[:1].isdigit())


def _read(spark: SparkSession, path: str) -> str:
    p, fs = _folder(spark, path)
    stream = fs.open(p)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def _append(spark: SparkSession, path: str, place: int, claim: str) -> None:
    """Takes a place of the log; Lost if it is taken. Creating a file that must not exist is one step on the file systems of clusters."""
    p, fs = _folder(spark, f"{path}/_log/{place:012d}-claim")
    try:
        stream = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            raise Lost(str(place)) from e
        raise
    try:
        stream.writeUTF(claim)
    finally:
        stream.close()


def claims(spark: SparkSession, path: str, entries: list[tuple[int, str]] | None = None) -> DataFrame:
    """(project, stored_name, attempt): which attempt's rows of a drawing count."""
    entries = _entries(spark, path) if entries is None else entries
    none = spark.createDataFrame([], f"{KEY_SCHEMA}, attempt string")
    if not entries:
        return none
    return spark.read.schema(f"{KEY_SCHEMA}, attempt string").parquet(*[f"{path}/_claims/{c}" for _, c in entries])


def write_drawings(entities: DataFrame, path: str, before_commit=lambda: None) -> DataFrame:
    """Appends entities (project, stored_name, ...) of drawings that `path` does not hold; returns (project, stored_name) of those written.

    Rows go to a folder of this attempt; then the drawings that are still free are claimed with the next place of the log. Whoever finds that place
    taken looks again which drawings are free, so that of two writers at one time exactly one has a drawing, and neither has half of it.
    An attempt that fails leaves rows that no claim names, which readers never see. before_commit() is called before every try, for tests.
    """
    spark, attempt = entities.sparkSession, uuid.uuid4().hex
    known = claims(spark, path)
    fresh = entities.join(known.select(*KEY).hint("merge"), KEY, "left_anti")
    data = f"{path}/data/attempt={attempt}"
    fresh.write.option("compression", "zstd").parquet(data)
    mine = spark.read.schema(fresh.schema).parquet(data).select(*KEY).distinct()
    while True:
        entries = _entries(spark, path)
        claim = uuid.uuid4().hex
        free = mine.join(claims(spark, path, entries).select(*KEY).hint("merge"), KEY, "left_anti")
        free.withColumn("attempt", F.lit(attempt)).write.parquet(f"{path}/_claims/{claim}")
        before_commit()
        try:
            _append(spark, path, entries[-1][0] + 1 if entries else 0, claim)
        except Lost:
            continue
        return spark.read.schema(f"{KEY_SCHEMA}, attempt string").parquet(f"{path}/_claims/{claim}").select(*KEY)


def read_drawings(spark: SparkSession, path: str, schema) -> DataFrame:
    """Entities of all drawings, each as its first import wrote it. schema: that of the rows that were written."""
    held = claims(spark, path)
    if held.isEmpty():
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(f"{path}/data").withColumn("attempt", F.regexp_extract(F.col("_metadata.file_path"), "attempt=([0-9a-f]+)", 1))
    return rows.join(held.hint("merge"), [*KEY, "attempt"], "left_semi").drop("attempt")
