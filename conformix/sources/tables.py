"""Intermediate tables in the cluster's shared folder, and joins whose small side is checked."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: A side of a join is broadcast only if it was counted and is no larger than this.
BROADCAST_BYTES = 8 << 20

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch that a write hands to Python at once, so that wide rows do not fill a worker.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only if it names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if not sc.getCheckpointDir():
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no shared folder")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors.

    Shuffle files of the write are removed with it, so that only the table itself stays on disk. Arrow batches of
    the write are bounded by their bytes, not by their rows alone.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/conformix/{name}-{uuid.uuid4().hex}"
    own = {CLEANUP: "true", BATCH: str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._conformix_path = path
    for written in _scratch:
        written.append(out)
    return out


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The list of what materialise() writes meanwhile. Tables that are still on it at the end are deleted: take off what is read later."""
    written: list[DataFrame] = []
    _scratch.append(written)
    try:
        yield written
    finally:
        _scratch[:] = [w for w in _scratch if w is not written]
        discard(*written)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that no later step reads."""
    for df in tables:
        path = getattr(df, "_conformix_path", None)
        if path:
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def checked_join(big: DataFrame, small: DataFrame, on, how: str, row_bytes: int, rows: int | None = None) -> DataFrame:
    """big JOIN small: broadcast if small was counted and fits BROADCAST_BYTES, else a sort-merge join
    (whose skewed partitions Spark splits)."""
    rows = small.count() if rows is None else rows
    hint = "broadcast" if rows * row_bytes <= BROADCAST_BYTES and how in ("inner", "left", "left_semi", "left_anti") else "merge"
    return big.join(small.hint(hint), on, how)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
