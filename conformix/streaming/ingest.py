"""Incremental document ingest: a micro-batch chunks only content that the evidence table has not seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conformix.operators.documents import chunk_lines

DOCUMENTS = "doc_id long, text string"


def evidence_of(docs: DataFrame) -> DataFrame:
    """Evidence chunks of (doc_id, text) with content, the hash of the whole text."""
    hashed = docs.withColumn("content", F.sha2("text", 256))
    lines = hashed.select(F.col("content").alias("document_id"), F.lit("").alias("filename"), F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return chunk_lines(lines.withColumn("line_no", F.col("i") + 1)).withColumnRenamed("document_id", "content")


def append_new(batch: DataFrame, path: str) -> None:
    """Append the evidence of texts that path has no content of; of equal texts in the batch one counts."""
    new = batch.withColumn("content", F.sha2("text", 256)).dropDuplicates(["content"])
    try:
        seen = batch.sparkSession.read.parquet(path).select("content").distinct()
    except Exception as e:  # the first batch has no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        new = new.join(seen.hint("merge"), "content", "left_anti")
    evidence_of(new.drop("content")).write.mode("append").parquet(path)


def ingest(spark: SparkSession, source: str, path: str, checkpoint: str, files_per_batch: int = 1):
    """Reads Parquet files of (doc_id, text) as they land in source; the table equals that of one batch over all of them.

    A batch that is run again after a failure finds its content in the table and appends nothing.
    """
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, _: append_new(df, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
