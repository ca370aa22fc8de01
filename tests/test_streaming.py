"""Micro-batches over landed files give the table of one batch."""

from conformix.streaming.ingest import evidence_of, ingest


def test_ingest_equals_one_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    source = str(tmp_path / "in")
    docs.repartition(3).write.parquet(source)
    ingest(spark, source, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted(r["id"] for r in evidence_of(spark.read.parquet(source).dropDuplicates(["text"])).collect())
    assert got == want and got
    ingest(spark, source, str(tmp_path / "out"), str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)
