"""op7 stores every counted bigram; parts and chunks of any size give one result."""

import zlib

import pytest
from pyspark.sql import functions as F

from conformix.llm import katz
from conformix.llm.queries import op7_katz_backoff
from tests.llm import brute
from tests.llm.test_operators import docs, texts  # noqa: F401


def test_query_keeps_bigrams_seen_once(spark, docs, texts, tmp_path):  # noqa: F811
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    want, p, uni = brute.katz_rows(texts, held)
    cut, *_ = brute.katz_rows(texts, held, min_count=2)
    out = op7_katz_backoff(spark, str(tmp_path)).collect()
    assert len(out) == len(want)
    for r in out:
        assert r["score"] == pytest.approx(want[r["doc_id"]][3]) and r["held_out"] == (r["doc_id"] in held)
    assert any(want[i][3] != pytest.approx(cut[i][3]) for i in want)
    for h in list(uni)[:5]:
        assert sum(p(w, h) for w in uni) + p("never seen", h) == pytest.approx(1)


def test_parts_chunks_and_clashing_names(docs, texts):  # noqa: F811
    """Small parts and chunks, repeated rows, null ids, kept columns with the operator's own names."""
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    train = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    want, *_ = brute.katz_rows(texts, held)
    model = katz.fit(train, part_bytes=500, chunk_bytes=900)
    rows = docs.union(docs.where("doc_id < 9")).union(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    rows = rows.withColumnsRenamed({"lang": "k0", "source": "chunk", "size": "_row"}).withColumn("t", F.array("doc_id"))
    out = katz.score(rows, model, chunk_bytes=700)
    assert out.columns == [*[c for c in rows.columns if c != "score"], "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = out.collect()
    assert len(got) == len(texts) + 10
    for r in got:
        w = want[3 if r["doc_id"] is None else r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == w[:2] and r["t"] == [r["doc_id"]]
        assert r["base_score"] == pytest.approx(w[2]) and r["score"] == pytest.approx(w[3])


def test_long_text_and_no_training_rows(spark):
    long = "ab cd " * 400_000
    docs = spark.createDataFrame([(1, long), (2, None), (None, "ab cd")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in katz.score(docs, katz.fit(docs)).collect()}
    assert out[1]["n_tokens"] == 800_001 and out[2]["n_tokens"] == 1 and out[1]["score"] > out[1]["base_score"]
    none = {r["doc_id"]: r for r in katz.score(docs, katz.fit(docs.limit(0))).collect()}
    assert none[1]["n_known"] == 0 and none[None]["score"] == pytest.approx(0.0)
