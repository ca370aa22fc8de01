"""op7's trigram scores equal a plain recursion over three levels."""

import zlib
from collections import Counter, defaultdict
from math import log10

import pytest
from pyspark.sql import functions as F

from conformix.llm import katz
from conformix.llm.queries import op7_katz_backoff
from tests.llm import brute
from tests.llm.test_operators import docs, texts  # noqa: F401

START = "<s>\n"


def trigram_rows(texts, held, top=5):
    """{id: score} and P(word | two words before), by brute force; the first word of a text has only the start before it."""
    _, p2, uni = brute.katz_rows(texts, held)
    seqs = {i: [*brute.lower_words(t), "</s>\n"] for i, t in texts.items()}
    tri = Counter()
    for i, s in seqs.items():
        if i not in held:
            tri.update(zip([START, *s], s, s[1:]))
    hist, of = Counter(), Counter(tri.values())
    for (u, v, _), c in tri.items():
        hist[u, v] += c
    d = katz.discounts(of, top)
    mass, below = defaultdict(float), defaultdict(float)
    for (u, v, w), c in tri.items():
        mass[u, v] += d.get(c, 1.0) * c
        below[u, v] += p2(w, v)

    def p(w, u, v):
        h = (u, v)
        if h not in hist:
            return p2(w, v)
        whole = hist[h] + 1 if mass[h] > hist[h] - 1e-6 else hist[h]
        c = tri[u, v, w]
        return d.get(c, 1.0) * c / whole if c else (1 - mass[h] / whole) / (1 - below[h]) * p2(w, v)

    return {i: log10(p2(s[0], START)) + sum(log10(p(w, u, v)) for u, v, w in zip([START, *s], s, s[1:])) for i, s in seqs.items()}, p, uni, tri


def test_query_has_trigrams(spark, docs, texts, tmp_path):  # noqa: F811
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    want, p, uni, tri = trigram_rows(texts, held)
    out = op7_katz_backoff(spark, str(tmp_path)).collect()
    assert len(out) == len(want)
    for r in out:
        assert r["trigram_score"] == pytest.approx(want[r["doc_id"]])
    assert any(r["trigram_score"] != pytest.approx(r["score"]) for r in out if r["held_out"])
    for u, v, _ in [*tri][:5]:
        assert sum(p(w, u, v) for w in uni) + p("never seen", u, v) == pytest.approx(1)


def test_parts_chunks_null_and_repeated_rows(spark, docs, texts):  # noqa: F811
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    train = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    want, *_ = trigram_rows(texts, held)
    model = katz.fit(train, part_bytes=500, chunk_bytes=900, order=3)
    rows = docs.union(docs.where("doc_id < 9")).withColumn("trigram_score", F.lit("x"))
    got = katz.score(rows, model, chunk_bytes=700).collect()
    assert len(got) == len(texts) + 9
    for r in got:
        assert r["trigram_score"] == pytest.approx(want[r["doc_id"]])
    empty = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    for some in (empty, empty.limit(0)):
        again = katz.score(docs.where("doc_id < 20"), katz.fit(some, order=3)).collect()
        assert len(again) == 20 and all(r["trigram_score"] == pytest.approx(r["score"]) for r in again)
