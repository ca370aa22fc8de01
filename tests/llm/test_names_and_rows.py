"""Columns of the operators' own names, repeated rows, null keys, empty tables and texts beyond the pieces they are read in."""

import pytest
from pyspark.sql import functions as F

from conformix.llm import jaccard, langid, mixing, packing, quality, suffix
from tests.llm import brute

NAMES = ["_row", "_t", "_bytes", "_letters", "_n", "_h", "_src", "_u", "_p", "_b", "_k", "_x", "k0", "r", "h", "node", "spans", "id", "hash", "_id", "_of"]
ROWS = [(1, "the cat sat on the mat", "x"), (1, "the cat sat on the mat", "x"), (2, None, None), (None, "die Katze sitzt auf der Matte", "y"), (3, "", "x"), (4, "le chat est sur le tapis", "y")]


@pytest.fixture(scope="module")
def rows(spark):
    base = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    return base.select("*", *[F.concat(F.lit(n), F.coalesce("text", F.lit("?"))).alias(n) for n in NAMES])


def plain(df):
    return sorted(((r["doc_id"], r["text"], *[r[n] for n in NAMES]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("run", ["mix", "dedup", "identify", "score", "keep_one"])
def test_kept_columns_come_back(spark, rows, run):
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    out = {
        "mix": lambda: mixing.mix(rows),
        "dedup": lambda: suffix.dedup(rows, length=60, gram=16),
        "identify": lambda: langid.identify(rows, langid.fit(rows)),
        "score": lambda: quality.score(rows, quality.fit(rows, labels)),
        "keep_one": lambda: jaccard.keep_one(rows),
    }[run]()
    want = plain(rows)
    if run == "keep_one":
        want = sorted({repr(x): x for x in want}.values(), key=repr)
    assert plain(out) == want


def test_empty_tables(spark, rows):
    none = rows.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert langid.identify(none, langid.fit(none)).count() == 0
    assert quality.fit(none, labels) is None and quality.score(none, None).count() == 0
    assert {r["score"] for r in quality.score(rows, None, keep=["doc_id"]).collect()} == {0.5}
    assert mixing.mix(none).count() == 0 and jaccard.keep_one(none).count() == 0 and packing.pack(none).count() == 0


def test_text_beyond_a_piece(spark):
    """A text longer than the pieces anchors are chosen in: its own repeats and those it shares are all found."""
    words = [f"w{i}" for i in range(260_000)]
    long = " ".join(words)
    part = long[1_048_000:1_049_400]
    rows = [(1, long), (2, "head " + part + " tail"), (3, "short")]
    out = {r["doc_id"]: r for r in suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {w[0]: w[1:] for w in brute.dedup_rows(rows[1:] + [(1, long[1_040_000:1_060_000])], 400)}
    assert out[2]["n_removed"] == want[2][1] == len(part) and out[1]["n_removed"] == want[1][1] and out[3]["n_removed"] == 0
    assert out[1]["n_bytes"] == len(long)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame([*rows, (4, long + " end")], "doc_id long, text string"), 3, 90).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1}
    packed = packing.pack(spark.createDataFrame(rows[:1], "doc_id long, text string")).collect()
    assert sorted(r["start"] for r in packed) == [2048 * i for i in range(len(packed))] and len(packed) > 300
