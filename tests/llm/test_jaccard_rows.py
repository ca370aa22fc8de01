"""keep_one() and join() where rows repeat, ids repeat with other texts, or ids are null."""

import random

from conformix.llm import jaccard

A = " ".join(f"a{i}" for i in range(100))
B = " ".join(f"b{i}" for i in range(100))
SCHEMA = "doc_id long, text string, source string"


def kept(spark, rows):
    random.Random(1).shuffle(rows)
    out = jaccard.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert out.columns == ["doc_id", "text", "source"]
    return sorted(map(tuple, out.collect()), key=str)


def test_repeated_rows_stay_once(spark):
    near = A.replace("a0 ", "x ")
    got = kept(spark, [(1, A, "s")] * 3 + [(2, near, "s"), (3, B, "s"), (3, B, "t")])
    assert [r[:2] for r in got] == [(1, A), (3, B)]


def test_rows_without_an_id(spark):
    assert kept(spark, [(None, A, "s"), (None, A, "s"), (None, B, "s"), (7, B, "s")]) == sorted([(7, B, "s"), (None, A, "s")], key=str)


def test_one_id_with_two_texts(spark):
    assert kept(spark, [(1, A, "s"), (2, A, "s"), (2, B, "s")]) == [(1, A, "s"), (2, B, "s")]


def test_rows_without_words_all_stay(spark):
    rows = [(1, None, "s"), (1, None, "s"), (None, "", "s"), (2, " \n", "s"), (2, " \n", "s")]
    assert kept(spark, list(rows)) == sorted(rows, key=str)


def test_chain_through_a_row_without_an_id(spark):
    words = A.split()
    change = lambda n: " ".join([f"x{i}" for i in range(n)] + words[n:])
    rows = [(1, A, "s"), (None, change(7), "s"), (2, change(14), "s")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(rows, SCHEMA), 3, 80).collect()}
    assert got == {1: 1, None: 1, 2: 1}
