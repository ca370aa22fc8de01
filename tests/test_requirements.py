"""Sentences beyond those of the derived specifications, and tables without rows."""

from pyspark.sql import functions as F

from conformix.operators import reports as R
from conformix.operators import requirements as Q

SENTENCES = {
    "嚴禁光纜與水管交叉": ("no_crossing", "==", 0.0, "光纜", "水管", ""),
    "水管及風管不應交叉": ("no_crossing", "==", 0.0, "水管", "風管", ""),
    "機房內嚴禁穿越水管。": ("keep_out", "==", 1.0, "機房內", "", "AMBIGUOUS_PARTIES"),
    "管線應正交": ("orthogonal", "<=", None, "管線", "", "MISSING_TOLERANCE"),
    "機房應至少設三個支架": ("min_count", ">=", 3.0, "支架", "", ""),
    "電纜間隔應保持 20 cm": ("clearance", None, 200.0, "電纜", "", "NO_DIRECTION,TARGET_MISSING,UNSPECIFIED_AXIS"),
    "淨距至少 300 in the drawing": ("clearance", ">=", 300.0, "", "", "NO_UNIT,TARGET_MISSING,UNSPECIFIED_AXIS,SUBJECT_MISSING"),
    "通信線纜架與電力線纜架之水平淨距 300 mm 以上。": ("clearance", ">=", 300.0, "通信線纜架", "電力線纜架", "NO_MODAL"),
    "A 與 B 及 C 之水平淨距不得小於 1.5 m": ("clearance", ">=", 1500.0, "A 與 B 及 C", "", "AMBIGUOUS_PARTIES"),
    "水平淨距不得大於 300 mm": (None, None, None, "", "", ""),
    "電纜應整齊排列，方便檢修": (None, None, None, "", "", ""),
}
NOTHING = ["本文件應妥善引用", "", None, "速度 300 m/s。", "管線不得交叉" + "甲" * 700]


def test_shapes_parties_and_problems(spark):
    given = list(SENTENCES) + NOTHING
    df = spark.createDataFrame(list(enumerate(given)), "k int, sentence string")
    got = Q.requirements(df, ["k"]).select("sentence", "template", "operator", "value", "subject", "target", F.concat_ws(",", "problems").alias("problems"))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == SENTENCES


def test_no_sentences_give_no_candidates(spark):
    none = spark.createDataFrame([], "document_id string, id string, page int, line_start int, text string")
    found = Q.from_chunks(none)
    assert found.count() == 0 and Q.conflicts(Q.merged(found)).count() == 0


def test_conflicting_limits_of_one_pair(spark):
    rows = [("d1", "e1", 1, 1, "甲管與乙管之水平淨距不得小於 300 mm。甲管與乙管之水平淨距不得小於 30 cm。"), ("d2", "e2", 1, 1, "甲管與乙管之水平淨距不得小於 400 mm。"), ("d3", "e3", 1, 9, "甲管與乙管之水平淨距不得小於 0.3 m。")]
    one = Q.merged(Q.from_chunks(spark.createDataFrame(rows, "document_id string, id string, page int, line_start int, text string")))
    assert sorted((r.document_id, r.value, r.sources) for r in one.collect()) == [("d1", 300.0, 2), ("d2", 400.0, 1)]
    assert [(r.signatures, r.members) for r in Q.conflicts(one).collect()] == [(2, 2)]


def test_details_are_cut_and_counted(spark):
    issues = spark.range(20).selectExpr("'r' AS run_id", "id AS seq", "CASE id % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'FAIL' ELSE 'WARNING' END AS status")
    got = R.details(issues, 7).orderBy("rank").collect()
    assert [r.status for r in got] == ["FAIL"] * 5 + ["WARNING"] * 2 and {r.hidden for r in got} == {8}


def test_general_number_format(spark):
    values = [0.0, 3.5, 300.0, 0.0001234, 123456.0, -2.25, 0.1]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(R.general(F.col("v"))).collect()
    assert [r[0] for r in got] == ["%g" % v for v in values]


def test_decimals_of_the_exact_binary_value(spark):
    import random

    from conformix.functions.text import fixed

    rng = random.Random(4)
    values = [2.385, 1.005, 0.125, 0.375, 2.5, 1e-9, -1.005, -0.125, 0.0, 999.995, 1e12 + 0.125, 123456789.985, 4.35, 0.285, 1.115, 1e12]
    values += [rng.randrange(10**6) / 1000 for _ in range(400)] + [rng.uniform(-1e4, 1e4) for _ in range(200)] + [rng.randrange(10**5) / 32 for _ in range(100)] + [rng.random() * 10 ** rng.randrange(-8, 12) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 2, 3, 6):
        got = [r[0] for r in df.select(fixed(F.col("v"), digits)).collect()]
        assert got == [f"{v:.{digits}f}" for v in values]


def test_equal_sentences_are_read_once(spark, monkeypatch):
    """What a sentence requires depends on its text alone: rows beyond the different sentences cost a join, not a reading."""
    seen, read = [], Q._read
    monkeypatch.setattr(Q, "_read", lambda df: seen.append(df.count()) or read(df))
    said = ["電纜長度不得大於 5 m。", "SCADA 電纜與電力電纜之水平淨距不得小於 30 mm，垂直淨距不得小於 20 mm。", "無要求", None]
    rows = Q.requirements(spark.createDataFrame([(i, said[i % 4]) for i in range(40)], "id int, sentence string"), ["id"])
    assert seen == [3]
    got = rows.groupBy("sentence").count().collect()
    assert sorted(r["count"] for r in got) == [10, 20] and rows.where("id % 4 = 0 AND value = 5000").count() == 10
