"""Messages, reasons and fixes of every measurement and case on a small drawing."""

import pytest
from pyspark.sql import functions as F

from conformix.functions.text import fixed
from conformix.operators import evaluate as E
from conformix.operators import messages as Msg
from conformix.operators import reports as R
from conformix.operators.reports import general
from conformix.plans.rules import normalise
from tests.test_routes import frame, line

S, T = {"layer_equals": "A"}, {"layer_equals": "B"}


@pytest.fixture(scope="module")
def drawing(spark):
    rows = [line("d", 1, (0, 0), (1000, 0), system="電纜"), line("d", 2, (0, 240), (1000, 240), layer="B", system=None), line("d", 3, (0, 500), (1000, 507), system="電纜"), line("d", 4, (500, 490), (500, 600), layer="B", system=None), line("d", 5, (9000, 9000), (9000, 9001))]
    rows += [{**line("d", 6, (8000, 8000), (9500, 8000), (9500, 9500), (8000, 9500), layer="Z"), "closed": True}, line("none", 1, (0, 0), (1, 0), system="電纜"), {**line("d", 7, (1, 1), (1, 1), layer="P", system=None)}]
    return frame(spark, rows), spark.createDataFrame([("d", 1.0, False), ("none", 1.0, False)], "drawing_key string, unit_to_mm double, units_assumed boolean")


def said(spark, drawing, **raw):
    rule = normalise({"id": "R", **raw})
    e, d = drawing
    out = Msg.with_messages(E.Evaluator(e, d, far_handles=True).rule(rule), Msg.rule_words(spark, [rule]), e)
    return {(r["drawing_key"], r["subject_handle"], r["target_handles"][0] if r["target_handles"] else None): (r["status"], r["message"], r["reason"], r["fix"]) for r in out.collect()}


ONE, TWO, THREE, FOUR, FIVE = "電纜 LINE（圖層 A，Handle H1）", "LINE（圖層 B，Handle H2）", "電纜 LINE（圖層 A，Handle H3）", "LINE（圖層 B，Handle H4）", "S LINE（圖層 A，Handle H5）"


def test_distances(spark, drawing):
    got = said(spark, drawing, subject=S, target=T, measurement="distance", operator=">=", value=250, warn_margin=20)
    how = "2D 平面最短距離"
    assert got["d", "H1", "H2"] == ("FAIL", f"{ONE} 與 {TWO} 的距離為 240 mm，低於規則要求的 250 mm。", how, f"將 {ONE} 與 {TWO} 的間距增加至少 10 mm（移動或改道其中一條路徑）。")
    assert got["d", "H3", "H2"] == ("WARNING", f"{THREE} 與 {TWO} 的距離為 260 mm，雖符合 >= 250 mm，但在警示範圍（20 mm）內。", how, f"將 {THREE} 與 {TWO} 的間距增加至少 -10 mm（移動或改道其中一條路徑）。")
    assert got["d", "H5", None] == ("PASS", f"{FIVE} 在搜尋範圍內找不到符合「圖層 = B」的物件。", "搜尋範圍內無目標物件", "")
    assert got["none", "H1", None] == ("UNKNOWN", f"圖面中沒有符合「圖層 = B」的物件，無法判定 {ONE}。", "Insufficient evidence：找不到目標物件", "")


def test_levels_and_crossings(spark, drawing):
    got = said(spark, drawing, subject=S, target=T, measurement="horizontal_clearance", operator=">=", value=10)
    blind = "Insufficient evidence：兩者在平面上交疊/交叉，但圖面沒有高程(Z)資料，無法判斷是否位於同一高度"
    assert got["d", "H3", "H4"] == ("UNKNOWN", f"{THREE} 與 {FOUR} 的水平淨距無法判定。{blind}", blind, "調整設計使其符合「>= 10 mm」。")
    got = said(spark, drawing, subject=S, target=T, measurement="intersection")
    assert got["d", "H3", "H4"] == ("FAIL", f"{THREE} 與 {FOUR} 在平面上交叉。", "2D 平面交叉判斷", f"調整 {THREE} 路徑避免與 {FOUR} 交叉，或以剖面/高程資料證明兩者位於不同高度。")
    assert got["d", "H1", None][:2] == ("PASS", f"{ONE} 與附近目標物件沒有交叉。")
    got = said(spark, drawing, subject=S, target=T, measurement="vertical_clearance", operator=">=", value=10)
    assert got["d", "H3", "H4"][2:] == ("Insufficient evidence：2D 圖面沒有高程(Z)資料，無法量測垂直淨距", "補充或確認兩者的安裝高程（Z 值），再判斷垂直淨距；必要時調整其中一者的高程。")


def test_upper_bounds(spark, drawing):
    got = said(spark, drawing, subject=S, target=T, measurement="distance", operator="<=", value=100, quantifier="all")
    assert got["d", "H1", "H2"] == ("FAIL", f"{ONE} 與 {TWO} 的距離為 240 mm，超過規則上限 100 mm。（另有 1 個目標同樣不符；這裡列出的是超出範圍者中的第一個）", "2D 平面最短距離", "調整設計使其符合「<= 100 mm」。")
    got = said(spark, drawing, subject=S, target=T, measurement="distance", operator="<=", value=10, quantifier="any")
    assert got["d", "H5", None] == ("FAIL", f"{FIVE} 在搜尋範圍內找不到符合「圖層 = B」的物件。", "搜尋半徑 30 mm 內沒有目標物件", "調整設計使其符合「<= 10 mm」。")
    assert got["d", "H3", "H4"][:2] == ("PASS", f"{THREE} 與 {FOUR} 的距離為 0 mm，符合規則要求的 <= 10 mm。")


def test_single_entities_zones_counts_and_connectivity(spark, drawing):
    got = said(spark, drawing, subject={"or": [S, {"layer_equals": "P"}]}, measurement="off_axis_angle", operator="<=", value=0.1)
    assert got["d", "H3", None] == ("FAIL", f"{THREE} 的偏離正交角度為 0.4°，不符合規則要求（<= 0.1°）。", "量測物件偏離正交角度", f"調整 {THREE} 走向，使角度 <= 0.1°。")
    assert got["d", "H7", None] == ("UNKNOWN", "LINE（圖層 P，Handle H7） 沒有可量測的方向（例如圓形或單點），無法判定偏離正交角度。", "Insufficient evidence：物件不具備此量測所需的幾何資訊", "")
    got = said(spark, drawing, subject=S, measurement="length", operator="<=", value=0.5, unit="m", fix_hint="截短")
    assert got["d", "H1", None] == ("FAIL", f"{ONE} 的長度為 1 m，不符合規則要求（<= 0.5 m）。", "量測物件長度", "截短")
    got = said(spark, drawing, subject=S, zone={"layer_equals": "Z"}, measurement="outside_zone")
    assert got["d", "H5", "H6"] == ("FAIL", f"{FIVE} 進入了區域 Z（Handle H6）。", "區域包含關係（2D 平面判斷）", f"將 {FIVE} 改道避開禁設區域。")
    assert got["d", "H1", None][1] == f"{ONE} 未進入禁設區域。" and got["none", "H1", None][1] == f"圖面中找不到符合「圖層 = Z」的封閉區域，無法判定 {ONE} 是否在區域內。"
    got = said(spark, drawing, subject={"not": S, "entity_type": ["LINE", "ARC"]}, measurement="entity_count", operator=">=", value=9)
    assert got["d", None, None] == ("FAIL", "符合「非 圖層 = A 且 類型為 LINE/ARC」的物件共 4 個，不符合規則要求（>= 9）。", "物件數量統計", "調整設計使其符合「>= 9 count」。")
    got = said(spark, drawing, subject=S, measurement="connectivity", operator="==", value=1, snap_tolerance_mm=5)
    assert got["d", "H1", "H3"] == ("FAIL", "路徑分成 3 個不連通群組。", "端點在 5 mm 容差內仍未連接", "連接斷開的路徑端點，或確認圖面是否缺少路徑線段。")
    assert got["none", "H1", None][:3] == ("UNKNOWN", "只有一個路徑圖元，沒有其他線段可供驗證連通性。", "Insufficient evidence：至少需要兩個 polyline 圖元")


def test_requirements_in_words(spark):
    rows = [("inside_zone", "==", 1.0, "count", "必須完全位於指定區域內"), ("outside_zone", "==", 1.0, "count", "不得進入指定區域"), ("intersection", "==", 0.0, "count", "交叉數 == 0"), ("length", "<=", 6.5, "m", "<= 6.5 m")]
    df = spark.createDataFrame(rows, "m string, o string, v double, u string, want string")
    assert [r[0] for r in df.select(Msg.described(F.col("m"), F.col("o"), F.col("v"), F.col("u")) == F.col("want")).collect()] == [True] * 4


def test_numbers_are_written_once_a_row_and_not_once_a_case(spark, drawing):
    """Every number's text is a long expression: messages take it from a column, so that their plan stays short."""
    assert general(F.col("x")).cast("string")._jc.toString().count("134217729") <= 2
    rule = normalise({"id": "R", "subject": S, "target": T, "measurement": "distance", "operator": ">=", "value": 250, "warn_margin": 20})
    e, d = drawing
    out = Msg.with_messages(E.Evaluator(e, d).rule(rule), Msg.rule_words(spark, [rule]), e)
    assert out._jdf.queryExecution().analyzed().toString().count("134217729") == 0


def test_texts_of_numbers_whose_digits_differ_by_row(spark):
    values = [0.0, 2.385, 0.5, 2.5, -3.25, 0.00012345678, 123456.5, 99999.95, 330.0, 12.0050001]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", general(F.col("v")).alias("g"), fixed(F.col("v"), F.lit(3)).alias("f"), fixed(F.col("v"), F.lit(0)).alias("w")).collect()
    assert [(r["g"], r["f"], r["w"]) for r in got] == [("%g" % r["v"], f"{r['v']:.3f}", f"{r['v']:.0f}") for r in got]


def test_evidence_of_one_rule_is_no_task_of_its_own(spark):
    """Issues meet the few chunks that they rest on without a shuffle by chunk; chunks that nothing rests on do not come along."""
    issues = spark.range(1000).selectExpr("id AS seq", "CASE WHEN id < 990 THEN 'E1' WHEN id < 995 THEN 'E2' END AS evidence_id")
    chunks = spark.createDataFrame([(f"E{i}", "a.md", 1, i, i, f"text {i}") for i in range(1, 9)], "id string, filename string, page int, line_start int, line_end int, text string")
    out = R.with_reference(issues, chunks)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["evidence_id"], r["evidence_ref"], r["evidence_text"]): r["count"] for r in out.groupBy("evidence_id", "evidence_ref", "evidence_text").count().collect()}
    assert got == {("E1", "a.md 第1頁 第1行", "text 1"): 990, ("E2", "a.md 第1頁 第2行", "text 2"): 5, (None, "", None): 5}
