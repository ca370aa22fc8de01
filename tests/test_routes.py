"""Routes, connectivity and surroundings over several drawings that number their entities alike, in any unit."""

import pytest
from pyspark.sql import functions as F

from conformix.functions.geometry import with_bbox
from conformix.operators import evaluate as E
from conformix.operators import routes as R
from conformix.plans.rules import normalise
from conformix.schema import ENTITY


def line(drawing, seq, *points, layer="A", system="S"):
    return {"drawing_key": drawing, "seq": seq, "handle": f"H{seq}", "layer": layer, "entity_type": "LINE", "kind": "polyline", "points": [{"x": float(x), "y": float(y)} for x, y in points], "closed": False, "system": system}


def frame(spark, rows):
    fields = [f for f in ENTITY.fields if f.name not in ("minx", "miny", "maxx", "maxy")]
    schema = "drawing_key string, seq long, handle string, layer string, entity_type string, kind string, points array<struct<x:double,y:double>>, closed boolean, system string"
    df = spark.createDataFrame(rows, schema)
    for f in fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return with_bbox(df)


@pytest.fixture(scope="module")
def two(spark):
    """d1: 1 and 2 touch; d2: 2 and 3 touch."""
    rows = [line("d1", 1, (0, 0), (10, 0)), line("d1", 2, (10, 0), (20, 0)), line("d1", 3, (90, 0), (99, 0)), line("d2", 1, (0, 0), (10, 0)), line("d2", 2, (50, 0), (60, 0)), line("d2", 3, (60, 0), (70, 0))]
    return frame(spark, rows), spark.createDataFrame([("d1", 1.0, False), ("d2", 1.0, False), ("d3", 1.0, True)], "drawing_key string, unit_to_mm double, units_assumed boolean")


def test_routes_stay_in_their_drawing(two):
    m = R.routes(*two)
    assert {(r["drawing_key"], r["seq"], r["root"]) for r in m.collect()} == {("d1", 1, 1), ("d1", 2, 1), ("d1", 3, 3), ("d2", 1, 1), ("d2", 2, 2), ("d2", 3, 2)}
    t = {(r["drawing_key"], r["route_id"]): (r["entity_count"], r["length"], r["handles"]) for r in R.route_table(m).collect()}
    assert t == {("d1", "R-S-001"): (2, 20.0, ["H1", "H2"]), ("d1", "R-S-002"): (1, 9.0, ["H3"]), ("d2", "R-S-001"): (1, 10.0, ["H1"]), ("d2", "R-S-002"): (2, 20.0, ["H2", "H3"])}


def test_connectivity_stays_in_its_drawing(two):
    rule = normalise({"id": "C", "subject": {"system": "S"}, "measurement": "connectivity", "snap_tolerance_mm": 1, "operator": "==", "value": 1})
    got = {r["drawing_key"]: (r["status"], r["violations"], r["groups"]) for r in E.Evaluator(*two).rule(rule).collect()}
    assert got == {"d1": ("FAIL", 2, [["H1", "H2"], ["H3"]]), "d2": ("FAIL", 2, [["H1"], ["H2", "H3"]]), "d3": ("UNKNOWN", None, None)}


def test_reach_is_in_drawing_units(spark):
    """In mils a millimetre is 39 units and a metre 39370."""
    e = frame(spark, [line("m", 1, (0, 0), (10, 0)), line("m", 2, (40, 0), (50, 0)), line("m", 3, (30_000, 0), (30_010, 0)), line("m", 4, (80_000, 0), (80_010, 0))])
    d = spark.createDataFrame([("m", 0.0254, False)], "drawing_key string, unit_to_mm double, units_assumed boolean")
    assert {r["seq"]: r["root"] for r in R.routes(e, d).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    involved = spark.createDataFrame([("I", "m", 0, 1)], "issue_id string, drawing_key string, pos int, seq long")
    assert [(x["handle"], x["distance"]) for x in R.nearby(involved, e, d).first()["nearby"]] == [("H2", 30.0), ("H3", 29_990.0)]


def test_nearby_counts_for_the_first_entity_that_reaches_it(spark):
    """H9 lies in the box window of the first entity but beyond its radius, and within that of the second: it is not listed."""
    rows = [line("d", 1, (0, 0), (1, 0)), line("d", 2, (1500, 1500), (1501, 1500)), line("d", 9, (900, 900), (901, 900)), line("d", 4, (0, 5), (1, 5)), line("d", 5, (2000, 1500), (2001, 1500))]
    rows += [line("d", 20 + i, (0, 10 + i), (1, 10 + i)) for i in range(9)]
    e, d = frame(spark, rows), spark.createDataFrame([("d", 1.0, False)], "drawing_key string, unit_to_mm double, units_assumed boolean")
    involved = spark.createDataFrame([("I", "d", 0, 1), ("I", "d", 1, 2), ("K", "d", 0, 2)], "issue_id string, drawing_key string, pos int, seq long")
    got = {r["issue_id"]: [(x["handle"], x["distance"]) for x in r["nearby"]] for r in R.nearby(involved, e, d).collect()}
    assert got["I"] == [("H4", 5.0)] + [(f"H{20 + i}", 10.0 + i) for i in range(7)]
    assert got["K"] == [("H5", 499.0), ("H9", round((599**2 + 600**2) ** 0.5, 1))]


def test_handles_of_violations_and_matches(spark):
    rows = [line("d", 1, (0, 0), (1, 0), system="A")] + [line("d", 10 + i, (0, 100 * i), (1, 100 * i), layer="T", system="B") for i in range(40)]
    e, d = frame(spark, rows), spark.createDataFrame([("d", 1.0, False)], "drawing_key string, unit_to_mm double, units_assumed boolean")
    ev = E.Evaluator(e, d, far_handles=True)
    within = normalise({"id": "W", "subject": {"system": "A"}, "target": {"layer_equals": "T"}, "measurement": "distance", "operator": "<=", "value": 500, "quantifier": "all"})
    r = ev.rule(within).first()
    assert (r["status"], r["violations"], r["target_handles"]) == ("FAIL", 34, ["H16"]) and r["listed_handles"] == [f"H{i}" for i in range(16, 36)]
    strict = ev.rule(normalise({**within, "operator": "<"})).first()
    assert strict["violations"] == 35 and strict["listed_handles"] == [f"H{i}" for i in range(16, 36)]
    few = ev.rule(normalise({**within, "operator": "<", "value": 3700})).first()
    assert (few["violations"], few["listed_handles"]) == (3, ["H48", "H49", "H47"])
    count = ev.rule(normalise({"id": "N", "subject": {"layer_equals": "T"}, "measurement": "entity_count", "operator": ">=", "value": 50})).first()
    assert (count["status"], count["listed_handles"][:2], len(count["listed_handles"])) == ("FAIL", ["H10", "H11"], 40)


def test_repeated_issues_are_numbered_within_their_drawing(spark):
    rows = [("d1", "R", 0, i, "H1", ["H2"], 1.2, 3.4) for i in range(3)] + [("d2", "R", 0, 1, "H1", ["H2"], 1.2, 3.4), ("d1", "R", 0, 9, None, [], None, None)]
    df = spark.createDataFrame(rows, "drawing_key string, rule_id string, rule_pos int, subject_seq long, subject_handle string, target_handles array<string>, loc_x double, loc_y double")
    got = [(r["drawing_key"], r["subject_seq"], r["issue_id"], r["handle"]) for r in E.issue_ids(df.withColumn("name", F.lit("plan")), "name").orderBy("drawing_key", "subject_seq").collect()]
    ids = [x[2] for x in got]
    assert ids[1] == f"{ids[0]}-1" and ids[2] == f"{ids[0]}-2" and ids[4] == ids[0] and ids[3] != ids[0] and len(ids[0]) == 20
    assert got[0][3] == "H1,H2" and got[3][3] == ""
