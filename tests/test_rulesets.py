"""Rules built from views beside hand-written ones."""

import pytest
from pyspark.sql import functions as F

from conformix.operators import mapping as M
from conformix.operators import rulesets as S
from conformix.operators.requirements import ORDER

SEL = f"{M.SELECTOR}"
VIEW = f"project string, candidate_id string, enabled boolean, template string, measurement string, operator string, value double, unit string, severity string, subject_selector {SEL}, target_selector {SEL}, zone_selector {SEL}, evidence_id string, filename string, sentence string, document_id string, page int, line_start int, sentence_no int, part int"


def sel(kind, *names):
    return (kind, list(names))


def view(n, template, measurement, operator, value, unit, subject, target=None, zone=None, enabled=True, severity="FAIL", cid=None):
    return ("p", cid or f"cand_{n:016d}", enabled, template, measurement, operator, value, unit, severity, subject, target, zone, f"E{n}", "d.md", f"sentence {n}", "d", 1, n, 0, 0)


VIEWS = [
    view(1, "clearance", "horizontal_clearance", ">=", 300.0, "mm", sel("system", "S"), sel("layers", "P1", "P2")), view(2, "max_length", "length", "<=", 6000.0, "mm", sel("layer", "P1")), view(3, "no_crossing", "intersection", "==", 0.0, "count", sel("system", "S"), sel("layer", "P1")),
    view(4, "min_count", "entity_count", ">=", 2.5, "count", sel("layer", "P1")), view(5, "max_length", "length", "<=", 5000.0, "mm", sel("layer", "P1"), enabled=False), view(6, "orthogonal", "off_axis_angle", "<=", 2.0, "deg", sel("layer", "P2"), severity="WARNING"),
    view(7, "max_length", "length", "<=", 100.0, "mm", sel("layer", "P2"), cid="cand_99999999aaaaaaaa"), view(8, "max_length", "length", "<=", 200.0, "mm", sel("layer", "P2"), cid="cand_99999999bbbbbbbb"), view(9, "keep_out", "outside_zone", "==", 1.0, "count", sel("system", "EMPTY"), zone=sel("layer", "Z")),
]


def rule(name, measurement, operator, value, unit, subject, target=None, zone=None, enabled=True, origin=None, clear=True):
    parts = lambda x: None if x is None else [x] if isinstance(x, tuple) else x
    return ("p", name, origin, enabled, measurement, operator, value, unit, "FAIL", name, True, parts(subject) if clear else None, target is not None, parts(target), zone is not None, parts(zone), None, None, None, None)


RULES = [
    rule("LENGTH-M", "length", "<=", 6.0, "m", sel("layer", "p1")), rule("CROSS-OFF", "intersection", "==", 0.0, "count", sel("system", "S"), sel("layer", "P1"), enabled=False), rule("ODD", "off_axis_angle", "<=", 2.0, "deg", None, clear=False),
    rule("TWO", "horizontal_clearance", ">=", 0.3, "m", [sel("layer", "S1"), sel("layer", "S2")], [sel("layers", "P2", "P1")]), rule("SPEC-ORTHOGONAL-00000000", "off_axis_angle", "<=", 9.0, "deg", sel("layer", "P1")), rule("SPEC-OLD-1", "length", "<=", 1.0, "mm", sel("layer", "P1"), origin=S.ORIGIN),
    rule("ZONE", "outside_zone", "==", 1.0, "count", sel("system", "EMPTY"), zone=sel("layer", "Z")),
]


@pytest.fixture(scope="module")
def world(spark):
    layers = spark.createDataFrame([("p", x) for x in ("S1", "S2", "P1", "P2", "Z")], "project string, layer string")
    systems = spark.createDataFrame([("p", 0, "S", "^S"), ("p", 1, "EMPTY", "^NOPE")], "project string, pos int, name string, layer_regex string")
    glossary = spark.createDataFrame([], "project string, concept string, pos int, patterns array<string>")
    return spark.createDataFrame(VIEWS, VIEW), spark.createDataFrame(RULES, S.RULE), M.Context(layers, systems, glossary)


def test_plan(world):
    made, skipped = S.plan(*world)
    got = {r["rule_id"]: r for r in made.collect()}
    assert set(got) == {"SPEC-NO-CROSSING-00000000", "SPEC-MAX-LENGTH-99999999", "SPEC-KEEP-OUT-00000000"}
    assert {(r["candidate_id"], r["reason"]) for r in skipped.collect()} == {
        (f"cand_{1:016d}", "手動規則「TWO」已經涵蓋"), (f"cand_{2:016d}", "手動規則「LENGTH-M」已經涵蓋"), (f"cand_{4:016d}", "規則不完整"), (f"cand_{6:016d}", "同編號的規則已被手動修改"), ("cand_99999999bbbbbbbb", "同編號的規則已被手動修改"),
    }
    r = got["SPEC-NO-CROSSING-00000000"]
    assert (r["name"], r["quote"], r["document"], r["origin"], r["has_zone"]) == ("「S」不得與「P1」在平面上交叉", "sentence 3", "d.md", S.ORIGIN, False)
    assert got["SPEC-MAX-LENGTH-99999999"]["value"] == 100


def test_applying_twice_changes_nothing(spark, world):
    views, rules, context = world
    new, first = S.apply(views, rules, context)
    again, second = S.apply(views, new, context)
    assert [tuple(r) for r in first.collect()] == [("p", 3, 6, True)] and [tuple(r) for r in second.collect()] == [("p", 3, 6, False)]
    assert new.where("rule_id = 'SPEC-OLD-1'").count() == 0 and again.count() == 9
    gate = S.gate(views.withColumn("bucket", F.lit("review")), rules, context).first()
    assert (gate["will_run"], gate["from_spec"], gate["manual"], gate["review"], gate["runnable"]) == (8, 3, 5, 9, True)


def test_nothing_to_build(world):
    views, rules, context = world
    new, state = S.apply(views.limit(0), rules.limit(0), context)
    assert new.count() == 0 and state.count() == 0 and ORDER
