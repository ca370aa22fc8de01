"""Rule model, predicates and kernels on small hand-made inputs."""

import numpy as np
import pytest

from conformix.functions import kernels as K
from conformix.functions import predicates as P
from conformix.plans import rules as R


def rule(**kw):
    return {"id": "X", "subject": {"layer_equals": "A"}, "target": {"layer_equals": "B"}, "measurement": "distance", "operator": ">=", "value": 1, **kw}


def test_defaults():
    assert R.normalise(rule())["quantifier"] == "all"
    assert R.normalise(rule(operator="<="))["quantifier"] == "any"
    r = R.normalise({"id": "Z", "subject": {"system": "S"}, "zone": {"layer_equals": "Z"}, "measurement": "inside_zone"})
    assert (r["operator"], r["value"], r["unit"], r["severity"], r["enabled"]) == ("==", 1, "count", "FAIL", True)


@pytest.mark.parametrize("bad", [{"id": ""}, {"measurement": "nope"}, {"operator": "~"}, {"value": float("nan")}, {"value": True}, {"unit": "kg"}, {"warn_margin": -1}, {"severity": "OOPS"}, {"subject": {}}, {"subject": {"nope": 1}}])
def test_invalid_rules(bad):
    with pytest.raises(R.RuleError):
        R.normalise(rule(**bad))


def test_templates_number_their_rules():
    made = R.build_rule("max_length", {"subject": {"system": "S"}, "value": 6, "unit": "m"}, {"MAX-LENGTH-01"})
    assert made["id"] == "MAX-LENGTH-02" and made["operator"] == "<=" and made["name"] == "「S」的單一物件長度不得超過 6 m"


def test_templates_measure_what_their_sentences_say():
    two = {"subject": {"system": "S"}, "target": {"layers": ["A", "B"]}, "value": 300}
    assert R.build_rule("clearance", two)["measurement"] == "horizontal_clearance"
    assert R.build_rule("clearance", two)["target"] == {"or": [{"layer_equals": "A"}, {"layer_equals": "B"}]}
    assert R.build_rule("max_distance", two)["quantifier"] == "any"
    r = R.build_rule("orthogonal", {"subject": {"layer": "A"}})
    assert (r["value"], r["unit"], r["subject"]) == (1, "deg", {"layer_equals": "A"})
    r = R.build_rule("entity_exists", {"subject": {"layer": "A"}})
    assert (r["measurement"], r["operator"], r["value"]) == ("entity_exists", ">=", 1)
    for bad in ({}, {"subject": {"layer": ""}}, {"subject": {"layers": []}}, {"subject": {"layer": "A", "system": "B"}}):
        with pytest.raises(R.RuleError):
            R.build_rule("entity_exists", bad)
    with pytest.raises(R.RuleError):
        R.build_rule("min_count", {"subject": {"layer": "A"}, "value": 1.5})


@pytest.mark.parametrize("name", ["-A", "_A", "A" * 81, "A B", "é"])
def test_ids_of_rules(name):
    with pytest.raises(R.RuleError):
        R.normalise(rule(id=name))
    assert R.normalise(rule(id="A" * 80))["id"]


@pytest.mark.parametrize("pattern", ["(a+)+$", "(?:x*y?)*z", "((a|b)*c)*", "a" * 201, "(", "(?:(?:a+)b)*"])
def test_patterns_that_must_not_run(pattern):
    with pytest.raises(P.PredicateError):
        P.validate({"layer_regex": pattern})
    assert P.faults({"and": [{"layer_regex": "^[A-Z]+-[0-9]{1,3}.*$"}]}) == []


def test_sets_of_rules():
    made = R.normalise_set({"systems": [{"name": "S", "layer_regex": "^S"}], "rules": [rule(), rule(id="Y", name=" ")]})
    assert [r["id"] for r in made.rules] == ["X", "Y"] and made.rules[1]["name"] == "Y"
    with pytest.raises(R.RuleError) as e:
        R.normalise_set({"systems": [{"name": "S", "layer_regex": "(a+)+"}], "rules": [rule(), rule(), rule(id="?"), {"id": "C", "measurement": "connectivity", "subject": {"system": "S"}}]})
    assert len(e.value.errors) == 4


def test_predicate_text_opt_in():
    assert P.mentions_text({"or": [{"layer_equals": "A"}, {"text_regex": "x"}]})
    assert not P.mentions_text({"not": {"text_regex": "x"}})


def one(*v):
    return [np.array([float(x)]) for x in v]


def test_segment_distances():
    d, *points = K.segment_pairs(*one(0, 0, 10, 0), *one(3, 4, 3, 9))
    assert d[0] == 4 and [p[0] for p in points] == [3, 0, 3, 4]
    assert K.segment_pairs(*one(0, 0, 10, 0), *one(5, -5, 5, 5))[0][0] == 0
    assert K.segment_pairs(*one(0, 0, 10, 0), *one(4, 0, 6, 0))[0][0] == 0


def test_rim_distances():
    assert K.rim_segments(*one(0, 0, 5), *one(8, -3, 8, 3))[0][0] == 3
    assert K.rim_segments(*one(0, 0, 5), *one(-1, 0, 1, 0))[0][0] == 4
    assert K.rim_segments(*one(0, 0, 5), *one(0, 0, 9, 0))[0][0] == 0
    assert K.rim_rims(*one(0, 0, 5), *one(1, 0, 2))[0][0] == 2


def test_concave_zone_is_left_in_the_middle():
    poly = np.array([[0, 0], [10, 0], [10, 10], [6, 10], [6, 4], [4, 4], [4, 10], [0, 10]], float)
    assert K.inside(np.array([[1.0, 9.0], [9.0, 9.0], [5.0, 9.0], [0.0, 5.0]]), poly).tolist() == [True, True, False, True]
    assert not K.segment_stays_inside(np.array([1.0, 9.0, 9.0, 9.0]), poly)
    assert K.segment_stays_inside(np.array([1.0, 1.0, 9.0, 1.0]), poly)


def test_overlap_length():
    assert K.overlap_of(np.array([[0, 0, 10, 0.0]]), np.array([[4, 0, 20, 0.0], [0, 1, 10, 1]]), 1e-6) == 6


def test_rules_that_are_counted_leave_no_tables_of_their_own(spark):
    """counts() gives what evaluate() gives, and deletes what a rule has written before the next one begins."""
    from conformix.operators import evaluate as E
    from conformix.sources.tables import materialise, scratch
    from tests.test_routes import frame, line

    rows = [line("d", i, (0, i * 300), (1000, i * 300), layer="A" if i % 2 else "B", system=None) for i in range(8)]
    e, d = frame(spark, rows), spark.createDataFrame([("d", 1.0)], "drawing_key string, unit_to_mm double")
    raw = [{"id": "N", "operator": ">=", "value": 400}, {"id": "L", "measurement": "length", "operator": "<=", "value": 900}]
    rules = [R.normalise({"subject": {"layer_equals": "A"}, "target": {"layer_equals": "B"}, **{"measurement": "distance", **r}}) for r in raw]
    with scratch() as written:
        got = E.Evaluator(e, d).counts(rules)
        there = [t for t in written if _exists(spark, t._conformix_path)]
        assert len(written) > len(there) == len(rules)
        want = E.Evaluator(e, d).evaluate(rules).groupBy("rule_id", "status").count()
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
        kept = materialise(d, "kept")
    assert not _exists(spark, kept._conformix_path)


def _exists(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
