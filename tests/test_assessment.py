"""Candidates from sentences to statuses: decisions, layers, evidence, merging, conflicts, lists."""

import random

import pytest
from pyspark.sql import functions as F

from conformix.operators import assessment as A
from conformix.operators import decisions as Dec
from conformix.operators import mapping as M
from conformix.operators import requirements as R

LINES = [
    ("d1", "SCADA 電纜與電力電纜之水平淨距不得小於 300 mm。"), ("d2", "SCADA 電纜與電力電纜之水平淨距不得小於 30 cm。"), ("d2", "SCADA電纜及電力纜線之水平淨距不得小於 0.3 m。"), ("d3", "給水管與風管之水平淨距不得小於 200 mm。"), ("d4", "給水管與風管之水平淨距不得小於 250 mm。"),
    ("d5", "給水管與電力電纜之間距不得小於 400 mm。"), ("d5", "給水管長度宜不大於 6 m。"), ("d6", "給水管應正交。"), ("d6", "無此物不得進入機房。"), ("d6", "管線應保持適當距離。"), ("d7", "給水管與風管之垂直淨距不得小於 100。"),
    ("d7", "水管與風管及電纜之水平淨距不得小於 120 mm。"), ("d8", "至少設置 3 個支架。"), ("d9", "風管不得與給水管交叉。"),
]
LAYERS = ["SCADA-1", "POWER-1", "WATER", "AIR", "SUPPORT"]
SYSTEMS = [("給水管", "^WATER"), ("風管", "^AIR"), ("支架", "^SUPPORT")]


@pytest.fixture(scope="module")
def world(spark):
    rows = [(d, f"E{i:02d}", 1, i, i, f"{d}.md", "", t) for i, (d, t) in enumerate(LINES)]
    chunks = spark.createDataFrame(rows, "document_id string, id string, page int, line_start int, line_end int, filename string, section string, text string")
    layers = spark.createDataFrame([("p", x) for x in LAYERS], "project string, layer string")
    systems = spark.createDataFrame([("p", i, n, r) for i, (n, r) in enumerate(SYSTEMS)], "project string, pos int, name string, layer_regex string")
    own = M.parse_glossary(spark.createDataFrame([("p", "電力纜線 = POWER-*")], "project string, text string"))
    return R.from_chunks(chunks).withColumn("project", F.lit("p")), M.Context(layers, systems, M.effective_glossary(layers, own)), chunks


def change(key, at, meaning=None, reset=None, cleared=None, **fields):
    return ("p", key, meaning, at, reset, cleared, *[fields.get(n) for n in Dec.FIELDS])


def held(spark, *changes):
    return Dec.decisions(Dec.merge(None, spark.createDataFrame(list(changes), Dec.CHANGE)))


def views(spark, world, *changes, context=None, chunks=None):
    c, ctx, ch = world
    v, sources = A.evaluate(c, context or ctx, held(spark, *changes), ch if chunks is None else chunks)
    return {r["sentence"]: r for r in v.collect()}, sources, v


def test_statuses_without_decisions(spark, world):
    got, sources, v = views(spark, world)
    state = {s: (r["status"], r["bucket"], sorted(r["problems"])) for s, r in got.items()}
    L = [t for _, t in LINES]
    assert state == {
        L[0]: ("CONFIRMED", "usable", []), L[3]: ("CONFLICTING", "conflict", []), L[4]: ("CONFLICTING", "conflict", []), L[5]: ("NEEDS_REVIEW", "review", ["UNSPECIFIED_AXIS"]), L[6]: ("NEEDS_REVIEW", "review", ["ADVISORY"]),
        L[7]: ("NEEDS_REVIEW", "review", ["MISSING_TOLERANCE"]), L[8]: ("NEEDS_REVIEW", "review", ["SUBJECT_UNMAPPED", "ZONE_UNMAPPED"]), L[9]: ("NOT_ENFORCEABLE", "not_enforceable", []), L[10]: ("NEEDS_REVIEW", "review", ["NO_UNIT"]),
        L[11]: ("NEEDS_REVIEW", "review", ["AMBIGUOUS_PARTIES"]), L[12]: ("CONFIRMED", "usable", []), L[13]: ("CONFIRMED", "usable", []),
    }
    # the same in centimetres is the same meaning; the same of the same layers in other words is merged
    assert sources.count() == 2 and got[L[0]]["enabled"] and got[L[0]]["confirmed_by"] == "auto"
    assert got[L[0]]["requirement"] == "水平淨距 ≥ 300 mm" and got[L[5]]["requirement"] == "淨距（水平或垂直未定） ≥ 400 mm" and got[L[13]]["requirement"] == "不得交叉"
    assert got[L[10]]["reason"] == "需要人工確認：數值沒有單位（不會自行當成 mm）" and got[L[3]]["options"] == 2
    assert (got[L[8]]["fix"]["slots"], got[L[11]]["fix"]["slots"], got[L[10]]["fix"]["direction_op"]) == (["subject", "zone"], ["subject", "target"], ">=")
    s = A.summary(v).first()
    assert (s["total"], s["usable"], s["review"], s["conflict"], s["not_enforceable"], s["off"], s["CONFLICTING"]) == (12, 3, 6, 2, 1, 0, 2)
    listed = [r["sentence"] for r in v.orderBy(*A.ordered(v)).collect()]
    assert listed[:5] == [L[0], L[12], L[13], L[3], L[4]] and listed[5:7] == [L[5], L[10]] and listed[-1] == L[9]
    assert {r["sentence"] for r in A.matching(v, "給水管 d5").collect()} == {L[5], L[6]} and A.matching(v, " - ").count() == 12


def test_decisions_take_effect(spark, world):
    plain, _, v = views(spark, world)
    L, ids = [t for _, t in LINES], {s: r["candidate_id"] for s, r in plain.items()}
    pick = lambda kind, *names: {"kind": kind, "values": list(names)}
    got, _, _ = views(
        spark, world, change(ids[L[5]], 1, template="vertical_clearance"), change(ids[L[6]], 2, accept=True), change(ids[L[7]], 3, value=2.0), change(ids[L[8]], 4, subject=pick("layer", "air"), zone=pick("system", "no such")),
        change(ids[L[10]], 5, unit="cm"), change(ids[L[11]], 6, subject=pick("system", "給水管"), target=pick("layers", "AIR", "POWER-1")), change(ids[L[12]], 7, disabled=True), change(plain[L[3]]["conflict_group"], 8, chosen=plain[L[4]]["meaning"]),
    )
    assert (got[L[5]]["status"], got[L[5]]["measurement"], got[L[5]]["confirmed_by"]) == ("CONFIRMED", "vertical_clearance", "user")
    assert (got[L[6]]["status"], got[L[6]]["severity"]) == ("CONFIRMED", "WARNING")
    assert (got[L[7]]["value"], got[L[7]]["unit"], got[L[7]]["status"]) == (2.0, "deg", "CONFIRMED")
    assert (got[L[8]]["problems"], got[L[8]]["subject_layers"]) == (["ZONE_UNMAPPED"], ["AIR"])
    assert (got[L[10]]["value"], got[L[10]]["unit"], got[L[10]]["status"]) == (1000.0, "mm", "CONFIRMED")
    assert (got[L[11]]["status"], got[L[11]]["target_layers"]) == ("CONFIRMED", ["AIR", "POWER-1"])
    assert (got[L[12]]["bucket"], got[L[12]]["enabled"]) == ("off", False)
    assert (got[L[3]]["status"], got[L[3]]["bucket"], got[L[4]]["status"], got[L[4]]["confirmed_by"]) == ("CONFLICTING", "off", "CONFIRMED", "user")


def test_a_decision_follows_its_meaning(spark, world):
    plain, _, _ = views(spark, world)
    L = [t for _, t in LINES]
    got, _, _ = views(spark, world, change("cand_of_an_older_document", 1, meaning=plain[L[6]]["meaning"], accept=True), change("cand_x", 2, meaning="other", accept=True))
    assert got[L[6]]["status"] == "CONFIRMED" and got[L[5]]["status"] == "NEEDS_REVIEW"


def test_no_drawing_and_no_evidence(spark, world):
    c, ctx, chunks = world
    bare = M.Context(ctx.layers.limit(0), ctx.systems, ctx.glossary)
    got, _, _ = views(spark, world, context=bare)
    L = [t for _, t in LINES]
    assert got[L[0]]["problems"] == ["NO_DRAWING"] and got[L[9]]["status"] == "NOT_ENFORCEABLE"
    got, _, _ = views(spark, world, chunks=chunks.where("id <> 'E00'").withColumn("text", F.when(F.col("id") == "E13", "其他").otherwise(F.col("text"))))
    assert got[L[0]]["problems"] == ["EVIDENCE_MISSING"] and got[L[13]]["problems"] == ["EVIDENCE_MISMATCH"]


def test_logs_merge_in_any_split(spark):
    rng = random.Random(7)
    log = []
    for at in range(60):
        fields = {n: rng.choice([None, {"boolean": rng.random() < 0.7, "double": float(at), "string": None}.get(t)]) for n, t in Dec.FIELDS.items()}
        fields |= {"operator": rng.choice([None, ">=", "<=", "=="]), "chosen": rng.choice([None, f"m{at}"])}
        log.append(change(f"cand_{rng.randrange(6)}", at, meaning=rng.choice([None, f"s{at}"]), reset=rng.random() < 0.2, cleared=rng.choice([None, ["value"], ["accept", "chosen"], ["nonsense"]]), **fields))
    state = {}
    for row in log:
        r = dict(zip(["project", "key", "meaning", "at", "reset", "cleared", *Dec.FIELDS], row))
        if r["operator"] == "==" or r["cleared"] == ["nonsense"]:
            continue
        s = {} if r["reset"] else dict(state.get(r["key"], {}))
        for n in r["cleared"] or []:
            s.pop(n, None)
        for n in Dec.FIELDS:
            if r[n] is not None:
                s.pop(n, None)
                if r[n] is not False:
                    s[n] = r[n]
        state[r["key"]] = s

    def table(*parts):
        facts = None
        for p in parts:
            facts = Dec.merge(facts, spark.createDataFrame(p, Dec.CHANGE))
        return {r["key"]: {n: r["decision"][n] for n in Dec.FIELDS if r["decision"][n] is not None} for r in Dec.decisions(facts).collect()}

    want = {k: s for k, s in state.items() if s}
    shuffled = log[:]
    rng.shuffle(shuffled)
    assert table(log) == want and table(log[30:], log[:30], log[30:]) == want and table(shuffled[:20], shuffled[20:]) == want and len(want) >= 4


def test_summary_of_columns_that_differ_by_case_can_be_written(spark, tmp_path):
    from conformix.plans.registry import QUERIES

    before = spark.conf.get("spark.sql.caseSensitive")
    got = QUERIES["a18_candidate_summary"](spark, "/root/testdata/sf0.001")
    got.write.parquet(str(tmp_path / "t"))
    assert {"not_enforceable", "NOT_ENFORCEABLE"} <= set(got.columns) and spark.conf.get("spark.sql.caseSensitive") == before
