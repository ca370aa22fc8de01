"""Queries that evaluate rules (R*, A1-A5, W*, U1) over the derived drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conformix.operators import evaluate as E
from conformix.plans import oracle_parts as O
from conformix.plans.rules import BENCH_RULES, normalise
from conformix.sources import derived as D

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def classified(spark: SparkSession, sf_dir: str, revised: bool = False) -> DataFrame:
    return E.classify_systems(D.stored_entities(spark, sf_dir, revised), D.SYSTEMS)


def evaluator(spark: SparkSession, sf_dir: str, revised: bool = False) -> E.Evaluator:
    return E.Evaluator(classified(spark, sf_dir, revised), D.drawings(spark, sf_dir))


def rule_query(name, raw, sql, columns=("drawing_key", "subject_seq", "status", "measured")):
    rule = normalise({"id": name.split("_")[0].upper(), **raw})

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = evaluator(spark, sf_dir).rule(rule)
        return out.select(*columns)

    QUERIES[name] = run
    ORACLES[name] = sql
    return rule


def _each(dist: str, value: float, margin: float, subject: str, target: str, unit_mm: float = 1.0, unknown: str = "false", skip: str = "false", radius: float | None = None) -> str:
    """SQL of quantifier all with a lower bound: every pair that does not pass, once for its earlier subject; else the best PASS."""
    near = 2 * (value + margin) if radius is None else radius
    return f"""WITH {O.entities()},
pairs AS (SELECT s.drawing_key, s.seq ss, t.seq ts, {dist} d, s.unit_to_mm u, ({unknown}) AS blind, ({skip}) AS skipped FROM ent s JOIN ent t ON s.drawing_key=t.drawing_key AND s.seq<>t.seq AND {subject} AND {target}
 AND s.minx-{near}*{unit_mm}/s.unit_to_mm<=t.maxx AND t.minx<=s.maxx+{near}*{unit_mm}/s.unit_to_mm AND s.miny-{near}*{unit_mm}/s.unit_to_mm<=t.maxy AND t.miny<=s.maxy+{near}*{unit_mm}/s.unit_to_mm),
val AS (SELECT *, CASE WHEN blind AND d<=1e-6 THEN NULL ELSE d*u/{unit_mm} END v FROM pairs WHERE d<={near}*{unit_mm}/u+1e-6 AND NOT (skipped AND d<=1e-6)),
st AS (SELECT *, CASE WHEN v IS NULL THEN 'UNKNOWN' ELSE {O.classify("v", ">=", value, margin=margin)} END status FROM val),
bad AS (SELECT drawing_key, ss, status, v FROM st WHERE status<>'PASS'),
good AS (SELECT drawing_key, ss, min(v) v, count(*) FILTER (WHERE status<>'PASS') nb FROM st GROUP BY 1,2)
SELECT drawing_key, ss subject_seq, status, round(v,3) measured FROM bad
UNION ALL SELECT s.drawing_key, s.seq, 'PASS', round(g.v,3) FROM ent s LEFT JOIN good g ON g.drawing_key=s.drawing_key AND g.ss=s.seq WHERE {subject} AND coalesce(g.nb,0)=0"""


SCADA, POWER = "s.system='SCADA' AND s.kind='polyline'", "t.system='POWER'"
LEVELS = "s.z_known AND t.z_known AND (s.z<t.z OR t.z<s.z)"

rule_query(
    "r05_horizontal_clearance",
    {"subject": {"system": "SCADA"}, "target": {"system": "POWER"}, "measurement": "horizontal_clearance", "operator": ">=", "value": 300, "warn_margin": 50},
    _each(O.line_line(), 300, 50, SCADA, POWER, unknown="NOT (s.z_known AND t.z_known)", skip=LEVELS),
)
rule_query(
    "r04_minimum_distance",
    {"subject": {"layer_regex": "^scada"}, "target": {"layer_equals": "power-cable"}, "measurement": "minimum_distance", "operator": ">=", "value": 25, "unit": "cm"},
    _each(O.line_line(), 25, 0, "s.layer LIKE 'SCADA%' AND s.kind='polyline'", "t.layer='POWER-CABLE'", unit_mm=10.0),
)
rule_query(
    "r06_vertical_clearance",
    {"subject": {"system": "SCADA"}, "target": {"layer_equals": "POWER-CROSS"}, "measurement": "vertical_clearance", "operator": ">=", "value": 200},
    f"""WITH {O.entities()}, st AS (SELECT s.drawing_key, s.seq ss, CASE WHEN s.z_known AND t.z_known THEN greatest(0,t.z-s.z,s.z-t.z)*s.unit_to_mm END v FROM ent s JOIN ent t ON s.drawing_key=t.drawing_key AND {SCADA} AND t.layer='POWER-CROSS' AND {O.crosses()}),
c AS (SELECT *, CASE WHEN v IS NULL THEN 'UNKNOWN' ELSE {O.classify("v", ">=", 200)} END status FROM st),
g AS (SELECT drawing_key, ss, min(v) v, count(*) FILTER (WHERE status<>'PASS') nb FROM c GROUP BY 1,2)
SELECT drawing_key, ss subject_seq, status, round(v,3) measured FROM c WHERE status<>'PASS'
UNION ALL SELECT s.drawing_key, s.seq, 'PASS', round(g.v,3) FROM ent s LEFT JOIN g ON g.drawing_key=s.drawing_key AND g.ss=s.seq WHERE {SCADA} AND coalesce(g.nb,0)=0""",
)
rule_query(
    "r07_intersection",
    {"subject": {"system": "SCADA"}, "target": {"layer_equals": "WATER"}, "measurement": "intersection"},
    f"""WITH {O.entities()}, x AS (SELECT s.drawing_key, s.seq ss FROM ent s JOIN ent t ON s.drawing_key=t.drawing_key AND {SCADA} AND t.layer='WATER' AND {O.crosses()})
SELECT drawing_key, ss subject_seq, 'FAIL' status, 1.0::double measured FROM x
UNION ALL SELECT drawing_key, seq, 'PASS', NULL FROM ent s WHERE {SCADA} AND seq NOT IN (SELECT ss FROM x)""",
)
rule_query(
    "r08_overlap",
    {"subject": {"layer_equals": "POWER-CABLE"}, "target": {"layer_equals": "TRENCH"}, "measurement": "overlap", "operator": "<=", "value": 100, "quantifier": "all"},
    f"""WITH {O.entities()}, x AS (SELECT s.drawing_key, s.seq ss, (least(s.bx,t.bx)-greatest(s.ax,t.ax))*s.unit_to_mm v FROM ent s JOIN ent t ON s.drawing_key=t.drawing_key AND s.layer='POWER-CABLE' AND t.layer='TRENCH' AND (s.ay=t.ay OR s.ay=t.ye) AND least(s.bx,t.bx)>greatest(s.ax,t.ax)),
m AS (SELECT drawing_key, ss, max(v) v FROM x GROUP BY 1,2),
anyt AS (SELECT DISTINCT drawing_key FROM ent WHERE layer='TRENCH')
SELECT s.drawing_key, s.seq subject_seq, CASE WHEN s.drawing_key NOT IN (SELECT drawing_key FROM anyt) THEN 'UNKNOWN' WHEN v>100+1e-6 THEN 'FAIL' ELSE 'PASS' END status, round(v,3) measured FROM ent s LEFT JOIN m ON m.ss=s.seq WHERE s.layer='POWER-CABLE'""",
)
for _name, _m, _layer, _v in (("r09_inside_zone", "inside_zone", "TRENCH", "CASE WHEN bool_or(i) THEN 1.0 ELSE 0.0 END"), ("r09_outside_zone", "outside_zone", "NOGO", "CASE WHEN count(t)>0 THEN 0.0 ELSE 1.0 END")):
    # in the derived drawings a zone is a rectangle and a run a two-point line
    rule_query(
        _name,
        {"subject": {"system": "SCADA"}, "zone": {"layer_equals": _layer}, "measurement": _m},
        f"""WITH {O.entities()}, z AS (SELECT * FROM ent WHERE layer='{_layer}'),
edges AS (SELECT drawing_key, seq, minx ax, miny ay, maxx bx, miny ye FROM z UNION ALL SELECT drawing_key, seq, maxx, miny, maxx, maxy FROM z UNION ALL SELECT drawing_key, seq, maxx, maxy, minx, maxy FROM z UNION ALL SELECT drawing_key, seq, minx, maxy, minx, miny FROM z),
e AS (SELECT *, least(ax,bx) minx, least(ay,ye) miny, greatest(ax,bx) maxx, greatest(ay,ye) maxy FROM edges),
rim AS (SELECT DISTINCT s.seq ss, t.seq ts FROM ent s JOIN e t ON s.drawing_key=t.drawing_key AND {SCADA} AND {O.crosses()}),
rel AS (SELECT s.seq ss, t.seq ts, s.minx>=t.minx AND s.maxx<=t.maxx AND s.miny>=t.miny AND s.maxy<=t.maxy i FROM ent s JOIN z t ON s.drawing_key=t.drawing_key AND {SCADA} AND s.minx<=t.maxx AND t.minx<=s.maxx AND s.miny<=t.maxy AND t.miny<=s.maxy LEFT JOIN rim ON rim.ss=s.seq AND rim.ts=t.seq
 WHERE rim.ss IS NOT NULL OR (s.minx>=t.minx AND s.maxx<=t.maxx AND s.miny>=t.miny AND s.maxy<=t.maxy)),
v AS (SELECT s.drawing_key, s.seq, {_v.replace("count(t)", "count(ts)")} v FROM ent s LEFT JOIN rel ON rel.ss=s.seq WHERE {SCADA} GROUP BY 1,2)
SELECT drawing_key, seq subject_seq, CASE WHEN v=1.0 THEN 'PASS' ELSE 'FAIL' END status, v::double measured FROM v WHERE drawing_key IN (SELECT drawing_key FROM z)
UNION ALL SELECT drawing_key, seq, 'UNKNOWN', NULL FROM v WHERE drawing_key NOT IN (SELECT drawing_key FROM z)""",
    )
rule_query(
    "r10_length",
    {"subject": {"system": "POWER"}, "measurement": "length", "operator": "<=", "value": 6, "unit": "m"},
    f"""WITH {O.entities()}, l AS (SELECT *, sqrt(pow(bx-ax,2)+pow(ye-ay,2))*unit_to_mm/1000 v FROM ent WHERE system='POWER') SELECT drawing_key, seq subject_seq, {O.classify("v", "<=", 6)} status, round(v,3) measured FROM l""",
)
rule_query(
    "r10_off_axis_angle",
    {"subject": {"or": [{"system": "SCADA"}, {"layer_equals": "SUPPORT"}]}, "measurement": "off_axis_angle", "operator": "<=", "value": 0.15, "severity": "WARNING"},
    f"""WITH {O.entities()}, a AS (SELECT *, CASE WHEN kind='polyline' THEN ((degrees(atan2(ye-ay,bx-ax))%180)+180)%90 END m FROM ent WHERE system='SCADA' OR layer='SUPPORT'), l AS (SELECT *, least(m,90-m) v FROM a)
SELECT drawing_key, seq subject_seq, CASE WHEN v IS NULL THEN 'UNKNOWN' ELSE {O.classify("v", "<=", 0.15, "WARNING")} END status, round(v,3) measured FROM l""",
)
rule_query(
    "r10_principal_angle",
    {"subject": {"entity_type": ["LINE", "LWPOLYLINE"], "not": {"layer_contains": "og"}}, "measurement": "angle", "operator": "==", "value": 0},
    f"""WITH {O.entities()}, l AS (SELECT *, CASE WHEN closed THEN 0.0 ELSE ((degrees(atan2(ye-ay,bx-ax))%180)+180)%180 END v FROM ent WHERE entity_type IN ('LINE','LWPOLYLINE') AND layer NOT LIKE '%OG%') SELECT drawing_key, seq subject_seq, {O.classify("v", "==", 0)} status, round(v,3) measured FROM l""",
)
rule_query(
    "r11_entity_count",
    {"subject": {"entity_type": "text", "text_regex": "scada"}, "measurement": "entity_count", "operator": ">=", "value": 93},
    f"""WITH {O.entities()}, d AS (SELECT DISTINCT drawing_key FROM ent), c AS (SELECT drawing_key, count(*) n FROM ent WHERE kind='text' GROUP BY 1) SELECT d.drawing_key, NULL::bigint subject_seq, CASE WHEN coalesce(n,0)>=93 THEN 'PASS' ELSE 'FAIL' END status, coalesce(n,0)::double measured FROM d LEFT JOIN c USING (drawing_key)""",
)
rule_query(
    "r11_entity_exists",
    {"subject": {"layer_equals": "NO-SUCH"}, "measurement": "entity_exists", "severity": "WARNING"},
    "SELECT DISTINCT 'dwg-'||(o_orderkey//1024) drawing_key, NULL::bigint subject_seq, 'WARNING' status, 0.0::double measured FROM orders",
)
rule_query(
    "r16_any_within",
    {"subject": {"system": "SCADA"}, "target": {"layer_equals": "SUPPORT"}, "measurement": "distance", "operator": "<=", "value": 600, "warn_margin": 100},
    f"""WITH {O.entities()}, p AS (SELECT s.drawing_key, s.seq ss, t.seq ts, {O.line_circle()}*s.unit_to_mm v FROM ent s JOIN ent t ON s.drawing_key=t.drawing_key AND {SCADA} AND t.layer='SUPPORT' AND s.minx-1800/s.unit_to_mm<=t.maxx AND t.minx<=s.maxx+1800/s.unit_to_mm AND s.miny-1800/s.unit_to_mm<=t.maxy AND t.miny<=s.maxy+1800/s.unit_to_mm),
c AS (SELECT *, CASE WHEN v>600+1e-6 THEN 'FAIL' WHEN v>500+1e-6 THEN 'WARNING' ELSE 'PASS' END st FROM p WHERE v<=1800+1e-6),
r AS (SELECT *, row_number() OVER (PARTITION BY ss ORDER BY CASE st WHEN 'PASS' THEN 0 WHEN 'WARNING' THEN 1 ELSE 3 END, CASE WHEN st='WARNING' THEN 0 ELSE abs(v-600) END, ts) n FROM c)
SELECT s.drawing_key, s.seq subject_seq, coalesce(st,'FAIL') status, round(v,3) measured FROM ent s LEFT JOIN r ON r.ss=s.seq AND n=1 WHERE {SCADA}""",
)
rule_query(
    "r15_all_within",
    {"subject": {"layer_equals": "POWER-CROSS"}, "target": {"layer_equals": "NOGO"}, "measurement": "distance", "operator": "<=", "value": 300000, "quantifier": "all"},
    f"""WITH {O.entities()},
f AS (SELECT s.drawing_key, s.seq ss, t.seq ts, CASE WHEN s.ax BETWEEN t.minx AND t.maxx AND s.maxy>=t.miny AND s.miny<=t.maxy THEN 0 ELSE sqrt(pow(greatest(0,t.minx-s.maxx,s.minx-t.maxx),2)+pow(greatest(0,t.miny-s.maxy,s.miny-t.maxy),2)) END*s.unit_to_mm v FROM ent s JOIN ent t ON s.drawing_key=t.drawing_key AND s.layer='POWER-CROSS' AND t.layer='NOGO'),
b AS (SELECT *, row_number() OVER (PARTITION BY ss ORDER BY ts) n FROM f WHERE v>300000+1e-6),
g AS (SELECT ss, count(*) violations FROM b GROUP BY 1), w AS (SELECT ss, max(v) v FROM f GROUP BY 1)
SELECT s.drawing_key, s.seq subject_seq, CASE WHEN w.ss IS NULL THEN 'UNKNOWN' WHEN b.ss IS NULL THEN 'PASS' ELSE 'FAIL' END status, round(coalesce(b.v,w.v),3) measured, g.violations FROM ent s LEFT JOIN b ON b.ss=s.seq AND n=1 LEFT JOIN g ON g.ss=s.seq LEFT JOIN w ON w.ss=s.seq WHERE s.layer='POWER-CROSS'""",
    columns=("drawing_key", "subject_seq", "status", "measured", "violations"),
)
rule_query(
    "r14_worst_intersection",
    {"subject": {"layer_equals": "WATER"}, "target": {"layer_equals": "POWER-CABLE"}, "measurement": "intersection", "operator": "<=", "value": 0, "quantifier": "all", "severity": "WARNING"},
    f"""WITH {O.entities()}, x AS (SELECT s.seq ss, count(*) n FROM ent s JOIN ent t ON s.drawing_key=t.drawing_key AND s.layer='WATER' AND t.layer='POWER-CABLE' AND {O.crosses()} GROUP BY 1)
SELECT s.drawing_key, s.seq subject_seq, CASE WHEN n>0 THEN 'WARNING' ELSE 'PASS' END status, CASE WHEN n>0 THEN 1.0::double END measured, n violations FROM ent s LEFT JOIN x ON x.ss=s.seq WHERE s.layer='WATER'""",
    columns=("drawing_key", "subject_seq", "status", "measured", "violations"),
)
CONNECT = normalise({"id": "R12", "subject": {"layer_equals": "SCADA-CABLE"}, "measurement": "connectivity", "snap_tolerance_mm": 5})


@query(
    "r12_connectivity",
    f"""WITH {O.entities()}, s AS (SELECT * FROM ent WHERE layer='SCADA-CABLE'), n AS (SELECT drawing_key, count(*) FILTER (WHERE slot=0) runs FROM s GROUP BY 1)
SELECT drawing_key, CASE WHEN runs=1 THEN 'PASS' ELSE 'FAIL' END status, CASE WHEN runs=1 THEN 1.0::double ELSE 0.0::double END measured, runs violations FROM n""",
)
def connectivity(spark, sf_dir):
    return evaluator(spark, sf_dir).rule(CONNECT).select("drawing_key", "status", "measured", "violations")


#: Rules of the coverage and issue queries: cheap ones of several kinds.
MIXED = [BENCH_RULES[0], BENCH_RULES[3], BENCH_RULES[5], BENCH_RULES[6], normalise({"id": "OFF", "enabled": False, "subject": {"system": "SCADA"}, "measurement": "length", "operator": "<=", "value": 1}), normalise({"id": "NONE", "subject": {"layer_equals": "NO-SUCH"}, "measurement": "length", "operator": "<=", "value": 1})]


def mixed(spark, sf_dir, revised=False):
    return evaluator(spark, sf_dir, revised).evaluate(MIXED)


def _mixed_sql(revised=False) -> str:
    e = O.entities(revised, "ent")
    clear = _each(O.line_line(), 300, 50, SCADA, POWER, unknown="NOT (s.z_known AND t.z_known)", skip=LEVELS)
    clear = clear.replace("WITH " + O.entities() + ",\n", "WITH ")
    return f"""WITH {e},
r0 AS ({clear}),
x AS (SELECT s.drawing_key, s.seq ss FROM ent s JOIN ent t ON s.drawing_key=t.drawing_key AND {SCADA} AND t.layer='WATER' AND {O.crosses()}),
r1 AS (SELECT drawing_key, ss subject_seq, 'FAIL' status, 1.0::double measured FROM x UNION ALL SELECT drawing_key, seq, 'PASS', NULL FROM ent s WHERE {SCADA} AND seq NOT IN (SELECT ss FROM x)),
r2 AS (SELECT drawing_key, seq subject_seq, CASE WHEN least(m,90-m)>1+1e-6 THEN 'FAIL' ELSE 'PASS' END status FROM (SELECT *, ((degrees(atan2(ye-ay,bx-ax))%180)+180)%90 m FROM ent s WHERE {SCADA})),
r3 AS (SELECT drawing_key, seq subject_seq, CASE WHEN sqrt(pow(bx-ax,2)+pow(ye-ay,2))*unit_to_mm/1000>6+1e-6 THEN 'FAIL' ELSE 'PASS' END status FROM ent WHERE system='POWER'),
al AS (SELECT 'CLEARANCE' rule_id, 0 rule_pos, drawing_key, status FROM r0 UNION ALL SELECT 'NO-CROSS', 1, drawing_key, status FROM r1 UNION ALL SELECT 'ORTHO', 2, drawing_key, status FROM r2 UNION ALL SELECT 'LENGTH', 3, drawing_key, status FROM r3)"""


def rule_counts(results: DataFrame, rules: list[dict]) -> DataFrame:
    """Counts by status of every enabled rule, its outcome (first of FAIL, WARNING, UNKNOWN, PASS) and whether it found subjects."""
    spark = results.sparkSession
    known = spark.createDataFrame([(r["id"],) for r in rules if r["enabled"]], "rule_id string")
    counts = results.groupBy("rule_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("FAIL", "WARNING", "PASS", "UNKNOWN")])
    out = F.broadcast(known).join(counts, "rule_id", "left").na.fill(0)
    outcome = None
    for s in ("FAIL", "WARNING", "UNKNOWN", "PASS"):
        outcome = F.when(F.col(s) > 0, s) if outcome is None else outcome.when(F.col(s) > 0, s)
    return out.withColumn("outcome", outcome).withColumn("execution", F.when(outcome.isNull(), "skipped").otherwise("evaluated"))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE status='{s}') \"{s}\"" for s in ("FAIL", "WARNING", "PASS", "UNKNOWN"))
_OUTCOME = "CASE WHEN \"FAIL\">0 THEN 'FAIL' WHEN \"WARNING\">0 THEN 'WARNING' WHEN \"UNKNOWN\">0 THEN 'UNKNOWN' WHEN \"PASS\">0 THEN 'PASS' END"
_STATS = f"{_mixed_sql()}, c AS (SELECT rule_id, {_COUNTS} FROM al GROUP BY 1 UNION ALL SELECT 'NONE',0,0,0,0), o AS (SELECT *, {_OUTCOME} outcome FROM c)"


@query("a02_rule_counts", f"{_STATS} SELECT *, CASE WHEN outcome IS NULL THEN 'skipped' ELSE 'evaluated' END execution FROM o")
def rule_stats(spark, sf_dir):
    return rule_counts(mixed(spark, sf_dir), MIXED)


@query(
    "a04_coverage",
    f"""{_STATS} SELECT 6::bigint loaded, 5::bigint applicable, count(outcome) evaluated, 5-count(outcome) skipped, count(*) FILTER (WHERE outcome='PASS') passed, count(*) FILTER (WHERE outcome='FAIL') failed, count(*) FILTER (WHERE outcome='WARNING') warning, count(*) FILTER (WHERE outcome='UNKNOWN') undetermined, round(100.0*count(outcome)/5,1)::double percent FROM o""",
)
def coverage(spark, sf_dir):
    one = lambda s: F.count_if(F.col("outcome") == s)
    out = rule_counts(mixed(spark, sf_dir), MIXED).agg(F.count("*").alias("applicable"), F.count("outcome").alias("evaluated"), one("PASS").alias("passed"), one("FAIL").alias("failed"), one("WARNING").alias("warning"), one("UNKNOWN").alias("undetermined"))
    return out.withColumns({"loaded": F.lit(len(MIXED)).cast("long"), "skipped": F.col("applicable") - F.col("evaluated"), "percent": F.round(100.0 * F.col("evaluated") / F.col("applicable"), 1)})


@query("a05_status_counts", f"{_mixed_sql()} SELECT drawing_key, {_COUNTS} FROM al GROUP BY 1")
def status_counts(spark, sf_dir):
    return mixed(spark, sf_dir).groupBy("drawing_key").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("FAIL", "WARNING", "PASS", "UNKNOWN")])


NO_CROSS = BENCH_RULES[3]
_IDS = f"""x AS (SELECT s.drawing_key, s.seq ss, s.handle sh, t.handle th, s.ax+(s.bx-s.ax)*((t.ax-s.ax)/nullif(s.bx-s.ax,0)) px, s.ay+(s.ye-s.ay)*((t.ax-s.ax)/nullif(s.bx-s.ax,0)) py FROM ent s JOIN ent t ON s.drawing_key=t.drawing_key AND s.system='SCADA' AND s.slot=0 AND t.layer='WATER' AND {O.crosses()})"""
_ID = "'ISS-'||upper(substr(sha256(drawing_key||'|NO-CROSS|'||least(sh,th)||','||greatest(sh,th)||'|'||round_even(px,0)::bigint||','||round_even(py,0)::bigint),1,16))"
RUNS_ONLY = normalise({**NO_CROSS, "subject": {"system": "SCADA", "entity_type": "LWPOLYLINE"}})


@query("f09_issue_ids", f"WITH {O.entities()}, {_IDS} SELECT ss subject_seq, {_ID} issue_id FROM x")
def issue_identity(spark, sf_dir):
    out = evaluator(spark, sf_dir).rule(RUNS_ONLY).where("status = 'FAIL'")
    return E.issue_ids(out).select("subject_seq", "issue_id")


def baseline_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(issue_id, state): NEW, RESOLVED, CHANGED (status, or measured by 1e-6) or UNCHANGED; PASS rows of either side do not count."""
    p, c = (d.where("status <> 'PASS'").select("issue_id", F.struct("status", "measured").alias(n)) for d, n in ((previous, "p"), (current, "c")))
    same = (F.col("p.status") == F.col("c.status")) & ((F.col("p.measured").isNull() & F.col("c.measured").isNull()) | F.coalesce(F.abs(F.col("p.measured") - F.col("c.measured")) < 1e-6, F.lit(False)))
    return p.join(c, "issue_id", "full").select("issue_id", F.when(F.col("p").isNull(), "NEW").when(F.col("c").isNull(), "RESOLVED").when(same, "UNCHANGED").otherwise("CHANGED").alias("state"))


ORTHO = normalise({**BENCH_RULES[6], "value": 3.5})


@query(
    "u01_baseline_diff",
    f"""WITH {O.entities()}, {O.entities(True, "ent2")},
p AS (SELECT seq, handle, drawing_key, (minx+maxx)/2 x, (miny+maxy)/2 y FROM ent WHERE system='POWER' AND sqrt(pow(bx-ax,2)+pow(ye-ay,2))*unit_to_mm/1000>3.5+1e-6),
c AS (SELECT seq, handle, drawing_key, (minx+maxx)/2 x, (miny+maxy)/2 y FROM ent2 WHERE system='POWER' AND sqrt(pow(bx-ax,2)+pow(ye-ay,2))*unit_to_mm/1000>3.5+1e-6)
SELECT state, count(*) n FROM (SELECT CASE WHEN p.seq IS NULL THEN 'NEW' WHEN c.seq IS NULL THEN 'RESOLVED' ELSE 'UNCHANGED' END state FROM p FULL JOIN c ON p.seq=c.seq AND round_even(p.x,0)=round_even(c.x,0) AND round_even(p.y,0)=round_even(c.y,0)) GROUP BY 1""",
)
def compare_runs(spark, sf_dir):
    a, b = (E.issue_ids(evaluator(spark, sf_dir, r).rule(ORTHO)) for r in (False, True))
    return baseline_diff(a, b).groupBy("state").agg(F.count("*").alias("n"))


@query("bench_seven_rules")
def seven_rules(spark, sf_dir):
    """The headline query: seven rules over all drawings, counted by rule and status."""
    return evaluator(spark, sf_dir).counts(BENCH_RULES)
