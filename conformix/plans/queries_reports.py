"""Queries over stored results and history: issue tables, reports, lists."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from conformix.operators import documents as Docs
from conformix.operators import evaluate as E
from conformix.operators import reports as R
from conformix.operators import routes as Routes
from conformix.plans import oracle_parts as O
from conformix.plans import queries_drawings as QD
from conformix.plans.queries_candidates import once
from conformix.plans.queries_rules import _ID, _IDS, RUNS_ONLY, evaluator
from conformix.plans.queries_text import CHUNKS, chunks, spec_files
from conformix.plans.rules import BENCH_RULES, normalise
from conformix.sources import derived as D
from conformix.sources.tables import shared_dir

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


# -- results of a run ------------------------------------------------------------------------------

LONG = normalise({**BENCH_RULES[6], "value": 3.5, "severity": "WARNING"})
RUN_RULES = [LONG, RUNS_ONLY]


def issues(spark, sf_dir):
    """Issue rows of two rules over all drawings, written once a session."""
    return once(spark, sf_dir, "issues", lambda: R.issue_rows(E.issue_ids(evaluator(spark, sf_dir).evaluate(RUN_RULES)), RUN_RULES))


_LEN = "sqrt(pow(bx-ax,2)+pow(ye-ay,2))*unit_to_mm/1000"
_RES = f"""{O.entities()}, {_IDS},
r AS (SELECT drawing_key run_id, 0 rule_pos, 'LENGTH' rule_id, seq subject_seq, handle sh, layer, NULL::varchar th, round({_LEN},3) measured, CASE WHEN {_LEN}>3.5+1e-6 THEN 'WARNING' ELSE 'PASS' END status, (minx+maxx)/2 x, (miny+maxy)/2 y FROM ent WHERE system='POWER'
 UNION ALL SELECT drawing_key, 1, 'NO-CROSS', ss, sh, 'SCADA-CABLE', th, 1.0, 'FAIL', px, py FROM x
 UNION ALL SELECT drawing_key, 1, 'NO-CROSS', seq, handle, layer, NULL, NULL, 'PASS', (minx+maxx)/2, (miny+maxy)/2 FROM ent WHERE system='SCADA' AND slot=0 AND seq NOT IN (SELECT ss FROM x)),
iss AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rule_pos, subject_seq, th NULLS FIRST)-1 seq, CASE WHEN th IS NULL THEN sh ELSE least(sh,th)||','||greatest(sh,th) END AS handle FROM r)"""


@query("s09_issue_rows", f"WITH {_RES} SELECT run_id, seq, rule_id, status, handle, measured, CASE status WHEN 'PASS' THEN NULL ELSE round(x,3) END x, CASE status WHEN 'PASS' THEN NULL ELSE round(y,3) END y, CASE rule_id WHEN 'LENGTH' THEN '<=' ELSE '==' END required_op FROM iss")
def s09(spark, sf_dir):
    """The stored rows, partitioned by run, read back."""
    path = f"{shared_dir(spark)}/conformix/issue-sink-{uuid.uuid4().hex}"
    issues(spark, sf_dir).repartition("run_id").write.partitionBy("run_id").parquet(path)
    bad = F.col("status") != "PASS"
    back = spark.read.schema(issues(spark, sf_dir).schema).parquet(path)
    return back.select("run_id", "seq", "rule_id", "status", "handle", "measured", F.when(bad, F.round("x", 3)).alias("x"), F.when(bad, F.round("y", 3)).alias("y"), "required_op")


@query("s09_issue_links", f"WITH {_RES} SELECT run_id, rule_id, role, h AS handle FROM (SELECT run_id, rule_id, 'subject' AS role, sh h FROM iss UNION ALL SELECT run_id, rule_id, 'target', th FROM iss WHERE th IS NOT NULL)")
def s09_links(spark, sf_dir):
    i = issues(spark, sf_dir)
    return R.issue_links(i).join(i.select("issue_id", "rule_id").hint("merge"), "issue_id").select("run_id", "rule_id", "role", "handle")


@query(
    "o01_issue_orders",
    f"WITH {_RES} SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY CASE status WHEN 'FAIL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 3 END, rule_id, seq)::int by_severity, row_number() OVER (PARTITION BY run_id ORDER BY measured NULLS LAST, seq)::int by_measured FROM iss",
)
def o01(spark, sf_dir):
    i = R.ranked(issues(spark, sf_dir), "severity").withColumnRenamed("rank", "by_severity")
    return R.ranked(i, "measured").select("run_id", "seq", "by_severity", F.col("rank").alias("by_measured"))


@query("p13_issue_filter", f"WITH {_RES} SELECT run_id, seq FROM iss WHERE status IN ('FAIL','WARNING') AND (contains(lower(handle),'a4') OR contains(lower(layer),'a4') OR contains(lower(rule_id),'a4') OR contains(lower(CASE rule_id WHEN 'NO-CROSS' THEN {_ID.replace('drawing_key', 'run_id').replace('px', 'x').replace('py', 'y')} ELSE 'ISS-'||upper(substr(sha256(run_id||'|LENGTH|'||sh||'|'||round_even(x,0)::bigint||','||round_even(y,0)::bigint),1,16)) END),'a4'))")
def p13(spark, sf_dir):
    return R.select_issues(issues(spark, sf_dir), ["FAIL", "WARNING"], search="A4").select("run_id", "seq")


_REQ = "CASE rule_id WHEN 'LENGTH' THEN '<= 3.5 m' ELSE '交叉數 == 0' END"
_MEAS = "CASE WHEN measured IS NULL THEN '' WHEN rule_id='LENGTH' THEN printf('%g', measured)||' m' WHEN measured>=1 THEN '有交叉' ELSE '沒有交叉' END"


_STATUS = "CASE status WHEN 'FAIL' THEN '不合格' WHEN 'WARNING' THEN '警告' WHEN 'PASS' THEN '合格' ELSE '無法判定' END"


@query(
    "s10_csv_file",
    f"WITH {_RES} SELECT 'P' AS project, {_STATUS} AS status, rule_id, handle, CASE WHEN measured IS NULL THEN NULL ELSE printf('%g', measured) END measured, {_REQ} required, CASE rule_id WHEN 'LENGTH' THEN 'm' ELSE 'count' END unit FROM iss",
)
def s10(spark, sf_dir):
    """Written as CSV with a header, read back by its columns; empty cells come back as nulls."""
    path = f"{shared_dir(spark)}/conformix/issue-csv-{uuid.uuid4().hex}"
    R.csv_rows(issues(spark, sf_dir), "P").write.option("header", True).option("escape", '"').csv(path)
    back = spark.read.option("header", True).option("escape", '"').schema(", ".join(f"`{c}` string" for c in R.CSV_COLUMNS)).csv(path)
    names = {"專案": "project", "狀態": "status", "規則編號": "rule_id", "Handle": "handle", "實測值": "measured", "規則要求": "required", "單位": "unit"}
    return back.select(*[F.col(k).alias(v) for k, v in names.items()])


_SHOWN = "b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE status WHEN 'FAIL' THEN 0 ELSE 1 END, seq) rank, count(*) OVER (PARTITION BY run_id) n FROM iss WHERE status<>'PASS')"


@query("s11_o06_report_details", f"WITH {_RES}, {_SHOWN} SELECT run_id, seq, rank::int rank, greatest(n-500,0) AS hidden FROM b WHERE rank<=500")
def s11(spark, sf_dir):
    return R.details(issues(spark, sf_dir)).select("run_id", "seq", "rank", "hidden")


_ST = ("FAIL", "WARNING", "UNKNOWN", "PASS")
_BY = ", ".join(f"count(*) FILTER (WHERE status='{s}') {s.lower()}_" for s in _ST)


@query(
    "s11_report_lines",
    f"""WITH {_RES}, pr AS (SELECT run_id, rule_id, {_BY} FROM iss GROUP BY 1, 2), oc AS (SELECT *, CASE WHEN fail_>0 THEN 'FAIL' WHEN warning_>0 THEN 'WARNING' WHEN unknown_>0 THEN 'UNKNOWN' ELSE 'PASS' END o FROM pr)
SELECT DISTINCT drawing_key run_id, 'header' AS section, '單位' item, CASE WHEN units_assumed THEN '圖面未宣告單位，以 mm 推定' ELSE '1 圖面單位 = '||printf('%g', unit_to_mm)||' mm' END AS content FROM ent
UNION ALL SELECT run_id, 'coverage', 'evaluated', count(*)::varchar FROM oc GROUP BY 1 UNION ALL {" UNION ALL ".join(f"SELECT run_id, 'coverage', '{s}', (count(*) FILTER (WHERE o='{s}'))::varchar FROM oc GROUP BY 1 UNION ALL SELECT run_id, 'result', '{s}', sum({s.lower()}_)::bigint::varchar FROM pr GROUP BY 1" for s in _ST)}
UNION ALL SELECT run_id, 'rule', rule_id, 'FAIL='||fail_||' WARNING='||warning_||' UNKNOWN='||unknown_||' PASS='||pass_||' '||o FROM oc""",
)
def s11_lines(spark, sf_dir):
    """Units, coverage, totals and rules of every run's report."""
    return R.report_lines(issues(spark, sf_dir), D.drawings(spark, sf_dir))


@query("s14_payload", f"WITH {_RES}, p AS (SELECT *, row_number() OVER (PARTITION BY run_id, status='PASS' ORDER BY seq) n FROM iss) SELECT run_id, seq, status, {_MEAS} measured_text, {_REQ} required_text FROM p WHERE status<>'PASS' OR n<=300")
def s14(spark, sf_dir):
    return R.payload(issues(spark, sf_dir)).select("run_id", "seq", "status", "measured_text", "required_text")


def extents(spark, sf_dir):
    e = D.stored_entities(spark, sf_dir).groupBy(F.col("drawing_key").alias("run_id")).agg(F.greatest(F.max("maxx") - F.min("minx"), F.max("maxy") - F.min("miny")).alias("span"))
    return e.join(D.drawings(spark, sf_dir).select(F.col("drawing_key").alias("run_id"), "unit_to_mm").hint("merge"), "run_id")


@query(
    "s12_f25_markers",
    f"""WITH {_RES}, ex AS (SELECT drawing_key run_id, greatest(max(maxx)-min(minx), max(maxy)-min(miny)) span, max(unit_to_mm) u FROM ent GROUP BY 1),
m AS (SELECT iss.*, greatest(span*0.006, 20/u) s FROM iss JOIN ex USING (run_id) WHERE status<>'PASS'),
k AS (SELECT *, unnest(['circle','line','line','text']) kind, unnest([x,x-s,x,x+s*1.3]) x1, unnest([y,y,y-s,y+s*0.3]) y1 FROM m)
SELECT run_id, CASE status WHEN 'FAIL' THEN 'ERI_FAIL' ELSE 'ERI_WARNING' END marker_layer, kind, round(x1,2) x1, round(y1,2) y1, CASE rule_id WHEN 'LENGTH' THEN 'WARNING '||printf('%g',measured)||'m vs <=3.5m' ELSE 'FAIL 1 vs ==0' END AS label FROM k""",
)
def s12(spark, sf_dir):
    m = R.markers(issues(spark, sf_dir), extents(spark, sf_dir))
    return m.select("run_id", "marker_layer", "kind", F.round("x1", 2).alias("x1"), F.round("y1", 2).alias("y1"), F.substring("label", 10, 100).alias("label"))


@query("s13_j26_plan_entities", f"WITH {_RES}, hit AS (SELECT run_id, sh h FROM iss WHERE status<>'PASS' UNION SELECT run_id, th FROM iss WHERE th IS NOT NULL) SELECT drawing_key, ent.handle, hit.h IS NOT NULL AS involved, 0::bigint left_out FROM ent LEFT JOIN hit ON hit.run_id=drawing_key AND hit.h=ent.handle WHERE kind<>'text'")
def s13(spark, sf_dir):
    links = R.issue_links(issues(spark, sf_dir).where("status <> 'PASS'"))
    return R.plan_entities(D.stored_entities(spark, sf_dir), links).select("drawing_key", "handle", "involved", "left_out")


@query("s16_ruleset_fingerprint", "SELECT count(*) AS sets, count(DISTINCT f) AS different FROM (SELECT p_brand, list_sort(list(p_type||'|'||p_size)) f FROM part GROUP BY 1)")
def s16(spark, sf_dir):
    """A rule set for each brand; two sets are told apart exactly by their fingerprints."""
    p = D.read(spark, sf_dir, "part").select(F.col("p_brand").alias("set"), F.col("p_type").alias("id"), F.col("p_size").alias("value"))
    return R.fingerprint(p, "set").agg(F.count("*").alias("sets"), F.countDistinct("sha256").alias("different"))


@query("s15_recent_activity", "SELECT event_id, event_type AS action FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def s15(spark, sf_dir):
    """Two appends to the activity table, then its latest hundred rows."""
    path = f"{shared_dir(spark)}/conformix/audit-{uuid.uuid4().hex}"
    e = D.read(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("action"))
    for part in (e.where("action = 'error'"), e.where("action IS NULL OR action <> 'error'")):
        part.write.mode("append").parquet(path)
    return spark.read.schema(e.schema).parquet(path).orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "action")


# -- texts -----------------------------------------------------------------------------------------

_KINDS = "['outside_zone','inside_zone','intersection','length','off_axis_angle']"
_OPS = "['>=','<=','==','!=','>']"


@query(
    "f19_requirement_texts",
    f"""WITH a AS (SELECT l_orderkey, l_linenumber, {_KINDS}[(l_orderkey%5+1)::int] m, {_OPS}[(l_linenumber%5+1)::int] op, l_quantity::bigint%3 q, round(l_discount*l_quantity,2) d FROM lineitem),
b AS (SELECT *, CASE WHEN m IN ('length','off_axis_angle') THEN d ELSE q END::double v, CASE m WHEN 'length' THEN ' mm' WHEN 'off_axis_angle' THEN '°' ELSE '' END u FROM a),
c AS (SELECT *, CASE op WHEN '>=' THEN 0>=v WHEN '<=' THEN 0<=v WHEN '==' THEN v=0 WHEN '!=' THEN v<>0 ELSE 0>v END no, CASE op WHEN '>=' THEN 1>=v WHEN '<=' THEN 1<=v WHEN '==' THEN v=1 WHEN '!=' THEN v<>1 ELSE 1>v END yes FROM b)
SELECT l_orderkey, l_linenumber, CASE WHEN m NOT LIKE '%zone' THEN CASE m WHEN 'intersection' THEN '交叉數 ' ELSE '' END||op||' '||printf('%g',v)||u WHEN no AND yes THEN '任何結果都符合（沒有限制）' WHEN no THEN CASE m WHEN 'outside_zone' THEN '必須進入區域（不在區域外）' ELSE '不得完全在區域內' END WHEN yes THEN CASE m WHEN 'outside_zone' THEN '必須在區域外' ELSE '必須完全在區域內' END ELSE '沒有任何結果能符合' END required,
CASE m WHEN 'outside_zone' THEN CASE WHEN v>=1 THEN '在區域外' ELSE '進入了區域' END WHEN 'inside_zone' THEN CASE WHEN v>=1 THEN '完全在區域內' ELSE '不在（或未完全在）區域內' END WHEN 'intersection' THEN CASE WHEN v>=1 THEN '有交叉' ELSE '沒有交叉' END ELSE printf('%g',v)||u END measured FROM c""",
)
def f19(spark, sf_dir):
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % 5 + 1).cast("int"))
    kinds, ops = ("outside_zone", "inside_zone", "intersection", "length", "off_axis_angle"), (">=", "<=", "==", "!=", ">")
    t = D.read(spark, sf_dir, "lineitem").withColumns({"m": pick(kinds, "l_orderkey"), "op": pick(ops, "l_linenumber")})
    free = F.col("m").isin("length", "off_axis_angle")
    t = t.withColumn("v", F.when(free, F.round(F.col("l_discount") * F.col("l_quantity"), 2)).otherwise(F.rint("l_quantity").cast("long") % 3).cast("double"))
    t = t.withColumn("u", F.when(F.col("m") == "length", "mm").when(F.col("m") == "off_axis_angle", "deg").otherwise("count"))
    return t.select("l_orderkey", "l_linenumber", R.required_text(F.col("m"), F.col("op"), F.col("v"), F.col("u")).alias("required"), R.measured_text(F.col("m"), F.col("v"), F.col("u")).alias("measured"))


@query("f20_evidence_references", f"WITH {CHUNKS} SELECT 'doc-'||document_id||'.txt 第1頁 第'||CASE WHEN line_start=line_end THEN line_start::varchar ELSE line_start||'-'||line_end END||'行' AS ref FROM ch")
def f20(spark, sf_dir):
    return chunks(spark, sf_dir).select(R.evidence_reference(F.col("filename"), F.col("page"), F.col("line_start"), F.col("line_end")).alias("ref"))


@query("f13_entity_labels", f"WITH {O.entities()} SELECT seq, coalesce(system||' ','')||entity_type||'（圖層 '||layer||'，Handle '||handle||'）' AS label FROM ent")
def f13(spark, sf_dir):
    return QD.classified(spark, sf_dir).select("seq", R.entity_label(F.col("system"), F.col("entity_type"), F.col("layer"), F.col("handle")).alias("label"))


# -- history ---------------------------------------------------------------------------------------


def runs(spark, sf_dir):
    """A run for each order: its customer is the project, its priority the drawing's name."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    return D.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("logical_name"), status.alias("status"), F.col("o_orderdate").alias("finished_at"))


@query("o07_active_runs", "SELECT o_orderkey run_id FROM orders WHERE o_orderstatus NOT IN ('F','O') ORDER BY o_orderdate, o_orderkey LIMIT 50")
def o07_active(spark, sf_dir):
    """Runs that are not through, oldest first."""
    return runs(spark, sf_dir).where("status = 'running'").orderBy("finished_at", "run_id").limit(50).select("run_id")


@query(
    "j15_default_baseline",
    """SELECT r.o_orderkey run_id, (SELECT max_by(b.o_orderkey, (b.o_orderdate, b.o_orderkey)) FROM orders b WHERE b.o_custkey=r.o_custkey AND b.o_orderpriority=r.o_orderpriority AND b.o_orderstatus='F' AND b.o_orderkey<>r.o_orderkey) baseline FROM orders r""",
)
def j15(spark, sf_dir):
    return R.default_baselines(runs(spark, sf_dir))


@query("j24_o07_run_history", "SELECT o_orderkey run_id, c_name AS project_name, o_orderdate finished_at FROM orders LEFT JOIN customer ON c_custkey=o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def j24(spark, sf_dir):
    newest = runs(spark, sf_dir).orderBy(F.desc("finished_at"), F.desc("run_id")).limit(50)
    names = D.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project"), F.col("c_name").alias("project_name"))
    # fifty rows are broadcast, not the table of projects
    near = names.join(F.broadcast(newest.select("project").distinct()), "project", "left_semi")
    return newest.join(F.broadcast(near), "project", "left").select("run_id", "project_name", "finished_at")


@query("o07_failed_runs", "SELECT o_custkey project, o_orderkey run_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) n FROM orders WHERE o_orderstatus='O') WHERE n<=10")
def o07(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("finished_at"), F.desc("run_id")))
    return runs(spark, sf_dir).where("status = 'failed'").withColumn("n", n).where("n <= 10").select("project", "run_id")


@query(
    "j23_projects_with_counts",
    "SELECT c_custkey project, (SELECT count(*) FROM orders WHERE o_custkey=c_custkey) runs, (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_custkey=c_custkey) names, (SELECT count(*) FROM events WHERE user_id=c_custkey) actions FROM customer",
)
def j23(spark, sf_dir):
    r = runs(spark, sf_dir).groupBy("project").agg(F.count("*").alias("runs"), F.countDistinct("logical_name").alias("names"))
    a = D.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("project")).agg(F.count("*").alias("actions"))
    p = D.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project"))
    return p.join(r.hint("merge"), "project", "left").join(a.hint("merge"), "project", "left").na.fill(0, ["runs", "names", "actions"])


@query("a23_store_checks", "SELECT 'completed' AS what, count(*) n FROM orders WHERE o_orderstatus='F' UNION ALL SELECT 'failed', count(*) FROM orders WHERE o_orderstatus='O' UNION ALL SELECT 'running', count(*) FROM orders WHERE o_orderstatus='P' UNION ALL SELECT 'dangling actions', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def a23(spark, sf_dir):
    """Runs by status, and actions that name no project."""
    by = runs(spark, sf_dir).groupBy(F.col("status").alias("what")).agg(F.count("*").alias("n"))
    p = D.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    lost = D.read(spark, sf_dir, "events").join(p.hint("merge"), "user_id", "left_anti").agg(F.count("*").alias("n"))
    return by.unionByName(lost.select(F.lit("dangling actions").alias("what"), "n"))


@query("j16_pending_extraction", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality<>1")
def j16(spark, sf_dir):
    """Documents never read, or read by another version of the reading rules (here the label stands for the version)."""
    done = D.read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return D.read(spark, sf_dir, "documents").select("doc_id").join(done.hint("merge"), "doc_id", "left_anti")


@query("a20_file_status", "SELECT source, count(*) FILTER (WHERE l.doc_id IS NOT NULL) read, count(*) FILTER (WHERE l.doc_id IS NULL) pending FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def a20(spark, sf_dir):
    done = D.read(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("done"))
    f = D.read(spark, sf_dir, "documents").select("doc_id", "source").join(done.hint("merge"), "doc_id", "left")
    return f.groupBy("source").agg(F.count("done").alias("read"), F.count_if(F.col("done").isNull()).alias("pending"))


_SCAN = "SELECT source folder, CASE WHEN doc_id%5=0 THEN 'new' WHEN doc_id%7=0 THEN 'removed' WHEN doc_id%11=0 THEN 'reparsed' WHEN doc_id%13=0 THEN 'touched' ELSE 'reused' END AS action FROM documents WHERE NOT (doc_id%5=0 AND doc_id%7=0)"


@query("a21_scan_statistics", f"SELECT folder, action, count(*) n FROM ({_SCAN}) GROUP BY ALL")
def a21(spark, sf_dir):
    d = Docs.scan_diff(*spec_files(spark, sf_dir))
    return d.groupBy(F.substring_index("rel_path", "/", 1).alias("folder"), "action").agg(F.count("*").alias("n"))


@query("a07_routes_by_system", f"WITH {O.entities()}, {QD._TOUCH} SELECT drawing_key, system, count(DISTINCT root) routes, count(*) entities FROM mr GROUP BY ALL")
def a07(spark, sf_dir):
    return Routes.routes_by_system(QD.members(spark, sf_dir))
