"""Queries that turn specification sentences into rule candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from conformix.operators import documents as Docs
from conformix.operators import requirements as R
from conformix.plans.queries_text import lines_of_parts
from conformix.sources import derived as D
from conformix.sources.tables import materialise, shared_dir

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


# what each template of derived.SPEC_TEMPLATES requires: template, measurement, operator, value, unit, subject, target, zone, problems
_V = "p_size*10"
_EXPECTED = [
    (1, 0, "clearance", "horizontal_clearance", ">=", _V, "mm", "SCADA 電纜", "電力電纜", "", ""), (2, 0, "clearance", "horizontal_clearance", ">=", _V, "mm", "SCADA 電纜", "電力電纜", "", ""),
    (4, 0, "no_crossing", "intersection", "==", "0", "count", "弱電電纜", "給水管", "", ""), (5, 0, "keep_out", "outside_zone", "==", "1", "count", "弱電電纜", "", "機房禁設區。", ""),
    (6, 0, "inside_zone", "inside_zone", "==", "1", "count", "電纜", "", "管溝", ""), (7, 0, "max_length", "length", "<=", "p_size*1000", "mm", "電纜", "", "", ""),
    (8, 0, "orthogonal", "off_axis_angle", "<=", "p_size%5+1", "deg", "", "", "", "SUBJECT_MISSING"), (9, 0, "min_count", "entity_count", ">=", "p_size%9+1", "count", "支架。", "", "", ""),
    (10, 0, "clearance", "horizontal_clearance", ">=", _V, None, "通信線纜架", "電力線纜架", "", "ADVISORY,NO_UNIT"), (11, 0, None, None, None, "NULL", None, "", "", "", ""),
    (12, 0, "clearance", "horizontal_clearance", ">=", _V, "mm", "SCADA 電纜", "電力電纜", "", "UNSPECIFIED_AXIS"), (13, 0, "max_distance", "distance", "<=", _V, "mm", "電纜", "", "", "TARGET_MISSING"),
    (14, 1, "clearance", "horizontal_clearance", ">=", _V, "mm", "SCADA 電纜", "電力電纜", "", ""), (14, 2, "vertical_clearance", "vertical_clearance", ">=", _V, "mm", "SCADA 電纜", "電力電纜", "", "INHERITED_PARTIES"),
]


def _text(v) -> str:
    return "NULL::varchar" if v is None else f"'{v}'"


def _select(key: str, rows) -> str:
    one = "SELECT {key}, {part} part, {template} AS template, {measurement} measurement, {operator} AS operator, ({value})::double AS value, {unit} unit, {subject} subject, {target} target, {zone} AS zone, {problems} problems FROM part WHERE p_partkey%16={k}"
    names = ("template", "measurement", "operator", "value", "unit", "subject", "target", "zone", "problems")
    return " UNION ALL ".join(one.format(key=key, k=k, part=part, **{n: v if n == "value" else _text(v) for n, v in zip(names, rest, strict=True)}) for k, part, *rest in rows)


_stored: dict[tuple, object] = {}


def once(spark, sf_dir, name, make):
    """A table that several queries read, written once a session."""
    key = (spark.sparkContext.applicationId, shared_dir(spark), sf_dir, name)
    if key not in _stored:
        _stored[key] = materialise(make(), name)
    return _stored[key]


def by_line(spark, sf_dir):
    def make():
        lines = lines_of_parts(spark, sf_dir).withColumnRenamed("text", "sentence")
        return R.requirements(lines, ["p_partkey"])

    return once(spark, sf_dir, "requirements", make)


COLUMNS = ["p_partkey", "part", "template", "measurement", "operator", "value", "unit", "subject", "target", "zone", "concat_ws(',', problems) AS problems"]


def of_shape(name: str, keys: tuple[int, ...], where: str) -> None:
    """A query over all lines that keeps one kind of requirement."""

    def run(spark, sf_dir):
        return by_line(spark, sf_dir).where(where).selectExpr(*COLUMNS)

    QUERIES[name] = run
    ORACLES[name] = _select("p_partkey", [r for r in _EXPECTED if r[0] in keys])


of_shape("x10_no_crossing", (4,), "template = 'no_crossing'")
of_shape("x11_zones", (5, 6), "template IN ('keep_out', 'inside_zone')")
of_shape("x12_clearances", (1, 2, 10, 14), "template IN ('clearance', 'vertical_clearance') AND NOT array_contains(problems, 'UNSPECIFIED_AXIS')")
of_shape("x13_length", (7,), "template = 'max_length'")
of_shape("x14_orthogonal", (8,), "template = 'orthogonal'")
of_shape("x15_min_count", (9,), "template = 'min_count'")
of_shape("x16_distance", (12, 13), "template = 'max_distance' OR array_contains(problems, 'UNSPECIFIED_AXIS')")
of_shape("x17_not_enforceable", (11,), "NOT enforceable")
of_shape("x18_two_requirements", (14,), "part > 0")
of_shape("x19_first_shape", tuple(range(16)), "true")


@query("x08_limits", f"SELECT p_partkey, part, operator, value, unit, problems LIKE '%NO_UNIT%' unitless FROM ({_select('p_partkey', [r for r in _EXPECTED if r[2]])})")
def x08(spark, sf_dir):
    return by_line(spark, sf_dir).where("enforceable").select("p_partkey", "part", "operator", "value", "unit", F.array_contains("problems", "NO_UNIT").alias("unitless"))


@query("x09_parties", f"SELECT subject, target, zone, count(*) n FROM ({_select('p_partkey', _EXPECTED)}) WHERE template IS NOT NULL GROUP BY ALL")
def x09(spark, sf_dir):
    return by_line(spark, sf_dir).where("enforceable").groupBy("subject", "target", "zone").agg(F.count("*").alias("n"))


def candidates(spark, sf_dir):
    return once(spark, sf_dir, "candidates", lambda: R.from_chunks(Docs.chunk_lines(D.spec_lines(spark, sf_dir))))


# finished requirements of equal meaning are one; unfinished ones are told apart by their sentence, which template and size give
_DISTINCT = f"""q AS ({_select("p_brand, p_partkey%16 k, p_size", _EXPECTED)}), d AS (SELECT DISTINCT p_brand document_id, template, measurement, operator, value, unit, subject, target, zone, problems,
CASE WHEN problems<>'' THEN k*1000+part*100000+coalesce(value,0) ELSE -1 END sentence FROM q)"""


@query("x20_w08_candidates", f"WITH {_DISTINCT} SELECT document_id, template, measurement, operator, value, unit, problems FROM d")
def x20(spark, sf_dir):
    return candidates(spark, sf_dir).select("document_id", "template", "measurement", "operator", "value", "unit", F.concat_ws(",", "problems").alias("problems"))


@query("w09_v05_merged_candidates", f"WITH {_DISTINCT} SELECT min(document_id) document_id, template, operator, value, unit, problems, count(*) sources FROM d GROUP BY template, measurement, operator, value, unit, subject, target, zone, problems, sentence")
def w09(spark, sf_dir):
    return R.merged(candidates(spark, sf_dir)).select("document_id", "template", "operator", "value", "unit", F.concat_ws(",", "problems").alias("problems"), "sources")


@query(
    "a25_v06_conflicts",
    f"""WITH {_DISTINCT}, m AS (SELECT DISTINCT measurement, subject, target, zone, operator, value, unit FROM d WHERE problems='' AND value IS NOT NULL),
g AS (SELECT concat_ws('|', measurement, lower(replace(subject,' ','')), replace(coalesce(nullif(target,''),zone),'。','')) family, count(*) signatures, count(*)::bigint members FROM (SELECT * REPLACE (replace(subject,'。','') AS subject) FROM m) GROUP BY 1)
SELECT 'grp_'||substr(sha256(family),1,16) group_id, family, signatures, members FROM g WHERE signatures>=2""",
)
def a25(spark, sf_dir):
    return R.conflicts(R.merged(candidates(spark, sf_dir)))


@query("f23_candidate_ids", f"WITH {_DISTINCT} SELECT 'cand_'||substr(sha256(document_id||'|length|電纜||<=|'||value::bigint||'|mm'),1,16) candidate_id FROM d WHERE template='max_length'")
def f23(spark, sf_dir):
    return candidates(spark, sf_dir).where("template = 'max_length'").select("candidate_id")


@query("j17_candidate_texts", f"WITH {_DISTINCT} SELECT document_id, count(*) candidates, count(*) quoted FROM d GROUP BY 1")
def j17(spark, sf_dir):
    """Candidates with the evidence that they were read from: each sentence stands in its chunk."""
    c, e = candidates(spark, sf_dir), Docs.chunk_lines(D.spec_lines(spark, sf_dir)).select(F.col("id").alias("evidence_id"), F.replace("text", F.lit("\n"), F.lit("")).alias("text"))
    j = c.select("document_id", "evidence_id", "sentence").join(e.hint("merge"), "evidence_id", "left")
    return j.groupBy("document_id").agg(F.count("*").alias("candidates"), F.count_if(F.contains("text", "sentence")).alias("quoted"))


@query("j13_u06_evidence_used", "SELECT p_brand document_id, count(*)>0 used FROM part WHERE p_partkey%16 NOT IN (0,3,15) GROUP BY 1")
def j13(spark, sf_dir):
    """The snapshot of evidence that candidates refer to: whole rows of each chunk used, once."""
    used = candidates(spark, sf_dir).select(F.col("evidence_id").alias("id")).distinct()
    rows = Docs.chunk_lines(D.spec_lines(spark, sf_dir)).join(used.hint("merge"), "id", "left_semi")
    return rows.groupBy("document_id").agg((F.count("*") > 0).alias("used"))
