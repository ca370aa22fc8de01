"""Queries that judge candidates and build rule sets (V2-V9, W9, W10, J18, J21, A18, A19, O4, P15, U5), over all candidates of the specifications.

A project is a maker of parts; its drawings have layers made of parts, but the fifth maker has no drawing. Evidence lacks some chunks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from conformix.operators import assessment as A
from conformix.operators import decisions as Dec
from conformix.operators import mapping as M
from conformix.operators import rulesets as S
from conformix.plans.queries_candidates import _EXPECTED, _select, candidates, once
from conformix.plans.queries_evidence import SPEC_CHUNKS, chunks
from conformix.sources import derived as D

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


SYSTEMS = [("SCADA 電纜", "^SCADA"), ("給水管", "^WATER"), ("支架", "^SUPPORT"), ("弱電電纜", "^SCADA")]


def project(c):
    return F.substring(c, 1, 7)


def context(spark, sf_dir) -> M.Context:
    k = F.col("p_partkey")
    layer = F.concat(F.element_at(F.array(*map(F.lit, ("SCADA-", "POWER-", "WATER-", "SUPPORT-"))), (k % 4 + 1).cast("int")), F.floor(k / 50).cast("string"))
    p = D.read(spark, sf_dir, "part").select(project("p_brand").alias("project"), layer.alias("layer")).distinct()
    every = p.select("project").distinct()
    systems = every.select("project", F.posexplode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(r).alias("layer_regex")) for n, r in SYSTEMS])).alias("pos", "s")).select("project", "pos", "s.*")
    none = every.select("project", F.lit("").alias("concept"), F.lit(0).alias("pos"), F.array().cast("array<string>").alias("patterns")).where("false")
    base = every.select("project", F.explode(F.array(*map(F.lit, ("SCADA-BASE", "POWER-BASE", "WATER-BASE", "SUPPORT-BASE")))).alias("layer"))
    layers = once(spark, sf_dir, "maker-layers", lambda: p.unionByName(base).where("project <> 'Brand#5'"))
    return M.Context(layers, once(spark, sf_dir, "maker-systems", lambda: systems), once(spark, sf_dir, "maker-glossary", lambda: M.effective_glossary(every, none)))


def of_projects(spark, sf_dir):
    return candidates(spark, sf_dir).withColumn("project", project("document_id"))


def evidence(spark, sf_dir):
    return chunks(spark, sf_dir).where("line_start % 5 <> 3")


def log(spark, sf_dir):
    """A change for every candidate that a person looked at."""
    c = of_projects(spark, sf_dir)
    size = (F.col("value") / 10).cast("long")
    pick = lambda kind, v: M.selector(kind, F.array(F.lit(v)))
    axis = F.array_contains("problems", "UNSPECIFIED_AXIS") & (size % 5 == 0)
    soft = F.array_contains("problems", "ADVISORY") & (size % 2 == 0)
    heir = F.array_contains("problems", "INHERITED_PARTIES") & (size % 3 == 0)
    zone = (F.col("template") == "keep_out") & F.col("project").isin("Brand#1", "Brand#2")
    off = (F.col("template") == "max_length") & (F.col("value") % 10000 == 0)
    fields = {
        "disabled": F.when(off, True), "accept": F.when(soft | heir, True), "subject": F.when(soft, pick("system", "SCADA 電纜")), "target": F.lit(None), "zone": F.when(zone, pick("system", "給水管")),
        "template": F.when(axis, "vertical_clearance"), "operator": F.lit(None), "unit": F.when(soft, "cm"), "value": F.lit(None), "chosen": F.lit(None),
    }
    at = F.xxhash64("candidate_id")
    head = ["project", F.col("candidate_id").alias("key"), "meaning", at.alias("at"), F.lit(False).alias("reset"), F.array().cast("array<string>").alias("cleared")]
    return c.where(axis | soft | heir | zone | off).select(*head, *[v.cast(Dec.FIELDS[n]).alias(n) for n, v in fields.items()])


def chosen(views):
    """The smallest length that documents of the third maker ask for is chosen in its group."""
    v = views.where("project = 'Brand#3' AND measurement = 'length' AND conflict_group IS NOT NULL")
    best = v.groupBy("project", "conflict_group").agg(F.min_by("meaning", "value").alias("chosen"))
    nothing = {n: F.lit(None).cast(t).alias(n) for n, t in Dec.FIELDS.items() if n != "chosen"}
    return best.select("project", F.col("conflict_group").alias("key"), F.lit(None).cast("string").alias("meaning"), F.lit(1).cast("long").alias("at"), F.lit(False).alias("reset"), F.array().cast("array<string>").alias("cleared"), *nothing.values(), "chosen").select(*[c.split(" ")[0] for c in ("project", "key", "meaning", "at", "reset", "cleared")], *Dec.FIELDS)


_kept: dict[tuple, tuple] = {}


def views(spark, sf_dir):
    """(views, sources, facts): candidates judged after two rounds of decisions."""
    from conformix.sources.tables import materialise, shared_dir

    key = (spark.sparkContext.applicationId, shared_dir(spark), sf_dir)
    if key not in _kept:
        c, ctx, ev = of_projects(spark, sf_dir), context(spark, sf_dir), evidence(spark, sf_dir)
        facts = materialise(Dec.merge(None, log(spark, sf_dir)), "facts")
        first, _ = A.evaluate(c, ctx, Dec.decisions(facts), ev)
        facts = materialise(Dec.merge(facts, chosen(first)), "facts")
        _kept[key] = (*A.evaluate(c, ctx, Dec.decisions(facts), ev), facts)
    return _kept[key]


# -- the same as SQL: what each sentence's parties are in a drawing is known, everything else follows from the rows ---------------

_ROWS = _select("p_partkey, p_brand, p_size, p_partkey%16 k", _EXPECTED)
_VIEWS = f"""{SPEC_CHUNKS}, q AS ({_ROWS}), pl AS (SELECT q.*, substr(p_brand,1,7) project, sl.page, sl.line_no, ck.line_start, {{'d': p_brand, 'p': sl.page, 'l': sl.line_no, 'c': part}} o,
 measurement||'|'||subject||'|'||target||zone||'|'||operator||'|'||value||'|'||unit fin, CASE WHEN problems='' AND template IS NOT NULL THEN -1 ELSE k*1000+part*100000+coalesce(value,0) END sent FROM q JOIN sl USING (p_partkey) JOIN ck ON ck.document_id=q.p_brand AND ck.page=sl.page AND sl.line_no BETWEEN ck.line_start AND ck.line_end),
md AS (SELECT project, p_brand, CASE WHEN sent=-1 THEN replace(fin,'。','') ELSE sent::varchar END mean, min_by(pl, o) x, min(o) o FROM pl GROUP BY 1, 2, 3),
mg AS MATERIALIZED (SELECT project, mean, min_by(x, o) x, min(o) o, count(*) docs FROM md GROUP BY 1, 2),
a0 AS (SELECT project, mean, o, docs, x.k k, x.part part, x.template t0, x.measurement m0, x.operator op, x.value v0, x.unit u0, x.problems p0, x.subject subj, x.target targ, x.zone zn, x.line_start ls, project<>'Brand#5' drawn, (x.value/10)::bigint sz FROM mg),
a1 AS (SELECT *, k=12 AND sz%5=0 ax, k=10 AND sz%2=0 sf, k=14 AND part=2 AND sz%3=0 hr, k=5 AND project IN ('Brand#1','Brand#2') zp, coalesce(t0='max_length' AND v0%10000=0, false) dis FROM a0),
a2 AS (SELECT *, CASE WHEN ax THEN 'vertical_clearance' ELSE t0 END t, CASE WHEN ax THEN 'vertical_clearance' ELSE m0 END m, CASE WHEN sf THEN v0*10 ELSE v0 END v, CASE WHEN sf THEN 'mm' ELSE u0 END u, CASE WHEN sf THEN 'WARNING' ELSE 'FAIL' END sev, ax OR sf OR hr OR (zp AND drawn) OR (zp) byu,
 list_sort(list_filter(CASE WHEN t0 IS NULL THEN []::varchar[] ELSE list_concat(list_filter(string_split(p0,','), lambda p: p<>'' AND NOT (ax AND p='UNSPECIFIED_AXIS') AND NOT (sf AND p IN ('ADVISORY','NO_UNIT')) AND NOT (hr AND p='INHERITED_PARTIES')),
  [CASE WHEN NOT drawn AND k<>8 THEN 'NO_DRAWING' END, CASE WHEN drawn AND k=10 AND NOT sf THEN 'SUBJECT_UNMAPPED' END, CASE WHEN drawn AND (k=6 OR (k=5 AND NOT zp)) THEN 'ZONE_UNMAPPED' END, CASE WHEN ls%5=3 THEN 'EVIDENCE_MISSING' END]) END, lambda p: p IS NOT NULL)) pr,
 CASE WHEN NOT drawn THEN replace(subj,'。','') WHEN k IN (1,2,4,5,6,7,12,13,14) OR sf THEN 'L:S' WHEN k=9 THEN 'L:U' ELSE replace(subj,'。','') END fs,
 CASE WHEN t0 IN ('keep_out','inside_zone') THEN CASE WHEN zp AND drawn THEN 'L:W' ELSE '' END WHEN NOT drawn THEN targ WHEN k IN (1,2,10,12,14) THEN 'L:P' WHEN k=4 THEN 'L:W' ELSE targ END ft FROM a1),
a3 AS (SELECT *, CASE WHEN t IS NULL THEN 'NOT_ENFORCEABLE' WHEN len(pr)=0 THEN 'CONFIRMED' ELSE 'NEEDS_REVIEW' END st, coalesce(m,'?')||'|'||fs||'|'||ft fam FROM a2),
sg AS (SELECT project, fam, op, v, u, sev, min(o) o1, count(*) n FROM a3 WHERE st<>'NOT_ENFORCEABLE' AND v IS NOT NULL AND op IS NOT NULL GROUP BY ALL),
a4 AS MATERIALIZED (SELECT a3.*, n FROM a3 LEFT JOIN sg ON sg.project=a3.project AND sg.fam=a3.fam AND sg.op=a3.op AND sg.v=a3.v AND sg.u IS NOT DISTINCT FROM a3.u AND sg.sev=a3.sev AND a3.st<>'NOT_ENFORCEABLE'),
a5 AS MATERIALIZED (SELECT a4.* FROM a4 LEFT JOIN sg ON sg.project=a4.project AND sg.fam=a4.fam AND sg.op=a4.op AND sg.v=a4.v AND sg.u IS NOT DISTINCT FROM a4.u AND sg.sev=a4.sev WHERE a4.n IS NULL OR a4.o=sg.o1),
cm AS (SELECT *, st<>'NOT_ENFORCEABLE' AND v IS NOT NULL AND op IS NOT NULL AND u IS NOT NULL AND NOT dis AND len(list_filter(pr, lambda p: NOT (p LIKE '%UNMAPPED' OR p='NO_DRAWING')))=0 comp FROM a5),
gr AS (SELECT project, fam, count(DISTINCT op||v||u) options, min(v) low FROM cm WHERE comp GROUP BY 1, 2 HAVING count(DISTINCT op||v||u)>=2),
a6 AS (SELECT cm.*, CASE WHEN comp THEN options END options, comp AND options IS NOT NULL inn, coalesce(cm.project='Brand#3' AND m='length' AND options IS NOT NULL, false) settled, v=low mine FROM cm LEFT JOIN gr ON gr.project=cm.project AND gr.fam=cm.fam),
vw AS MATERIALIZED (SELECT project, o, (o).d document_id, t AS template, m AS measurement, op AS operator, v AS value, u AS unit, sev severity, fam, docs, k, part, mean, pr, options, subj, targ, zn, drawn, sf, dis,
 CASE WHEN inn AND NOT (settled AND mine) THEN 'CONFLICTING' ELSE st END status, CASE WHEN dis AND st<>'NOT_ENFORCEABLE' THEN 'off' WHEN inn AND settled AND NOT mine THEN 'off' WHEN inn AND NOT settled THEN 'conflict' WHEN st='NOT_ENFORCEABLE' THEN 'not_enforceable' WHEN st='CONFIRMED' THEN 'usable' ELSE 'review' END bucket,
 CASE WHEN st='CONFIRMED' THEN CASE WHEN byu OR sev='WARNING' OR (inn AND settled AND mine) THEN 'user' ELSE 'auto' END END confirmed_by, array_to_string(pr, ',') problems FROM a6)"""

_SHOWN = "project, document_id, template, measurement, operator, value, unit, severity, status, bucket, confirmed_by, problems"


def shown(v):
    return v.select("project", "document_id", "template", "measurement", "operator", "value", "unit", "severity", "status", "bucket", "confirmed_by", F.array_join(F.array_sort("problems"), ",").alias("problems"))


@query("v04_statuses", f"WITH {_VIEWS} SELECT {_SHOWN} FROM vw")
def v04(spark, sf_dir):
    """Every view: what a candidate asks for after decisions, its status, bucket and problems."""
    return shown(views(spark, sf_dir)[0])


@query("v02_decided", f"WITH {_VIEWS} SELECT {_SHOWN} FROM vw WHERE confirmed_by='user'")
def v02(spark, sf_dir):
    return shown(views(spark, sf_dir)[0].where("confirmed_by = 'user'"))


@query("v03_evidence_missing", f"WITH {_VIEWS} SELECT project, bucket, count(*) FILTER (WHERE contains(problems, 'EVIDENCE_MISSING')) missing, count(*) n FROM vw GROUP BY 1, 2")
def v03(spark, sf_dir):
    return views(spark, sf_dir)[0].groupBy("project", "bucket").agg(F.count_if(F.array_contains("problems", "EVIDENCE_MISSING")).alias("missing"), F.count("*").alias("n"))


@query("v06_conflict_groups", f"WITH {_VIEWS} SELECT project, measurement, options, count(*) members, count(*) FILTER (WHERE bucket='off') lost FROM vw WHERE options IS NOT NULL GROUP BY project, measurement, fam, options")
def v06(spark, sf_dir):
    v = views(spark, sf_dir)[0].where("conflict_group IS NOT NULL")
    return v.groupBy("project", "measurement", "family", "options").agg(F.count("*").alias("members"), F.count_if(F.col("bucket") == "off").alias("lost")).drop("family")


@query("v07_buckets", f"WITH {_VIEWS} SELECT project, bucket, status, status='CONFIRMED' AND NOT dis enabled, count(*) n FROM vw GROUP BY ALL")
def v07(spark, sf_dir):
    return views(spark, sf_dir)[0].groupBy("project", "bucket", "status", "enabled").agg(F.count("*").alias("n"))


@query("w09_w10_sources", f"WITH {_VIEWS}, al AS (SELECT project, sum(docs)-count(*) merged_documents, count(*) meanings FROM a3 GROUP BY 1), le AS (SELECT project, count(*) n FROM vw GROUP BY 1) SELECT al.project, le.n::bigint AS views, (merged_documents+meanings-le.n)::bigint sources FROM al JOIN le USING (project)")
def w10(spark, sf_dir):
    """Views that are left, and the candidates that were merged into them by meaning or by what they ask of which layers."""
    v, sources, _ = views(spark, sf_dir)
    n = sources.groupBy("project").agg(F.count("*").alias("sources"))
    return v.groupBy("project").agg(F.count("*").alias("views")).join(n.hint("merge"), "project", "left").na.fill(0)


@query("a18_candidate_summary", f"""WITH {_VIEWS} SELECT project, count(*) total, {", ".join(f"count(*) FILTER (WHERE bucket='{b}') {b}" for b in A.BUCKETS)}, {", ".join(f"count(*) FILTER (WHERE status='{s}') {s}" for s in A.STATUSES)} FROM vw GROUP BY 1""")
def a18(spark, sf_dir):
    # two of its columns differ by case alone, so the table needs a session that tells them apart; the caller's session stays as it is
    apart = spark.newSession()
    apart.conf.set("spark.sql.caseSensitive", "true")
    v = views(spark, sf_dir)[0]
    return A.summary(apart.read.schema(v.schema).parquet(v._conformix_path))


_RANK = "CASE bucket WHEN 'usable' THEN 0 WHEN 'conflict' THEN 1 WHEN 'review' THEN 2 WHEN 'not_enforceable' THEN 3 ELSE 4 END"
# parties found of those that need review, by sentence
_FOUND = "CASE WHEN NOT drawn THEN CASE WHEN sf THEN 1 ELSE 0 END WHEN k IN (12,14,1,2,4) THEN 2 WHEN k=10 THEN CASE WHEN sf THEN 2 ELSE 1 END WHEN k=8 THEN 0 WHEN k=5 THEN CASE WHEN problems LIKE '%ZONE%' THEN 1 ELSE 2 END ELSE 1 END"


@query("o04_candidate_order", f"WITH {_VIEWS}, od AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY {_RANK}, CASE WHEN bucket='review' THEN -({_FOUND}) ELSE 0 END, CASE WHEN bucket='review' THEN len(pr) ELSE 0 END, o) n FROM vw) SELECT project, n::int AS place, document_id, template, value FROM od")
def o04(spark, sf_dir):
    from pyspark.sql import Window

    v = views(spark, sf_dir)[0]
    return v.withColumn("place", F.row_number().over(Window.partitionBy("project").orderBy(*A.ordered(v)))).select("project", "place", "document_id", "template", "value")


@query("p15_candidate_search", f"WITH {_VIEWS} SELECT project, document_id, template, value FROM vw WHERE k IN (1,2,12,14) AND (template IN ('clearance','vertical_clearance')) AND contains('scada電纜'||coalesce(printf('%.0f', value),''), '30')")
def p15(spark, sf_dir):
    """Candidates that name SCADA cables and power and hold a 30 in any of the fields that a search looks at."""
    found = A.matching(views(spark, sf_dir)[0], "SCADA-電纜 電力")
    return found.where(F.contains(F.concat(F.lit("scada電纜"), F.coalesce(F.format_string("%.0f", "value"), F.lit(""))), F.lit("30"))).select("project", "document_id", "template", "value")


@query("v09_decision_table", f"WITH {_VIEWS}, dc AS (SELECT project, p_brand d, k, part, CASE WHEN k=12 THEN 'axis' WHEN k=10 THEN 'accept' WHEN k=14 THEN 'accept' WHEN k=5 THEN 'zone' ELSE 'disabled' END field, count(*) n FROM (SELECT project, p_brand, x.k k, x.part part, x.value v FROM md) WHERE (k=12 AND (v/10)::bigint%5=0) OR (k=10 AND (v/10)::bigint%2=0) OR (k=14 AND part=2 AND (v/10)::bigint%3=0) OR (k=5 AND project IN ('Brand#1','Brand#2')) OR (k=7 AND v%10000=0) GROUP BY ALL) SELECT project, field, sum(n)::bigint n FROM dc GROUP BY 1, 2 UNION ALL SELECT project, 'chosen', count(*) FROM gr WHERE project='Brand#3' AND fam LIKE 'length%' GROUP BY 1")
def v09(spark, sf_dir):
    """What the merged log of decisions holds."""
    d = Dec.decisions(views(spark, sf_dir)[2])
    field = F.when(F.col("decision.chosen").isNotNull(), "chosen").when(F.col("decision.template").isNotNull(), "axis").when(F.col("decision.accept"), "accept").when(F.col("decision.zone").isNotNull(), "zone").otherwise("disabled")
    return d.groupBy("project", field.alias("field")).agg(F.count("*").alias("n"))


@query("j18_decision_lookup", f"WITH {_VIEWS} SELECT project, count(*) FILTER (WHERE ax) axis, count(*) FILTER (WHERE sf OR hr) accepted, count(*) FILTER (WHERE dis) disabled FROM a1 GROUP BY 1")
def j18(spark, sf_dir):
    """Decisions found for the first candidate of every meaning, by id or by meaning."""
    first, _ = A.primaries(of_projects(spark, sf_dir))
    got = Dec.for_candidates(first, Dec.decisions(views(spark, sf_dir)[2]))
    one = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return got.groupBy("project").agg(one(F.col("decision.template").isNotNull()).alias("axis"), one(F.col("decision.accept")).alias("accepted"), one(F.col("decision.disabled")).alias("disabled"))


# -- rule sets -----------------------------------------------------------------------------------------


def rules(spark, sf_dir):
    """Hand-written rules of every project: one that checks crossings of the same layers as the specifications, one that is switched off, one
    whose number is in metres, one with a predicate of its own, and a stale rule of an earlier candidate."""
    p = D.read(spark, sf_dir, "part").select(project("p_brand").alias("project")).distinct()
    system = lambda *names: F.array(*[M.selector("system", F.array(*map(F.lit, names)))])

    def one(name, measurement, operator, value, unit, subject, target=None, enabled=True, origin=None, complex_=False):
        fields = {"rule_id": F.lit(name), "origin": F.lit(origin), "enabled": F.lit(enabled), "measurement": F.lit(measurement), "operator": F.lit(operator), "value": F.lit(float(value)), "unit": F.lit(unit), "severity": F.lit("FAIL"), "name": F.lit(name)}
        fields |= {"has_subject": F.lit(True), "subject": F.lit(None) if complex_ else subject, "has_target": F.lit(target is not None), "target": F.lit(None) if target is None else target, "has_zone": F.lit(False), "zone": F.lit(None)}
        fields |= dict.fromkeys(("evidence_id", "document", "quote", "candidate_id"), F.lit(None))
        types = dict(f.split(" ") for f in S.RULE.split(", "))
        return F.struct(*[v.cast(types[n]).alias(n) for n, v in fields.items()])

    made = [
        one("HAND-CROSS", "intersection", "==", 0, "count", system("弱電電纜"), system("給水管")), one("HAND-LENGTH", "length", "<=", 7, "m", system("SCADA 電纜")), one("HAND-OFF", "entity_count", ">=", 3, "count", system("支架"), enabled=False),
        one("HAND-COUNT", "entity_count", ">=", 2, "count", None, complex_=True), one("SPEC-MAX-LENGTH-00000000", "length", "<=", 1, "mm", system("SCADA 電纜"), origin=S.ORIGIN),
    ]
    return p.select("project", F.explode(F.array(*made)).alias("r")).select("project", "r.*")


_LIVE = "status='CONFIRMED' AND NOT dis"
# crossings and lengths of seven metres are covered by hand where there is a drawing
_BY_HAND = "CASE WHEN template='no_crossing' THEN 'HAND-CROSS' WHEN template='max_length' AND value=7000 THEN 'HAND-LENGTH' END"


@query("v08_built_rules", f"WITH {_VIEWS} SELECT project, template, measurement, operator, value, unit, severity, count(*) n FROM vw WHERE {_LIVE} AND {_BY_HAND} IS NULL GROUP BY ALL")
def v08(spark, sf_dir):
    """Rules that confirmed candidates give."""
    v = views(spark, sf_dir)[0]
    made, _ = S.plan(v, rules(spark, sf_dir), context(spark, sf_dir))
    named = made.join(v.select("project", "candidate_id", "template").hint("merge"), ["project", "candidate_id"])
    return named.groupBy("project", "template", "measurement", "operator", "value", "unit", "severity").agg(F.count("*").alias("n"))


@query("j21_covered_by_hand", f"WITH {_VIEWS} SELECT project, '手動規則「'||{_BY_HAND}||'」已經涵蓋' reason, count(*) n FROM vw WHERE {_LIVE} AND {_BY_HAND} IS NOT NULL GROUP BY 1, 2")
def j21(spark, sf_dir):
    _, skipped = S.plan(views(spark, sf_dir)[0], rules(spark, sf_dir), context(spark, sf_dir))
    return skipped.groupBy("project", "reason").agg(F.count("*").alias("n"))


@query("u05_applied_rules", f"WITH {_VIEWS}, mk AS (SELECT DISTINCT substr(p_brand,1,7) project FROM part), n AS (SELECT project, count(*) c FROM vw WHERE {_LIVE} AND {_BY_HAND} IS NULL GROUP BY 1) SELECT mk.project, r AS round, coalesce(c,0) applied, 4::bigint manual, r=1 changed FROM mk LEFT JOIN n USING (project), range(1,3) t(r)")
def u05(spark, sf_dir):
    """Candidates applied twice: the first time replaces the stale rule, the second time changes nothing."""
    v, ctx = views(spark, sf_dir)[0], context(spark, sf_dir)
    once_, first = S.apply(v, rules(spark, sf_dir), ctx)
    _, second = S.apply(v, once_, ctx)
    return first.withColumn("round", F.lit(1).cast("long")).unionByName(second.withColumn("round", F.lit(2).cast("long")))


@query("a19_run_gate", f"""WITH {_VIEWS}, n AS (SELECT project, count(*) FILTER (WHERE {_LIVE} AND {_BY_HAND} IS NULL) from_spec, {", ".join(f"count(*) FILTER (WHERE bucket='{b}') {b}" for b in ("review", "conflict", "not_enforceable"))} FROM vw GROUP BY 1) SELECT project, from_spec+3 will_run, from_spec, 3::bigint manual, review, conflict, not_enforceable, true runnable FROM n""")
def a19(spark, sf_dir):
    return S.gate(views(spark, sf_dir)[0], rules(spark, sf_dir), context(spark, sf_dir))
