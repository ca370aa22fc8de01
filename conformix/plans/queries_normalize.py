"""Queries that turn raw primitives and inserts into entities (N1-N11), over drawings whose block names repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from conformix.plans import normalize as N
from conformix.plans import oracle_parts as O
from conformix.sources import derived as D
from conformix.sources.tables import materialise, shared_dir

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


_CODES = ",".join(map(str, D.RAW_CODES))
_FACTOR = "CASE c WHEN 1 THEN 25.4 WHEN 2 THEN 304.8 WHEN 4 THEN 1.0 WHEN 5 THEN 10.0 WHEN 6 THEN 1000.0 WHEN 22 THEN 25.4000508 ELSE 1.0 END::double"
_UNITS = f"un AS (SELECT DISTINCT c_custkey//64 d, [{_CODES}][(c_custkey//64%8+1)::int] c FROM customer)"


@query("n01_unit_resolution", f"WITH {_UNITS} SELECT 'raw-'||d drawing_key, c::int code, {_FACTOR} unit_to_mm, c IN (0,99) units_assumed, CASE c WHEN 0 THEN 'no unit declared' WHEN 99 THEN 'unsupported unit code' END unit_warning FROM un")
def n01(spark, sf_dir):
    return N.resolve_units(D.raw_units(spark, sf_dir), "code").select("drawing_key", "code", "unit_to_mm", "units_assumed", "unit_warning")


@query("n02_arc_flattening", "SELECT c_custkey arc, greatest(1, ceil(radians(30+c_custkey%300)/(2*acos(1-0.1/(50+c_custkey%500)))))::int chords, round(50+c_custkey%500,3)::double end_distance FROM customer")
def n02(spark, sf_dir):
    c = F.col("c_custkey")
    arcs = D.read(spark, sf_dir, "customer").select(c.alias("arc"), (50 + c % 500).cast("double").alias("radius"), (c * 37 % 360).cast("double").alias("start"), (30 + c % 300).cast("double").alias("sweep"))
    pts = N.flatten_arc(F.lit(0.0), F.lit(0.0), F.col("radius"), F.col("start"), F.col("start") + F.col("sweep"), 0.1)
    out = arcs.withColumn("p", pts)
    return out.select("arc", (F.size("p") - 1).alias("chords"), F.round(F.hypot(F.element_at("p", -1)["x"], F.element_at("p", -1)["y"]), 3).alias("end_distance"))


@query("n04_circle_scaling", "SELECT c_custkey k, CASE WHEN c_custkey%2=0 THEN 'circle' ELSE 'polyline' END kind, CASE WHEN c_custkey%2=0 THEN 2.0*(50+c_custkey%500) END::double radius FROM customer")
def n04(spark, sf_dir):
    c = F.col("c_custkey")
    raw = D.read(spark, sf_dir, "customer").select(c.alias("k"), (50 + c % 500).cast("double").alias("r"), F.array(F.lit(2.0), F.lit(0.0), F.lit(0.0), F.when(c % 2 == 0, 2.0).otherwise(3.0), F.lit(10.0), F.lit(20.0)).alias("m"))
    return raw.select("k", N.transform_circle(F.lit(1.0), F.lit(1.0), F.col("r"), F.col("m")).alias("g")).select("k", "g.kind", "g.radius")


# -- blocks ---------------------------------------------------------------------------------------


def _inserts_sql() -> str:
    rows = []
    for where, container, block, layer, m, n_rows, n_cols in D.RAW_INSERTS:
        name = lambda t: D._named(t, "'{head}'||({n})")
        rows.append(f"SELECT d, {name(container)} container, k, {name(block)} block, {layer} layer, [{m}]::double[] m, {n_rows} nr, {n_cols} nc FROM cu WHERE {where}")
    return " UNION ALL ".join(rows)


_MUL = "[a[1]*b[1]+a[3]*b[2], a[2]*b[1]+a[4]*b[2], a[1]*b[3]+a[3]*b[4], a[2]*b[3]+a[4]*b[4], a[1]*b[5]+a[3]*b[6]+a[5], a[2]*b[5]+a[4]*b[6]+a[6], a[7]+b[7]]"
_KIND = "['LINE','LWPOLYLINE','POLYLINE','ARC','CIRCLE','TEXT','SPLINE','ELLIPSE'][(s//8+1)::int]"
_WALK = f"""cu AS MATERIALIZED (SELECT c_custkey k, c_custkey//64 d, c_custkey%64 s FROM customer), ins AS MATERIALIZED ({_inserts_sql()}),
pr AS MATERIALIZED (SELECT k, d, k%100 x, CASE WHEN s%8=0 THEN 'MODEL' WHEN s%8=1 THEN 'ROOT' WHEN s%8=7 THEN 'D8' ELSE 'B'||(s%8) END container, CASE WHEN k%6=0 THEN '0' ELSE 'OWN' END layer, CASE WHEN {_KIND}='ELLIPSE' AND s%2=1 THEN 'MESH' ELSE {_KIND} END ty, CASE WHEN k%2=1 THEN 5.0 ELSE 0.0 END::double z FROM cu),
known AS (SELECT d, container block FROM pr UNION SELECT d, container FROM ins),
w AS (WITH RECURSIVE r(d, handle, block, layer, m, path, ord, depth, trouble) AS (
 SELECT i.d, 'I'||k, i.block, layer, m, []::varchar[], [k], 0, CASE WHEN kn.block IS NULL THEN 'missing block' WHEN nr*nc>100000 THEN 'too many cells' END FROM (SELECT * FROM ins WHERE container='MODEL') i LEFT JOIN known kn ON kn.d=i.d AND kn.block=i.block
 UNION ALL SELECT c.d, c.handle||'>I'||i.k||'', i.block, CASE WHEN i.layer='0' THEN c.layer ELSE i.layer END, (SELECT {_MUL} FROM (SELECT c.m a, i.m b)), c.path, c.ord||[i.k], c.depth+1,
  CASE WHEN c.depth+1>=8 THEN 'too deep' WHEN list_contains(c.path, i.block) THEN 'cycle' WHEN kn.block IS NULL THEN 'missing block' WHEN i.nr*i.nc>100000 THEN 'too many cells' END
 FROM (SELECT p.d, CASE WHEN nr*nc>1 THEN p.handle||'['||cell||']' ELSE p.handle END handle, p.block, p.layer, (SELECT {_MUL} FROM (SELECT p.m a, [1,0,0,1,(cell%nc)*5000,(cell//nc)*7000,0]::double[] b)) m, p.path||[p.block] path, p.ord||[cell] ord, p.depth
   FROM (SELECT r.*, n.nr, n.nc, unnest(range(n.nr*n.nc)) cell FROM r JOIN ins n ON n.d=r.d AND n.k=r.ord[-1] AND n.block=r.block WHERE r.trouble IS NULL) p) c
  JOIN ins i ON i.d=c.d AND i.container=c.block LEFT JOIN known kn ON kn.d=i.d AND kn.block=i.block) SELECT * FROM r),
cell AS MATERIALIZED (SELECT d, CASE WHEN nr*nc>1 THEN handle||'['||cell||']' ELSE handle END handle, block, layer, (SELECT {_MUL} FROM (SELECT q.m a, [1,0,0,1,(cell%nc)*5000,(cell//nc)*7000,0]::double[] b)) m, ord||[cell] ord FROM (SELECT w.*, n.nr, n.nc, unnest(range(n.nr*n.nc)) cell FROM w JOIN ins n ON n.d=w.d AND n.k=w.ord[-1] AND n.block=w.block WHERE w.trouble IS NULL) q),
pl AS MATERIALIZED (SELECT d, printf('%X',k) handle, layer, [1,0,0,1,0,0,0]::double[] m, [k] ord, pr.* EXCLUDE (d, layer) FROM pr WHERE container='MODEL'
 UNION ALL SELECT c.d, c.handle||'>'||printf('%X',p.k), CASE WHEN p.layer='0' THEN c.layer ELSE p.layer END, c.m, c.ord||[p.k], p.* EXCLUDE (d, layer) FROM cell c JOIN pr p ON p.d=c.d AND p.container=c.block)"""

_stored: dict[tuple, tuple] = {}


def placed(spark, sf_dir):
    """Primitives with their matrices, and warnings; worked out once a session."""
    key = (spark.sparkContext.applicationId, shared_dir(spark), sf_dir)
    if key not in _stored:
        out, warnings = N.expand_blocks(D.raw_primitives(spark, sf_dir), D.raw_inserts(spark, sf_dir))
        _stored[key] = (materialise(out, "placed"), materialise(warnings, "block-warnings"))
    return _stored[key]


def entities(spark, sf_dir, cap=N.ENTITIES):
    units = N.resolve_units(D.raw_units(spark, sf_dir), "code")
    return N.numbered(N.entities_of(placed(spark, sf_dir)[0], units), cap)


@query("n07_block_expansion", f"WITH {_WALK} SELECT 'raw-'||d drawing_key, handle, layer, ty AS type, round(m[1]*100+m[3]*7+m[5],6) x, round(m[2]*100+m[4]*7+m[6],6) y, m[7] lift FROM pl")
def n07(spark, sf_dir):
    """Every placed primitive; x and y are where its matrix takes the point (100, 7)."""
    p = N.apply_matrix(F.col("pm"), F.lit(100.0), F.lit(7.0))
    return placed(spark, sf_dir)[0].select("drawing_key", "handle", "layer", "type", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"), F.get("pm", F.lit(6)).alias("lift"))


@query("n07_block_warnings", f"WITH {_WALK} SELECT 'raw-'||d drawing_key, handle, block, trouble AS warning FROM w WHERE trouble IS NOT NULL")
def n07w(spark, sf_dir):
    return placed(spark, sf_dir)[1].select("drawing_key", "handle", "block", "warning")


_ENTITIES = f"""{_WALK}, {_UNITS}, e0 AS (SELECT pl.*, {_FACTOR} u, abs(sqrt(m[1]*m[1]+m[2]*m[2])-sqrt(m[3]*m[3]+m[4]*m[4]))<1e-9 AND abs(m[1]*m[3]+m[2]*m[4])<1e-9 uniform FROM pl JOIN un USING (d) WHERE ty<>'MESH'),
e1 AS (SELECT *, CASE ty WHEN 'LINE' THEN 2 WHEN 'LWPOLYLINE' THEN 3 WHEN 'POLYLINE' THEN 2 WHEN 'SPLINE' THEN 3 WHEN 'ARC' THEN 1+greatest(1, ceil(radians(30+k%300)/(2*acos(greatest(-1,1-0.1/u/(50+k%50))))))
 WHEN 'ELLIPSE' THEN greatest(1, ceil(radians(360)/(2*acos(greatest(-1,1-0.1/u/20))))) WHEN 'CIRCLE' THEN CASE WHEN uniform THEN NULL ELSE 180 END END::int n,
 CASE ty WHEN 'POLYLINE' THEN x+3 WHEN 'ARC' THEN x+(50+k%50)*cos(radians(k*37%360)) WHEN 'ELLIPSE' THEN x+20 WHEN 'CIRCLE' THEN CASE WHEN uniform THEN x ELSE x+10+k%7 END ELSE x END::double px,
 CASE ty WHEN 'LINE' THEN 1 WHEN 'POLYLINE' THEN 4 WHEN 'ARC' THEN 5+(50+k%50)*sin(radians(k*37%360)) WHEN 'ELLIPSE' THEN 5 WHEN 'CIRCLE' THEN 5 WHEN 'TEXT' THEN 5 ELSE 0 END::double py,
 CASE WHEN ty IN ('ARC','CIRCLE','TEXT','ELLIPSE') THEN k%3 ELSE z END+m[7] zz FROM e0),
en AS (SELECT 'raw-'||d drawing_key, handle, layer, ty AS entity_type, CASE WHEN ty='TEXT' THEN 'text' WHEN ty='CIRCLE' AND uniform THEN 'circle' ELSE 'polyline' END kind, n points, ty IN ('LWPOLYLINE','SPLINE','ELLIPSE','POLYLINE') OR (ty='CIRCLE' AND NOT uniform) OR (ty='ARC' AND false) closed,
 round(m[1]*px+m[3]*py+m[5],4) x, round(m[2]*px+m[4]*py+m[6],4) y, CASE WHEN ty='CIRCLE' AND uniform THEN round((10+k%7)*sqrt(m[1]*m[1]+m[2]*m[2]),6) END radius, CASE WHEN ty='TEXT' THEN round(2.5*sqrt(m[3]*m[3]+m[4]*m[4]),6) END text_height, abs(zz)>1e-9 z_known, zz z_min, zz z_max,
 row_number() OVER (PARTITION BY d ORDER BY ord, handle)-1 seq FROM e1)"""


def shown(e):
    first = F.element_at("points", 1)
    x, y = (F.round(F.when(F.col("points").isNotNull(), first[c]).otherwise(F.col(f"c{c}")), 4).alias(c) for c in "xy")
    n = F.when(F.col("kind") == "polyline", F.size("points")).alias("points")
    return e.select("drawing_key", "handle", "layer", "entity_type", "kind", n, "closed", x, y, F.round("radius", 6).alias("radius"), F.round("text_height", 6).alias("text_height"), "z_known", "z_min", "z_max", "seq")


@query("n03_n05_n06_entities", f"WITH {_ENTITIES} SELECT * FROM en")
def n03(spark, sf_dir):
    """Every entity of the raw drawings: vertices and closing, texts, heights, in the order of the walk."""
    return shown(entities(spark, sf_dir))


@query("n03_polylines", f"WITH {_ENTITIES} SELECT drawing_key, handle, points, closed, x, y FROM en WHERE kind='polyline'")
def n03_polylines(spark, sf_dir):
    return shown(entities(spark, sf_dir)).where("kind = 'polyline'").select("drawing_key", "handle", "points", "closed", "x", "y")


@query("n05_texts", f"WITH {_ENTITIES} SELECT drawing_key, handle, x, y, text_height FROM en WHERE kind='text'")
def n05(spark, sf_dir):
    return shown(entities(spark, sf_dir)).where("kind = 'text'").select("drawing_key", "handle", "x", "y", "text_height")


@query("n06_heights", f"WITH {_ENTITIES} SELECT drawing_key, entity_type, count(*) n, count(*) FILTER (WHERE z_known) known, min(z_min) low, max(z_max) high FROM en GROUP BY 1,2")
def n06(spark, sf_dir):
    e = entities(spark, sf_dir)
    return e.groupBy("drawing_key", "entity_type").agg(F.count("*").alias("n"), F.count_if("z_known").alias("known"), F.min("z_min").alias("low"), F.max("z_max").alias("high"))


@query("n10_type_counts", f"WITH {_WALK} SELECT 'raw-'||d drawing_key, ty AS type, ty<>'MESH' supported, count(*) n FROM pl GROUP BY ALL")
def n10(spark, sf_dir):
    return N.type_counts(placed(spark, sf_dir)[0])


@query("n11_entity_cap", f"WITH {_ENTITIES}, t AS (SELECT drawing_key, count(*) n FROM en GROUP BY 1) SELECT drawing_key, least(n,40) kept, least(n,40)-1 last_seq, n>40 capped FROM t")
def n11(spark, sf_dir):
    """A cap of 40 entities a drawing: what stays, and which drawings lost some."""
    e = N.entities_of(placed(spark, sf_dir)[0], N.resolve_units(D.raw_units(spark, sf_dir), "code"))
    kept = N.numbered(e, 41)
    own = F.col("seq") < 40
    return kept.groupBy("drawing_key").agg(F.count_if(own).alias("kept"), F.max(F.when(own, F.col("seq"))).alias("last_seq"), (F.count("*") > 40).alias("capped"))
