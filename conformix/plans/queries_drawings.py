"""Queries over drawings: normalisation, predicates, joins, aggregates, routes and reports (S, N, P, J, A, M, O, W, G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conformix.functions import geometry as G
from conformix.functions import predicates as P
from conformix.operators import evaluate as E
from conformix.operators import spatial
from conformix.operators import routes as R
from conformix.plans import normalize as N
from conformix.plans import oracle_parts as O
from conformix.sources import derived as D

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.stored_entities(spark, sf_dir)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.classify_systems(entities(spark, sf_dir), D.SYSTEMS)


def side(df: DataFrame, name: str) -> DataFrame:
    return df.select("drawing_key", F.struct(*[c for c in df.columns if c != "drawing_key"]).alias(name))


ENT = O.entities()


@query("s01_entities", f"WITH {ENT} SELECT drawing_key, seq, eid, handle, layer, entity_type, kind, closed, round(cx,6) cx, round(cy,6) cy, radius, txt AS text, z_known, z::double z_min FROM ent")
def s01(spark, sf_dir):
    return entities(spark, sf_dir).select("drawing_key", "seq", "eid", "handle", "layer", "entity_type", "kind", "closed", "cx", "cy", "radius", "text", "z_known", "z_min")


@query("s03_drawing_catalog", f"WITH {ENT}, l AS (SELECT drawing_key, layer, entity_type, count(*) n FROM ent GROUP BY 1,2,3) SELECT drawing_key, layer, sum(n)::bigint entities, string_agg(entity_type||':'||n, ',' ORDER BY entity_type) types FROM l GROUP BY 1,2")
def s03(spark, sf_dir):
    per = entities(spark, sf_dir).groupBy("drawing_key", "layer", "entity_type").agg(F.count("*").alias("n"))
    kinds = F.array_sort(F.collect_list(F.struct("entity_type", F.concat_ws(":", "entity_type", "n").alias("t"))))
    return per.groupBy("drawing_key", "layer").agg(F.sum("n").alias("entities"), F.array_join(F.transform(kinds, lambda x: x["t"]), ",").alias("types"))


@query("n12_bounding_boxes", f"WITH {ENT} SELECT seq, round(minx,6) minx, round(miny,6) miny, round(maxx,6) maxx, round(maxy,6) maxy FROM ent")
def n12(spark, sf_dir):
    return entities(spark, sf_dir).select("seq", *[F.round(c, 6).alias(c) for c in ("minx", "miny", "maxx", "maxy")])


@query("n13_distinct_layers", f"WITH {ENT} SELECT drawing_key, string_agg(DISTINCT layer, ',' ORDER BY layer) layers FROM ent GROUP BY 1")
def n13(spark, sf_dir):
    return entities(spark, sf_dir).groupBy("drawing_key").agg(F.array_join(F.sort_array(F.collect_set("layer")), ",").alias("layers"))


def _predicate(name, node, where):
    @query(name, f"WITH {ENT} SELECT seq FROM ent WHERE {where}")
    def run(spark, sf_dir):
        return classified(spark, sf_dir).where(P.selects(node)).select("seq")


_predicate("p01_layer_regex", {"layer_regex": "^s.*e$"}, "regexp_matches(lower(layer), '^s.*e$') AND kind<>'text'")
_predicate("p02_layer_equals", {"layer_equals": "nogo"}, "layer='NOGO'")
_predicate("p03_layer_contains", {"layer_contains": "cable"}, "layer LIKE '%CABLE%'")
_predicate("p04_entity_type", {"entity_type": ["line", "text"]}, "entity_type IN ('LINE','TEXT')")
_predicate("p05_system", {"system": ["power", "support"]}, "system IN ('POWER','SUPPORT')")
_predicate("p06_text_regex", {"text_regex": "[02468]$"}, "kind='text' AND regexp_matches(txt,'[02468]$')")
_predicate("p07_and_or_not", {"or": [{"system": "SCADA", "entity_type": "LINE"}, {"not": {"layer_contains": "A"}}]}, "kind<>'text' AND ((system='SCADA' AND entity_type='LINE') OR layer NOT LIKE '%A%')")


@query("j01_system_classification", f"WITH {ENT} SELECT layer, system, count(*) n FROM ent GROUP BY 1,2")
def j01(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("layer", "system").agg(F.count("*").alias("n"))


@query(
    "j02_grid_bbox_join",
    f"WITH {ENT} SELECT s.seq a, t.seq b FROM ent s JOIN ent t ON s.drawing_key=t.drawing_key AND s.layer='SCADA-CABLE' AND t.layer IN ('WATER','TRENCH','NOTE') AND s.minx-250<=t.maxx AND t.minx<=s.maxx+250 AND s.miny-250<=t.maxy AND t.miny<=s.maxy+250",
)
def j02(spark, sf_dir):
    e = entities(spark, sf_dir)
    a, b = side(e.where("layer = 'SCADA-CABLE'"), "s"), side(e.where("layer IN ('WATER', 'TRENCH', 'NOTE')"), "t")
    cells = spatial.auto_cell(e)
    a, b = (x.join(cells, "drawing_key") for x in (a, b))
    return spatial.candidates(a, b, F.col("cell"), 250.0).select(F.col("s.seq").alias("a"), F.col("t.seq").alias("b"))


@query("j04_distance_within", f"WITH {ENT}, p AS (SELECT s.seq a, t.seq b, {O.line_circle()} d FROM ent s JOIN ent t ON s.drawing_key=t.drawing_key AND s.layer='WATER' AND t.layer='SUPPORT' AND s.minx-400<=t.maxx AND t.minx<=s.maxx+400 AND s.miny-400<=t.maxy AND t.miny<=s.maxy+400) SELECT a, b, round(d,3) distance FROM p WHERE d<=400+1e-6")
def j04(spark, sf_dir):
    e = entities(spark, sf_dir)
    pairs = spatial.within(side(e.where("layer = 'WATER'"), "s"), side(e.where("layer = 'SUPPORT'"), "t"), 2000.0, 400.0)
    return pairs.select(F.col("s.seq").alias("a"), F.col("t.seq").alias("b"), F.round("distance", 3).alias("distance"))


@query(
    "j05_pair_filter",
    f"WITH {ENT} SELECT s.layer a, t.layer b, count(*) n FROM ent s JOIN ent t ON s.drawing_key=t.drawing_key AND s.seq<>t.seq AND s.kind='polyline' AND t.kind='polyline' AND s.minx<=t.maxx AND t.minx<=s.maxx AND s.miny<=t.maxy AND t.miny<=s.maxy WHERE s.system IS NOT NULL AND t.system IS NOT NULL AND s.system<>t.system AND s.layer<>t.layer GROUP BY 1,2",
)
def j05(spark, sf_dir):
    e = classified(spark, sf_dir).where("kind = 'polyline'")
    pairs = spatial.candidates(side(e, "s"), side(e, "t"), 2000.0).where("s.seq <> t.seq")
    return pairs.where(P.pair({"different_system": True, "different_layer": True}, F.col("s"), F.col("t"))).groupBy(F.col("s.layer").alias("a"), F.col("t.layer").alias("b")).agg(F.count("*").alias("n"))


@query("j16_entities_by_handle", f"WITH {ENT} SELECT seq, handle FROM ent WHERE handle IN ('10','91','FF1','NONE')")
def j16(spark, sf_dir):
    wanted = spark.createDataFrame([(h,) for h in ("10", "91", "FF1", "NONE", "10")], "handle string").distinct()
    return entities(spark, sf_dir).join(F.broadcast(wanted), "handle", "left_semi").select("seq", "handle")


@query("a06_a08_extent", f"WITH {ENT} SELECT drawing_key, min(minx) minx, min(miny) miny, max(maxx) maxx, max(maxy) maxy FROM ent GROUP BY 1")
def a08(spark, sf_dir):
    return entities(spark, sf_dir).groupBy("drawing_key").agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


@query(
    "a09_auto_cell_size",
    f"WITH {ENT}, a AS (SELECT drawing_key, median(greatest(maxx-minx,maxy-miny)) m, greatest(max(maxx)-min(minx),max(maxy)-min(miny)) e FROM ent GROUP BY 1) SELECT drawing_key, round(greatest(CASE WHEN m>0 THEN 2*m ELSE e/64 END, e/1000),3) cell FROM a",
)
def a09(spark, sf_dir):
    return spatial.auto_cell(entities(spark, sf_dir)).withColumn("cell", F.round("cell", 3))


@query("a14_lengths", f"WITH {ENT} SELECT layer, count(*) n, round(sum(CASE WHEN kind='circle' THEN 2*pi()*radius WHEN kind='text' THEN 0 WHEN closed THEN 2*(bx-ax+ye-ay) ELSE sqrt(pow(bx-ax,2)+pow(ye-ay,2)) END),2) length FROM ent GROUP BY 1")
def a14(spark, sf_dir):
    e = side(entities(spark, sf_dir), "s")
    return e.groupBy(F.col("s.layer").alias("layer")).agg(F.count("*").alias("n"), F.round(F.sum(G.length(F.col("s"))), 2).alias("length"))


@query("m01_orientation", f"WITH {ENT} SELECT seq, ((bx-ax)*(miny-100-ay)-(ye-ay)*(minx-100-ax))::double o FROM ent WHERE kind='polyline' AND NOT closed")
def m01(spark, sf_dir):
    e = entities(spark, sf_dir).where("kind = 'polyline' AND NOT closed")
    p, q = F.element_at("points", 1), F.element_at("points", 2)
    return e.select("seq", G.orient(p, q, G.point(F.col("minx") - 100, F.col("miny") - 100)).alias("o"))


@query("m03_point_segment_distance", f"WITH {ENT} SELECT seq, round({O.point_segment('minx+300', 'miny+77', 'ax', 'ay', 'bx', 'ye')},4) d FROM ent WHERE kind='polyline' AND NOT closed")
def m03(spark, sf_dir):
    e = entities(spark, sf_dir).where("kind = 'polyline' AND NOT closed")
    return e.select("seq", F.round(G.point_segment_distance(G.point(F.col("minx") + 300, F.col("miny") + 77), F.element_at("points", 1), F.element_at("points", 2)), 4).alias("d"))


@query("m04_segments_intersect", f"WITH {ENT} SELECT s.seq a, t.seq b FROM ent s JOIN ent t ON s.k=t.k AND s.slot IN (0,9) AND t.slot IN (1,4,5) AND {O.crosses()}")
def m04(spark, sf_dir):
    e = entities(spark, sf_dir)
    a = e.where("layer = 'SCADA-CABLE'").select((F.floor(F.col("seq") / 16)).alias("k"), F.col("seq").alias("a"), F.col("points").alias("p"))
    b = e.where("layer IN ('POWER-CABLE', 'WATER', 'POWER-CROSS')").select((F.floor(F.col("seq") / 16)).alias("k"), F.col("seq").alias("b"), F.col("points").alias("q"))
    hit = G.segments_intersect(F.element_at("p", 1), F.element_at("p", 2), F.element_at("q", 1), F.element_at("q", 2))
    return a.join(b.hint("merge"), "k").where(hit).select("a", "b")


@query("m07_point_in_polygon", f"WITH {ENT} SELECT t.seq zone, s.seq subject FROM ent s JOIN ent t ON s.k=t.k AND t.closed AND s.kind='polyline' AND NOT s.closed AND s.ax BETWEEN t.minx AND t.maxx AND s.ay BETWEEN t.miny AND t.maxy")
def m07(spark, sf_dir):
    e = entities(spark, sf_dir).where("kind = 'polyline'").withColumn("k", F.floor(F.col("seq") / 16))
    z = e.where("closed").select("k", F.col("seq").alias("zone"), F.col("points").alias("poly"))
    s = e.where("NOT closed").select("k", F.col("seq").alias("subject"), F.element_at("points", 1).alias("p"))
    return s.join(z.hint("merge"), "k").where(G.point_in_polygon(F.col("p"), F.col("poly"))).select("zone", "subject")


@query("m16_bbox_distance", f"WITH {ENT} SELECT s.seq a, t.seq b, round(sqrt(pow(greatest(0,greatest(s.minx,t.minx)-least(s.maxx,t.maxx)),2)+pow(greatest(0,greatest(s.miny,t.miny)-least(s.maxy,t.maxy)),2)),4) d FROM ent s JOIN ent t ON s.k=t.k AND s.seq<t.seq")
def m16(spark, sf_dir):
    e = entities(spark, sf_dir).withColumn("k", F.floor(F.col("seq") / 16))
    s, t = (e.select("k", F.struct("seq", "minx", "miny", "maxx", "maxy").alias(n)) for n in "st")
    return s.join(t.hint("merge"), "k").where("s.seq < t.seq").select(F.col("s.seq").alias("a"), F.col("t.seq").alias("b"), F.round(G.bbox_distance(F.col("s"), F.col("t")), 4).alias("d"))


@query("m17_z_interval", f"WITH {ENT} SELECT layer, count(*) FILTER (WHERE z_known) known, sum(CASE WHEN z_known THEN z END)::double total FROM ent GROUP BY 1")
def m17(spark, sf_dir):
    z = G.z_interval(F.col("s"))
    return side(entities(spark, sf_dir), "s").groupBy(F.col("s.layer").alias("layer")).agg(F.count(z).alias("known"), F.sum(z["hi"]).alias("total"))


# -- routes --------------------------------------------------------------------------------------


def members(spark, sf_dir):
    return R.routes(classified(spark, sf_dir), D.drawings(spark, sf_dir))


# in the derived drawings a cell's SCADA runs meet at one end, its POWER runs cross where POWER-CROSS spans the cable, and supports overlap by their discs or rims
_TOUCH = f"""m AS (SELECT * FROM ent WHERE system IS NOT NULL AND kind<>'text'),
near AS (SELECT s.seq a, t.seq b FROM m s JOIN m t ON s.drawing_key=t.drawing_key AND s.system=t.system AND s.seq<t.seq AND s.minx-1/s.unit_to_mm<=t.maxx AND t.minx<=s.maxx+1/s.unit_to_mm AND s.miny-1/s.unit_to_mm<=t.maxy AND t.miny<=s.maxy+1/s.unit_to_mm
 WHERE CASE WHEN s.kind='polyline' THEN {O.line_line()}<=1/s.unit_to_mm ELSE sqrt(pow(s.cx-t.cx,2)+pow(s.cy-t.cy,2))<=s.radius+t.radius+1/s.unit_to_mm END),
walk AS (WITH RECURSIVE r(seq, root) AS (SELECT seq, seq FROM m UNION SELECT n.b, r.root FROM r JOIN (SELECT a, b FROM near UNION SELECT b, a FROM near) n ON n.a=r.seq) SELECT seq, min(root) root FROM r GROUP BY seq),
mr AS (SELECT m.*, w.root, CASE kind WHEN 'circle' THEN 2*pi()*radius ELSE sqrt(pow(bx-ax,2)+pow(ye-ay,2)) END len FROM m JOIN walk w USING (seq)),
rt AS (SELECT drawing_key, system, root, printf('R-%s-%03d', system, row_number() OVER (PARTITION BY drawing_key, system ORDER BY root)) route_id, count(*) entity_count, round(sum(len),3) length, list(handle ORDER BY seq)[1:50] handles FROM mr GROUP BY drawing_key, system, root)"""


@query("j07_g1_routes", f"WITH {ENT}, {_TOUCH} SELECT drawing_key, route_id, system, entity_count, length, handles FROM rt")
def j07(spark, sf_dir):
    return R.route_table(members(spark, sf_dir))


@query(
    "j09_nearby_objects",
    f"""WITH {ENT}, p AS (SELECT s.seq a, t.handle h, t.layer l, t.entity_type ty, coalesce(t.system,'') sy, round(CASE t.kind WHEN 'polyline' THEN CASE WHEN t.closed THEN NULL ELSE {O.line_line()} END ELSE {O.line_circle()} END,1) d, CASE t.kind WHEN 'polyline' THEN {O.line_line()} ELSE {O.line_circle()} END exact
 FROM ent s JOIN ent t ON s.drawing_key=t.drawing_key AND s.seq<>t.seq AND s.layer='POWER-CROSS' AND t.layer IN ('SUPPORT','WATER','SCADA-CABLE','POWER-CABLE','POWER-CROSS') AND s.minx-1000/s.unit_to_mm<=t.maxx AND t.minx<=s.maxx+1000/s.unit_to_mm AND s.miny-1000/s.unit_to_mm<=t.maxy AND t.miny<=s.maxy+1000/s.unit_to_mm WHERE exact<=1000/s.unit_to_mm),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, h) n FROM p) SELECT a::varchar issue_id, list(h||' '||l||' '||ty||' '||sy||' '||printf('%.1f', d) ORDER BY n) near FROM r WHERE n<=8 GROUP BY a""",
)
def j09(spark, sf_dir):
    """What lies near every power crossing, each of them an issue of its own."""
    e = classified(spark, sf_dir).where("kind <> 'text' AND NOT closed")
    involved = e.where("layer = 'POWER-CROSS'").select(F.col("seq").cast("string").alias("issue_id"), "drawing_key", F.lit(0).alias("pos"), "seq")
    near = R.nearby(involved, e, D.drawings(spark, sf_dir))
    return near.select("issue_id", F.transform("nearby", lambda x: F.concat_ws(" ", x["handle"], x["layer"], x["entity_type"], x["system"], F.format_string("%.1f", x["distance"]))).alias("near"))
