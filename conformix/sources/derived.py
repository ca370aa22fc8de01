"""Drawings, specification lines and other inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conformix.functions.geometry import with_bbox
from conformix.schema import ENTITY
from conformix.sources.tables import materialise, shared_dir, tasks

PER_DRAWING, PITCH = 1024, 6000
#: Orders whose entities one task makes, at most.
ORDERS_A_TASK = 65_536
GAPS = (180, 250, 320, 340, 450, 700)

SYSTEMS = [("SCADA", "^SCADA"), ("POWER", "^POWER"), ("SUPPORT", "^SUPPORT")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _d(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("double")


def _shape(slot, when, layer, kind_type, points=None, closed=False, circle=None, text=None, z=None) -> Column:
    """One entity struct, or null where `when` does not hold."""
    pts = F.array(*[F.struct(_d(x).alias("x"), _d(y).alias("y")) for x, y in points]) if points else F.lit(None).cast("array<struct<x:double,y:double>>")
    kind = "polyline" if points else "circle" if text is None else "text"
    cx, cy, r = circle or (None, None, None)
    known, low = z or (F.lit(False), F.lit(None))
    fields = {
        "slot": F.lit(slot), "layer": F.lit(layer), "entity_type": F.lit(kind_type), "kind": F.lit(kind), "points": pts, "closed": F.lit(closed),
        "cx": _d(cx), "cy": _d(cy), "radius": _d(r), "text": F.lit(None).cast("string") if text is None else text, "text_height": _d(100 if text is not None else None),
        "z_known": known, "z_min": F.when(known, _d(low)), "z_max": F.when(known, _d(low)), "height": F.when(known, F.lit(0.0)),
    }
    return F.when(when, F.struct(*[c.alias(n) for n, c in fields.items()]))


def drawing_entities(spark: SparkSession, sf_dir: str, revised: bool = False) -> DataFrame:
    """Cable runs, supports, pipes, zones and notes: one cell of 6 m for each order, 1024 cells to a drawing.

    revised: the second state of the drawings (other gaps in every tenth cell, every fiftieth cell gone).
    """
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    base = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # a small file becomes a table many times its size: its rows are dealt to as many tasks as the entities need
    rows = base.count()
    base = base.repartition(max(rows // ORDERS_A_TASK, min(tasks(spark), rows // 4096), 1), "o_orderkey")
    if revised:
        base = base.where(k % 50 != 7)
    gap = F.element_at(F.array(*map(F.lit, GAPS)), (c % 6 + 1).cast("int"))
    if revised:
        gap = gap + F.when(k % 10 == 3, 60).otherwise(0)
    cx, cy = k % 128 * PITCH, F.floor(k / 128) * PITCH
    tilt = F.when(c % 5 == 4, 8).otherwise(0)
    x1 = cx + 2500 + (k * 7919 + c) % 2300
    wx = cx + 1500 + k * 53 % 2500
    y, yes, even = cy + 1000, F.lit(True), k % 2 == 0
    shapes = [
        _shape(0, yes, "SCADA-CABLE", "LWPOLYLINE", [(cx + 200, y), (x1, y + tilt)], z=(even, F.lit(1000))),
        _shape(1, yes, "POWER-CABLE", "LWPOLYLINE", [(cx + 200, y + gap), (x1, y + gap)]),
        _shape(2, yes, "SUPPORT", "CIRCLE", circle=(cx + 300 + (k * 31 + c * 17) % 5200, cy + 300 + (k * 13 + c * 7) % 2200, 90)),
        _shape(3, yes, "SUPPORT", "CIRCLE", circle=(cx + 300 + (k * 57 + c * 29) % 5200, cy + 300 + (k * 23 + c * 11) % 2200, 90)),
        _shape(4, k % 3 == 0, "WATER", "LINE", [(wx, cy + 300), (wx, cy + 2600)]),
        _shape(5, k % 9 == 0, "POWER-CROSS", "LINE", [(cx + 1200, cy + 700), (cx + 1200, cy + 1300)], z=(even, 1100 + c % 5 * 50)),
        _shape(6, k % 10 == 0, "TRENCH", "LWPOLYLINE", [(cx + 100, cy + 900), (cx + 5000, cy + 900), (cx + 5000, cy + 1100), (cx + 100, cy + 1100)], True),
        _shape(7, k % 20 == 5, "NOGO", "LWPOLYLINE", [(cx + 2000, cy + 800), (cx + 2600, cy + 800), (cx + 2600, cy + 1400), (cx + 2000, cy + 1400)], True),
        _shape(8, k % 11 == 0, "NOTE", "TEXT", circle=(cx + 500, cy + 1100, None), text=F.concat(F.lit("SCADA "), k.cast("string"))),
        _shape(9, k % 4 == 0, "SCADA-CABLE", "LINE", [(x1, y + tilt), (x1, cy + 500)]),
    ]
    rows = base.select(k.alias("k"), F.explode(F.array_compact(F.array(*shapes))).alias("e")).select("k", "e.*")
    seq = F.col("k") * 16 + F.col("slot")
    rows = rows.withColumns({"drawing_key": F.concat(F.lit("dwg-"), F.floor(F.col("k") / PER_DRAWING).cast("string")), "seq": seq, "handle": F.hex(seq)})
    rows = rows.withColumn("eid", F.concat_ws("#", "drawing_key", "handle"))
    return with_bbox(rows).select(*ENTITY.fieldNames())


_stored: dict[tuple, DataFrame] = {}


def stored_entities(spark: SparkSession, sf_dir: str, revised: bool = False) -> DataFrame:
    """drawing_entities as a table of the shared folder, written once a session: what reads it plans over plain columns."""
    key = (spark.sparkContext.applicationId, shared_dir(spark), sf_dir, revised)
    if key not in _stored:
        _stored[key] = materialise(drawing_entities(spark, sf_dir, revised), "entities")
    return _stored[key]


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(drawing_key, unit_to_mm, units_assumed) of every drawing, written once a session like the entities."""
    key = (spark.sparkContext.applicationId, shared_dir(spark), sf_dir, "drawings")
    if key not in _stored:
        _stored[key] = materialise(_drawings(spark, sf_dir), "drawings")
    return _stored[key]


def _drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.col("o_orderkey") / PER_DRAWING)
    d = read(spark, sf_dir, "orders").select(n.alias("n")).distinct()
    return d.select(F.concat(F.lit("dwg-"), F.col("n").cast("string")).alias("drawing_key"), F.when(F.col("n") % 5 == 3, 10.0).otherwise(1.0).alias("unit_to_mm"), (F.col("n") % 7 == 2).alias("units_assumed"))


SPEC_TEMPLATES = [
    ("4.{s} 管線配置",), ("SCADA 電纜與電力電纜之水平淨距不得小於 {v} mm。",), ("SCADA 電纜與電力電纜之水平淨距不得小於 {c} cm。",), ("",),
    ("弱電電纜不得與給水管交叉。",), ("弱電電纜不得進入機房禁設區。",), ("電纜應完全位於管溝範圍內。",), ("電纜長度不得大於 {s} m。",),
    ("電纜之走向應為水平或垂直，偏差不得超過 {d}°。",), ("至少設置 {n} 個支架。",), ("通信線纜架與電力線纜架之水平淨距宜大於等於 {v}。",), ("管線應保持適當距離。",),
    ("SCADA 電纜與電力電纜之間距不得小於 {v} mm。",), ("電纜距離支架不得超過 {v} mm。",), ("SCADA 電纜與電力電纜之水平淨距不得小於 {v} mm，垂直淨距不得小於 {v} mm。",), ("速度 300 m/s，1,300 mm 與 ３００ ｍｍ 之比較。",),
]


def spec_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, filename, page, line_no, text): one specification for each part brand, 40 lines to a page."""
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("long").alias("s")).withColumn("rank", F.row_number().over(w) - 1)
    values = {"s": F.col("s"), "v": F.col("s") * 10, "c": F.col("s"), "d": F.col("s") % 5 + 1, "n": F.col("s") % 9 + 1}
    text = None
    for i, (t,) in enumerate(SPEC_TEMPLATES):
        made = F.lit(t)
        for name, v in values.items():
            if "{" + name + "}" in t:
                made = F.replace(made, F.lit("{" + name + "}"), v.cast("string"))
        text = F.when(F.col("p_partkey") % 16 == i, made) if text is None else text.when(F.col("p_partkey") % 16 == i, made)
    page = F.floor(F.col("rank") / 40) + 1
    return p.select(F.col("p_brand").alias("document_id"), F.concat("p_brand", F.lit(".md")).alias("filename"), page.cast("int").alias("page"), (F.col("rank") % 40 + 1).cast("int").alias("line_no"), text.alias("text"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of `documents`, numbered from 1 in each."""
    docs = read(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return lines.select("document_id", "filename", "page", (F.col("i") + 1).alias("line_no"), "text")


#: Customers to a drawing of raw primitives.
PER_RAW = 64
RAW_CODES = (4, 5, 6, 1, 2, 0, 99, 22)

# inserts of each drawing d: slot of the customer, in which drawings, container, block, layer, matrix, rows, columns, spacing
RAW_INSERTS = [
    ("s = 1", "MODEL", "ROOT", "concat('L', d % 5)", "1,0,0,1,0,d*100,0", 1, 1),
    ("s IN (2, 4)", "ROOT", "B{s}", "'0'", "1,0,0,1,s*1000,0,s*10", 1, 1),
    ("s IN (3, 5)", "ROOT", "B{s}", "'INS'", "2,0,0,2,s*1000,0,0", 1, 1),
    ("s = 6", "ROOT", "B6", "'0'", "1,0,0,1,6000,0,0", 2, 3),
    ("s = 7 AND d % 3 = 0", "B2", "ROOT", "'0'", "1,0,0,1,0,0,0", 1, 1),
    ("s = 7 AND d % 3 <> 0", "B2", "B5", "'0'", "1,0,0,1,7,7,0", 1, 1),
    ("s = 8 AND d % 2 = 0", "ROOT", "NOPE", "'0'", "1,0,0,1,0,0,0", 1, 1),
    ("s = 9", "MODEL", "B3", "'STRETCH'", "2,0,0,3,50,60,0", 1, 1),
    ("s = 10 AND d % 4 = 1", "ROOT", "B4", "'0'", "1,0,0,1,0,0,0", 400, 300),
    ("s = 11", "MODEL", "B6", "'TURN'", "0,1,-1,0,10,20,0", 1, 1),
    ("s = 12 AND d % 7 = 0", "MODEL", "D1", "'0'", "1,0,0,1,1,0,0", 1, 1),
    ("s BETWEEN 13 AND 21 AND d % 7 = 0", "D{s-12}", "D{s-11}", "'0'", "1,0,0,1,1,0,0", 1, 1),
]


def _named(text: str, sql: str) -> str:
    """A name with a number in braces as an SQL expression."""
    head, _, rest = text.partition("{")
    return f"'{head}'" if not rest else sql.format(head=head, n=rest[:-1])


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(drawing_key, k, d, s): customers dealt to drawings of raw primitives."""
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select(k.alias("k"), F.floor(k / PER_RAW).alias("d"), (k % PER_RAW).alias("s"))
    return c.select(F.concat(F.lit("raw-"), F.col("d").cast("string")).alias("drawing_key"), "k", "d", "s")


def raw_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(drawing_key, code): the unit code of every raw drawing."""
    codes = F.element_at(F.array(*map(F.lit, RAW_CODES)), (F.col("d") % len(RAW_CODES) + 1).cast("int"))
    return raw_customers(spark, sf_dir).select("drawing_key", codes.alias("code")).distinct()


def raw_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, out = raw_customers(spark, sf_dir), None
    for where, container, block, layer, m, rows, cols in RAW_INSERTS:
        name = lambda t: _named(t, "concat('{head}', CAST({n} AS STRING))")
        matrix = "array(" + ",".join(f"CAST({x} AS DOUBLE)" for x in m.split(",")) + ")"
        one = base.where(where).selectExpr("drawing_key", f"{name(container)} AS container", "k AS ord", "concat('I', CAST(k AS STRING)) AS handle", f"{name(block)} AS block", f"{layer} AS layer", f"{matrix} AS m", f"{rows} AS rows", f"{cols} AS cols", "5000D AS dx", "7000D AS dy")
        out = one if out is None else out.unionByName(one)
    return out


def raw_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primitives of every type in the model and in blocks whose names repeat from drawing to drawing."""
    k, s = F.col("k"), F.col("s")
    x = (k % 100).cast("double")
    kind = F.element_at(F.array(*map(F.lit, ("LINE", "LWPOLYLINE", "POLYLINE", "ARC", "CIRCLE", "TEXT", "SPLINE", "ELLIPSE"))), (F.floor(s / 8) + 1).cast("int"))
    kind = F.when((kind == "ELLIPSE") & (s % 2 == 1), "MESH").otherwise(kind)
    place = F.when(s % 8 == 0, "MODEL").when(s % 8 == 1, "ROOT").when(s % 8 == 7, "D8").otherwise(F.concat(F.lit("B"), (s % 8).cast("string")))
    z = F.when(k % 2 == 1, 5.0).otherwise(0.0)
    at = lambda *ps: F.array(*[F.struct((x + px).alias("x"), F.lit(float(py)).alias("y"), z.alias("z")) for px, py in ps])
    axis = F.array(F.struct(F.lit(20.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")))
    points = F.when(kind == "LINE", at((0, 1), (10, 1))).when(kind == "LWPOLYLINE", at((0, 0), (10, 0), (10, 10), (0, 0))).when(kind == "POLYLINE", at((3, 4))).when(kind == "SPLINE", at((0, 0), (5, 5), (9, 0), (0, 0))).when(kind == "ELLIPSE", axis)
    centred, round_ = kind.isin("ARC", "CIRCLE", "TEXT", "ELLIPSE"), kind.isin("ARC", "ELLIPSE")
    start = F.when(kind == "ARC", k * 37 % 360).otherwise(0)
    return raw_customers(spark, sf_dir).select(
        "drawing_key", place.alias("container"), k.alias("ord"), F.hex("k").alias("handle"), F.when(k % 6 == 0, "0").otherwise("OWN").alias("layer"), kind.alias("type"), points.alias("points"), (kind == "LWPOLYLINE").alias("closed"),
        F.when(centred, x).alias("cx"), F.when(centred, 5.0).alias("cy"), F.when(centred, (k % 3).cast("double")).alias("cz"), F.when(kind == "ARC", (50 + k % 50).cast("double")).when(kind == "CIRCLE", (10 + k % 7).cast("double")).alias("radius"),
        F.when(kind == "ELLIPSE", 0.5).alias("ratio"), F.when(round_, start.cast("double")).alias("start_deg"), F.when(round_, (start + F.when(kind == "ARC", 30 + k % 300).otherwise(360)).cast("double")).alias("end_deg"),
        F.when(kind == "TEXT", F.concat(F.lit("T"), k.cast("string"))).alias("text"), F.when(kind == "TEXT", 2.5).alias("text_height"), F.lit(None).cast("string").alias("tag"),
    )
