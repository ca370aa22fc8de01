"""The grid join gives what comparing all boxes gives."""

import random

from pyspark.sql import functions as F

from conformix.operators import spatial


def test_grid_join_equals_brute_force(spark):
    rng = random.Random(3)
    boxes = [(i, *(rng.uniform(0, 5000) for _ in range(2)), rng.uniform(0, 300), rng.uniform(0, 300)) for i in range(300)] + [(300, 0.0, 2000.0, 400000.0, 1.0), (301, 500.0, 500.0, 0.0, 0.0)]
    df = spark.createDataFrame(boxes, "seq long, x double, y double, w double, h double").withColumn("drawing_key", F.lit("d"))
    df = df.withColumns({"minx": F.col("x"), "miny": F.col("y"), "maxx": F.col("x") + F.col("w"), "maxy": F.col("y") + F.col("h")})
    s, t = (df.select("drawing_key", F.struct("seq", "minx", "miny", "maxx", "maxy").alias(n)) for n in "st")
    pairs = lambda p: sorted((r[0], r[1]) for r in p.select("s.seq", "t.seq").collect())
    grid, brute = pairs(spatial.candidates(s, t, 90.0, 50.0)), pairs(spatial.brute_candidates(s, t, 50.0))
    assert len(grid) == len(set(grid)) and grid == brute


def test_large_boxes_are_joined_only_where_there_are_any(spark):
    rng = random.Random(4)
    small = [(i, rng.uniform(0, 3000), rng.uniform(0, 3000), rng.uniform(0, 300), rng.uniform(0, 300)) for i in range(60)]
    large = [(60, 0.0, 2000.0, 400000.0, 1.0)]

    def side(boxes, n):
        df = spark.createDataFrame(boxes, "seq long, x double, y double, w double, h double")
        box = [F.col("x").alias("minx"), F.col("y").alias("miny"), (F.col("x") + F.col("w")).alias("maxx"), (F.col("y") + F.col("h")).alias("maxy")]
        return df.select(F.lit("d").alias("drawing_key"), F.struct("seq", *box).alias(n))

    pairs = lambda p: sorted((r[0], r[1]) for r in p.select("s.seq", "t.seq").collect())
    for left, right, joins in ((small, small, 1), (small + large, small, 2), (small, small + large, 2), (small + large, small + large, 3)):
        s, t = side(left, "s"), side(right, "t")
        found = spatial.candidates(s, t, 90.0, 50.0)
        # a join by drawing alone deals out the whole other side, so there is none without a large box
        assert found._jdf.queryExecution().analyzed().toString().count("Join Inner") == joins
        assert pairs(found) == pairs(spatial.brute_candidates(s, t, 50.0))


def test_far_from_the_origin_entities_touch_no_sooner(spark):
    schema = "kind string, points array<struct<x:double,y:double>>, closed boolean, cx double, cy double, radius double, minx double, miny double, maxx double, maxy double"
    line = lambda x, y, *ps: ("polyline", [(px + x, py + y) for px, py in ps], False, None, None, None, min(p[0] for p in ps) + x, min(p[1] for p in ps) + y, max(p[0] for p in ps) + x, max(p[1] for p in ps) + y)
    ring = lambda x, y, r: ("circle", None, False, float(x), float(y), float(r), x - r + 0.0, y - r + 0.0, x + r + 0.0, y + r + 0.0)
    # a line that ends 0.05 beside a rim, one whose end lies 0.3 beside another line, and one with an end in the disc
    made = lambda x, y: [(line(x, y, (0, 0), (100, 0)), ring(x + 190.05, y, 90)), (line(x, y, (0, 0), (100, 0)), line(x, y, (50, 0.3), (50, 90))), (line(x, y, (0, 0), (100, 0)), ring(x + 120, y, 90))]

    def measured(x, y):
        df = spark.createDataFrame(made(x, y), f"s struct<{schema.replace(' ', ':').replace(',:', ',')}>, t struct<{schema.replace(' ', ':').replace(',:', ',')}>")
        rows = spatial.distances(df, F.lit(1000.0)).select("distance", "pa.x", "pa.y", "contained").collect()
        return sorted((round(r[0], 6), round(r[1] - x, 6), round(r[2] - y, 6), r[3]) for r in rows)

    near = measured(0.0, 0.0)
    assert [r[0] for r in near] == [0.0, 0.05, 0.3]
    assert [(round(a, 4), *map(lambda v: round(v, 4), b[:2]), c) for a, *b, c in measured(6000.0, 4.2e8)] == [(round(a, 4), *map(lambda v: round(v, 4), b[:2]), c) for a, *b, c in near]


def test_entities_are_never_dealt_by_layer(spark):
    """Most entities may be of one layer: systems reach them without a shuffle by layer, whatever is broadcast of its own accord."""
    from conformix.operators import evaluate as E

    e = spark.range(2000).selectExpr("CASE WHEN id % 10 = 0 THEN 'POWER' ELSE 'SUPPORT' END AS layer", "id AS seq")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = E.classify_systems(e, [("P", "^power")])
        assert got.where("system = 'P'").count() == 200 and got.count() == 2000
        assert "hashpartitioning(layer" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_entities_come_out_of_several_tasks(spark):
    """A file of one row group is dealt anew before it becomes entities."""
    from conformix.sources import derived as D

    assert D.drawing_entities(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() > 1


def test_the_longest_segment_is_looked_for_once():
    from conformix.functions import geometry as G

    e = {n: F.col(n) for n in ("points", "closed", "kind")}
    assert str(G.principal_angle(e)).count("aggregate(") == 1


def test_rules_are_evaluated_once_for_numbering(spark):
    from conformix.operators import reports as R

    rows = [("d", 0, i, [str(i)], 1.0, 2.0) for i in range(30)] + [("d", 1, None, [], None, None)]
    df = spark.createDataFrame(rows, "drawing_key string, rule_pos int, subject_seq long, target_handles array<string>, loc_x double, loc_y double")
    got = R.numbered(df)
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r.seq for r in got.orderBy("rule_pos", "subject_seq").collect()] == list(range(31))
