"""Spatial joins as equi-joins on grid cells, and exact distances of candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conformix.functions import geometry as G
from conformix.functions import kernels
from conformix.sources.tables import materialise

#: An entity that covers more cells than this is joined by its drawing instead.
MANY_CELLS = 4096


def auto_cell(entities: DataFrame) -> DataFrame:
    """(drawing_key, cell): max(2 * median of the larger box side, extent / 1000), or extent / 64 if that median is 0."""
    side = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    agg = entities.groupBy("drawing_key").agg(F.median(side).alias("m"), F.greatest(F.max("maxx") - F.min("minx"), F.max("maxy") - F.min("miny")).alias("extent"))
    cell = F.greatest(F.when(F.col("m") > 0, F.col("m") * 2).otherwise(F.col("extent") / 64), F.col("extent") / 1000)
    return agg.select("drawing_key", F.when(cell > 0, cell).otherwise(1.0).alias("cell"))


def _spread(df: DataFrame, p: str, by: Column, cell: Column) -> DataFrame:
    low = lambda n: F.floor((F.col(p + n) - by) / cell)
    high = lambda n: F.floor((F.col(p + n) + by) / cell)
    df = df.withColumns({f"{p}x0": low("minx"), f"{p}x1": high("maxx"), f"{p}y0": low("miny"), f"{p}y1": high("maxy")})
    return df.withColumn("_few", (F.col(f"{p}x1") - F.col(f"{p}x0") + 1) * (F.col(f"{p}y1") - F.col(f"{p}y0") + 1) <= MANY_CELLS)


def _explode(df: DataFrame, p: str) -> DataFrame:
    """One row for each cell of a box. One generator makes both numbers of a cell: through two of them in a row Spark's pruning of nested
    fields can lose a field of the entity."""
    x0, y0 = F.least(f"{p}x0", f"{p}x1"), F.least(f"{p}y0", f"{p}y1")
    wide, high = F.abs(F.col(f"{p}x1") - F.col(f"{p}x0")) + 1, F.abs(F.col(f"{p}y1") - F.col(f"{p}y0")) + 1
    cells = df.where("_few").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), wide * high - 1)))
    return cells.withColumns({"gx": x0 + F.pmod("_i", wide), "gy": y0 + F.floor(F.col("_i") / wide)}).drop("_i")


def candidates(left: DataFrame, right: DataFrame, cell: float | Column, radius: float | Column = 0.0) -> DataFrame:
    """Pairs (s, t) of one drawing whose boxes, s's grown by `radius`, overlap (touching counts), each pair once.

    left has a struct column s, right a struct column t; both have drawing_key, and whatever Columns `cell` and
    `radius` name (equal on both sides for one drawing). Each box goes to the cells it covers; the join is an
    equi-join on (drawing_key, cell), and a pair counts only in the cell that holds the lower corner of the overlap.
    Boxes over more than MANY_CELLS cells are joined with all of their drawing; they are counted first, since that join
    deals out the whole other side even where there are none.
    """
    cell, radius = (x if isinstance(x, Column) else F.lit(float(x)) for x in (cell, radius))
    keep = [c for c in left.columns if c not in ("s", "drawing_key")]
    sides = ("minx", "miny", "maxx", "maxy")
    # boxes as flat columns: what the join compares does not reach into the entities
    a = left.withColumns({f"_a{n}": F.col("s")[n] for n in sides} | {"_r": radius})
    b = right.withColumns({f"_b{n}": F.col("t")[n] for n in sides})
    a = _spread(a, "_a", F.col("_r"), cell).select("drawing_key", "s", "_few", "_r", *[f"_a{n}" for n in (*sides, "x0", "x1", "y0", "y1")], *keep)
    b = _spread(b, "_b", F.lit(0.0), cell).select("drawing_key", "t", "_few", *[f"_b{n}" for n in (*sides, "x0", "x1", "y0", "y1")])
    c = F.col
    near = (c("_aminx") - c("_r") <= c("_bmaxx")) & (c("_bminx") <= c("_amaxx") + c("_r")) & (c("_aminy") - c("_r") <= c("_bmaxy")) & (c("_bminy") <= c("_amaxy") + c("_r"))
    once = (c("gx") == F.greatest("_ax0", "_bx0")) & (c("gy") == F.greatest("_ay0", "_by0"))
    out = _explode(a, "_a").join(_explode(b, "_b").drop("_few").hint("shuffle_hash"), ["drawing_key", "gx", "gy"]).where(once & near)
    pick = lambda df: df.select("drawing_key", "s", "t", *keep)
    out = pick(out)
    sizes = a.select(F.lit("s").alias("side"), "_few").unionByName(b.select(F.lit("t").alias("side"), "_few"))
    wide = {r["side"] for r in sizes.where("not _few").groupBy("side").count().collect()}
    if "s" in wide:
        out = out.unionByName(pick(a.where("not _few").join(b.drop("_few").hint("merge"), "drawing_key").where(near)))
    if "t" in wide:
        out = out.unionByName(pick(a.where("_few").join(b.where("not _few").drop("_few").hint("merge"), "drawing_key").where(near)))
    return out


def brute_candidates(left: DataFrame, right: DataFrame, radius: float = 0.0) -> DataFrame:
    """The same pairs by comparing all of a drawing; for tests."""
    return left.join(right, "drawing_key").where(G.bbox_overlaps(F.col("s"), F.col("t"), F.lit(float(radius)))).select("drawing_key", "s", "t")


def _shape(e: Column) -> Column:
    return F.struct(*[e[n].alias(n) for n in ("kind", "points", "closed", "cx", "cy", "radius", "minx", "miny", "maxx", "maxy")])


def distances(pairs: DataFrame, cutoff: Column) -> DataFrame:
    """pairs with distance, pa, pb (closest points) and contained; pairs beyond the cutoff are dropped.

    The exact measurement is one Arrow kernel over whole batches: as Column expressions the branches for circles, segments
    and many-sided shapes plan for longer than they run. Boxes beyond the cutoff never reach it.
    """
    s, t = F.col("s"), F.col("t")
    near = pairs.where(G.bbox_distance(s, t) <= cutoff)
    out = near.withColumn("_m", kernels.distance_udf()(_shape(s), _shape(t)))
    p, q = G.point(F.col("_m.pax"), F.col("_m.pay")), G.point(F.col("_m.pbx"), F.col("_m.pby"))
    return out.where(F.col("_m.d") <= cutoff).withColumns({"distance": F.col("_m.d"), "pa": p, "pb": q, "contained": F.col("_m.contained")}).drop("_m")


def overlap_lengths(pairs: DataFrame, tol: Column) -> DataFrame:
    """pairs with overlap: the summed length of collinear overlaps of their boundaries."""
    return pairs.withColumn("overlap", kernels.overlap_udf()(_shape(F.col("s")), _shape(F.col("t")), tol))


def zone_relations(pairs: DataFrame) -> DataFrame:
    """pairs of an entity s and a closed zone t with rel: inside, partial or outside."""
    return pairs.withColumn("rel", kernels.zone_udf()(_shape(F.col("s")), _shape(F.col("t"))))


def touching_points(left: DataFrame, right: DataFrame, cell: float | Column) -> DataFrame:
    """(drawing_key, s_seq, t_seq, points): of entities that touch, one point for each pair of their segments that do, in the order of the segments.

    Candidate pairs by boxes, then pairs of segments whose boxes overlap as rows, tested by columns; points of a pair are gathered again. Circles
    count as their polygons. Where collinear segments share a stretch, the first end that lies on the other one stands for it.
    """
    pairs = candidates(left, right, cell).where("s.seq <> t.seq").select("drawing_key", F.col("s.seq").alias("s_seq"), F.col("t.seq").alias("t_seq"), G.segments(F.col("s")).alias("_s"), G.segments(F.col("t")).alias("_t"))
    # written before the segments come out as rows, so that both sides are cut into segments once
    pairs = materialise(pairs, "touching")
    one = pairs.select("drawing_key", "s_seq", "t_seq", F.posexplode("_s").alias("i", "p"), "_t").select("drawing_key", "s_seq", "t_seq", "i", "p", F.posexplode("_t").alias("j", "q"))
    a, b, c, d = F.col("p.a"), F.col("p.b"), F.col("q.a"), F.col("q.b")
    low, high = lambda u, v, n: F.least(u[n], v[n]), lambda u, v, n: F.greatest(u[n], v[n])
    boxes = (low(a, b, "x") <= high(c, d, "x")) & (low(c, d, "x") <= high(a, b, "x")) & (low(a, b, "y") <= high(c, d, "y")) & (low(c, d, "y") <= high(a, b, "y"))
    hit = one.where(boxes).where(G.segments_intersect(a, b, c, d)).withColumn("at", G.shared_point(a, b, c, d))
    listed = F.array_sort(F.collect_list(F.struct("i", "j", "at")))
    return hit.groupBy("drawing_key", "s_seq", "t_seq").agg(F.transform(listed, lambda x: x["at"]).alias("points"))


def within(left: DataFrame, right: DataFrame, cell, radius, cutoff: Column | None = None) -> DataFrame:
    """Pairs of different entities whose exact distance is at most radius + EPS."""
    from conformix.schema import EPS

    pairs = candidates(left, right, cell, radius).where("s.seq <> t.seq")
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    return distances(pairs, r + EPS if cutoff is None else cutoff)
