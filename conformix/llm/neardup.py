"""Near-duplicate embeddings by NN-descent: neighbour lists refined by neighbours-of-neighbours joins, threshold edges kept."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conformix.llm.ann import clean_vectors
from conformix.llm.common import components, discard, materialise, tasks
from conformix.llm.jaccard import forest

#: Length of the neighbour lists to begin with, the similarity from which a neighbour is worth following, rows compared at once.
NEIGHBOURS, EXPLORE, WINDOW_ROWS = 12, 0.9, 128
#: Share of the pairs at the threshold that the tables of the first lists may miss, and how far full lists grow.
FIRST, GROWTH = 0.3, 4
#: Most vectors of one side of a tile of the exact link count.
BLOCK = 2048
#: Linked vectors that a recall audit sees at least, vectors it asks in one pass at most, and the recall below which more tables are added.
AUDIT_ROWS, AUDIT_PASS, RECALL = 200, 4096, 0.995
#: Rounds of closing tables after which all vectors of different components are compared instead.
TABLE_ROUNDS = 20


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _pairs(a, b, s):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.asarray(s, float))], ["a", "b", "s"])


def _best(ids: np.ndarray, x: np.ndarray, k: int, least: float):
    """(a, b, cosine): each row's k best others in x from `least` on."""
    c = x @ x.T
    np.fill_diagonal(c, -2)
    if len(ids) > k:
        c[c < np.partition(c, -k, axis=1)[:, -k][:, None]] = -2
    i, j = np.nonzero(c >= least)
    return ids[i], ids[j], c[i, j]


def _shape(n: int, share: float) -> tuple[int, int]:
    """Bits of a code and tables: a pair at the threshold has no equal code in any table with probability `share` at most."""
    bits = max(4, math.ceil(math.log2(max(n, 2) / 100)))
    agree = (1 - math.acos(0.98) / math.pi) ** bits
    return bits, max(4, math.ceil(math.log(share) / math.log(1 - agree)))


def _coded(vectors: DataFrame, seed: int, bits: int, count: int) -> DataFrame:
    """Each vector with its sign code and a projection, once a table."""

    def code(batches):
        for b in batches:
            for g in {*b.column(1).to_pylist()}:
                part = b.filter(pa.compute.equal(b.column(1), g))
                dim = int(part.column(2)[0].as_py())
                x = _matrix(part.column(3), dim)
                for t in range(count):
                    planes = np.random.default_rng([seed, t, dim]).standard_normal((dim, bits + 1))
                    y = x @ planes
                    codes = (y[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    n_ = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n_, t, np.int32)), *part.columns[:4], pa.array(codes), pa.array(y[:, bits]), part.column(4)], ["t", "id", "grp", "dim", "x", "code", "y", "comp"])

    return vectors.select("id", "grp", "dim", "x", "comp").mapInArrow(code, "t int, id long, grp long, dim int, x binary, code long, y double, comp long")


def _tables(vectors: DataFrame, n: int, seed: int, k: int, least: float, share: float) -> DataFrame:
    """First lists: in each of several tables, vectors sorted by group, sign code and a projection; windows of neighbours
    in that order are compared. Codes get a bit as the vectors double, and tables so that a pair at the threshold
    misses all of them with probability `share` at most. A range partitioning cuts a crowded code over many tasks."""
    bits, count = _shape(n, share)
    coded = _coded(vectors, seed, bits, count)
    wide = max(tasks(vectors.sparkSession), n * count // 50_000)
    dealt = coded.repartitionByRange(wide, "t", "grp", "code", "y", "id").sortWithinPartitions("t", "grp", "code", "y", "id").select("id", "grp", "dim", "x", "t")

    def compare(batches):
        held: list[tuple] = []

        def out(rows):
            ids, x = np.array([r[0] for r in rows], np.int64), np.frombuffer(b"".join(r[3] for r in rows), np.float64).reshape(len(rows), rows[0][2])
            return _pairs(*_best(ids, x, k, least))

        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(5))):
                if held and (r[1], r[4]) != (held[-1][1], held[-1][4]):
                    yield out(held)
                    held = []
                held.append(r)
                if len(held) == WINDOW_ROWS:
                    yield out(held)
                    held = held[WINDOW_ROWS // 2 :]
        if held:
            yield out(held)

    return dealt.mapInArrow(compare, "a long, b long, s double")


def _across(vectors: DataFrame, n: int, seed: int, threshold: float, block: int, share: float = 0.05) -> DataFrame:
    """(a, b): components that a link joins, from all pairs of vectors with an equal sign code in one of several tables.

    A code is compared as a whole, a crowded one in tiles of its blocks; codes within one component are left out. Share 1:
    one table without bits, so that all vectors of a group are compared.
    """
    bits, count = _shape(n, share) if share < 1 else (0, 1)
    coded = _coded(vectors, seed, bits, count)
    by = ["t", "grp", "code"]
    sizes = coded.groupBy(*by).agg(F.count("*").alias("g"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("g") > block)
    # at most one row for `block` rows of the tables, so small enough to be broadcast
    crowded = materialise(sizes.select(*by, F.when(F.col("lo") < F.col("hi"), F.ceil(F.col("g") / block)).otherwise(0).cast("long").alias("blocks")), "crowded")
    placed = coded.join(F.broadcast(crowded), by, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).where("blocks > 0")
    placed = placed.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    at = placed.select(*by, F.least("blk", "other").alias("t1"), F.greatest("blk", "other").alias("t2"), "blk", "comp", "dim", "x")
    wide = max(tasks(vectors.sparkSession), n * count // 20_000)
    dealt = at.repartition(wide, *by, "t1", "t2").sortWithinPartitions(*by, "t1", "t2")

    def compare(batches):
        now, sides = None, {}

        def out():
            a, b = sides.get(now[3], []), sides.get(now[4], [])
            if not a or not b:
                return None
            (ca, xa), (cb, xb) = ((np.array([r[0] for r in side], np.int64), np.frombuffer(b"".join(r[2] for r in side), np.float64).reshape(len(side), side[0][1])) for side in (a, b))
            i, j = np.nonzero((xa @ xb.T >= threshold) & (ca[:, None] != cb[None, :]))
            if not len(i):
                return None
            pairs = forest(ca[i], cb[j])
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            for t, grp, code, t1, t2, blk, *r in zip(*(b.column(i).to_pylist() for i in range(9))):
                if (t, grp, code, t1, t2) != now:
                    if now is not None and (got := out()) is not None:
                        yield got
                    now, sides = (t, grp, code, t1, t2), {}
                sides.setdefault(blk, []).append(r)
        if now is not None and (got := out()) is not None:
            yield got

    return dealt.mapInArrow(compare, "a long, b long")


def _lists(pairs: DataFrame, k) -> DataFrame:
    """Each vertex's best neighbours, one row each: k of them, or as many as its own column k says."""
    w = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    return pairs.groupBy("a", "b").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("a", "b", "s")


def _refine(lists: DataFrame, vectors: DataFrame, k: int, least: float) -> DataFrame:
    """Neighbours of neighbours: at each pivot, the vectors that list it or that it lists are compared with each other."""
    back = Window.partitionBy("b").orderBy(F.desc("s"), "a")
    reverse = lists.withColumn("r", F.row_number().over(back)).where(F.col("r") <= 2 * k).select(F.col("b").alias("u"), F.col("a").alias("id"))
    around = lists.select(F.col("a").alias("u"), F.col("b").alias("id")).union(reverse).distinct()
    full = around.join(vectors.select("id", "dim", "x").hint("merge"), "id")
    wide = max(tasks(vectors.sparkSession), 1)
    dealt = full.repartition(wide, "u").sortWithinPartitions("u").select("u", "id", "dim", "x")

    def join(batches):
        now, held = None, []

        def out():
            ids, x = np.array([r[1] for r in held], np.int64), np.frombuffer(b"".join(r[3] for r in held), np.float64).reshape(len(held), held[0][2])
            return _best(ids, x, max(3, k // 2), least)

        found = []
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(4))):
                if r[0] != now:
                    if len(held) > 1:
                        found.append(out())
                    now, held = r[0], []
                held.append(r)
            if found:
                yield _pairs(*(np.concatenate(c) for c in zip(*found)))
                found = []
        if len(held) > 1:
            yield _pairs(*out())

    return dealt.mapInArrow(join, "a long, b long, s double")


def _links_in(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(id, links): exact numbers of linked vectors (copies counted) within each component, tile by tile of its blocks."""
    spark = members.sparkSession
    sizes = members.groupBy("comp").agg(F.count("*").alias("g")).withColumn("blocks", F.ceil(F.col("g") / block).cast("long"))
    placed = materialise(members.join(sizes.hint("merge"), "comp").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks"))), "placed")
    one = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    # a block meets every block of its component: as the lower side of the tile or as the upper one
    at = placed.withColumn("other", F.explode(one)).select("comp", F.least("blk", "other").alias("t1"), F.greatest("blk", "other").alias("t2"), "blk", "id", "copies", "dim", "x")
    wide = max(tasks(spark), placed.count() // 20_000)
    dealt = at.repartition(wide, "comp", "t1", "t2").sortWithinPartitions("comp", "t1", "t2")

    def count(batches):
        now, sides = None, {}

        def out():
            a, b = sides.get(now[1], []), sides.get(now[2], [])
            if not a or not b:
                return None
            ia, wa, xa = np.array([r[0] for r in a], np.int64), np.array([r[1] for r in a], float), np.frombuffer(b"".join(r[3] for r in a), float).reshape(len(a), a[0][2])
            ib, wb, xb = np.array([r[0] for r in b], np.int64), np.array([r[1] for r in b], float), np.frombuffer(b"".join(r[3] for r in b), float).reshape(len(b), b[0][2])
            near = xa @ xb.T >= threshold
            if now[1] == now[2]:
                np.fill_diagonal(near, False)
                ids, n = ia, near @ wb
            else:
                ids, n = np.concatenate((ia, ib)), np.concatenate((near @ wb, near.T @ wa))
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], ["id", "links"])

        for b in batches:
            for comp, t1, t2, blk, *r in zip(*(b.column(i).to_pylist() for i in range(8))):
                if (comp, t1, t2) != now:
                    if now is not None and (got := out()) is not None:
                        yield got
                    now, sides = (comp, t1, t2), {}
                sides.setdefault(blk, []).append(r)
        if now is not None and (got := out()) is not None:
            yield got

    return dealt.mapInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def _audit(vectors: DataFrame, threshold: float, rows: int) -> float:
    """Recall of links, averaged over vectors with a link: vectors against all rows, in blocks, until `rows` of those
    asked have a link or all have been asked. A link counts as found if both are in one component."""
    n = vectors.count()
    shares = max(1, -(-n // rows))
    share, at, step, linked, recall = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shares)), 0, 1, 0, 0.0
    while at < shares and linked < rows:
        q = {}
        for r in vectors.where((share >= at) & (share < at + step)).select("id", "grp", "dim", "x", "comp").collect():
            q.setdefault(r["grp"], []).append(r)
        at, step = at + step, min(2 * step, max(1, AUDIT_PASS // rows))
        if q:
            for r in vectors.select("id", "grp", "dim", "x", "comp").mapInArrow(_asked(q, threshold), "id long, t long, f long").groupBy("id").agg(F.sum("t").alias("t"), F.sum("f").alias("f")).collect():
                linked += 1
                recall += r["f"] / r["t"]
    return recall / linked if linked else 1.0


def _asked(q: dict, threshold: float):
    """(id, t, f) of the asked vectors q (by group) with links to a batch's rows: all of them and those within a component."""

    def run(batches):
        for b in batches:
            ids_of, true, found = [], [], []
            for g in {*b.column(1).to_pylist()} & q.keys():
                part = b.filter(pa.compute.equal(b.column(1), g))
                dim = int(part.column(2)[0].as_py())
                x, ids, comp = _matrix(part.column(3), dim), part.column(0).to_numpy(), part.column(4).to_numpy()
                for i in range(0, len(q[g]), 256):
                    some = q[g][i : i + 256]
                    y, own = np.frombuffer(b"".join(bytes(r["x"]) for r in some), float).reshape(-1, dim), np.array([r["id"] for r in some])
                    near = (y @ x.T >= threshold) & (own[:, None] != ids[None, :])
                    t = near.sum(1)
                    ids_of.append(own[t > 0])
                    true.append(t[t > 0])
                    found.append((near & (np.array([r["comp"] for r in some])[:, None] == comp[None, :])).sum(1)[t > 0])
            if ids_of:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (ids_of, true, found)], ["id", "t", "f"])

    return run


def descend(units: DataFrame, n: int, threshold: float, k: int = NEIGHBOURS, rounds: int = 8) -> DataFrame:
    """(a, b, s): NN-descent over n vectors units(id, grp, dim, x): first lists, then rounds of neighbours of neighbours."""
    plain = units.withColumn("comp", F.lit(None).cast("long"))

    lists = materialise(_lists(_tables(plain, n, 1, k, min(EXPLORE, threshold), FIRST), k), "lists")
    for _ in range(rounds):
        size, strong = lists.agg(F.count("*"), F.coalesce(F.sum((F.col("s") >= threshold).cast("long")), F.lit(0))).first()
        if not size:
            break
        full = lists.groupBy("a").agg(F.count("*").alias("n"), F.min("s").alias("low")).where((F.col("n") >= k) & (F.col("low") >= threshold))
        room = full.select("a", F.least(2 * F.col("n"), F.lit(GROWTH * k)).alias("room"))
        wider = lists.union(_refine(lists, units, k, min(EXPLORE, threshold))).join(room.hint("merge"), "a", "left")
        w = Window.partitionBy("a").orderBy(F.desc("s"), "b")
        new = wider.groupBy("a", "b").agg(F.max("s").alias("s"), F.max("room").alias("room")).withColumn("r", F.row_number().over(w))
        new = materialise(new.where(F.col("r") <= F.coalesce("room", F.lit(k))).select("a", "b", "s"), "lists")
        now = new.agg(F.coalesce(F.sum((F.col("s") >= threshold).cast("long")), F.lit(0))).first()[0]
        discard(lists)
        lists = new
        if now - strong <= 0.001 * max(strong, 1):
            break
    return lists


def near_duplicates(df: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", k: int = NEIGHBOURS, rounds: int = 8, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: links are pairs with equal, not null labels and cosine >= threshold.

    Equal vectors of a label are one class. Lists of `k` neighbours start from a few sorted sign-code tables, which miss FIRST of the
    pairs, and are refined by neighbours-of-neighbours joins until they find hardly a further link; lists that are full of
    links are doubled, up to GROWTH times `k` (a component needs no more: its links are counted exactly below). Edges from the
    threshold on give components; further tables compare all vectors of a code that are in different components,
    until no components merge. A recall audit (vectors against all rows, in blocks) always comes before the end and
    adds tables while it is below RECALL; after TABLE_ROUNDS of them all vectors of different components are
    compared. n_links is then counted exactly within each component.

    Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link with
    nothing. Vectors of different lengths do not link. Rows that repeat a vec_id are one vector (of its usable rows the
    one with the smallest label, then vector) and get the same result; other columns are not looked at; a null vec_id links
    with nothing; an empty table gives no rows.
    """
    usable = df.where(F.col(label).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"), F.col(label).cast("string").alias("label"))
    one = clean_vectors(usable, "key", "vector", "label").groupBy("id").agg(F.min(F.struct("label", "v")).alias("m"))
    good = materialise(one.select("id", "m.label", "m.v"), "vectors")
    classes = materialise(good.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "classes")

    def unit(batches):
        for b in batches:
            out = []
            for v in b.column(2).to_pylist():
                x = np.array(v, float)
                x = x / np.abs(x).max()
                out.append((x / np.linalg.norm(x)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) // 8 for x in out], pa.int32()), pa.array(out, pa.binary()), b.column(3)], ["id", "grp", "dim", "x", "copies"])

    units = materialise(classes.select("id", F.xxhash64("label", F.size("v")).alias("grp"), "v", "copies").mapInArrow(unit, "id long, grp long, dim int, x binary, copies long"), "units")
    n = units.count()
    lists = descend(units, n, threshold, k, rounds)
    edges = materialise(lists.where(F.col("s") >= threshold).select("a", "b"), "edges")
    seed, whole = 2, False
    while True:
        comp = materialise(components(edges), "components")
        state = units.join(comp.select(F.col("node").alias("id"), F.col("component").alias("c")).hint("merge"), "id", "left").withColumn("comp", F.coalesce("c", "id")).drop("c")
        state = materialise(state, "state")
        if whole:
            break
        whole = seed > TABLE_ROUNDS
        across = materialise(_across(state, n, seed, threshold, block, 1 if whole else 0.05), "across")
        seed += 1
        if across.isEmpty() and (whole or _audit(state, threshold, AUDIT_ROWS) >= RECALL):
            break
        edges = materialise(edges.union(across), "edges")
    many = state.groupBy("comp").agg(F.count("*").alias("g"), F.min("id").alias("root")).where("g > 1")
    members = state.join(many.select("comp", "root").hint("merge"), "comp")
    links = _links_in(members.select("comp", "id", "copies", "dim", "x"), threshold, block)
    of = members.select("id", "root").join(links.hint("merge"), "id", "left")
    per = classes.join(of.hint("merge"), "id", "left").select(F.col("label"), "v", F.col("id").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    # the class of a row is found by its vector; a class has one row here, and Spark splits a hot class's rows
    got = good.join(per.hint("merge"), ["label", "v"]).select("id", "n_links", "component_id")
    out = df.select(F.col(key).cast("long").alias("id")).join(got.hint("merge"), "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.col(key) == F.col("component_id"))
