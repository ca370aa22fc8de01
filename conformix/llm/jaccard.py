"""N-gram Jaccard join: a blocked sparse matrix product of sets by n-grams, rare columns first, bounded by sizes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conformix.llm.common import components, discard, materialise, mix, tasks, tidied, words_of
from conformix.llm.exchange import ROWS_SQL, answers, asking, by_value, chunked, each, joined, numbers, packed, summed

_U = np.uint64
#: Sets of one side of a tile of the matrix product.
BLOCK = 1024
#: What a set of a tile takes on average (_load), at most.
LOAD = 800
#: Text bytes of a chunk whose sets are stored in one row, and of which one part counts the n-grams.
CHUNK_BYTES, PART_BYTES = 4 << 20, 6 << 20
#: Kinds of rows between chunks and parts.
ASK, TOLD, SETS = range(3)


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's `width`-word shingles; fewer words: the whole sequence as one; none: none."""
    words, owner = words_of(texts)
    n = len(words)
    gram = np.zeros(n, _U)
    for k in range(width):
        shifted = np.zeros(n, _U)
        shifted[: max(n - k, 0)] = words[k:] if k else words
        gram = mix(gram * _U(0x9FB21C651E98DF25) + shifted + _U(k + 1))
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        lo, hi = bounds[i], bounds[i + 1]
        if hi - lo >= width:
            out.append(np.unique(gram[lo : hi - width + 1]))
        elif hi > lo:
            h = np.array([hi - lo], _U)
            for w in words[lo:hi]:
                h = mix(h * _U(3) + w)
            out.append(h)
        else:
            out.append(np.zeros(0, _U))
    return out


def first_grams(n: int, percent: int) -> int:
    """How many n-grams of a set of n come first: two sets that link share one of those, in any order common to both.

    100 * intersection >= percent * union needs an intersection of percent / 100 * n at least, so that a set of n that
    shares none of its first n - ceil(percent * n / 100) + 1 n-grams has too few left.
    """
    return n - -(-percent * n // 100) + 1


def _entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])


def product_links(a: list[np.ndarray], b: list[np.ndarray], percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a x b that link, i < j if both are the same block.

    Overlaps are accumulated from the two incidence matrices (sets by n-grams): columns that cannot count (an n-gram
    that one side lacks, or that one set alone has) are left out, sparse columns add their few products one by one,
    dense ones go through a matrix product of 1024 columns at a time. Pairs whose sizes rule a link out are discarded.
    """
    na, nb = (np.array([len(x) for x in s], np.int64) for s in (a, b))
    (ga, ra), (gb, rb) = _entries(a), _entries(b)
    grams, ca = np.unique(ga, return_inverse=True)
    at = np.minimum(np.searchsorted(grams, gb), len(grams) - 1)
    hit = grams[at] == gb
    rb, cb = rb[hit], at[hit]
    da, db = np.bincount(ca, minlength=len(grams)), np.bincount(cb, minlength=len(grams))
    work = da * db
    work[(da < 2) & (db < 2) if same else work == 0] = 0
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ra, ca, rb, cb = ra[oa], ca[oa], rb[ob], cb[ob]
    first = np.concatenate(([0], np.cumsum(db)))
    over = np.zeros(len(a) * len(b), np.int32)
    sparse = (work > 0) & (work < 4096)
    mine = np.flatnonzero(sparse[ca])
    # entries together make a million products at a time
    made = np.cumsum(db[ca[mine]]) >> 20
    for lo, hi in zip(*(lambda cut: (cut[:-1], cut[1:]))([0, *(np.flatnonzero(np.diff(made)) + 1), len(mine)])):
        e = mine[lo:hi]
        times = db[ca[e]]
        row = np.repeat(ra[e], times)
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        np.add.at(over, row * len(b) + rb[np.repeat(first[ca[e]], times) + inner], 1)
    over = over.reshape(len(a), len(b))
    dense = np.flatnonzero(work >= 4096)
    place = np.full(len(grams), -1, np.int64)
    for lo in range(0, len(dense), 1024):
        cols = dense[lo : lo + 1024]
        place[:] = -1
        place[cols] = np.arange(len(cols))
        left, right = np.zeros((len(a), len(cols)), np.float32), np.zeros((len(b), len(cols)), np.float32)
        for m, r, c in ((left, ra, ca), (right, rb, cb)):
            k = place[c]
            m[r[k >= 0], k[k >= 0]] = 1
        over += (left @ right.T).astype(np.int32)
    ok = np.stack([100 * row.astype(np.int64) >= percent * (n + nb - row) for row, n in zip(over, na)])
    if same:
        ok = np.triu(ok, 1)
    return np.nonzero(ok)


def forest(pairs_a: np.ndarray, pairs_b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links of one tile: it connects what they connect."""
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(pairs_a.tolist(), pairs_b.tolist()):
        u, v = find(x), find(y)
        if u != v:
            parent[max(u, v)] = min(u, v)
            out.append((x, y))
    return out


def set_key(grams: np.ndarray) -> int:
    """A 64-bit key of a whole set, signed."""
    k = int(np.bitwise_xor.reduce(mix(grams + _U(5)))) ^ (len(grams) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return k - (1 << 64) if k >> 63 else k


def join(docs: DataFrame, width: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: sets of `width`-word shingles link at Jaccard >= percent / 100.

    1. Texts with the same set are one class (a hash of the whole set), held by its smallest id.
    2. Every n-gram of the incidence matrix is counted over all sets. A set's columns are put in order, rare ones first;
       only its first ones (first_grams: a bound of its size) that another set has too can bring a partner, none is lost.
       Classes of one such column are linked to a first class, never expanded into pairs.
    3. Each class is multiplied with the one it shares most such columns with. Candidate groups that those links leave
       in several components meet in tiles of the blocked product, whose blocks are sorted by size so that tiles whose
       sizes rule a link out are not made, nor those of one component; a group of any size is dealt over as many tiles.
       A tile adds up whole overlaps, drops pairs below the bound of their sizes and hands on a spanning forest.
    4. Components of the links give each document the smallest doc_id it reaches.

    null text, empty text and text of white space only: n_shingles 0, linked with nothing (component_id is the own
    doc_id). Repeated rows come out as often as they come in; rows with a null id have a null component unless others reach them.
    Other columns are not looked at; an empty table gives no rows. Whole texts count, of any length. Words, n-grams and
    sets are told apart by 64-bit hashes.
    """
    known, classes, linked = _joined(docs, width, percent, key, text, block)
    labels = linked.join(classes.hint("merge"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = linked.join(labels.hint("merge"), "component").select("node", "component_id")
    of_class = classes.select("node", "rep").join(of_class.hint("merge"), "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    # a hot class has one row on the right, and Spark splits its rows on the left
    found = known.where("n_shingles > 0").join(of_class.hint("merge"), "node").select("doc_id", "n_shingles", "component_id")
    return found.union(known.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _joined(docs: DataFrame, width: int, percent: int, key: str, text: str, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, h, n_shingles, node) with a hash h of their text, classes (node, rep, h, n) and (node, component) of linked classes."""
    spark = docs.sparkSession
    raw = docs.select(F.col(text).cast("binary").alias("t"), F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("binary")).alias("h"))

    def sets(batches):
        start = TaskContext.get().partitionId() << 32
        for seq, slices in enumerate(chunked(batches, CHUNK_BYTES)):
            texts = [x for b in slices for x in b.column(0).to_pylist()]
            got = shingle_sets(texts, width)
            nodes = [set_key(g) if len(g) else None for g in got]
            held = [*{node: t for node, t in zip(nodes, texts) if node is not None}.values()]  # copies within a chunk are stored once
            listed = [[x for b in slices for x in b.column(i).to_pylist()] for i in (1, 2)] + [[len(g) for g in got], nodes]
            made = [pa.array([x], pa.list_(pa.int64())) for x in listed] + [pa.array([np.array([len(t) for t in held], np.int64).tobytes()], pa.binary()), pa.array([b"".join(held)], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([start + seq]), *made], ["chunk", "ids", "hs", "ns", "ks", "sizes", "texts"])

    own = materialise(raw.mapInArrow(tidied(sets), "chunk long, ids array<long>, hs array<long>, ns array<long>, ks array<long>, sizes binary, texts binary"), "sets")
    each_row = own.select(F.explode(F.arrays_zip("ids", "hs", "ns", "ks")).alias("r"))
    known = materialise(each_row.select(F.col("r.ids").alias("doc_id"), F.col("r.hs").alias("h"), F.col("r.ns").alias("n_shingles"), F.col("r.ks").alias("node")), "known")
    classes = materialise(known.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")), "classes")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    links = _links(own.select("chunk", "sizes", "texts"), classes, width, percent, block, max(tasks(spark), -(-size // PART_BYTES)))
    discard(own)
    linked = materialise(components(links), "components")
    discard(links)
    return known, classes, linked


def _stored(sizes: bytes, texts: bytes, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys and n-grams of the sets of a chunk, from its stored texts."""
    ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
    sets = shingle_sets([texts[i:j] for i, j in zip([0, *ends], ends)], width)
    return np.array([set_key(g) for g in sets], np.int64), sets


def _candidates(own: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """(a, b, agree): classes linked to the first class of a column that both have among their first n-grams, and how often."""

    def ask(batches):
        for chunk, *texts in each(batches):
            g, n = np.unique(np.concatenate([np.zeros(0, _U), *_stored(*texts, width)[1]]), return_counts=True)
            yield from packed([*asking(g, parts, chunk, ASK, n)])

    def total(batches):
        for _, rows in by_value(0, each(batches)):
            _, (n,), order, new = summed(rows[ASK], [5], numbers)
            told = np.empty(len(order), _U)
            told[order] = n[np.cumsum(new) - 1]
            yield from packed([*answers(rows[ASK], TOLD, told)])

    def firsts(batches):
        """(gram, node, low): of each column of a chunk its first class (low is null), and its other classes linked to that one."""
        for _, rows in by_value(1, each(batches)):
            nodes, sets = _stored(*rows[SETS][0][4:6], width)
            if not sets:
                continue
            sizes, g = np.array([len(x) for x in sets]), np.concatenate(sets)
            order = np.argsort(g)
            back = np.empty(len(g), np.int64)
            back[order] = np.cumsum(np.concatenate(([False], g[order][1:] != g[order][:-1])))
            df = joined(rows[TOLD], 4).astype(np.int64)[back]
            of = np.repeat(np.arange(len(nodes)), sizes)
            # the same order of columns everywhere: by how many sets have it, then by a hash
            rank = np.lexsort((mix(g), df, of))
            place = np.arange(len(g)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            take = rank[(place < np.repeat(first_grams(sizes, percent), sizes)) & (df[rank] > 1)]
            take = take[np.argsort(g[take], kind="stable")]
            s, n = g[take], nodes[of[take]]
            new = np.concatenate(([True], s[1:] != s[:-1]))[: len(s)]
            head = n[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
            for i in range(0, len(s), 1 << 16):
                j = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(s[j].view(np.int64)), pa.array(n[j]), pa.array(head[j], mask=new[j])], ["gram", "node", "low"])

    def starred(batches):
        """Classes of one column, linked to its first class; rows come sorted by column."""
        last_sig, last = None, None
        for b in batches:
            s, n = (b.column(k).to_numpy() for k in (0, 1))
            local = ~np.asarray(b.column(2).is_null())
            low = b.column(2).filter(pa.array(local)).to_numpy()
            out_a, out_b = [n[local]], [low]
            s, n = s[~local], n[~local]
            if len(s):
                new = np.concatenate(([s[0] != last_sig], s[1:] != s[:-1]))
                place = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
                head = np.where(place >= 0, n[np.maximum(place, 0)], last if last is not None else 0)
                out_a.append(n[~new])
                out_b.append(head[~new])
                last_sig, last = s[-1], head[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    told = own.mapInArrow(tidied(ask), ROWS_SQL).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(tidied(total), ROWS_SQL)
    told = materialise(told, "told")
    whole = own.select(F.lit(None).cast("int").alias("part"), "chunk", F.lit(SETS).alias("kind"), F.lit(0).alias("seq"), F.col("sizes").alias("x"), F.col("texts").alias("y"), F.lit(None).cast("binary").alias("z"))
    dealt = told.union(whole).repartition(parts, "chunk").sortWithinPartitions("chunk")
    columns = materialise(dealt.mapInArrow(tidied(firsts), "gram long, node long, low long"), "columns")
    discard(told)
    # a column has one row a chunk at most that is not linked yet, however many classes have it
    star = columns.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(tidied(starred), "a long, b long")
    star = materialise(star.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("agree")), "star")
    discard(columns)
    return star


def _links(own: DataFrame, classes: DataFrame, width: int, percent: int, block: int, wide: int) -> DataFrame:
    """(a, b): links between classes that connect what all links connect."""
    star = _candidates(own, width, percent, wide)
    bags = _bags(own, star, width)
    sure = materialise(_products(_towards(star, classes, block), bags, percent, wide), "sure")
    groups = _open(components(star), sure)
    discard(star)
    # blocks of a group by size: the place of a size in its group comes from sums by size, so no group is sorted in one task
    load, most = _load(), block * LOAD
    member = groups.join(classes.hint("merge"), "node")
    by_size = member.groupBy("grp", "n").agg(F.sum(load).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("grp").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = by_size.withColumn("before", before)
    span = F.floor((F.col("before") + F.col("c") - 1) / most) - F.floor(F.col("before") / most) + 1
    spread = member.join(starts.hint("merge"), ["grp", "n"]).withColumn("blk", (F.floor(F.col("before") / most) + F.pmod(F.xxhash64("node"), span)).cast("long"))
    spread = materialise(spread.select("node", "n", "grp", "comp", "blk"), "members")
    one = spread.groupBy("grp", "blk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    two = one.select("grp", *[F.col(c).alias(f"{c}_") for c in ("blk", "lo", "c1", "c2")])
    # a tile whose sets are linked with each other already has nothing to find
    fresh = (F.least("c1", "c1_") < F.greatest("c2", "c2_")) & (F.col("hi") * 100 >= F.col("lo_") * percent)
    tiles = one.join(two.hint("merge"), "grp").where((F.col("blk") <= F.col("blk_")) & fresh)
    ends = tiles.select("grp", F.explode(F.array_distinct(F.array("blk", "blk_"))).alias("at"), F.col("blk").alias("tile1"), F.col("blk_").alias("tile2")).withColumnRenamed("at", "blk")
    ends = materialise(ends, "tiles")
    placed = spread.join(ends.hint("merge"), ["grp", "blk"]).select("grp", "tile1", "tile2", "blk", "node")
    found = materialise(_products(placed, bags, percent, wide), "found")
    links = materialise(sure.union(found), "links")
    discard(groups, spread, ends, bags, sure, found)
    return links


def _bags(own: DataFrame, star: DataFrame, width: int) -> DataFrame:
    """(node, grams): the n-grams of each class that has a candidate."""

    def split(batches):
        for texts in each(batches):
            nodes, sets = _stored(*texts, width)
            for i in range(0, len(nodes), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 1000]), pa.array([g.tobytes() for g in sets[i : i + 1000]], pa.binary())], ["node", "grams"])

    some = materialise(star.select(F.col("a").alias("node")).union(star.select("b")).distinct(), "some")
    sets = own.select("sizes", "texts").mapInArrow(tidied(split), "node long, grams binary")
    bags = materialise(sets.join(some.hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "grams")
    discard(some)
    return bags


def _load() -> Column:
    """What a set of n n-grams takes in a tile."""
    return F.col("n") + 400


def _towards(star: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """Each class placed with the class that agrees with it on most signatures: one tile a block of such followers, by what their n-grams take."""
    best = star.groupBy("a").agg(F.max(F.struct("agree", "b")).alias("m")).select("a", F.col("m.b").alias("head"))
    best = best.join(classes.select(F.col("node").alias("a"), "n").hint("merge"), "a")
    tile = F.pmod(F.xxhash64("a", F.lit(3)), F.ceil(F.col("c") / (block * LOAD))).cast("long")
    at = best.join(best.groupBy("head").agg(F.sum(_load()).alias("c")).hint("merge"), "head").select("a", "head", tile.alias("tile"))
    two = F.lit(1).cast("long")
    led = at.select(F.col("head").alias("grp"), "tile", F.lit(0).cast("long").alias("blk"), F.col("head").alias("node")).distinct()
    both = led.union(at.select("head", "tile", two, "a"))
    return both.select("grp", (-1 - F.col("tile")).alias("tile1"), two.alias("tile2"), F.when(F.col("blk") == 0, -1 - F.col("tile")).otherwise(two).alias("blk"), "node")


def _open(candidates: DataFrame, sure: DataFrame) -> DataFrame:
    """(node, grp, comp) of candidate groups that the links found so far leave in more than one component."""
    found = materialise(components(sure), "partial").select("node", F.col("component").alias("comp"))
    at = candidates.withColumnRenamed("component", "grp").join(found.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    at = materialise(at, "groups")
    many = at.groupBy("grp").agg((F.min("comp") < F.max("comp")).alias("many")).where("many").select("grp")
    out = materialise(at.join(many.hint("merge"), "grp"), "open")
    discard(at, found)
    return out


def _products(placed: DataFrame, bags: DataFrame, percent: int, wide: int) -> DataFrame:
    """(a, b): links of the tiles (grp, tile1, tile2) of the blocked product, as a spanning forest a tile."""

    def run(batches):
        """Tiles of a task one after another, from rows sorted by tile."""
        now, sides = None, {}

        def close():
            a, b = sides.get(now[1], []), sides.get(now[2], [])
            pairs = []
            if a and b:
                i, j = product_links([x[1] for x in a], [x[1] for x in b], percent, now[1] == now[2])
                pairs = forest(np.array([x[0] for x in a], np.int64)[i], np.array([x[0] for x in b], np.int64)[j])
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            for k, (grp, t1, t2, blk, node) in enumerate(zip(*(b.column(c).to_pylist() for c in range(5)))):
                if (grp, t1, t2) != now:
                    if now is not None:
                        yield close()
                    now, sides = (grp, t1, t2), {}
                sides.setdefault(blk, []).append((node, np.frombuffer(b.column(5)[k].as_py(), _U)))
        if now is not None:
            yield close()

    full = placed.join(bags.hint("merge"), "node").select("grp", "tile1", "tile2", "blk", "node", "grams")
    dealt = full.repartition(wide, "grp", "tile1", "tile2").sortWithinPartitions("grp", "tile1", "tile2")
    return dealt.mapInArrow(tidied(run), "a long, b long")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs, one of each component: the smallest key's, rows without a key last, and of its texts that of the smallest
    hash. Of repeated rows of a key and text one stays, chosen by a hash of all columns. Rows without words all stay.
    """
    known, _, linked = _joined(docs, width, percent, key, text, BLOCK)
    rows = known.where("n_shingles > 0").join(linked.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    per = materialise(rows.groupBy("component", "doc_id", "h").agg(F.count("*").alias("copies")), "per")
    best = per.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("best"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("h") == F.col("best.h"))
    state = per.join(best.hint("merge"), "component").select(F.col("doc_id").alias("_id"), F.col("h").alias("_hash"), stays.alias("_stays"), "copies")
    state = materialise(state.where("not _stays or copies > 1").select("_id", "_hash", "_stays"), "state")
    # whole rows travel as one struct, so that no column of docs can clash
    wide = docs.select(F.struct(*docs.columns).alias("r"), F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text).cast("binary")).alias("hash"))
    # rows to drop are few columns wide on the right; a kept row that is repeated is reduced map-side first
    found = wide.join(state.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left").where("_stays is null or _stays")
    once = found.where("_stays is null").select("r.*")
    repeated = found.where("_stays").groupBy("_id", "_hash").agg(F.min_by("r", F.xxhash64("r")).alias("r"))
    return once.union(repeated.select("r.*"))
