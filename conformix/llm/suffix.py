"""Removal of repeated byte strings by column-wise construction over many texts at once."""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conformix.llm.common import chunks, discard, materialise, PrefixHash, tasks, tidied

_U = np.uint64
#: Length of the repeated strings, and of the grams among which their anchors are chosen.
LENGTH, GRAM = 400, 64
#: Most distinct contexts of one anchor that one construction takes; larger groups are split by their content.
GROUP = 32_768
#: Contexts that one construction takes at most besides.
RUN = 49_152
PAD = 255  # no byte of UTF-8


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions): of each window of `length` bytes the first of its grams with the smallest hash.

    The choice depends on the window's bytes alone, so equal windows have equal anchors at equal places.
    """
    n = len(data)
    if n < length:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    piece = 1 << 20
    if n > piece:
        got = [(h, p + at) for at in range(0, n - length + 1, piece - length + 1) for h, p in [anchors(data[at : at + piece], length, gram)]]
        h, p = (np.concatenate(x) for x in zip(*got))
        p, first = np.unique(p, return_index=True)
        return h[first], p
    ph, starts = PrefixHash(data), np.arange(n - gram + 1)
    h = ph.of(starts, starts + gram)
    low = (h & ~_U((1 << 20) - 1)) | starts.astype(_U)
    span, width = 1, length - gram + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    p = (low & _U((1 << 20) - 1)).astype(np.int64)
    p = p[np.concatenate(([True], p[1:] != p[:-1]))]
    return h[p], p


def construct(contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(lo, hi): the first and last place at which each context has a `length`-byte string that another one has there too;
    lo > hi if there is none.

    Column-wise, from the last column to the first, one symbol of every context is inserted a round: a stable sort by the
    new symbols turns the order of the suffixes into the next one (the permutation that the transform of the collection
    stands for), and common prefixes of neighbours follow from the smallest of the old ones between them. The columns are
    read one after another from a sequential external file.
    """
    n, wide = len(contexts), max(map(len, contexts))
    lo, hi = np.full(n, wide, np.int64), np.full(n, -1, np.int64)
    with tempfile.TemporaryFile() as file:
        block = np.full((n, wide), PAD, np.uint8)
        for i, c in enumerate(contexts):
            block[i, : len(c)] = np.frombuffer(c, np.uint8)
        np.ascontiguousarray(block.T[::-1]).tofile(file)
        del block
        file.seek(0)
        order = np.arange(n)
        common = np.zeros(n + 1, np.int32)
        for column in range(wide - 1, -1, -1):
            symbols = np.fromfile(file, np.uint8, n)[order]
            step = np.argsort(symbols, kind="stable")
            after = symbols[step]
            same = np.flatnonzero((after[1:] == after[:-1]) & (after[1:] != PAD))
            ends = np.empty(2 * len(same), np.int64)
            ends[0::2], ends[1::2] = step[same] + 1, step[same + 1] + 1
            new = np.zeros(n + 1, np.int32)
            if len(same):
                new[same + 1] = np.minimum.reduceat(common, ends)[0::2] + 1
            order, common = order[step], new
            if column <= wide - length:
                at = np.flatnonzero(common >= length)
                if len(at):
                    found = np.concatenate((order[at], order[at - 1]))
                    lo[found] = column
                    hi[found] = np.maximum(hi[found], column)
    return lo, hi


def _digest(*parts: bytes) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(p)
    return h.digest()


def valid_range(ctx: bytes, length: int) -> tuple[int, int]:
    body = ctx.lstrip(b"\xff")
    left = len(ctx) - len(body)
    return left, left + len(body.rstrip(b"\xff")) - length


ENTRY = "id binary, key binary, m long, o1 int, width int, ctx binary"


def _solve(entries: DataFrame, length: int, group: int, level: int = 0) -> DataFrame:
    """(id, lo, hi): places (from the anchor) of the repeated strings of distinct contexts, by anchor group.

    Groups of up to `group` contexts are constructed as they are. A larger one is halved by the place of the string: a half
    joins its common core to the key and cuts its contexts to what its places need; equal contexts become one entry with
    a count. At a single place the context is the string itself and the count decides, so groups of any size end.
    """
    spark = entries.sparkSession
    sizes = materialise(entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "sizes")
    n_hot = sizes.where(F.col("c") > group).count()
    small = entries.join(sizes.where(F.col("c") <= group).select("key").hint("merge"), "key")
    parts = max(tasks(spark), sizes.agg(F.coalesce(F.sum(F.least("c", F.lit(group))), F.lit(0))).first()[0] // 20_000)

    def run(batches):
        held: list[tuple] = []

        def build():
            lo, hi = construct([x[2] for x in held], length)
            ok = np.flatnonzero(hi >= lo)
            return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in ok], pa.binary()), pa.array([held[i][3] + int(lo[i]) for i in ok], pa.int32()), pa.array([held[i][3] + int(hi[i]) for i in ok], pa.int32())], ["id", "lo", "hi"])

        last = None
        for b in batches:
            for x in zip(*(b.column(k).to_pylist() for k in range(4))):  # id, key, ctx, o1
                if held and (x[3] != last[1] or x[1] != last[0] and len(held) >= RUN - group):
                    yield build()
                    held = []
                held.append(x)
                last = (x[1], x[3])
        if held:
            yield build()

    dealt = small.select("id", "key", "ctx", "o1").repartition(parts, "key").sortWithinPartitions("o1", "key")
    found = dealt.mapInArrow(tidied(run), "id binary, lo int, hi int")
    if not n_hot:
        return found
    found = materialise(found, "found")
    hot = entries.join(sizes.where(F.col("c") > group).select("key").hint("broadcast") if n_hot < 100_000 else sizes.where(F.col("c") > group).select("key").hint("merge"), "key")

    def halve(batches):
        for b in batches:
            rows = []
            for pid, key, m, o1, width, ctx in zip(*(b.column(k).to_pylist() for k in range(6))):
                mid = width // 2
                for a, w in ((0, mid), (mid + 1, width - mid - 1)) if width else ():
                    part = ctx[a : a + w + length]
                    left, right = valid_range(part, length)
                    if right >= left:
                        core = part[w:length]
                        k = _digest(key, bytes([a > 0]), core)
                        rows.append((pid, _digest(k, part), k, m, o1 + a, w, part))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["pid", "id", "key", "m", "o1", "width", "ctx"])

    cut = materialise(hot.select("id", "key", "m", "o1", "width", "ctx").mapInArrow(tidied(halve), "pid binary, " + ENTRY), "halves")
    one = materialise(cut.groupBy("id").agg(F.first("key").alias("key"), F.sum("m").alias("m"), F.first("o1").alias("o1"), F.first("width").alias("width"), F.first("ctx").alias("ctx")), "entries")
    below = _solve(one, length, group, level + 1).union(_whole(one, length))
    back = cut.select("pid", "id").join(below.groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).hint("merge"), "id")
    return found.union(back.select(F.col("pid").alias("id"), "lo", "hi"))


def _whole(entries: DataFrame, length: int) -> DataFrame:
    """Contexts that occur more than once: all their strings are repeated."""

    def run(batches):
        for b in batches:
            rows = [(i, o1 + v[0], o1 + v[1]) for i, o1, c in zip(*(b.column(k).to_pylist() for k in range(3))) for v in [valid_range(c, length)] if v[1] >= v[0]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int32(), pa.int32()))], ["id", "lo", "hi"])

    return entries.where("m > 1").select("id", "o1", "ctx").mapInArrow(tidied(run), "id binary, lo int, hi int")


def repeated_spans(docs: DataFrame, key: str, text: str, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(_row, spans): for each text that has any, byte ranges covered by strings of `length` bytes that also start elsewhere."""
    reach = length - gram  # a string starts at most so far before its anchor
    rows = docs.select(F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("_row"), F.col(text).cast("binary").alias("t"))

    def find(batches):
        for ids, texts in chunks(batches, limit=4 << 20):
            got = [(i, *anchors(np.frombuffer(t, np.uint8), length, gram)) for i, t in zip(ids, texts) if t is not None and len(t) >= length]
            if got:
                sizes = [len(x[1]) for x in got]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[1] for x in got]).view(np.int64)), pa.array(np.repeat(np.array([x[0] for x in got], np.int64), sizes)), pa.array(np.concatenate([x[2] for x in got]).astype(np.int32))], ["h", "_row", "pos"])

    marks = materialise(rows.mapInArrow(tidied(find), "h long, _row long, pos int"), "anchors")
    repeated = materialise(marks.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "repeated")
    # sides that grow with the texts are never broadcast, at any size
    places = marks.join(repeated.hint("merge"), "h").groupBy("_row").agg(F.collect_set("pos").alias("at"))
    places = materialise(places, "places")
    discard(marks)

    def cut(batches):
        for b in batches:
            for start in range(0, b.num_rows, 32):
                part = b.slice(start, 32)
                out = []
                for row, t, at in zip(*(part.column(k).to_pylist() for k in range(3))):
                    for p in at:
                        ctx = b"\xff" * max(reach - p, 0) + t[max(p - reach, 0) : p + length]
                        ctx += b"\xff" * (reach + length - len(ctx))
                        anchor = _digest(ctx[reach : reach + gram])
                        out.append((_digest(anchor, ctx), anchor, row, p, ctx))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary()))], ["id", "key", "_row", "pos", "ctx"])

    held = rows.join(places.hint("merge"), "_row").select("_row", "t", "at")
    seen = materialise(held.mapInArrow(tidied(cut), "id binary, key binary, _row long, pos int, ctx binary"), "contexts")
    one = seen.groupBy("id").agg(F.first("key").alias("key"), F.count("*").alias("m"), F.first("ctx").alias("ctx"))
    one = materialise(one.select("id", "key", "m", F.lit(-reach).alias("o1"), F.lit(reach).alias("width"), "ctx"), "entries")
    found = materialise(_solve(one, length, group).union(_whole(one, length)).groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "results")
    # contexts that hold a thousandth of all places, so a thousand at most, are broadcast; no hot one meets its places in a task
    hot = materialise(one.where(F.col("m") * 1000 >= seen.count()).select("id"), "hot")
    at = seen.select("id", "_row", "pos")
    often, rest = F.broadcast(hot.join(found.hint("merge"), "id")), at.join(F.broadcast(hot), "id", "left_anti")
    met = at.join(often, "id").union(rest.join(found.hint("merge"), "id").select("id", "_row", "pos", "lo", "hi"))
    spans = met.select("_row", F.struct((F.col("pos") + F.col("lo")).alias("s"), (F.col("pos") + F.col("hi") + length).alias("e")).alias("x"))
    out = materialise(spans.groupBy("_row").agg(F.array_sort(F.collect_set("x")).alias("spans")), "spans")
    discard(seen, one, found, places, repeated, hot)
    return out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP, keep: list[str] | None = None) -> DataFrame:
    """Rows of docs (columns `keep`, all by default) with n_bytes, n_removed, n_spans, kept_sha256 and kept (binary).

    Bytes covered by a string of `length` bytes that starts at two places or more (of any texts, the same one included)
    are removed; strings are judged on the input. Exact: a repeated string has the same anchor gram at the same place
    in all its copies; anchors that occur once are dropped by a count; the contexts of the others, collapsed to distinct
    ones, go through construct(), group by group, which compares bytes.

    null text counts as empty: 0 bytes, nothing removed, the hash of nothing, kept null. Texts shorter than `length`
    stay whole; longer ones are read in whole, of any length; repeated rows are places of their own; a null key is a value
    like others; rows are told apart by a 64-bit hash of key and text; an empty table gives no rows; columns with the names of the new
    ones are replaced.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    spans = repeated_spans(docs, key, text, length, gram, group)
    wide = docs.select(F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("_row"), F.col(text).cast("binary").alias("_t"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    names = [f"k{i}" for i in range(len(keep))]
    wide = wide.join(spans.hint("merge"), "_row", "left").select("_t", "spans", *names)
    schema = T.StructType([wide.schema[c] for c in names] + [T.StructField(n, t) for n, t in zip(new, (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BinaryType()))])

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 128):
                part = b.slice(start, 128)
                out = []
                for t, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    left, at, gone, runs, end = [], 0, 0, 0, -1
                    for x in found or ():
                        s, e = x["s"], x["e"]
                        if s > end:
                            left.append(t[at:s])
                            runs += 1
                            gone += e - s
                            end = e
                        elif e > end:
                            gone += e - end
                            end = e
                        at = end
                    rest = None if t is None else t if not found else b"".join(left) + t[at:]
                    out.append((len(t or b""), gone, runs, hashlib.sha256(rest or b"").hexdigest(), rest))
                yield pa.RecordBatch.from_arrays([*part.columns[2:], *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], [*names, *new])

    return wide.mapInArrow(tidied(run), schema).select(*[F.col(n).alias(c) for n, c in zip(names, keep)], *new)


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with each text as what dedup() leaves of it; a character cut in two by a span's edge goes with it."""

    columns = docs.columns

    def decode(batches):
        for b in batches:
            kept = [None if x is None else x.decode("utf-8", "ignore") for x in b.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if c == text else b.column(c) for c in columns], columns)

    others = [c for c in docs.columns if c != text]
    return dedup(docs, text=text, length=length, keep=others).mapInArrow(tidied(decode), docs.schema)
