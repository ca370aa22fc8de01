"""Best-fit packing of token sequences in hierarchical residual rounds."""

from __future__ import annotations

import bisect
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conformix.llm.common import materialise, tasks, tidied

SEQUENCE = 2048
#: A bin with at most this much room left is finished in the round that makes it.
NEARLY_FULL = 8
#: Most bins of one task of a merge round.
MERGE_BINS = 50_000

#: Text whose tokens a word cache gives exactly: ASCII without odd controls, and composed Latin-1 letters.
PLAIN = re.compile("[\t\n\v\f\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: The tokenizer's own split of such text (fixed pattern of the tokenizer file, its letter and digit classes written out).
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


class WordIds(dict):
    """Ids of words as little-endian unsigned 32-bit bytes; a word goes through the tokenizer's model when first asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenize = tokenizer.model.tokenize
        # the spelling that the model gets for letters beyond ASCII, as the tokenizer's own first step gives it
        self.spelling = {c: tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}

    def __missing__(self, word: str) -> bytes:
        ids = [x.id for x in self.tokenize(word if word.isascii() else word.translate(self.spelling))]
        self[word] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out


class WordTokens:
    """Ids of whole texts as bytes, word by word; texts outside PLAIN, or that spell a special token, go through the whole
    tokenizer as they are."""

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.cache = WordIds(self.tokenizer)

    def encode(self, text: str) -> bytes:
        if "<|" in text or not PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.cache) > self.limit:
            self.cache.clear()
        return b"".join(map(self.cache.__getitem__, WORDS.findall(text.lower())))


_kept: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The tokenizer and its word cache, kept while the worker process lives."""
    if path not in _kept:
        _kept[path] = WordTokens(path)
    return _kept[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as tokens and a closing 0, cut only beyond `size`."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = word_tokens(path or tokenizer_path())
        for b in batches:
            rows: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = tok.encode(t.as_py() or "") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((i, k, k * size, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(tidied(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(fills: np.ndarray, size: int) -> list[list[int]]:
    """Bins of the items' positions: largest first, each into the fullest bin that has room for it."""
    order = np.argsort(-fills, kind="stable")
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # those with bins, in order
    bins: list[list[int]] = []
    for i in order:
        n = int(fills[i])
        at = bisect.bisect_left(rooms, n)
        if at == len(rooms):
            bins.append([i])
            room, k = size - n, len(bins) - 1
        else:
            old = rooms[at]
            k = by_room[old].pop()
            if not by_room[old]:
                del by_room[old], rooms[at]
            bins[k].append(i)
            room = old - n
        if room:
            if room not in by_room:
                by_room[room] = []
                bisect.insort(rooms, room)
            by_room[room].append(k)
    return bins


ITEM = "struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>"


def pack(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, nearly: int = NEARLY_FULL, merge_bins: int = MERGE_BINS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): pieces packed into sequences of at most `size` tokens.

    Round by round: each task packs its items best-fit, largest first, and emits bins with at most `nearly` room (or none
    that the smallest item left could use); the underfull bins are the next round's items, over a quarter as many tasks.
    A task never takes more than about merge_bins bins; the rounds end when one task, or no better packing, is left.

    null and empty texts are one token (the closing 0); repeated rows are packed as often as they come; a document is
    never cut unless it is longer than `size`; an empty table gives no rows. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    items = materialise(pieces(docs, path, size), "pieces")
    schema = f"fill long, items array<{ITEM}>, done boolean"
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        rows: list[tuple] = []
        for b in batches:
            rows += zip(b.column(0).to_pylist(), b.column(1))
        if not rows:
            return
        # the order within a task does not depend on the order of its input
        rows.sort(key=lambda r: (-r[0], r[1][0].as_py()["doc_id"] or 0, r[1][0].as_py()["piece"]))
        fills = np.array([r[0] for r in rows])
        least, out = int(fills.min()), []
        for members in best_fit(fills, size):
            fill = int(fills[members].sum())
            out.append((fill, pa.concat_arrays([rows[i][1].values for i in members]), size - fill <= nearly or size - fill < least))
        for start in range(0, len(out), 4096):
            part = out[start : start + 4096]
            lens = np.concatenate(([0], np.cumsum([len(x[1]) for x in part])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.concat_arrays([x[1] for x in part])), pa.array([x[2] for x in part])], ["fill", "items", "done"])

    full = items.where(F.col("length") == size)
    whole = full.select(F.col("length").alias("fill"), F.array(F.struct(*names)).alias("items"))
    rest = items.where(F.col("length") < size).select(F.col("length").alias("fill"), F.array(F.struct(*names)).alias("items"))
    count = rest.count()
    finished = [whole]
    parts = max(1, min(tasks(spark), -(-count // 2000)), -(-count // merge_bins))
    while count:
        spread = F.xxhash64(F.element_at("items", 1)["doc_id"], F.element_at("items", 1)["piece"], F.lit(parts))
        now = rest.withColumn("_s", F.pmod(spread, F.lit(parts * 8))).repartition(parts, "_s").select("fill", "items").mapInArrow(tidied(run), schema)
        now = materialise(now, "bins")
        finished.append(now.where("done").select("fill", "items"))
        rest = now.where("not done").select("fill", "items")
        left = rest.count()
        fewer = max(1, -(-parts // 4), -(-left // merge_bins))
        if parts == 1 or (left >= 0.98 * count and fewer >= parts):
            finished.append(rest)
            break
        parts, count = fewer, left
    bins = finished[0]
    for x in finished[1:]:
        bins = bins.union(x)
    bins = materialise(bins.select("items"), "sequences")
    cut = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "items").select("sequence_id", "items", F.posexplode("items").alias("_k", "_i"))
    offset = F.coalesce(F.aggregate(F.slice("items", F.lit(1), F.col("_k")), F.lit(0).cast("long"), lambda a, x: a + x["length"]), F.lit(0).cast("long"))
    return cut.select("_i.*", "sequence_id", offset.alias("offset"))
