"""Ranked lexical search: documents are scanned by an automaton of all items' terms; there is no document index."""

from __future__ import annotations

import heapq
import math
import uuid
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conformix.llm.common import chunks, materialise

#: Items and bytes of their texts that one automaton takes; more items make more automata, each of which scans all documents.
ITEMS, ITEM_BYTES = 4096, 1 << 20
#: Documents that are scored at once, and most scores (documents times items) among them.
DOCS, SCORES = 256, 1 << 20

# what stands between terms becomes the guard, A-Z become small; bytes from 0x80 on belong to terms
GUARD = b" "
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else GUARD[0] for c in range(256))


def folded(text: bytes) -> bytes:
    """The text with one guard for each byte between terms, and one at either end."""
    return GUARD + text.translate(_FOLD) + GUARD


@dataclass
class Items:
    """One automaton's items: their ids, all their distinct terms, and for each term the items that hold it, how often."""

    ids: list
    terms: list[bytes]
    first: np.ndarray  # of term t: entries first[t] to first[t + 1] of
    item: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, texts: list[tuple[object, bytes]]) -> Items:
        counts: dict[bytes, dict[int, int]] = {}
        for i, (_, text) in enumerate(texts):
            for term in folded(text).split():
                held = counts.setdefault(term, {})
                held[i] = held.get(i, 0) + 1
        terms = sorted(counts)
        sizes = [len(counts[t]) for t in terms]
        flat = [x for t in terms for x in counts[t].items()]
        item, times = (np.array([x[j] for x in flat], np.int64) for j in (0, 1))
        return cls([i for i, _ in texts], terms, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), item, times)

    def automaton(self) -> ahocorasick.Automaton:
        """Terms between guards, as the bytes of UTF-8; the end of a term is the end of its match, never inside a longer one."""
        a = ahocorasick.Automaton()
        for i, t in enumerate(self.terms):
            a.add_word((GUARD + t + GUARD).decode("latin-1"), i)
        if self.terms:
            a.make_automaton()
        return a


def count_terms(automaton, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Terms of a whole text with repeats, and which of the automaton's terms occur how often."""
    t = folded(text)
    is_guard = np.frombuffer(t, np.uint8) == GUARD[0]
    n = int((is_guard[:-1] & ~is_guard[1:]).sum())
    hits = np.fromiter((i for _, i in automaton.iter(t.decode("latin-1"))), np.int64) if n and len(automaton) else np.zeros(0, np.int64)
    terms, tf = np.unique(hits, return_counts=True)
    return n, terms, tf


_built: dict[str, object] = {}


def _of_worker(token: str, items: Items):
    """The automaton, built once in a worker process."""
    if token not in _built:
        _built.clear()
        _built[token] = items.automaton()
    return _built[token]


def _statistics(held, token: str):
    """Task function: documents with a term and all their terms (term -1), and for each term the documents that hold it."""

    def run(batches):
        items = held.value
        automaton, df, docs, total = _of_worker(token, items), np.zeros(len(items.terms), np.int64), 0, 0
        for _, texts in chunks(batches):
            for text in texts:
                if text:
                    n, terms, _ = count_terms(automaton, text)
                    docs, total = docs + (n > 0), total + n
                    df[terms] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([docs, *df[at]], pa.int64()), pa.array([total, *[0] * len(at)], pa.int64())], ["term", "docs", "total"])

    return run


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Best:
    """The k highest scores of every item with their documents; equal scores by ascending id, null ids last."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps, self.floor = k, [[] for _ in range(n)], np.ones(n, np.int64)

    def add(self, ids: list, scores: np.ndarray) -> None:
        """scores: documents times items."""
        least = self.floor
        if len(ids) > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=0)[-self.k])
        for d, i in zip(*(x.tolist() for x in np.nonzero(scores >= least))):
            heap, entry = self.heaps[i], (int(scores[d, i]), ids[d] is None, ids[d])
            key = (entry[0], not entry[1], 0 if entry[1] else -ids[d])
            if len(heap) < self.k:
                heapq.heappush(heap, (key, ids[d]))
            elif key > heap[0][0]:
                heapq.heapreplace(heap, (key, ids[d]))
            if len(heap) == self.k:
                self.floor[i] = max(1, heap[0][0][0])


def _scores(held, weight: np.ndarray, docs: int, total: int, token: str, k: int):
    """Task function: scans its documents again and hands on each item's k best of them."""

    def run(batches):
        items = held.value
        automaton, many = _of_worker(token, items), len(items.ids)
        best, step = Best(many, k), max(1, min(DOCS, SCORES // max(1, many)))
        sizes = np.diff(items.first)
        for ids, texts in chunks(batches):
            for at in range(0, len(ids), step):
                scores = np.zeros(min(step, len(ids) - at) * many, np.int64)
                for d, text in enumerate(texts[at : at + step]):
                    n, terms, tf = count_terms(automaton, text) if text else (0, np.zeros(0, np.int64), None)
                    if not len(terms):
                        continue
                    m = 100 - 75 + 75 * n * docs // total
                    x = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                    # from terms to the entries of their items
                    entry = np.repeat(items.first[terms] - np.cumsum(sizes[terms]) + sizes[terms], sizes[terms]) + np.arange(sizes[terms].sum())
                    np.add.at(scores, d * many + items.item[entry], np.repeat(x, sizes[terms]) * items.times[entry])
                best.add(ids[at : at + step], scores.reshape(-1, many))
        rows = [(i, doc, key[0]) for i, heap in enumerate(best.heaps) for key, doc in heap]
        cols = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["place", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0.

    Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. An automaton of all items' terms, each
    between guards, goes to the tasks (ITEMS items or ITEM_BYTES bytes of them at most; more items make more automata).
    A first scan of the whole texts counts documents, terms and document frequencies, a second one scores: what the
    automaton finds is mapped to the items that hold the term. Each task hands on k documents an item. All scores are
    64-bit integers; only a term's weight, floor(1000 * ln(...)), is taken in doubles.

    Nulls: a null or empty text has no terms and counts nowhere; a null doc_id is ranked, behind others of its score.
    Rows that share an item_id (null is one too) are one item with the terms of their distinct texts. Repeated documents
    count and rank one each. No item, no document or no common term: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_key).cast("long").alias("id"), F.col(doc_text).cast("binary").alias("t"))
    wanted = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).cast("binary").alias("t")).where("t IS NOT NULL").distinct()
    count, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    blocks = max(1, -(-count // ITEMS), -(-size // ITEM_BYTES))
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    parts = []
    for block in range(blocks):
        own: dict = {}
        for r in wanted.where(F.col("block") == block).orderBy("item_id", "t").select("item_id", "t").collect():
            own.setdefault(r["item_id"], []).append(bytes(r["t"]))
        one = Items.of([(i, GUARD.join(ts)) for i, ts in own.items()])
        if not one.terms:
            continue
        held = spark.sparkContext.broadcast(one)
        token = uuid.uuid4().hex
        counted = texts.mapInArrow(_statistics(held, token), "term int, docs long, total long")
        # a row for each term of the automaton
        found = {r["term"]: (r["d"], r["n"]) for r in materialise(counted.groupBy("term").agg(F.sum("docs").alias("d"), F.sum("total").alias("n")), "frequencies").collect()}
        n_docs, total = found.pop(-1, (0, 0))
        df = np.array([found.get(t, (0, 0))[0] for t in range(len(one.terms))], np.int64)
        scored = texts.mapInArrow(_scores(held, weights(df, n_docs), n_docs, max(1, total), token, k), "place int, doc_id long, score long")
        scored = materialise(scored, "scores")
        names = spark.createDataFrame([(p, i) for p, i in enumerate(one.ids)], "place int, item_id long")
        parts.append(scored.join(F.broadcast(names), "place").drop("place"))  # ITEMS rows at most
    out = spark.createDataFrame([], "doc_id long, score long, item_id long")
    for p in parts:
        out = out.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item_id").alias(item_key), "rank", "doc_id", "score")
