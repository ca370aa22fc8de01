"""Katz backoff language model: Good-Turing discounted bigrams and trigrams, exactly normalised backoff weights, partitioned tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conformix.llm.common import discard, materialise, mix, tasks, words_of
from conformix.llm.exchange import ROWS, ROWS_SQL, answers, asking, by_value, chunked, cut, each, floats, joined, keys_of, numbers, packed, part_of, planes, rising, row, summed

_U = np.uint64
#: Text bytes of which one part of the tables holds the n-grams, and of which a task sends them on together.
PART_BYTES, CHUNK_BYTES = 6 << 20, 4 << 20
#: Kinds: tables of bigrams and words, what chunks ask or tell about either, what parts answer, a chunk itself, totals of a part.
BIGRAMS, WORDS, ASK_BIGRAMS, ASK_WORDS, MASSES, OF_BIGRAMS, OF_WORDS, CHUNK, COUNTS, SIZES, TRIGRAMS, ASK_TRIGRAMS, OF_TRIGRAMS = range(13)
#: Slices of the keys' range in which trigrams travel one after the other, so that the disk holds the shuffle of one at a time.
SLICES = 4
#: Counts up to this are discounted.
DISCOUNT_TO = 5
#: Keys of the closing token and of the place before the first word; no word hashes to them but by chance.
END, START = _U(1), _U(2)


def bigram_keys(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Keys of words or bigrams `first` followed by words `last`."""
    return mix(first * _U(0x9FB21C651E98DF25) + mix(last))


def sequences(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of whole texts one after another (their words, then one end) and the number of each text's tokens."""
    words, owner = words_of(texts)
    n = len(texts)
    token = np.full(len(words) + n, END)
    token[np.arange(len(words)) + owner] = words
    return token, np.bincount(owner, minlength=n) + 1


def repeated(x: np.ndarray) -> bytes:
    """Complex numbers of which few differ: those, and the place of each."""
    values, at = np.unique(x, return_inverse=True)
    return len(values).to_bytes(8, "little") + values.astype("<c16").tobytes() + planes(at.astype(_U))


def repeats(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    return np.frombuffer(x, "<c16", n, 8)[numbers(x[8 + 16 * n :]).astype(np.int64)]


def discounts(counts: dict[int, int], top: int = DISCOUNT_TO) -> dict[int, float]:
    """Katz's discount ratios d_r, r <= top, from counts of counts; a ratio that sparse counts put outside (0, 1] is 1."""
    n = lambda r: counts.get(r, 0)
    out = {}
    a = (top + 1) * n(top + 1) / n(1) if n(1) else 1.0
    for r in range(1, top + 1):
        star = (r + 1) * n(r + 1) / n(r) if n(r) else 0.0
        d = (star / r - a) / (1 - a) if a < 1 else 1.0
        out[r] = d if 0 < d <= 1 else 1.0
    return out


def discounted(ratios: list[float], n: np.ndarray) -> np.ndarray:
    return np.take(ratios, np.minimum(n, DISCOUNT_TO + 1)) * n


class Chunk:
    """Tokens of a chunk of texts as places in the ordered list of its words (START included), and its bigrams by their keys."""

    def __init__(self, words: bytes, token: bytes, sizes: bytes):
        self.words, self.token, self.sizes = keys_of(words), numbers(token).astype(np.int64), numbers(sizes).astype(np.int64)

    def bigram_of_each(self) -> np.ndarray:
        """The key of every token's bigram."""
        self.history = np.roll(self.token, 1)
        self.history[np.cumsum(self.sizes) - self.sizes] = np.searchsorted(self.words, START)
        return bigram_keys(self.words[self.history], self.words[self.token])

    def pair(self) -> Chunk:
        key = self.bigram_of_each()
        self.order = np.argsort(key)
        key = key[self.order]
        self.new = np.concatenate(([True], key[1:] != key[:-1]))
        self.first = np.flatnonzero(self.new)
        self.keys = key[self.first]
        return self

    def trigram_of_each(self, bigram: np.ndarray) -> np.ndarray:
        """The key of every token's trigram: the bigram before it, and the token. A text's first token has none; `third` are the others."""
        later = np.ones(len(self.token), bool)
        later[np.cumsum(self.sizes) - self.sizes] = False
        self.third = np.flatnonzero(later)
        return bigram_keys(bigram[self.third - 1], self.words[self.token[self.third]])

    def triple(self) -> Chunk:
        """Trigrams of pair() by their keys; `place` are the bigrams of tokens among keys, `before` those before the tokens of `third`."""
        self.place = np.empty(len(self.token), np.int64)
        self.place[self.order] = np.cumsum(self.new) - 1
        key = self.trigram_of_each(self.keys[self.place])
        self.before = self.place[self.third - 1]
        self.order3 = np.argsort(key)
        key = key[self.order3]
        self.new3 = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
        self.first3 = np.flatnonzero(self.new3)
        return self

    def ask_slice(self, i: int, parts: int, chunk: int, counted: bool):
        """asking() for the trigrams of slice i; only those are put in order."""
        key = self.trigram_of_each(self.bigram_of_each())
        part = part_of(key, parts)
        keys, n = np.unique(key[(part >= parts * i // SLICES) & (part < parts * (i + 1) // SLICES)], return_counts=True)
        for r in asking(keys, parts, chunk, ASK_TRIGRAMS, n if counted else None):
            yield (*r[:3], r[3] + (i << 22), *r[4:])


def _own(batches, limit: int):
    """One row a chunk: its words, tokens and sizes, and its kept columns."""
    start = TaskContext.get().partitionId() << 32
    for seq, slices in enumerate(chunked(batches, limit)):
        token, sizes = sequences([x for b in slices for x in b.column(0).to_pylist()])
        words, token = np.unique(np.append(token, START), return_inverse=True)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema(list(slices[0].schema)[1:])) as out:
            for b in slices:
                out.write_batch(b.select(b.schema.names[1:]))
        made = [[start + seq], [rising(words)], [planes(token[:-1])], [planes(sizes)], [sink.getvalue().to_pybytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if i == 0 else pa.binary()) for i, v in enumerate(made)], ["chunk", "words", "token", "sizes", "kept"])


OWN_SQL = "chunk long, words binary, token binary, sizes binary, kept binary"


@dataclass
class Totals:
    """Tokens N, distinct tokens V, and discount ratios by count (from 0 to one beyond the last that is discounted)."""

    tokens: int
    types: int
    ratios: list[float]

    def low(self, c):
        """Base probability of a word that was seen c times."""
        return (c + 1) / (self.tokens + self.types + 1)

    def discounted(self, n):
        return discounted(self.ratios, n)


@dataclass
class Katz:
    """A fitted model as tables in the shared folder, over `parts` parts of the keys' range: bigrams(part, seq, x: keys in
    order, y: counts) and words(part, seq, x: keys in order, y: counts c(w), z: totals c(h) as history and log10 alpha(h)).

    P(w | h) = d(n) n / c(h) for a bigram that was seen n times, else alpha(h) P(w), or P(w) if nothing was seen after h;
    P(w) = (c + 1) / (N + V + 1), unknown words included.

    With order 3 the bigrams have z as well, and trigrams(part, seq, x, y) are stored by slices: P(w | u v) = d(n) n / c(u v) for a trigram that was seen
    n times, else alpha(u v) P(w | v). z holds what alpha(u v) is made of, over the words seen after u v: the sum of the trigrams' discounted
    counts, and of the bigrams' discounted counts of v and those words.
    """

    bigrams: DataFrame
    words: DataFrame
    parts: int
    totals: Totals
    trigrams: list[DataFrame] | None = None
    ratios: list[float] | None = None


def _rows(df: DataFrame, kind: int) -> DataFrame:
    """A table of blobs in the form of rows on their way."""
    have = set(df.columns)
    return df.select(*[F.lit(kind).alias(f.name) if f.name == "kind" else F.col(f.name) if f.name in have else F.lit(None).cast({"part": "int", "chunk": "long", "seq": "int"}.get(f.name, "binary")).alias(f.name) for f in ROWS])


def _whole(own: DataFrame, kept: bool) -> DataFrame:
    """Chunks in the form of rows on their way; kept columns travel in a row of their own (seq 1)."""
    chunk = own.select(F.lit(None).cast("int").alias("part"), "chunk", F.lit(CHUNK).alias("kind"), F.lit(0).alias("seq"), F.col("words").alias("x"), F.col("token").alias("y"), F.col("sizes").alias("z"))
    if not kept:
        return chunk
    null = F.lit(None).cast("binary")
    return chunk.union(own.select(F.lit(None).cast("int"), "chunk", F.lit(CHUNK), F.lit(1), "kept", null, null))


def _told(asked: list[tuple], kind: int, table: int, part: int):
    """What a part makes of the counts that chunks sent: its counts of counts, its table, and for each chunk twice the sum, and one if it accounts for the n-gram."""
    keys, (n,), order, new = summed(asked, [5], numbers)
    told = np.empty(len(order), _U)
    told[order] = (2 * n)[np.cumsum(new) - 1] + new.astype(_U)
    top = np.bincount(np.minimum(n, DISCOUNT_TO + 2).astype(np.int64), minlength=DISCOUNT_TO + 2)
    yield from packed([row(part, int(top[r]), COUNTS, r) for r in range(1, DISCOUNT_TO + 2)])
    yield from packed([row(part, None, table, s, rising(keys[i:j]), planes(n[i:j])) for s, (i, j) in enumerate(cut(len(keys)))])
    yield from packed([*answers(asked, kind, told)])


def _seen(counted: DataFrame) -> dict[int, int]:
    return {r["seq"]: r["n"] for r in counted.where(F.col("kind") == COUNTS).groupBy("seq").agg(F.sum("chunk").alias("n")).collect()}


def _third(own: DataFrame, counted: DataFrame, parts: int, totals: Totals) -> tuple[list[DataFrame], DataFrame, list[float]]:
    """Trigrams by slices, bigrams with z, and the discount ratios of trigrams. A part answers each chunk with the sums of its trigrams, chunks then sum what
    the trigrams that they account for leave to their histories, and the parts of the bigrams add that up."""

    def ask(i):
        def run(batches):
            for chunk, words, token, sizes in each(batches):
                yield from packed([*Chunk(words, token, sizes).ask_slice(i, parts, chunk, True)])

        return run

    def total(batches):
        for part, rows in by_value(0, each(batches)):
            yield from _told(rows[ASK_TRIGRAMS], OF_TRIGRAMS, TRIGRAMS, part)

    counts = []
    for i in range(SLICES):
        asked = own.select("chunk", "words", "token", "sizes").mapInArrow(ask(i), ROWS_SQL).repartition(parts, "part").sortWithinPartitions("part")
        counts.append(materialise(asked.mapInArrow(total, ROWS_SQL), "counts"))
    every = counts[0]
    for one in counts[1:]:
        every = every.union(one)
    ratios = [1.0, *discounts(_seen(every)).values(), 1.0]

    def masses(batches):
        for chunk, rows in by_value(1, each(batches)):
            c = Chunk(*rows[CHUNK][0][4:]).pair().triple()
            n2, told = joined(rows[OF_BIGRAMS], 4).astype(np.int64) >> 1, joined(rows.get(OF_TRIGRAMS), 4).astype(np.int64)
            mine = np.flatnonzero(told & 1)
            at = c.order3[c.first3[mine]]
            sums = [np.bincount(c.before[at], weights=w, minlength=len(c.keys)) for w in (discounted(ratios, told[mine] >> 1), totals.discounted(n2[c.place[c.third[at]]]))]
            some = np.flatnonzero(sums[0] > 0)
            yield from packed([*asking(c.keys[some], parts, chunk, MASSES, (sums[0] + 1j * sums[1])[some], coded=repeated)])

    def gather(batches):
        for part, rows in by_value(0, each(batches)):
            k, n = joined(rows[BIGRAMS], 4, keys_of), joined(rows[BIGRAMS], 5)
            z = np.zeros(len(k), np.complex128)
            if MASSES in rows:
                keys, (sums,), _, _ = summed(rows[MASSES], [5], repeats)
                z[np.searchsorted(k, keys)] = sums
            yield from packed([row(part, None, BIGRAMS, s, rising(k[i:j]), planes(n[i:j]), repeated(z[i:j])) for s, (i, j) in enumerate(cut(len(k)))])

    told = every.where(F.col("kind") == OF_TRIGRAMS).union(counted.where(F.col("kind") == OF_BIGRAMS)).union(_whole(own, False))
    left = materialise(told.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(masses, ROWS_SQL), "masses")
    discard(own)
    trigrams = []
    for one in counts:
        trigrams.append(materialise(one.where(F.col("kind") == TRIGRAMS).select("part", "seq", "x", "y"), "trigrams"))
        discard(one)
    both = counted.where(F.col("kind") == BIGRAMS).union(left).repartition(parts, "part").sortWithinPartitions("part")
    bigrams = materialise(both.mapInArrow(gather, ROWS_SQL).select("part", "seq", "x", "y", "z"), "bigrams")
    discard(left)
    return trigrams, bigrams, ratios


def fit(docs: DataFrame, text: str = "text", part_bytes: int = PART_BYTES, chunk_bytes: int = CHUNK_BYTES, order: int = 2) -> Katz:
    """Count every token and bigram, with order 3 every trigram too, of all whole texts of docs and build the tables.

    Texts are stored as chunks of tokens. A chunk sends its distinct words and bigrams with counts to their parts (by a hash,
    so that a frequent one is one entry a chunk), where they are summed; all are kept, those seen once too. A part answers
    each chunk with the sums, and lets one chunk alone account for a bigram. Chunks then sum what those bigrams leave to
    their histories, and the parts turn the sums into exactly normalised backoff weights. null texts are a single end; no
    documents: an empty model.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    parts = max(tasks(spark), -(-size // part_bytes))
    own = materialise(docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(lambda b: _own(b, chunk_bytes), OWN_SQL), "chunks")

    def ask(batches):
        for chunk, words, token, sizes in each(batches):
            c = Chunk(words, token, sizes).pair()
            as_w, as_h = (np.bincount(x, minlength=len(c.words)) for x in (c.token, c.history))
            yield from packed([*asking(c.keys, parts, chunk, ASK_BIGRAMS, np.diff(np.append(c.first, len(c.order)))), *asking(c.words, parts, chunk, ASK_WORDS, as_w, as_h)])

    def total(batches):
        for part, rows in by_value(0, each(batches)):
            if ASK_BIGRAMS in rows:
                yield from _told(rows[ASK_BIGRAMS], OF_BIGRAMS, BIGRAMS, part)
            asked = rows[ASK_WORDS] if ASK_WORDS in rows else []
            if asked:
                keys, (c, t), order, new = summed(asked, [5, 6], numbers)
                told = np.empty(len(order), _U)
                told[order] = c[np.cumsum(new) - 1]
                yield from packed([row(part, int(c.sum()), SIZES, int((c > 0).sum()))])
                yield from packed([row(part, None, WORDS, s, rising(keys[i:j]), planes(c[i:j]), planes(t[i:j])) for s, (i, j) in enumerate(cut(len(keys)))])
                yield from packed([*answers(asked, OF_WORDS, told)])

    asked = own.select("chunk", "words", "token", "sizes").mapInArrow(ask, ROWS_SQL)
    counted = materialise(asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(total, ROWS_SQL), "counts")
    tokens, types = counted.where(F.col("kind") == SIZES).agg(F.coalesce(F.sum("chunk"), F.lit(0)), F.coalesce(F.sum("seq"), F.lit(0))).first()
    totals = Totals(int(tokens), int(types), [1.0, *discounts(_seen(counted)).values(), 1.0])

    def masses(batches):
        for chunk, rows in by_value(1, each(batches)):
            c = Chunk(*rows[CHUNK][0][4:]).pair()
            told, count = joined(rows[OF_BIGRAMS], 4).astype(np.int64), joined(rows[OF_WORDS], 4)
            mine = np.flatnonzero(told & 1)
            at, n = c.order[c.first[mine]], told[mine] >> 1
            mass = np.bincount(c.history[at], weights=totals.discounted(n), minlength=len(c.words))
            below = np.bincount(c.history[at], weights=totals.low(count)[c.token[at]], minlength=len(c.words))
            some = np.flatnonzero(mass > 0)
            yield from packed([*asking(c.words[some], parts, chunk, MASSES, mass[some], below[some], lambda v: v.astype("<f8").tobytes())])

    def weights(batches):
        for part, rows in by_value(0, each(batches)):
            if WORDS not in rows:
                continue
            k, c, t = (joined(rows[WORDS], i, f) for i, f in ((4, keys_of), (5, numbers), (6, numbers)))
            mass, below = np.zeros(len(k)), np.zeros(len(k))
            if MASSES in rows:
                keys, sums, _, _ = summed(rows[MASSES], [5, 6], floats)
                at = np.searchsorted(k, keys)
                mass[at], below[at] = sums
            # a history whose every bigram is frequent has nothing left: its total then grows by one, which leaves 1 / (c + 1)
            whole = t + ((mass > t - 1e-6) & (mass > 0))
            alpha = np.where(mass > 0, np.log10((1 - mass / np.maximum(whole, 1)) / np.maximum(1 - below, 1e-300)), 0.0)
            yield from packed([row(part, None, WORDS, s, rising(k[i:j]), planes(c[i:j]), whole[i:j].astype("<f8").tobytes() + alpha[i:j].astype("<f8").tobytes()) for s, (i, j) in enumerate(cut(len(k)))])

    told = counted.where(F.col("kind").isin(OF_BIGRAMS, OF_WORDS)).union(_whole(own, False))
    left = materialise(told.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(masses, ROWS_SQL), "masses")
    both = counted.where(F.col("kind") == WORDS).union(left)
    words = materialise(both.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(weights, ROWS_SQL).select("part", "seq", "x", "y", "z"), "words")
    discard(left)
    trigrams = ratios = None
    if order == 3:
        trigrams, bigrams, ratios = _third(own, counted, parts, totals)
    else:
        bigrams = materialise(counted.where(F.col("kind") == BIGRAMS).select("part", "seq", "x", "y"), "bigrams")
    discard(own, counted)
    return Katz(bigrams, words, parts, totals, trigrams, ratios)


def score(docs: DataFrame, model: Katz, text: str = "text", keep: list[str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of docs (columns `keep`) with n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of whole texts by words
    alone and by bigrams), and of a model of order 3 with trigram_score.

    Texts are stored as chunks of tokens with the kept columns. A chunk asks the parts of the tables for its words and
    bigrams, the answers come together by chunk, and the probability of each token is evaluated with the recursion of Katz
    and summed by text. A text longer than chunk_bytes is a chunk of its own. null and empty texts are scored as their
    single end; null keys and repeated rows are rows like others; an empty table gives no rows; columns with the names of
    the new ones are replaced, other names cannot clash.
    """
    third = model.trigrams is not None
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score", *["trigram_score"] * third]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    parts, totals, ratios = model.parts, model.totals, model.ratios
    wide = docs.select(F.col(text).cast("binary").alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    own = materialise(wide.mapInArrow(lambda b: _own(b, chunk_bytes), OWN_SQL), "chunks")

    def ask_words(batches):
        for chunk, words in each(batches):
            yield from packed([*asking(keys_of(words), parts, chunk, ASK_WORDS)])

    def ask_bigrams(batches):
        for chunk, words, token, sizes in each(batches):
            yield from packed([*asking(Chunk(words, token, sizes).pair().keys, parts, chunk, ASK_BIGRAMS)])

    def ask_trigrams(i):
        def run(batches):
            for chunk, words, token, sizes in each(batches):
                yield from packed([*Chunk(words, token, sizes).ask_slice(i, parts, chunk, False)])

        return run

    def found_in(table, k):
        at = np.minimum(np.searchsorted(table, k), max(len(table) - 1, 0))
        return at, (table[at] == k if len(table) else np.zeros(len(k), bool))

    def of_words(batches):
        for _, rows in by_value(0, each(batches)):
            table = sorted(rows.get(WORDS, []), key=lambda r: r[3])
            k, c = joined(table, 4, keys_of), np.append(joined(table, 5), _U(0))
            whole, alpha = ([np.concatenate([[0.0], *(floats(r[6]).reshape(2, -1)[i] for r in table)])[1:] for i in (0, 1)])
            whole, alpha = np.append(whole, 0.0), np.append(alpha, 0.0)
            for r in rows.get(ASK_WORDS, []):
                at, hit = found_in(k, keys_of(r[4]))
                at = np.where(hit, at, len(k))
                yield from packed([row(None, r[1], OF_WORDS, r[3], planes(c[at]), planes(whole[at]), alpha[at].tobytes())])

    def of_ngrams(table, ask, kind, z):
        def run(batches):
            for _, rows in by_value(0, each(batches)):
                k, n = joined(rows.get(table), 4, keys_of), np.append(joined(rows.get(table), 5), _U(0))
                more = np.append(joined(rows.get(table), 6, repeats), 0j) if z else None
                out = []
                for r in rows.get(ask, []):
                    at, hit = found_in(k, keys_of(r[4]))
                    at = np.where(hit, at, len(k))
                    out.append(row(None, r[1], kind, r[3], planes(n[at]), repeated(more[at]) if z else None))
                yield from packed(out)

        return run

    def settle(table, asked, run, name):
        dealt = table.union(asked).repartition(parts, "part").sortWithinPartitions("part")
        return materialise(dealt.mapInArrow(run, ROWS_SQL), name)

    words = settle(_rows(model.words, WORDS), own.select("chunk", "words").mapInArrow(ask_words, ROWS_SQL), of_words, "words")
    bigrams = settle(_rows(model.bigrams, BIGRAMS), own.select("chunk", "words", "token", "sizes").mapInArrow(ask_bigrams, ROWS_SQL), of_ngrams(BIGRAMS, ASK_BIGRAMS, OF_BIGRAMS, third), "bigrams")
    told = []
    for i in range(SLICES if third else 0):
        asked = own.select("chunk", "words", "token", "sizes").mapInArrow(ask_trigrams(i), ROWS_SQL)
        told.append(settle(_rows(model.trigrams[i], TRIGRAMS), asked, of_ngrams(TRIGRAMS, ASK_TRIGRAMS, OF_TRIGRAMS, False), "trigrams"))
    schema = T.StructType([wide.schema[f"k{i}"] for i in range(len(keep))] + [T.StructField(n, T.DoubleType() if "score" in n else T.LongType()) for n in new])

    def longer(own, n, whole, p, z, told):
        """Log probabilities of tokens given the two before them, from those given the one before (p)."""
        n3 = np.empty(len(own.third), np.int64)
        n3[own.order3] = told.astype(np.int64)[np.cumsum(own.new3) - 1]
        # a bigram is followed as often as it was seen; one whose every trigram is frequent has nothing left, as above
        c, mass, below = n[own.third - 1], z.real[own.before], z.imag[own.before]
        all_ = c + ((mass > c - 1e-6) & (mass > 0))
        low = whole[own.history[own.third]]
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.log10(discounted(ratios, n3)) - np.log10(all_)
            alpha = np.log10((1 - mass / all_) / np.maximum(1 - below / low, 1e-300))
        out = p.copy()
        out[own.third] = np.where(n3 > 0, seen, np.where(mass > 0, alpha, 0.0) + p[own.third])
        return out

    def evaluate(batches):
        for _, rows in by_value(1, each(batches)):
            mine, kept = sorted(rows[CHUNK], key=lambda r: r[3])
            own = Chunk(*mine[4:]).pair()
            n = np.empty(len(own.token), np.int64)
            n[own.order] = joined(rows[OF_BIGRAMS], 4).astype(np.int64)[np.cumsum(own.new) - 1]
            c, whole, alpha = (joined(rows[OF_WORDS], i, f) for i, f in ((4, numbers), (5, numbers), (6, floats)))
            low = np.log10(totals.low(c))
            with np.errstate(divide="ignore"):
                seen = np.log10(totals.discounted(n)) - np.log10(whole)[own.history]
            p = np.where(n > 0, seen, alpha[own.history] + low[own.token])
            text_of = np.repeat(np.arange(len(own.sizes)), own.sizes)
            logs = [c[own.token] > 0, low[own.token], p]
            if third:
                logs.append(longer(own.triple(), n, whole, p, joined(rows[OF_BIGRAMS], 5, repeats), joined(rows.get(OF_TRIGRAMS), 4)))
            sums = [np.bincount(text_of, weights=v, minlength=len(own.sizes)) for v in logs]
            at = 0
            for b in pa.ipc.open_stream(kept[4]):
                j = slice(at, at + b.num_rows)
                at += b.num_rows
                made = [pa.array(own.sizes[j]), pa.array(np.rint(sums[0][j]).astype(np.int64)), pa.array(np.full(b.num_rows, totals.tokens, np.int64)), *[pa.array(x[j]) for x in sums[1:]]]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], names=schema.names)

    dealt = words.union(bigrams).union(_whole(own, True))
    for one in told:
        dealt = dealt.union(one)
    dealt = dealt.repartition(parts, "chunk").sortWithinPartitions("chunk")
    out = materialise(dealt.mapInArrow(evaluate, schema), "scores")
    discard(own, words, bigrams, *told)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *new)
