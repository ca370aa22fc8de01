"""What the operators share: texts as chunks of bytes and hashes of words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from conformix.operators.graph import components  # noqa: F401
from conformix.sources.tables import BATCH, BATCH_BYTES, checked_join, discard, materialise, shared_dir, tasks  # noqa: F401

def small_batches(spark) -> None:
    """Bounds the Arrow batches of the session by their bytes, unless that is set already: rows of whole texts would else come to a task
    ten thousand at a time. What is returned unwritten runs later, so the setting stays."""
    if spark.conf.get(BATCH) == "67108864b":  # Spark's own
        spark.conf.set(BATCH, str(BATCH_BYTES))


def give_back() -> None:
    """Returns memory that Arrow and the allocator hold unused: a worker process outlives its task, and several wait idle in an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        pass


def tidied(run):
    """A task function over batches that gives unused memory back when it is through."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


# --- text as bytes -----------------------------------------------------------------------------

#: Bytes of text that a task holds at once.
CHUNK = 8 << 20

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)


def chunks(batches, columns: int = 2, limit: int = CHUNK) -> Iterator[list[list]]:
    """Rows of Arrow batches as column lists, the second being binary, cut so that a cut holds about `limit` bytes."""
    keep: list[list] = [[] for _ in range(columns)]
    held = 0
    for batch in batches:
        cols = [batch.column(i) for i in range(columns)]
        text = cols[1]
        for start in range(0, batch.num_rows, 64):
            for k in range(columns):
                keep[k].extend(cols[k].slice(start, 64).to_pylist())
            held += sum(len(x) for x in text.slice(start, 64).to_pylist() if x is not None)
            if held >= limit:
                yield keep
                keep, held = [[] for _ in range(columns)], 0
    if keep[0]:
        yield keep


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """base**i modulo 2**64 for i < n, built by doubling."""
    out = np.ones(max(n, 1), dtype=_U)
    step, have = base, 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * _U(step)
        step, have = step * step % (1 << 64), have + take
    return out


_INV = pow(0x9E3779B97F4A7C15, -1, 1 << 64)


_tables: dict[int, np.ndarray] = {}


def table(n: int, base: int) -> np.ndarray:
    """powers(n, base), kept and grown as longer texts come."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        have = _tables[base] = powers(max(n, 1 << 16), base)
    return have[:n]


class PrefixHash:
    """Hashes of substrings of one byte array in constant time each (polynomial, modulo 2**64, then mixed)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=_U)
        np.cumsum((data.astype(_U) + _U(1)) * table(n, 0x9E3779B97F4A7C15), out=self.sums[1:])
        self.inverse = table(n + 1, _INV)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(h ^ mix((end - start).astype(_U) * _P))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


#: Bytes of texts that are hashed at once.
PIECE = 2 << 20


def words_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of whole texts, A-Z lower-cased: 64-bit hashes in order and the text of each word."""
    words, owners, at = [np.zeros(0, _U)], [np.zeros(0, np.int64)], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size < PIECE):
            size += len(texts[to] or b"") + 1
            to += 1
        w, o = _words_of(texts[at:to])
        words.append(w)
        owners.append(o + at)
        at = to
    return np.concatenate(words), np.concatenate(owners)


def _words_of(texts):
    sizes = np.fromiter((0 if t is None else len(t) for t in texts), np.int64, len(texts))
    data = np.frombuffer(b" ".join(b"" if t is None else t for t in texts) + b" ", np.uint8)
    data = _LOWER[data]
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    first = np.concatenate(([0], np.cumsum(sizes + 1)))
    owner = np.searchsorted(first, start, side="right") - 1
    return PrefixHash(data).of(start, end), owner
