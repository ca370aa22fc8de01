"""Chunks of texts ask parts of a table about keys: rows of sorted 64-bit keys and numbers, and how they are told and gathered."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: Numbers of one row on its way to a part or chunk, at most.
ROW_KEYS = 1 << 16


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts of keys; keys in order have their parts in order."""
    return ((keys >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, as many as the largest needs, after a byte that says how many."""
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def numbers(planes: bytes) -> np.ndarray:
    rows = np.frombuffer(planes, np.uint8, offset=1).reshape(planes[0], -1)
    out = np.zeros((rows.shape[1], 8), np.uint8)
    out[:, : planes[0]] = rows.T
    return out.view("<u8").ravel()


def rising(x: np.ndarray) -> bytes:
    """Keys in order, as planes of their gaps."""
    return planes(np.diff(x, prepend=_U(0)))


def keys_of(planes: bytes) -> np.ndarray:
    return np.cumsum(numbers(planes), dtype=_U)


def floats(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<f8")


def cut(n: int):
    return [(i, min(i + ROW_KEYS, n)) for i in range(0, n, ROW_KEYS)]


#: Rows on their way: keys of bigrams or words in order (x) with numbers (y, z), between chunks and parts.
ROWS = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("seq", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])
ROWS_SQL = "part int, chunk long, kind int, seq int, x binary, y binary, z binary"
def row(part=None, chunk=None, kind=None, seq=None, x=None, y=None, z=None):
    return (part, chunk, kind, seq, x, y, z)


def packed(rows: list[tuple], limit: int = 4 << 20):
    """Arrow batches of about `limit` bytes."""
    start = size = 0
    for i, r in enumerate(rows):
        size += sum(len(v) for v in r[4:] if v)
        if size >= limit or i + 1 == len(rows):
            part = rows[start : i + 1]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in part], f.type) for j, f in enumerate(ROWS)], schema=ROWS)
            start, size = i + 1, 0


def each(batches):
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)))


def chunked(batches, limit: int):
    """Arrow batches regrouped into lists of slices that hold about `limit` bytes of text (their first column)."""
    held, size = [], 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, before + limit - size, side="right")), start + 1)
            held.append(b.slice(start, stop - start))
            size += int(ends[stop - 1] - before)
            start = stop
            if size >= limit or start < b.num_rows:
                yield held
                held, size = [], 0
    if held:
        yield held


def asking(keys: np.ndarray, parts: int, chunk: int, kind: int, y=None, z=None, coded=planes):
    """Rows that ask for keys or tell their numbers, to the parts in order of keys; seq keeps that order."""
    bounds, seq = np.searchsorted(part_of(keys, parts), np.arange(parts + 1)), 0
    for p in np.flatnonzero(np.diff(bounds)):
        for i, j in cut(int(bounds[p + 1] - bounds[p])):
            at = slice(i + bounds[p], j + bounds[p])
            yield row(int(p), chunk, kind, seq, rising(keys[at]), *(None if v is None else coded(v[at]) for v in (y, z)))
            seq += 1


def by_value(column: int, rows):
    """(value, rows by kind) for one value of a column after another, from rows that come sorted by it."""
    now, held = None, {}
    for r in rows:
        if held and r[column] != now:
            yield now, held
            held = {}
        now = r[column]
        held.setdefault(r[2], []).append(r)
    if held:
        yield now, held


def joined(rows, column: int, decode=numbers) -> np.ndarray:
    return np.concatenate([decode(r[column]) for r in sorted(rows, key=lambda r: r[3])]) if rows else np.zeros(0, _U)


def summed(rows, numbers: list[int], decode):
    """Distinct keys of rows in order, sums of their numbers, and (order, new): where each entry went and which come first."""
    keys = np.concatenate([keys_of(r[4]) for r in rows])
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    new = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))
    first = np.flatnonzero(new)
    sums = [np.add.reduceat(np.concatenate([decode(r[c]) for r in rows])[order], first) for c in numbers]
    return sorted_keys[first], sums, order, new


def answers(rows, kind: int, told: np.ndarray):
    at = 0
    for r in rows:
        n = (len(r[4]) - 1) // r[4][0]
        yield row(None, r[1], kind, r[3], planes(told[at : at + n]))
        at += n
