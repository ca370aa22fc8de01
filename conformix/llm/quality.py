"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conformix.llm.common import words_of

#: Hashed word features, rank of the interactions, and the documented bound of the labelled sample.
WORDS, RANK, TRAIN_ROWS = 2048, 8, 4000
THRESHOLD = 0.7
STATS = 16


def features(texts: list[bytes | None], n_chars: list[int | None]) -> np.ndarray:
    """Rows of WORDS hashed word weights (square roots of counts, unit length) and STATS structure statistics of whole texts."""
    out = np.zeros((len(texts), WORDS + STATS), np.float32)
    words, owner = words_of(texts)
    counts = np.bincount(owner * WORDS + (words >> np.uint64(17)).astype(np.int64) % WORDS, minlength=len(texts) * WORDS).reshape(len(texts), WORDS)
    root = np.sqrt(counts)
    out[:, :WORDS] = root / np.maximum(np.sqrt((root**2).sum(axis=1, keepdims=True)), 1)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    punct = np.zeros(256, bool)
    punct[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
    for i, t in enumerate(texts):
        t = t or b""
        n = max(len(t), 1)
        h = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        own = words[bounds[i] : bounds[i + 1]]
        m = max(len(own), 1)
        _, c = np.unique(own, return_counts=True)
        rep = float((own[1:] == own[:-1]).mean()) if len(own) > 1 else 0.0
        lines = [x for x in t.split(b"\n") if x.strip()]
        letters = max(h[65:91].sum() + h[97:123].sum(), 1)
        out[i, WORDS:] = (
            np.log1p(len(t)) / 10, h[65:91].sum() / letters, h[48:58].sum() / n, h[punct].sum() / n, h[33] / n * 5, h[124] / n * 5,
            h[[35, 36, 37, 38, 42]].sum() / n * 5, h[128:].sum() / n, len(t) / m / 20, len(c) / m, (c.max() if len(c) else 0) / m, rep,
            np.log1p(len(lines)) / 5, 1 - len(set(lines)) / max(len(lines), 1), np.log1p(max(n_chars[i] or 0, 0)) / 10, float(n_chars[i] is None),
        )
    return out


@dataclass
class FactorisationMachine:
    mean: np.ndarray
    scale: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """w0 + w.x + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2): linear in the number of features."""
        z = np.clip((x - self.mean) * self.scale, -6, 6)
        return self.bias + z @ self.linear + 0.5 * ((z @ self.factors) ** 2 - (z**2) @ (self.factors**2)).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_machine(x: np.ndarray, y: np.ndarray, rank: int = RANK, epochs: int = 30, rate: float = 0.01, decay: float = 2e-4, seed: int = 1) -> FactorisationMachine:
    """Adam on the logistic loss, in small batches; statistics are standardised, word weights only scaled."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    mean[:WORDS] = 0
    scale = np.ones(x.shape[1], np.float32)
    scale[WORDS:] = 1 / np.maximum(sd[WORDS:], 1e-3)
    scale[:WORDS] = 3
    rng, n, d = np.random.default_rng(seed), len(x), x.shape[1]
    p = float(np.clip(y.mean(), 0.01, 0.99))
    par = [np.array([np.log(p / (1 - p))], np.float32), np.zeros(d, np.float32), (rng.standard_normal((d, rank)) * 0.01).astype(np.float32)]
    m, v, step = [np.zeros_like(a) for a in par], [np.zeros_like(a) for a in par], 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 128):
            rows = order[at : at + 128]
            z = np.clip((x[rows] - mean) * scale, -6, 6)
            zf = z @ par[2]
            out = par[0][0] + z @ par[1] + 0.5 * (zf**2 - (z**2) @ (par[2] ** 2)).sum(axis=1)
            e = ((1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[rows]) / len(rows)).astype(np.float32)
            grads = [np.array([e.sum()]), z.T @ e + decay * par[1], z.T @ (e[:, None] * zf) - ((z**2).T @ e)[:, None] * par[2] + decay * par[2]]
            step += 1
            lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                par[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return FactorisationMachine(mean, scale, float(par[0][0]), par[1], par[2])


def _featured(batches):
    """(slice, features) of batches whose first columns are the text's bytes and n_chars."""
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            yield part, features(part.column(0).to_pylist(), part.column(1).to_pylist())


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> FactorisationMachine | None:
    """Fit on at most `rows` documents with a label that is not null (smallest hashes of the key). Their features, of
    fixed width, are all that reaches the driver. None if there is no labelled document."""
    known = labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("_y"))
    chosen = known.withColumn("_h", F.xxhash64(F.col(key).cast("string"))).orderBy("_h").limit(rows)
    chars = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    sample = docs.select(F.col(text).cast("binary").alias("t"), chars.cast("long").alias("n"), key).join(F.broadcast(chosen), key)  # `rows` rows at most
    sample = sample.select("t", "n", "_h", F.col("_y").cast("long").alias("_y"))

    def run(batches):
        for part, x in _featured(batches):
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["h", "y", "x"])

    got = sample.mapInArrow(run, "h long, y long, x binary").orderBy("h", "x").limit(rows).collect()
    if not got:
        return None
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float16) for r in got]).astype(np.float32)
    return fit_machine(x, np.array([r["y"] for r in got], np.float32))


def score(docs: DataFrame, model: FactorisationMachine | None, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs (columns `keep`) with score (0 to 1, that the label is 1) and predicted (1 from `threshold` on).

    null and empty texts are scored from their zero statistics; without a model every score is 0.5; very long texts are
    read whole; n_chars may be null or missing; columns named score or predicted are replaced; repeated rows stay.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    chars = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    wide = docs.select(F.col(text).cast("binary").alias("_t"), chars.cast("long").alias("_n"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    names = [f"k{i}" for i in range(len(keep))]
    fields = "".join(f"{c} {wide.schema[c].dataType.simpleString()}, " for c in names)

    def run(batches):
        for part, x in _featured(batches):
            s = np.full(len(x), 0.5) if model is None else np.clip(model.score(x).astype(float), 0, 1)
            yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], [*names, "score", "predicted"])

    return wide.mapInArrow(run, f"{fields}score double, predicted int").select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "score", "predicted")
