"""Language identification: blended-spectrum presence kernels, Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conformix.llm.common import _LOWER, small_batches, tidied

#: Lengths of the byte n-grams of the blended spectrum, and the size of the hashed feature space of their presence.
NGRAMS, SPACE = (1, 2, 3, 4), 1 << 14
#: Documented bound of the labelled sample that the classifier is fitted on, and the landmarks among it.
TRAIN_ROWS, LANDMARKS, RIDGE = 3000, 256, 1e-3
#: Score below which the pipeline's language stage rejects a document.
REJECT_BELOW = 0.3


def presence(texts: list[bytes | None], ngrams=NGRAMS, space: int = SPACE) -> np.ndarray:
    """Boolean rows: which (hashed) byte n-grams occur anywhere in each whole text, A-Z lower-cased."""
    out = np.zeros((len(texts), space), dtype=bool)
    shift = np.uint32(32 - space.bit_length() + 1)
    for row, t in zip(out, texts):
        if not t:
            continue
        code = data = _LOWER[np.frombuffer(t, np.uint8)].astype(np.uint32)
        for n in range(1, max(ngrams) + 1):
            if n > 1:
                if len(data) < n:
                    break
                code = (code[:-1] << np.uint32(8)) | data[n - 1 :]
            if n in ngrams:
                row[((code + np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1)) >> shift] = True
    return out


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray | None  # space x languages: landmark matrix times the regression's dual coefficients
    bias: np.ndarray | None

    def scores(self, seen: np.ndarray) -> np.ndarray:
        """Normalised kernels against all landmarks times the coefficients, as one matrix product a batch."""
        norm = np.sqrt(np.maximum(seen.sum(axis=1), 1)).astype(np.float32)
        f = seen.astype(np.float32) @ self.weights / norm[:, None] + self.bias
        e = np.exp(4 * (f - f.max(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)


def fit_kernel(seen: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Nyström features K_nm K_mm^-1/2 against the first rows as landmarks, then ridge regression, one language against the rest."""
    names = sorted(set(langs))

    def unit(rows):
        return rows.astype(np.float32) / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1)).astype(np.float32)

    marks = unit(seen[:landmarks])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.concatenate([unit(seen[i : i + 256]) @ marks.T for i in range(0, len(seen), 256)]).astype(float) @ root
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    mean, bias = phi.mean(axis=0), y.mean(axis=0)
    centred = phi - mean
    w = np.linalg.solve(centred.T @ centred + ridge * len(phi) * np.eye(phi.shape[1]), centred.T @ (y - bias))
    return LanguageModel(names, (marks.T @ (root @ w)).astype(np.float32), (bias - mean @ w).astype(np.float32))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> LanguageModel:
    """Fit on at most `rows` labelled documents (smallest hashes of their key); only their packed presence bits, of
    SPACE / 8 bytes each, reach the driver. No labelled rows: a model that knows no language."""
    held = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(text).cast("binary").alias("t"), F.col(lang).alias("l"))
    ids = held.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if ids is None:
        return LanguageModel([], None, None)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                bits = np.packbits(presence(part.column(1).to_pylist()), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in bits], pa.binary()), part.column(2)], ["h", "bits", "l"])

    got = held.where(F.col("h") <= ids).mapInArrow(tidied(run), "h long, bits binary, l string").orderBy("h", "bits").limit(rows).collect()
    seen = np.unpackbits(np.stack([np.frombuffer(bytes(r["bits"]), np.uint8) for r in got]), axis=1).astype(bool)
    return fit_kernel(seen, [r["l"] for r in got])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of docs (columns `keep`, all by default) with lang_pred and score (softmax of the one-versus-rest outputs, 0 to 1).

    null text and text without a letter: `und` with score 0, as is all text if the model knows no language. Whole texts
    of any length are read. Columns named lang_pred or score are replaced. Repeated rows stay; empty tables stay empty.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    small_batches(docs.sparkSession)
    # a kept text goes to the task once and comes back as the bytes that were read
    names = ["_bytes" if c == text and docs.schema[c].dataType == T.StringType() else f"k{i}" for i, c in enumerate(keep)]
    others = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names) if n != "_bytes"]
    wide = docs.select(F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)).alias("_letters"), F.col(text).cast("binary").alias("_bytes"), *others)
    back = [n for n in wide.columns[1:] if n in names]
    schema = T.StructType([wide.schema[c] for c in back] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                named, top = ["und"] * part.num_rows, [0.0] * part.num_rows
                ok = [j for j, x in enumerate(part.column(0).to_pylist()) if x and model.langs]
                if ok:
                    p = model.scores(presence(part.column(1).take(pa.array(ok)).to_pylist()))
                    for j, k, s in zip(ok, p.argmax(axis=1), p.max(axis=1)):
                        named[j], top[j] = model.langs[k], min(1.0, float(s))
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in back], pa.array(named, pa.string()), pa.array(top, pa.float64())], [*back, "lang_pred", "score"])

    return wide.mapInArrow(tidied(run), schema).select(*[(F.col(n).cast("string") if n == "_bytes" else F.col(n)).alias(c) for n, c in zip(names, keep)], "lang_pred", "score")
