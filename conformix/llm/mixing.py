"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conformix.llm.common import give_back, materialise, tasks

#: Weights of the sources in order of their code points, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Most units that one flight holds.
BLOCK = 20_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, cap: float = 3.0) -> dict[str | None, float]:
    """Share the total size by weight; a target stops at cap times its source's size and its excess is shared again."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, open_, out = dict(order), {s for s, n in order if n > 0}, {s: 0.0 for s, _ in order}
    rest = float(sum(size.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if rest * weight[s] / total >= cap * size[s]}
        if not full:
            out.update({s: rest * weight[s] / total for s in open_})
            break
        for s in full:
            out[s] = cap * size[s]
        rest -= sum(out[s] for s in full)
        open_ -= full
    return out


def flight(p: np.ndarray, x: np.ndarray, seed: int, land: bool = False) -> np.ndarray:
    """Move inclusion probabilities p through the null space of the balancing constraints (columns x * p0 / p0 = x).

    Constraints: sum of p and sum of p * x stay as they are. Three undecided units have a null direction at each step;
    the step ends when one of them reaches 0 or 1, and a martingale choice of side keeps every unit's expectation.
    What is left (two units at most) keeps its fraction, or with land=True is rounded so that the sum of sizes moves least.
    """
    p, rng = p.astype(float).copy(), np.random.default_rng(seed)
    live, draws, k = [], rng.random(len(p) + 1), 0
    eps = 1e-9
    for i in range(len(p)):
        if p[i] <= eps or p[i] >= 1 - eps:
            p[i] = round(p[i])
            continue
        live.append(i)
        if len(live) < 3:
            continue
        a, b, c = live
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])  # orthogonal to (1, 1, 1) and to (xa, xb, xc)
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[j]) / d if d > 0 else p[j] / -d for j, d in zip(live, u) if d)
        down = min(p[j] / d if d > 0 else (1 - p[j]) / -d for j, d in zip(live, u) if d)
        step = up if draws[k] * (up + down) < down else -down
        k += 1
        for j, d in zip(live, u):
            q = p[j] + step * d
            p[j] = 0.0 if q <= eps else 1.0 if q >= 1 - eps else q
        live = [j for j in live if 0 < p[j] < 1]
    if land and live:
        want = sum(p[j] * x[j] for j in live)
        best = min(range(1 << len(live)), key=lambda m: (abs(sum(x[j] for i, j in enumerate(live) if m >> i & 1) - want), m))
        for i, j in enumerate(live):
            p[j] = float(best >> i & 1)
    return p


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, cap: float = 3.0, block: int = BLOCK) -> DataFrame:
    """Rows of docs with size, source_size, target, copies and taken (columns of docs with these names are replaced).

    A source's documents share one rate r = target / size of the source. floor(r) copies of each are certain; the rest
    is a fractional inclusion probability, which cube-method flights settle: blocks of at most `block` documents first
    (a source of any size is dealt over blocks), then the few undecided units of a source's blocks together in rounds,
    then the landing of at most two units a source. Word and document totals of a source so stay near their expectation.

    A text of any length is one unit; a null key is a value like others. null text has size 0 and takes nothing (taken = 0, but may have copies); a null source is a source of its own, last
    in order; repeated rows are units of their own; an empty table gives an empty table. Source totals (one row per
    source) are the only thing that reaches the driver. Draws depend on keys and content alone, so reruns agree.
    """
    spark = docs.sparkSession
    own = ["size", "source_size", "target", "copies", "taken"]
    names = [c for c in docs.columns if c not in own]
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)]
    words = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.expr(f"filter(split(`{text}`, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"))).cast("long")
    # a unit is a distinct (key, text); repeated rows of it are told apart by their number
    unit = F.xxhash64(F.col(key).cast("string"), F.col(text), F.col(source))
    # a row's own columns travel under other names, so that none can clash
    sized = docs.select(*kept, F.col(source).cast("string").alias("_of"), words.alias("size"), unit.alias("_h"))
    slim = materialise(sized.groupBy("_h", "_of", "size").agg(F.count("*").alias("_n")), "units")
    per = slim.groupBy("_of").agg(F.sum(F.col("size") * F.col("_n")).alias("s"), F.sum("_n").alias("n")).collect()
    goal = targets([(r[0], r[1]) for r in per], weights, cap)
    rates = [(r[0], int(r[1]), float(goal[r[0]]), min(cap, goal[r[0]] / r[1]) if r[1] else 0.0, max(1, -(-2 * r[2] // block))) for r in per]
    schema = T.StructType([T.StructField("_src", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("_r", T.DoubleType()), T.StructField("_b", T.LongType())])
    rate = spark.createDataFrame(rates, schema)
    rate = rate.hint("broadcast") if len(rates) <= 50_000 else rate.hint("merge")

    def rated(df):
        return df.join(rate, F.col("_of").eqNullSafe(F.col("_src")), "left")

    units = rated(slim).select("_h", "size", F.col("_src"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_i"), (F.col("_r") - F.floor("_r")).alias("_p"), F.pmod(F.xxhash64("_h", F.lit(7)), F.col("_b")).alias("_b"))
    state = "_h long, size long, _src string, _i long, _p double"

    def fly(last):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            # large units first, so that what is left to land is small
            pdf = pdf.sort_values(["size", "_h", "_i"], ascending=[False, True, True], kind="stable")
            seed = int(np.bitwise_xor.reduce(pdf["_h"].to_numpy().view(np.uint64))) & 0x7FFFFFFF
            out = pdf.assign(_p=flight(pdf["_p"].to_numpy(), pdf["size"].to_numpy().astype(float), seed, last))[["_h", "size", "_src", "_i", "_p"]]
            give_back()
            return out

        return run

    if rates:
        blocks = max(r[4] for r in rates)
        done = materialise(units.groupBy("_src", "_b").applyInPandas(fly(False), state), "flight")
        settled = done.where("_p <= 0 or _p >= 1")
        while True:
            open_ = done.where("_p > 0 and _p < 1")
            blocks = -(-blocks * 4 // block)  # two or fewer undecided units a block
            last = blocks <= 1
            dealt = open_.withColumn("_b", F.pmod(F.xxhash64("_h", F.lit(blocks)), F.lit(blocks)))
            done = materialise(dealt.groupBy("_src", "_b").applyInPandas(fly(last), state), "flight")
            settled = settled.union(done.where("_p <= 0 or _p >= 1"))
            if last:
                break
        extra = settled.groupBy("_h").agg(F.array_sort(F.collect_list(F.struct("_i", F.col("_p").cast("int").alias("p")))).alias("_x"))
    else:
        extra = units.groupBy("_h").agg(F.array_sort(F.collect_list(F.struct("_i", F.lit(0).alias("p")))).alias("_x"))
    # repeated rows are numbered only where there are any; the others take the one entry
    numbered = sized.withColumn("_k", F.monotonically_increasing_id())
    many = slim.where("_n > 1").select("_h")
    n_many = many.count()
    if n_many:
        from pyspark.sql import Window

        flag = many.distinct().withColumn("_many", F.lit(True))
        numbered = numbered.join(flag.hint("broadcast") if n_many <= 100_000 else flag.hint("merge"), "_h", "left")
        salt = F.when(F.col("_many"), F.lit(0)).otherwise(F.col("_k"))
        numbered = numbered.withColumn("_j", F.row_number().over(Window.partitionBy("_h", salt).orderBy("_k"))).drop("_many")
    else:
        numbered = numbered.withColumn("_j", F.lit(1))
    out = rated(numbered).join(extra.hint("merge"), "_h", "left").withColumn("copies", (F.floor("_r") + F.coalesce(F.get("_x", F.col("_j") - 1)["p"], F.lit(0))).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "size", "source_size", "target", "copies", "taken")


def resample(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a document with n copies comes n times; columns stay as they are."""
    mixed = mix(docs)
    return mixed.where("copies > 0").withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)
