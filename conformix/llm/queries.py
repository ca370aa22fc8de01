"""The queries opN_<name> and the pipeline over the given tables; each returns its operator's whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_consensus_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conformix.llm.html import extract

    return extract(_read(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op2_columnwise_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conformix.llm.suffix import dedup

    return dedup(_read(spark, sf_dir, "documents"), keep=["doc_id"]).drop("kept")


def op3_string_kernel_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conformix.llm.langid import fit, identify

    docs = _read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_remainder(4) == 2, F.lit(False)))
    return identify(docs, fit(docs.where("not held_out")), keep=["doc_id", "held_out"])


def op7_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conformix.llm.katz import fit, score

    docs = _read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_remainder(7) == 2, F.lit(False)))
    return score(docs, fit(docs.where("not held_out"), order=3), keep=["doc_id", "held_out"])


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conformix.llm.quality import fit, score

    docs = _read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_remainder(4) == 2, F.lit(False)))
    labels = _read(spark, sf_dir, "labels").where(_remainder(4) != 2)
    return score(docs, fit(docs.where("not held_out"), labels), keep=["doc_id", "held_out"])


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conformix.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"))


def op5_nn_descent_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conformix.llm.neardup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "embeddings"))


def op6_block_matrix_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conformix.llm.ann import search

    vectors = _read(spark, sf_dir, "embeddings")
    return search(vectors.where("vec_id % 20 = 0"), vectors, k=20)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conformix.llm.jaccard import join

    return join(_read(spark, sf_dir, "documents"), width=3, percent=90)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conformix.llm.mixing import mix

    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op11_eenns_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conformix.llm.clusters import cluster

    return cluster(_read(spark, sf_dir, "embeddings"))


def op12_warc_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conformix.llm.warc import round_trip

    return round_trip(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_aho_corasick_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from conformix.llm.lexical import search

    return search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_consensus_html": op1_consensus_html,
    "op2_columnwise_suffix_dedup": op2_columnwise_suffix_dedup,
    "op3_string_kernel_language_id": op3_string_kernel_language_id,
    "op7_katz_backoff": op7_katz_backoff,
    "op8_quality_classifier": op8_quality_classifier,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_nn_descent_near_dedup": op5_nn_descent_near_dedup,
    "op6_block_matrix_ann": op6_block_matrix_ann,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_mixing": op10_mixing,
    "op11_eenns_clustering": op11_eenns_clustering,
    "op12_warc_assembly": op12_warc_assembly,
    "op13_aho_corasick_search": op13_aho_corasick_search,
    "pipeline": pipeline,
}

_KEPT = """kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: floor(256*c::DOUBLE)::BIGINT) x FROM embeddings
 WHERE len(embedding)=64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c)))=64)"""
_START = "c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:'||vec_id) NULLS LAST, x)-1)::INT c, x FROM kept ORDER BY sha256('2:'||vec_id) NULLS LAST, x LIMIT 40)"


def _nearest(name: str, centroids: str) -> str:
    distance = "list_sum(list_transform(range(1,65), lambda i: (k.x[i]-c.x[i])*(k.x[i]-c.x[i])))::BIGINT"
    return f"""{name} AS MATERIALIZED (SELECT r, vec_id, x, b.c AS c, b.d AS d FROM (SELECT k.r, any_value(k.vec_id) vec_id, any_value(k.x) x, min({{'d': {distance}, 'c': c.c}}) b
 FROM (SELECT *, row_number() OVER () r FROM kept) k CROSS JOIN {centroids} c GROUP BY k.r))"""


def _round(n: int) -> str:
    """Assignment to the centroids before, and the centroids after it."""
    moved = f"SELECT c, list(m ORDER BY i) x FROM (SELECT c, i, floor(sum(x[i])::DOUBLE/count(*))::BIGINT m FROM a{n}, range(1,65) t(i) GROUP BY c, i) GROUP BY c"
    return f"""{_nearest(f"a{n}", f"c{n}")}, m{n} AS ({moved}), c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.x, o.x) x FROM c{n} o LEFT JOIN m{n} m ON m.c=o.c)"""


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '{_TERM}')"

ORACLES: dict[str, str] = {
    "op11_eenns_clustering": f"""WITH {_KEPT}, {_START}, {", ".join(_round(n) for n in range(5))}, {_nearest("a5", "c5")},
s AS (SELECT c, sum(d)::BIGINT s FROM a5 GROUP BY c)
SELECT vec_id, a5.c AS "cluster", d AS distance, s.s AS cluster_inertia, (SELECT sum(s)::BIGINT FROM s) AS inertia, sha256(array_to_string(c5.x, ',')) AS centroid_sha256 FROM a5 JOIN s ON s.c=a5.c JOIN c5 ON c5.c=a5.c""",
    "op12_warc_assembly": """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html,''))) n, sha256(coalesce(html,'')) h FROM pages), w AS (SELECT *, min(page_id) OVER (PARTITION BY h) f FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n>=100 AND page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n>=100 AND page_id IS DISTINCT FROM f THEN f END AS refers_to FROM w""",
    "op13_aho_corasick_search": f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () r, doc_id, {_TERMS} ts FROM documents WHERE text IS NOT NULL),
g AS (SELECT count(*)::BIGINT n_docs, sum(len(ts))::BIGINT l FROM d WHERE len(ts)>0),
i AS MATERIALIZED (SELECT item_id, t, count(*)::BIGINT k FROM (SELECT item_id, unnest({_TERMS}) t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY 1, 2),
v AS (SELECT DISTINCT t FROM i),
f AS MATERIALIZED (SELECT r, any_value(doc_id) doc_id, t, count(*)::BIGINT tf, any_value(n)::BIGINT n FROM (SELECT r, doc_id, len(ts) n, unnest(ts) t FROM d) SEMI JOIN v USING (t) GROUP BY r, t),
w AS (SELECT t, floor(1000*ln((2*n_docs+2)::DOUBLE/(2*count(*)+1)::DOUBLE))::BIGINT w FROM f, g GROUP BY t, n_docs),
s AS (SELECT i.item_id, f.r, any_value(f.doc_id) doc_id, sum(k*w.w*((1000000000*f.tf)//(1000*f.tf+8*(100-75+((75*f.n*g.n_docs)//g.l)))))::BIGINT score FROM f JOIN w ON w.t=f.t JOIN i ON i.t=f.t, g GROUP BY i.item_id, f.r),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score>0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank<=10""",
}
