"""Queries that read requirements out of specifications (X2-X7) and write numbers (F11, F12, F14, F16), and evidence lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from conformix.functions import requirements as Q
from conformix.functions import text as X
from conformix.plans.queries_text import CHUNKS, chunks, lines_of_parts
from conformix.sources import derived as D

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


_K = "p_partkey%16"

_JOINED = r"""j AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '\r\n|\n|\r'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' ') t FROM documents WHERE text IS NOT NULL)"""


@query("x02_join_lines", f"WITH {_JOINED} SELECT doc_id, length(t)::bigint n, md5(t) h FROM j")
def x02(spark, sf_dir):
    t = D.read(spark, sf_dir, "documents").where("text is not null").select("doc_id", Q.join_lines(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("h"))


@query(
    "x03_sentences",
    f"""WITH {_JOINED}, c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([。；;！？!?])', '\\1'||chr(1), 'g'), '(\\.)(\\s+[A-Z])', '\\1'||chr(1)||'\\2', 'g') t FROM j),
s AS (SELECT doc_id, unnest(string_split(t, chr(1))) x FROM c) SELECT doc_id, count(*) n, max(length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')))::bigint longest FROM s WHERE regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY 1""",
)
def x03(spark, sf_dir):
    s = D.read(spark, sf_dir, "documents").select("doc_id", F.explode(Q.sentences(F.col("text"))).alias("x"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("x")).cast("long").alias("longest"))


@query("x04_without_numbering", f"SELECT p_partkey, p_size||' 管線配置' AS rest FROM part WHERE {_K}=0")
def x04(spark, sf_dir):
    rest = Q.without_numbering(F.col("text"))
    return lines_of_parts(spark, sf_dir).where(rest != F.trim("text")).select("p_partkey", rest.alias("rest"))


@query("x05_modality", f"SELECT p_partkey, CASE WHEN {_K} IN (0,3,15) THEN 'unknown' WHEN {_K}=10 THEN 'advisory' ELSE 'mandatory' END modality FROM part")
def x05(spark, sf_dir):
    return lines_of_parts(spark, sf_dir).select("p_partkey", Q.modality(F.col("text")).alias("modality"))


@query(
    "x06_direction",
    f"""SELECT p_partkey, CASE WHEN {_K} IN (1,2,9,10,12,14) THEN '>=' WHEN {_K} IN (7,8,13) THEN '<=' END AS operator,
CASE {_K} WHEN 1 THEN '不得小於' WHEN 2 THEN '不得小於' WHEN 12 THEN '不得小於' WHEN 14 THEN '不得小於' WHEN 9 THEN '至少' WHEN 10 THEN '大於等於' WHEN 7 THEN '不得大於' WHEN 8 THEN '不得超過' WHEN 13 THEN '不得超過' END AS words,
CASE WHEN false THEN '' END AS problem FROM part""",
)
def x06(spark, sf_dir):
    return lines_of_parts(spark, sf_dir).select("p_partkey", Q.direction(F.col("text")).alias("d")).select("p_partkey", "d.operator", "d.words", "d.problem")


@query("x07_postfix_direction", "SELECT p_partkey, CASE p_size%4 WHEN 0 THEN '>=' WHEN 1 THEN '<=' WHEN 2 THEN '<=' END AS operator FROM part")
def x07(spark, sf_dir):
    word = F.element_at(F.array(*[F.lit(w) for w in ("以上", "以下", "以內", "以外")]), (F.col("p_size") % 4 + 1).cast("int"))
    text = F.concat(F.lit("淨距 "), (F.col("p_size") * 10).cast("string"), F.lit(" mm "), word)
    return D.read(spark, sf_dir, "part").select("p_partkey", Q.postfix_direction(text).alias("operator"))


@query("f14_to_mm", f"SELECT p_partkey, (p_size*10)::double mm FROM part WHERE {_K} IN (1,2,12,13) UNION ALL SELECT p_partkey, (p_size*1000)::double FROM part WHERE {_K}=7 UNION ALL SELECT p_partkey, unnest([p_size*10, p_size*10])::double FROM part WHERE {_K}=14 UNION ALL SELECT p_partkey, unnest([1300, 300])::double FROM part WHERE {_K}=15")
def f14(spark, sf_dir):
    q = lines_of_parts(spark, sf_dir).select("p_partkey", F.explode(X.quantities_in(F.col("text"))).alias("q")).where("q.unit <> 'deg'")
    return q.select("p_partkey", Q.to_mm(F.col("q.value"), F.col("q.unit")).alias("mm"))


@query("f16_counts", "SELECT p_partkey, p_size::bigint AS n FROM part")
def f16(spark, sf_dir):
    digits = F.array(*[F.lit(c) for c in ("", *"一二三四五六七八九")])
    at = lambda c: F.element_at(digits, (c + 1).cast("int"))
    tens, ones = F.floor(F.col("p_size") / 10), F.col("p_size") % 10
    word = F.when(tens == 0, at(ones)).otherwise(F.concat(F.when(tens == 1, "").otherwise(at(tens)), F.lit("十"), at(ones)))
    token = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).otherwise(word)
    return D.read(spark, sf_dir, "part").select("p_partkey", Q.count_of(token).cast("long").alias("n"))


@query("f12_number_text", r"SELECT l_orderkey, l_linenumber, regexp_replace(printf('%.6f', (l_extendedprice*l_tax)::double), '\.?0+$', '') AS txt FROM lineitem")
def f12(spark, sf_dir):
    return D.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", Q.fmt_num((F.col("l_extendedprice") * F.col("l_tax")).cast("double")).alias("txt"))


@query(
    "f11_gap_text",
    r"SELECT l_orderkey, l_linenumber, CASE WHEN v>0 AND v<0.005 THEN '<0.01' WHEN abs(v-round_even(v,0))<0.005 THEN round_even(v,0)::bigint::varchar ELSE regexp_replace(printf('%.2f',v),'\.?0+$','') END AS txt FROM (SELECT l_orderkey, l_linenumber, (l_discount*l_tax)::double v FROM lineitem)",
)
def f11(spark, sf_dir):
    return D.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", Q.fmt_gap((F.col("l_discount") * F.col("l_tax")).cast("double")).alias("txt"))


@query("o05_evidence_page", f"WITH {CHUNKS} SELECT document_id, line_start::bigint line_start, CASE WHEN length(txt)>600 THEN substr(txt,1,600)||'…' ELSE txt END preview FROM ch ORDER BY document_id, line_start LIMIT 500")
def o05(spark, sf_dir):
    preview = F.when(F.length("text") > 600, F.concat(F.substring("text", 1, 600), F.lit("…"))).otherwise(F.col("text"))
    return chunks(spark, sf_dir).select("document_id", F.col("line_start").cast("long").alias("line_start"), preview.alias("preview")).orderBy("document_id", "line_start").limit(500)


@query("a22_chunks_by_document", f"WITH {CHUNKS} SELECT document_id, count(*) chunks, sum(length(txt))::bigint chars FROM ch GROUP BY 1")
def a22(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))
