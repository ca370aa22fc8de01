"""Queries over documents and logs: lines, evidence, search, quantities, scans, redaction, lists (S, X, F, P, J, U, O, L, W)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conformix.functions import text as X
from conformix.operators import documents as Docs
from conformix.sources import derived as D

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


LINES = "ln AS (SELECT doc_id::varchar document_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)),1) line_no FROM documents)"
HEAD = r"'^\s*(#{1,6}\s+.+|\d+(\.\d+)*[\s、.．)]\s*\S.*|第[一二三四五六七八九十百零〇\d]+[章節條款].*|[A-Z]\.\d+(\.\d+)*\s+\S.*)$'"
CHUNKS = f"""{LINES}, a AS (SELECT document_id, line_no, rtrim(t, ' ') t, trim(t, ' ')='' blank, length(trim(t, ' ')) BETWEEN 1 AND 80 AND regexp_matches(trim(t, ' '), {HEAD}) head FROM ln),
b AS (SELECT *, coalesce(last_value(CASE WHEN head THEN trim(regexp_replace(trim(t, ' '),'^#+',''), ' ') END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY line_no ROWS UNBOUNDED PRECEDING),'') section, sum(CASE WHEN blank OR head OR coalesce(ph,false) THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) island FROM (SELECT *, lag(head) OVER (PARTITION BY document_id ORDER BY line_no) ph FROM a)),
c AS (SELECT *, (row_number() OVER (PARTITION BY document_id, island ORDER BY line_no)-1)//12 part FROM b WHERE NOT blank),
ch AS (SELECT document_id, section, min(line_no) line_start, max(line_no) line_end, trim(string_agg(t, chr(10) ORDER BY line_no), ' ') txt FROM c GROUP BY document_id, section, island, part)"""


@query("s04_document_lines", f"WITH {LINES} SELECT document_id, count(*) lines, count(*) FILTER (WHERE trim(t, ' ')='') blank, max(length(t))::bigint longest FROM ln GROUP BY 1")
def s04(spark, sf_dir):
    return D.document_lines(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("lines"), F.count_if(F.trim("text") == "").alias("blank"), F.max(F.length("text")).cast("long").alias("longest"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Docs.chunk_lines(D.document_lines(spark, sf_dir))


@query("x01_evidence_chunks", f"WITH {CHUNKS} SELECT 'EV-'||upper(substr(sha256(document_id||'|1|'||line_start||'|'||sha256(txt)),1,12)) id, document_id, line_start, line_end, section, sha256(txt) hash FROM ch")
def x01(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", "document_id", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "section", "hash")


@query("p14_evidence_search", f"WITH {CHUNKS} SELECT document_id, line_start FROM ch WHERE contains(regexp_replace(lower(txt||section),'\\s+','','g'),'rights') AND contains(regexp_replace(lower(txt||section),'\\s+','','g'),'the')")
def p14(spark, sf_dir):
    return Docs.search(chunks(spark, sf_dir), "Rights THE").select("document_id", F.col("line_start").cast("long").alias("line_start"))


@query("f03_norm_text", r"""SELECT doc_id, md5(regexp_replace(lower(text),'[\s,.;:、，。；：()"''「」『』《》\-_/]+','','g')) h FROM documents""")
def f03(spark, sf_dir):
    return D.read(spark, sf_dir, "documents").select("doc_id", F.md5(X.norm_text(F.col("text")).cast("binary")).alias("h"))


@query("f04_numbers_in", r"""SELECT doc_id, len(n) n, round(list_sum(n),4) total FROM (SELECT doc_id, [replace(x,',','')::double for x in regexp_extract_all(text,'(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)',1)] n FROM documents) WHERE len(n)>0""")
def f04(spark, sf_dir):
    out = D.read(spark, sf_dir, "documents").select("doc_id", X.numbers_in(F.col("text")).alias("x")).where(F.size("x") > 0)
    return out.select("doc_id", F.size("x").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


def lines_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, text): each specification line with the part that it was made from."""
    p = D.read(spark, sf_dir, "part").withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    keyed = p.select("p_partkey", F.col("p_brand").alias("document_id"), (F.floor(F.col("rank") / 40) + 1).cast("int").alias("page"), (F.col("rank") % 40 + 1).cast("int").alias("line_no"))
    return D.spec_lines(spark, sf_dir).join(keyed, ["document_id", "page", "line_no"]).select("p_partkey", "text")


_Q = "p_size*10"


@query(
    "f05_quantities_in",
    f"""SELECT p_partkey, v AS value, u AS unit FROM (
SELECT p_partkey, {_Q}::double v, 'mm' u FROM part WHERE p_partkey%16 IN (1,12,13,14) UNION ALL SELECT p_partkey, {_Q}::double, 'mm' FROM part WHERE p_partkey%16=14 UNION ALL SELECT p_partkey, p_size::double, 'cm' FROM part WHERE p_partkey%16=2
UNION ALL SELECT p_partkey, p_size::double, 'm' FROM part WHERE p_partkey%16=7 UNION ALL SELECT p_partkey, (p_size%5+1)::double, 'deg' FROM part WHERE p_partkey%16=8 UNION ALL SELECT p_partkey, 1300.0, 'mm' FROM part WHERE p_partkey%16=15 UNION ALL SELECT p_partkey, 300.0, 'mm' FROM part WHERE p_partkey%16=15)""",
)
def f05(spark, sf_dir):
    return lines_of_parts(spark, sf_dir).select("p_partkey", F.explode(X.quantities_in(F.col("text"))).alias("q")).select("p_partkey", "q.value", "q.unit")


@query("f06_is_heading", "SELECT p_brand document_id, count(*) FILTER (WHERE p_partkey%16=0) headings, count(*) lines FROM part GROUP BY 1")
def f06(spark, sf_dir):
    return D.spec_lines(spark, sf_dir).groupBy("document_id").agg(F.count_if(X.is_heading(F.col("text"))).alias("headings"), F.count("*").alias("lines"))


@query("f08_quote_boundaries", "SELECT p_partkey, coalesce(CASE WHEN p_partkey%16 IN (1,12,13,14) THEN p_size*10=300 WHEN p_partkey%16=15 THEN true ELSE false END, false) AS exact FROM part")
def f08(spark, sf_dir):
    """Every line of the specifications: 300 mm is quoted as itself and in full-width letters, not as the end of 1,300 mm."""
    return lines_of_parts(spark, sf_dir).select("p_partkey", X.contains_quote(F.col("text"), F.lit("３００ mm")).alias("exact"))


@query("f10_number_format", r"SELECT l_orderkey, l_linenumber, CASE WHEN abs(v-round_even(v,0))<0.005 THEN round_even(v,0)::bigint::varchar ELSE regexp_replace(printf('%.2f',v),'\.?0+$','') END AS txt FROM (SELECT l_orderkey, l_linenumber, (l_quantity*l_discount)::double v FROM lineitem)")
def f10(spark, sf_dir):
    return D.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.fmt((F.col("l_quantity") * F.col("l_discount")).cast("double")).alias("txt"))


@query("f17_safe_cell", "SELECT doc_id, CASE WHEN substr(s,1,1) IN ('=','+','-','@') THEN ''''||s ELSE s END AS cell FROM (SELECT doc_id, CASE doc_id%4 WHEN 0 THEN '='||source WHEN 1 THEN '-'||source WHEN 2 THEN source ELSE '@'||source END s FROM documents)")
def f17(spark, sf_dir):
    sign = F.element_at(F.array(F.lit("="), F.lit("-"), F.lit(""), F.lit("@")), (F.col("doc_id") % 4 + 1).cast("int"))
    return D.read(spark, sf_dir, "documents").select("doc_id", X.safe_cell(F.concat(sign, F.col("source"))).alias("cell"))


def spec_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = D.read(spark, sf_dir, "documents")
    base = d.select("doc_id", F.lit("root").alias("root"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("rel_path"), F.col("n_chars").alias("size_bytes"), F.lit(1).cast("long").alias("mtime_ns"), F.sha2("text", 256).alias("sha256"))
    k = F.col("doc_id")
    changed, touched = k % 11 == 0, k % 13 == 0
    # u04 compares two states: files of every seventh id are gone from the folder, those of every fifth are new to the store
    found = base.where(k % 7 != 0).withColumns({"size_bytes": F.when(changed, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")), "mtime_ns": F.when(changed | touched, F.lit(2)).otherwise(F.lit(1)).cast("long"), "sha256": F.when(changed, F.sha2(F.concat("sha256", F.lit("x")), 256)).otherwise(F.col("sha256"))})
    return found, base.where(k % 5 != 0)


@query("u04_scan_diff", "SELECT action, count(*) n FROM (SELECT CASE WHEN doc_id%5=0 THEN 'new' WHEN doc_id%7=0 THEN 'removed' WHEN doc_id%11=0 THEN 'reparsed' WHEN doc_id%13=0 THEN 'touched' ELSE 'reused' END AS action FROM documents WHERE NOT (doc_id%5=0 AND doc_id%7=0)) GROUP BY 1")
def u04(spark, sf_dir):
    return Docs.scan_diff(*spec_files(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("n"))


@query("u04_orphaned_documents", "SELECT doc_id AS document_id FROM documents WHERE doc_id%5<>0 AND doc_id%4<>1 AND (doc_id%7=0 OR doc_id%11=0)")
def u04_orphans(spark, sf_dir):
    """Documents of files that are gone or changed: those that a scan made, and that no file refers to any more."""
    k = F.col("doc_id")
    stored = D.read(spark, sf_dir, "documents").where(k % 5 != 0).select(k.cast("string").alias("d"), (k % 4 != 1).alias("created_document"), "doc_id").select(F.col("d").alias("document_id"), "created_document", "doc_id")
    after = stored.where((k % 7 != 0) & (k % 11 != 0)).unionByName(stored.where((k % 7 != 0) & (k % 11 == 0)).withColumn("document_id", F.concat("document_id", F.lit("-new"))))
    return Docs.orphans(stored, after).select(F.col("document_id").cast("long").alias("document_id"))


@query("j25_content_duplicates", "SELECT source||'/'||doc_id rel_path, min(source||'/'||doc_id) OVER (PARTITION BY sha256(text)) AS \"first\" FROM documents")
def j25(spark, sf_dir):
    files = D.read(spark, sf_dir, "documents").select(F.lit("root").alias("root"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("rel_path"), F.sha2("text", 256).alias("sha256"))
    return Docs.first_of_content(files).select("rel_path", "first")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    head = F.lit("2024-01-01 00:00:00 ")
    path = F.concat(F.lit("/srv/data/projects/p_"), F.lpad(F.lower(F.hex("event_id")), 16, "0"), F.lit("/drawings/f"), F.col("event_id").cast("string"), F.lit(".dxf"))
    first = F.when(F.col("event_type") == "error", F.concat(head, F.lit("ERROR worker said: ValueError: bad "), F.col("event_id").cast("string"))).when(F.col("event_type") == "click", F.concat(head, F.lit("INFO open "), path)).otherwise(F.concat(head, F.lit("INFO "), F.col("event_type")))
    more = F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), F.array(first, F.lit("  detail of the failure"))).otherwise(F.array(first))
    return e.select("user_id", "event_id", F.posexplode(more).alias("i", "line"))


_LOG = "SELECT event_id, CASE event_type WHEN 'error' THEN '2024-01-01 00:00:00 ERROR worker said: ValueError: <內容已省略>' WHEN 'click' THEN '2024-01-01 00:00:00 INFO open <data>/projects/p_'||lpad(printf('%x', event_id),16,'0')||'/drawings/<file>' ELSE '2024-01-01 00:00:00 INFO '||event_type END line FROM events"


@query("l01_l02_log_redaction", _LOG)
def l01(spark, sf_dir):
    # a record is one event, so continuations are dropped within it
    kept = Docs.drop_continuations(log_lines(spark, sf_dir), "event_id", "i")
    return Docs.scrub(Docs.redact(kept), {"/srv/data": "<data>", "/srv": "<app>"}).select("event_id", "line")


@query("o02_paging", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100 OFFSET 50")
def o02(spark, sf_dir):
    return D.read(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(50).limit(100)


@query("a22_documents_by_source", "SELECT source, count(*) documents, count(*) FILTER (WHERE trim(text, ' ')='') empty, sum(n_chars)::bigint chars FROM documents GROUP BY 1")
def a22(spark, sf_dir):
    return D.read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.trim("text") == "").alias("empty"), F.sum("n_chars").alias("chars"))
