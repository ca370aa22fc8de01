"""Queries that lead from rules to the evidence they rest on (J12, R19, R20), over quotes, numbers and rules made of specification lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from conformix.functions import text as X
from conformix.operators import documents as Docs
from conformix.operators import evidence as Ev
from conformix.plans.queries_candidates import once
from conformix.plans.queries_text import HEAD, lines_of_parts
from conformix.sources import derived as D

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


# -- specification lines and their chunks as SQL -----------------------------------------------------

_FILL = {"s": "p_size", "v": "p_size*10", "c": "p_size", "d": "p_size%5+1", "n": "p_size%9+1"}


def _line(text: str) -> str:
    out = "'" + text + "'"
    for name, value in _FILL.items():
        out = out.replace("{" + name + "}", f"'||({value})::bigint||'")
    return out


SPEC = f"""sl AS (SELECT *, (rn//40+1)::int page, (rn%40+1)::int line_no, CASE p_partkey%16 {" ".join(f"WHEN {i} THEN {_line(t)}" for i, (t,) in enumerate(D.SPEC_TEMPLATES))} END t
 FROM (SELECT p_partkey, p_brand document_id, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)-1 rn FROM part))"""
SPEC_CHUNKS = f"""{SPEC}, sa AS (SELECT *, t='' blank, regexp_matches(t, {HEAD}) AND length(t) BETWEEN 1 AND 80 head FROM sl),
sb AS (SELECT *, sum(CASE WHEN blank OR head OR coalesce(ph,false) THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page ORDER BY line_no ROWS UNBOUNDED PRECEDING) island FROM (SELECT *, lag(head) OVER (PARTITION BY document_id, page ORDER BY line_no) ph FROM sa)),
sc AS (SELECT *, (row_number() OVER (PARTITION BY document_id, page, island ORDER BY line_no)-1)//12 part FROM sb WHERE NOT blank),
ck AS MATERIALIZED (SELECT document_id, page, min(line_no)::int line_start, max(line_no)::int line_end, string_agg(t, chr(10) ORDER BY line_no) txt FROM sc GROUP BY document_id, page, island, part)"""


def norm_sql(t: str) -> str:
    return f"regexp_replace(lower(translate({t}, '{X._WIDE.replace(chr(39), chr(39) * 2)}', '{X._NARROW.replace(chr(39), chr(39) * 2)}')), '\\s+', '', 'g')"


def holds_sql(n: str, q: str) -> str:
    """Text n holds quote q, which neither begins nor ends inside a larger number."""
    head, tail = r"(^|[^0-9.,]|(^|[^0-9])[.,])", r"($|[^0-9.,]|[.,]($|[^0-9]))"
    return f"contains({n}, {q}) AND regexp_matches({n}, CASE WHEN regexp_matches({q}, '^[0-9]') THEN '{head}' ELSE '' END||regexp_escape({q})||CASE WHEN regexp_matches({q}, '[0-9]$') THEN '{tail}' ELSE '' END)"


def chunks(spark, sf_dir):
    return once(spark, sf_dir, "spec-chunks", lambda: Docs.chunk_lines(D.spec_lines(spark, sf_dir)))


ORDER = ["document_id", "page", "line_start"]

# -- quotes --------------------------------------------------------------------------------------------


def quotes(spark, sf_dir):
    """(p_partkey, quote, document): whole lines, in one file or any; bare numbers; a clause in another case of the file's name."""
    p = D.read(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") * 10).cast("string").alias("v"))
    k = F.col("p_partkey") % 4
    q = F.when(k < 2, F.col("text")).when(k == 2, F.concat("v", F.lit(" mm"))).otherwise(F.concat(F.lit("水平淨距不得小於 "), "v", F.lit(" mm")))
    file = F.when(k == 0, F.concat("p_brand", F.lit(".md"))).when(k == 3, F.concat(F.upper("p_brand"), F.lit(".MD")))
    return p.join(lines_of_parts(spark, sf_dir), "p_partkey").select("p_partkey", q.alias("quote"), file.alias("document"))


_QUOTES = """qt AS (SELECT p_partkey, CASE WHEN p_partkey%4<2 THEN t WHEN p_partkey%4=2 THEN (p_size*10)::bigint||' mm' ELSE '水平淨距不得小於 '||(p_size*10)::bigint||' mm' END quote, CASE WHEN p_partkey%4 IN (0,3) THEN document_id END doc FROM sl)"""
_FOUND = f"""{SPEC_CHUNKS}, {_QUOTES}, qn AS MATERIALIZED (SELECT DISTINCT quote, doc, {norm_sql("quote")} q FROM qt), cn AS MATERIALIZED (SELECT *, {norm_sql("txt")} n FROM ck),
mt AS MATERIALIZED (SELECT quote, qn.doc, q, n, document_id, page, line_start FROM qn JOIN cn ON (qn.doc IS NULL OR qn.doc=cn.document_id) AND q<>'' AND contains(n, q)),
fd AS (SELECT quote, doc, min({{'document_id': document_id, 'page': page, 'line_start': line_start}}) o FROM mt WHERE {holds_sql("n", "q")} GROUP BY 1, 2)"""


@query("j12_evidence_resolution", f"WITH {_FOUND} SELECT p_partkey, (o).document_id AS document_id, (o).page AS page, (o).line_start AS line_start FROM qt LEFT JOIN fd ON fd.quote=qt.quote AND fd.doc IS NOT DISTINCT FROM qt.doc")
def j12(spark, sf_dir):
    """For a quote made of every part, the first chunk that holds it."""
    asked, ev = quotes(spark, sf_dir), chunks(spark, sf_dir)
    found = Ev.resolve_quotes(asked.select("quote", "document"), ev, ORDER).join(ev.select("id", *ORDER).hint("merge"), "id")
    same = F.col("a.quote").eqNullSafe(F.col("f.quote")) & F.col("a.document").eqNullSafe(F.col("f.document"))
    return asked.alias("a").join(found.alias("f").hint("merge"), same, "left").select("p_partkey", *ORDER)


# -- numbers -------------------------------------------------------------------------------------------

MEASURES = ("horizontal_clearance", "length", "off_axis_angle", "intersection")


def numbered(spark, sf_dir):
    """(p_partkey, text, measurement, value, unit): a rule's number beside every line."""
    p = D.read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("s"))
    k = F.floor(F.col("p_partkey") / 16) % 4
    pick = lambda *v: F.element_at(F.array(*v), (k + 1).cast("int"))
    value = pick(F.col("s") * 10.0, F.col("s") * 100.0, F.col("s") % 5 + 1.0, F.lit(0.0))
    return lines_of_parts(spark, sf_dir).join(p, "p_partkey").select("p_partkey", "text", pick(*map(F.lit, MEASURES)).alias("measurement"), value.alias("value"), pick(*map(F.lit, ("mm", "cm", "deg", "count"))).alias("unit"))


_WRITTEN = r"((\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(mm|cm|m|°))(?:[^A-Za-z0-9²³/^·×]|$)"
_NUMBERED = f"""{SPEC}, nb AS (SELECT *, p_partkey//16%4 g, ['horizontal_clearance','length','off_axis_angle','intersection'][(p_partkey//16%4+1)::int] measurement, [p_size*10, p_size*100, p_size%5+1, 0][(p_partkey//16%4+1)::int]::double v, ['mm','cm','deg','count'][(p_partkey//16%4+1)::int] u,
 translate(t, '{X._WIDE.replace(chr(39), chr(39) * 2)}', '{X._NARROW.replace(chr(39), chr(39) * 2)}') w FROM sl),
qs AS (SELECT *, list_zip(regexp_extract_all(w, '{_WRITTEN}', 1), regexp_extract_all(w, '{_WRITTEN}', 2), regexp_extract_all(w, '{_WRITTEN}', 3)) z FROM nb),
kn AS (SELECT *, list_filter(z, lambda x: (x[3]='°')=(g=2)) same, v*CASE g WHEN 1 THEN 10 ELSE 1 END want FROM qs),
am AS (SELECT p_partkey, g, v::bigint||' '||u rule, CASE WHEN g=3 THEN '' WHEN len(same)=0 THEN '規範證據文字沒有帶單位的數值，無法佐證規則數值 '||v::bigint||' '||u
 WHEN len(list_filter(same, lambda x: abs(replace(x[2],',','')::double*CASE x[3] WHEN 'm' THEN 1000 WHEN 'cm' THEN 10 ELSE 1 END-want)<=1e-9*greatest(1,want)))>0 THEN ''
 ELSE '規範證據中的數值（'||array_to_string(list_transform(same[1:4], lambda x: x[1]),'、')||'）與規則數值 '||v::bigint||' '||u||' 不一致' END amiss FROM kn)"""


@query("r20_evidence_numbers", f"WITH {_NUMBERED} SELECT p_partkey, amiss FROM am")
def r20(spark, sf_dir):
    return numbered(spark, sf_dir).select("p_partkey", Ev.number_problem(F.col("measurement"), F.col("value"), F.col("unit"), F.col("text")).alias("amiss"))


# -- confidence ----------------------------------------------------------------------------------------


def confident(spark, sf_dir):
    """A rule of every part, with a result in one drawing; each rule quotes its part's line, but every seventh quotes nothing."""
    n = numbered(spark, sf_dir)
    k = F.col("p_partkey")
    rules = n.select(
        F.concat(F.lit("P"), k.cast("string")).alias("rule_id"), "measurement", F.lit(">=").alias("required_op"), F.col("value").alias("required_value"), "unit", F.lit("FAIL").alias("severity"), F.lit("").alias("rule_name"),
        F.lit(None).cast("string").alias("evidence_id"), F.when((k % 7 != 0) & (F.col("text") != ""), F.col("text")).alias("quote"), F.lit(None).cast("string").alias("document"),
    )
    d = D.drawings(spark, sf_dir)
    held = d.count()
    results = n.select(F.concat(F.lit("P"), k.cast("string")).alias("rule_id"), F.concat(F.lit("dwg-"), (k % held).cast("string")).alias("drawing_key"), F.when(k % 5 == 0, "UNKNOWN").when(k % 5 == 1, "FAIL").otherwise("PASS").alias("status"))
    return Ev.with_confidence(results, Ev.linked(rules, chunks(spark, sf_dir), ORDER), d)


@query(
    "r19_confidence",
    f"""WITH {_NUMBERED}, dr AS (SELECT DISTINCT o_orderkey//1024 n FROM orders), nd AS (SELECT count(*) c FROM dr),
cf AS (SELECT 'P'||am.p_partkey rule_id, am.p_partkey%c dn, am.p_partkey%5=0 un, CASE WHEN am.p_partkey%7=0 OR t='' THEN '規則未連結到已匯入的規範證據' WHEN amiss<>'' THEN amiss END a1, CASE WHEN g IN (0,1) AND (am.p_partkey%c)%7=2 AND am.p_partkey%c IN (SELECT n FROM dr) THEN '圖面未宣告單位（$INSUNITS），以 mm 推定' END a2, g<>3 numeric FROM am JOIN sl USING (p_partkey), nd)
SELECT rule_id, 'dwg-'||dn drawing_key, CASE WHEN un THEN 'UNKNOWN' WHEN a1 IS NULL AND a2 IS NULL THEN 'CONFIRMED' ELSE 'INFERRED' END confidence,
CASE WHEN un THEN '資料不足，無法判定' WHEN a1 IS NULL AND a2 IS NULL THEN CASE WHEN numeric THEN '規範原文含相同的數值與單位（比較方向與適用對象仍需人工確認）' ELSE '已連結規範原文（此類規則沒有數值可與原文比對；適用對象與方向仍需人工確認）' END ELSE concat_ws('|', a1, a2) END reasons FROM cf""",
)
def r19(spark, sf_dir):
    return confident(spark, sf_dir).select("rule_id", "drawing_key", "confidence", F.array_join("confidence_reasons", "|").alias("reasons"))
