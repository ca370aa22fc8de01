"""Queries over sources and stores: encodings, Word and PDF lines (S4, S5, S6), first import (S2), incremental analysis (T2), lists of handles (A1, A16, A17, W14), touching points (M12), suggestions (F24), pairs of alike."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from conformix.functions import text as X
from conformix.operators import documents as Docs
from conformix.operators import evaluate as E
from conformix.operators import spatial
from conformix.plans import oracle_parts as O
from conformix.plans.queries_evidence import SPEC
from conformix.plans.queries_rules import SCADA, classified
from conformix.plans.queries_runs import NEAR, _gaps
from conformix.plans.queries_text import HEAD, lines_of_parts
from conformix.plans.rules import normalise
from conformix.sources import derived as D
from conformix.sources import documents as Src
from conformix.sources import store
from conformix.sources.tables import materialise, shared_dir
from conformix.streaming import analysis as Inc

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


# -- documents -----------------------------------------------------------------------------------------

_TEXTS = "tx AS (SELECT document_id, string_agg(t, chr(10) ORDER BY rn) AS text FROM sl GROUP BY 1)"


def spec_texts(spark, sf_dir):
    """(document_id, filename, text): every specification as one text, its lines ended in one of three ways."""
    lines = D.spec_lines(spark, sf_dir)
    end = F.element_at(F.array(F.lit("\n"), F.lit("\r\n"), F.lit("\r")), (F.length("document_id") + F.ascii(F.substring("document_id", -1, 1))) % 3 + 1)
    got = lines.groupBy("document_id", "filename").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "text"))), lambda x: x["text"]).alias("ls"))
    return got.select("document_id", "filename", F.array_join("ls", "\n").alias("text"), end.alias("end"), "ls")


@query("s04_decoded_lines", f"WITH {SPEC} SELECT document_id, p_partkey, rn+1 AS line_no, t AS text FROM sl WHERE rn<(SELECT max(rn) FROM sl s2 WHERE s2.document_id=sl.document_id AND s2.t<>'')+1")
def s04(spark, sf_dir):
    """Specifications as bytes of UTF-8, with and without its mark, and of a Chinese encoding, read back line by line."""
    files = spec_texts(spark, sf_dir).select("document_id", "filename", F.array_join("ls", "\n").alias("text"), F.ascii(F.substring("document_id", -1, 1)).alias("k"), "end")
    files = files.withColumn("text", F.replace("text", F.lit("\n"), F.col("end")))

    def encode(batches):
        import pyarrow as pa

        for b in batches:
            text, k = b.column("text").to_pylist(), b.column("k").to_pylist()
            data = [t.encode("cp950") if i % 3 == 0 else (b"\xef\xbb\xbf" if i % 3 == 1 else b"") + t.encode() for t, i in zip(text, k)]
            yield pa.RecordBatch.from_arrays([b.column("document_id"), b.column("filename"), pa.array(data, pa.binary())], ["document_id", "filename", "content"])

    stored = materialise(files.select("document_id", "filename", "text", "k").mapInArrow(encode, "document_id string, filename string, content binary"), "files")
    lines, _ = Src.text_lines(stored)
    keys = D.read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("document_id"))
    from pyspark.sql import Window

    keys = keys.withColumn("line_no", F.row_number().over(Window.partitionBy("document_id").orderBy("p_partkey")))
    return lines.join(keys.hint("merge"), ["document_id", "line_no"]).select("document_id", "p_partkey", F.col("line_no").cast("long").alias("line_no"), "text")


@query("f24_suggested_values", None)
def f24(spark, sf_dir):
    s = lines_of_parts(spark, sf_dir).select("p_partkey", F.posexplode(X.suggest_values(F.col("text"))).alias("at", "v"))
    return s.select("p_partkey", "at", "v.value", "v.unit")


ORACLES["f24_suggested_values"] = f"""WITH {SPEC}, nb AS (SELECT p_partkey, translate(t, '{X._WIDE.replace(chr(39), chr(39) * 2)}', '{X._NARROW.replace(chr(39), chr(39) * 2)}') w FROM sl),
z AS (SELECT p_partkey, w, list_zip(regexp_extract_all(w, r, 1), regexp_extract_all(w, r, 2)) q FROM (SELECT *, '(\\d{{1,3}}(?:,\\d{{3}})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?)\\s*(mm|cm|m|°)(?:[^A-Za-z0-9²³/^·×]|$)' r FROM nb)),
u AS (SELECT p_partkey, CASE WHEN len(q)>0 THEN list_transform(q, lambda x: {{'v': replace(x[1],',','')::double, 'u': replace(x[2],'°','deg')}}) ELSE list_transform(regexp_extract_all(w, '(\\d{{1,3}}(?:,\\d{{3}})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?)', 1), lambda x: {{'v': replace(x,',','')::double, 'u': NULL::varchar}}) END l FROM z)
SELECT p_partkey, (i-1)::int AS at, l[i].v AS value, l[i].u AS unit FROM (SELECT p_partkey, l, unnest(range(1, len(l)+1)) i FROM u)"""


@query(
    "s05_word_chunks",
    f"""WITH {SPEC}, pg AS (SELECT document_id, (rn+1)::int line, CASE WHEN regexp_matches(t, {HEAD}) THEN t WHEN p_partkey%7=0 AND t<>'' THEN t END ti, t FROM sl),
ps AS (SELECT document_id, line, coalesce(last_value(ti IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY line ROWS UNBOUNDED PRECEDING),'') section, t FROM pg)
SELECT document_id, line, section, t AS text FROM ps WHERE t<>'' UNION ALL SELECT p_brand, (100000*(p_size%5+1)+p_partkey)::int, '表格 '||(p_size%5+1)||' 第 '||p_partkey||' 列', CASE WHEN p_type=p_name THEN p_type ELSE p_type||' | '||p_name END||' | '||p_size FROM part""",
)
def s05(spark, sf_dir):
    """Specifications as Word paragraphs, every seventh of which is a heading by its style, and a table row of every part."""
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = D.read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.row_number().over(w).alias("number"))
    p = p.join(lines_of_parts(spark, sf_dir), "p_partkey").select(F.col("p_brand").alias("document_id"), F.lit("x.docx").alias("filename"), "number", F.when(F.col("p_partkey") % 7 == 0, "Heading 2").alias("style"), "text")
    t = D.read(spark, sf_dir, "part").select(F.col("p_brand").alias("document_id"), F.lit("x.docx").alias("filename"), (F.col("p_size") % 5 + 1).cast("int").alias("table_no"), F.col("p_partkey").cast("int").alias("row_no"), F.array("p_type", "p_type", F.lit(" "), "p_name", F.col("p_size").cast("string"), F.lit(None).cast("string")).alias("cells"))
    return Src.word_chunks(p, t).select("document_id", F.col("line_start").alias("line"), "section", "text")


def pdf_pages(spark, sf_dir):
    """Pages of specifications, and two blank pages after every document whose brand ends in an odd figure."""
    lines = D.spec_lines(spark, sf_dir)
    pages = lines.groupBy("document_id", "filename", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    last = pages.groupBy("document_id", "filename").agg(F.max("page").alias("page")).where(F.ascii(F.substring("document_id", -1, 1)) % 2 == 1)
    return pages.unionByName(last.select("document_id", "filename", F.explode(F.array(F.col("page") + 1, F.col("page") + 2)).alias("page"), F.lit(" \n ").alias("text")))


@query(
    "s06_pdf_chunks",
    f"""WITH {SPEC}, sa AS (SELECT *, t='' blank, regexp_matches(t, {HEAD}) head FROM sl), sb AS (SELECT *, coalesce(last_value(CASE WHEN head THEN t END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page, line_no ROWS UNBOUNDED PRECEDING),'') section,
 sum(CASE WHEN blank OR head OR coalesce(ph,false) THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page ORDER BY line_no ROWS UNBOUNDED PRECEDING) island FROM (SELECT *, lag(head) OVER (PARTITION BY document_id, page ORDER BY line_no) ph FROM sa)),
sc AS (SELECT *, (row_number() OVER (PARTITION BY document_id, page, island ORDER BY line_no)-1)//12 part FROM sb WHERE NOT blank) SELECT document_id, page, min(line_no)::int line_start, max(line_no)::int line_end, section FROM sc GROUP BY document_id, page, section, island, part""",
)
def s06(spark, sf_dir):
    lines, _ = Src.page_lines(pdf_pages(spark, sf_dir))
    return Docs.chunk_lines(lines).select("document_id", "page", "line_start", "line_end", "section")


@query("s06_a22_empty_pages", f"WITH {SPEC}, pg AS (SELECT document_id, page, bool_and(t='') blank FROM sl GROUP BY 1, 2), n AS (SELECT document_id, count(*) FILTER (WHERE blank)+CASE WHEN ascii(substr(document_id,-1,1))%2=1 THEN 2 ELSE 0 END n FROM pg GROUP BY 1) SELECT document_id, n::bigint empty_pages, n||' 頁沒有文字層（可能是掃描影像），這些頁無法作為證據；本工具不做 OCR。' warning FROM n WHERE n>0")
def s06_empty(spark, sf_dir):
    return Src.page_lines(pdf_pages(spark, sf_dir))[1]


# -- stores --------------------------------------------------------------------------------------------


@query("s02_first_import", "WITH o AS (SELECT o_orderkey k, o_orderkey//1024 d FROM orders), n AS (SELECT d, count(*) c, count(*) FILTER (WHERE k%50<>7) r FROM o GROUP BY 1) SELECT 'p' AS project, 'dwg-'||d stored_name, CASE WHEN d%2=0 THEN 'first' ELSE 'second' END import, (CASE WHEN d%2=0 THEN c ELSE r END)::bigint cables FROM n WHERE (CASE WHEN d%2=0 THEN c ELSE r END)>0")
def s02(spark, sf_dir):
    """Every second drawing is imported; then all drawings' revisions, of which only those not there yet are kept; then the first ones again."""
    path = f"{shared_dir(spark)}/conformix/store-{uuid.uuid4().hex}"
    number = F.regexp_extract("drawing_key", "([0-9]+)$", 1).cast("long")

    def rows(revised, name):
        e = D.stored_entities(spark, sf_dir, revised).where("layer = 'SCADA-CABLE' AND entity_type = 'LWPOLYLINE'")
        return e.select(F.lit("p").alias("project"), F.col("drawing_key").alias("stored_name"), "seq", "handle", F.lit(name).alias("import"), number.alias("n"))

    for part in (rows(False, "first").where("n % 2 = 0"), rows(True, "second"), rows(False, "third")):
        store.write_drawings(part, path)
    held = store.read_drawings(spark, path, rows(False, "first").schema)
    return held.groupBy("project", "stored_name", "import").agg(F.count("*").alias("cables"))


_LANDED = [c.split(" ")[0] for c in Inc.LANDED.split(", ") if not c.startswith("y:")]


def landed(spark, sf_dir, revised: bool):
    e = D.stored_entities(spark, sf_dir, revised).join(D.drawings(spark, sf_dir), "drawing_key")
    at = 2 if revised else 1
    e = e.withColumns({"run_id": F.concat_ws("@", "drawing_key", F.lit(str(at))), "project": F.lit("p"), "name": F.col("drawing_key"), "at": F.lit(at).cast("long")})
    return e.select(*_LANDED)


@query("t02_incremental_analysis", f"WITH {O.entities()}, {O.entities(True, 'ent2')}, {_gaps('ent', 330)}, {_gaps('ent2', 330)}, sh AS (SELECT b.dk, CASE WHEN abs(a.v-b.v)<1e-6 THEN 'UNCHANGED' ELSE 'NEW' END st FROM ent2r b LEFT JOIN entr a ON a.dk=b.dk AND a.sh=b.sh AND a.th=b.th) SELECT dk||'@1' run_id, NULL::varchar baseline_state, count(*) n FROM entr GROUP BY 1 UNION ALL SELECT dk||'@2', st, count(*) FROM sh GROUP BY 1, 2")
def t02(spark, sf_dir):
    """The drawings land, then their revisions, as files of a stream that reads one batch after another; the second batch comes twice.

    A gap that widens moves the place of its issue, so that it is a new one."""
    base = f"{shared_dir(spark)}/conformix/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"
    for revised in (False, True, True):
        # a batch is many files of whole runs: as one file it would be written by one task
        landed(spark, sf_dir, revised).repartition("run_id").write.mode("append").parquet(f"{base}/in")
        Inc.analyse_stream(spark, f"{base}/in", out, f"{base}/checkpoint", [NEAR], D.SYSTEMS, files_per_batch=None).awaitTermination()
    return Inc.stored_issues(spark, out).where("status <> 'PASS'").groupBy("run_id", "baseline_state").agg(F.count("*").alias("n"))


# -- lists of handles ------------------------------------------------------------------------------------

ev = lambda spark, sf_dir, far=False: E.Evaluator(classified(spark, sf_dir), D.drawings(spark, sf_dir), far_handles=far)


@query("a01_matched_handles", f"WITH {O.entities()}, m AS (SELECT drawing_key, handle, row_number() OVER (PARTITION BY drawing_key ORDER BY seq) n, count(*) OVER (PARTITION BY drawing_key) c FROM ent WHERE layer='TRENCH'), d AS (SELECT DISTINCT drawing_key FROM ent) SELECT d.drawing_key, coalesce(max(c),0)::double measured, coalesce(list(handle ORDER BY n) FILTER (WHERE n<=200), []) handles FROM d LEFT JOIN m USING (drawing_key) GROUP BY 1")
def a01(spark, sf_dir):
    rule = normalise({"id": "N", "subject": {"layer_equals": "TRENCH"}, "measurement": "entity_count", "operator": ">=", "value": 10})
    return ev(spark, sf_dir).rule(rule).select("drawing_key", "measured", F.col("listed_handles").alias("handles"))


@query(
    "a16_violating_handles",
    f"""WITH {O.entities()}, x AS (SELECT s.drawing_key, s.seq ss, t.seq ts, t.handle th FROM ent s JOIN ent t ON s.drawing_key=t.drawing_key AND s.layer='TRENCH' AND t.layer IN ('WATER','SCADA-CABLE','POWER-CABLE') AND t.ax IS NOT NULL AND NOT t.closed AND s.minx<=t.maxx AND t.minx<=s.maxx AND s.miny<=t.maxy AND t.miny<=s.maxy),
n AS (SELECT *, row_number() OVER (PARTITION BY ss ORDER BY ts) r, count(*) OVER (PARTITION BY ss) c FROM x) SELECT drawing_key, ss subject_seq, max(c)::bigint violations, list(th ORDER BY r) FILTER (WHERE r<=20) handles FROM n GROUP BY 1, 2""",
)
def a16(spark, sf_dir):
    """Runs that touch a trench (an upright or level run touches a rectangle where their boxes do; sloping ones are left to r14)."""
    rule = normalise({"id": "T", "subject": {"layer_equals": "TRENCH"}, "target": {"or": [{"layer_equals": x} for x in ("WATER", "SCADA-CABLE", "POWER-CABLE")]}, "measurement": "intersection", "operator": "<=", "value": 0, "quantifier": "all"})
    return ev(spark, sf_dir).rule(rule).where("violations IS NOT NULL").select("drawing_key", "subject_seq", "violations", F.col("listed_handles").alias("handles"))


@query(
    "w14_first_beyond",
    f"""WITH {O.entities()}, s AS (SELECT * FROM ent WHERE layer='POWER-CROSS'), t AS (SELECT * FROM ent WHERE layer='NOGO'), p AS (SELECT s.drawing_key, s.seq ss, t.seq ts, t.handle th, sqrt(pow(greatest(0,greatest(s.minx,t.minx)-least(s.maxx,t.maxx)),2)+pow(greatest(0,greatest(s.miny,t.miny)-least(s.maxy,t.maxy)),2))*s.unit_to_mm d FROM s JOIN t USING (drawing_key)),
n AS (SELECT *, row_number() OVER (PARTITION BY ss ORDER BY ts) r, count(*) OVER (PARTITION BY ss) c FROM p WHERE d>20000+1e-6) SELECT drawing_key, ss subject_seq, max(c)::bigint violations, list(th ORDER BY r) FILTER (WHERE r<=20) handles FROM n GROUP BY 1, 2""",
)
def w14(spark, sf_dir):
    """Zones that lie farther than 20 m from a crossing: how many, and the first twenty (boxes give the distance of an upright line and a rectangle)."""
    rule = normalise({"id": "F", "subject": {"layer_equals": "POWER-CROSS"}, "target": {"layer_equals": "NOGO"}, "measurement": "distance", "operator": "<=", "value": 20000, "quantifier": "all"})
    return ev(spark, sf_dir, True).rule(rule).where("status = 'FAIL'").select("drawing_key", "subject_seq", "violations", F.col("listed_handles").alias("handles"))


@query(
    "a17_component_handles",
    f"""WITH {O.entities()}, m AS (SELECT *, k FROM ent WHERE {SCADA.replace("s.", "")}), g AS (SELECT drawing_key, k, min(seq) root, list(handle ORDER BY seq) h FROM m GROUP BY 1, 2) SELECT drawing_key, count(*)::bigint components, sum(len(h))::bigint entities, list(array_to_string(h, '+') ORDER BY root)[1:50] groups FROM g GROUP BY 1""",
)
def a17(spark, sf_dir):
    """Runs joined at their ends, by drawing: the two runs of a cell meet, cells do not."""
    rule = normalise({"id": "C", "subject": {"system": "SCADA"}, "measurement": "connectivity", "operator": "==", "value": 1, "snap_tolerance_mm": 0.5})
    out = ev(spark, sf_dir).rule(rule).where("groups IS NOT NULL")
    return out.select("drawing_key", F.col("violations").alias("components"), F.col("counted").alias("entities"), F.slice(F.transform("groups", lambda g: F.array_join(g, "+")), 1, 50).alias("groups"))


@query(
    "w01_symmetric_pairs",
    f"""WITH {O.entities()}, p AS (SELECT s.drawing_key, s.seq a, t.seq b, (sqrt(pow(s.cx-t.cx,2)+pow(s.cy-t.cy,2))-180)*s.unit_to_mm v FROM ent s JOIN ent t ON s.drawing_key=t.drawing_key AND s.layer='SUPPORT' AND t.layer='SUPPORT' AND s.seq<t.seq AND abs(s.cx-t.cx)<=180+1000/s.unit_to_mm AND abs(s.cy-t.cy)<=180+1000/s.unit_to_mm)
SELECT drawing_key, a subject_seq, printf('%X', b) target, round(greatest(v,0),3) measured FROM p WHERE greatest(v,0)<400-1e-6""",
)
def w01(spark, sf_dir):
    """Supports closer than 400 mm to each other: subject and target are alike, and each pair is reported once, for the one that is drawn first."""
    rule = normalise({"id": "W", "subject": {"layer_equals": "SUPPORT"}, "target": {"layer_equals": "SUPPORT"}, "measurement": "distance", "operator": ">=", "value": 400})
    return ev(spark, sf_dir).rule(rule).where("status = 'FAIL'").select("drawing_key", "subject_seq", F.get("target_handles", F.lit(0)).alias("target"), "measured")


# -- touching points -------------------------------------------------------------------------------------


@query(
    "m12_touching_points",
    f"""WITH {O.entities()}, z AS (SELECT * FROM ent WHERE layer='TRENCH'),
ed AS (SELECT drawing_key, seq, minx ax, miny ay, maxx bx, miny ye FROM z UNION ALL SELECT drawing_key, seq, maxx, miny, maxx, maxy FROM z UNION ALL SELECT drawing_key, seq, maxx, maxy, minx, maxy FROM z UNION ALL SELECT drawing_key, seq, minx, maxy, minx, miny FROM z),
e AS (SELECT *, least(ax,bx) minx, least(ay,ye) miny, greatest(ax,bx) maxx, greatest(ay,ye) maxy FROM ed),
h AS (SELECT s.drawing_key, s.seq ss, t.seq ts, t.ax=t.bx up, s.ax, s.ay, s.bx, s.ye, t.ax tx, t.ay ty FROM ent s JOIN e t ON s.drawing_key=t.drawing_key AND {SCADA} AND {O.crosses()})
SELECT drawing_key, ss subject_seq, ts target_seq, count(*) points, round(sum(CASE WHEN up THEN CASE WHEN ax=bx THEN NULL ELSE tx END ELSE CASE WHEN ay=ye THEN NULL ELSE ax+(bx-ax)*(ty-ay)/(ye-ay) END END),3) sum_x FROM h GROUP BY 1, 2, 3""",
)
def m12(spark, sf_dir):
    """Where runs touch trenches: a point for every pair of segments that touch."""
    e = classified(spark, sf_dir).join(D.drawings(spark, sf_dir).select("drawing_key", "unit_to_mm"), "drawing_key")
    shape = ("seq", "kind", "points", "closed", "cx", "cy", "radius", "minx", "miny", "maxx", "maxy")
    side = lambda where, n: e.where(where).select("drawing_key", "unit_to_mm", F.struct(*shape).alias(n))
    found = spatial.touching_points(side("system = 'SCADA' AND kind = 'polyline'", "s"), side("layer = 'TRENCH'", "t"), 2000.0)
    return found.select("drawing_key", F.col("s_seq").alias("subject_seq"), F.col("t_seq").alias("target_seq"), F.size("points").cast("long").alias("points"), F.round(F.aggregate("points", F.lit(0.0), lambda a, p: a + p["x"]), 3).alias("sum_x"))
