"""Queries that lead from words to layers (J19, J20, V1, U3, A26, F26), over layers, systems, glossaries and terms made of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from conformix.operators import mapping as M
from conformix.plans.queries_candidates import once
from conformix.sources import derived as D

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


# The same texts for Spark and for the oracle: k is p_partkey, n its tens, and || joins strings in both.
_N = "(p_partkey div 30)"
PROJECT = "'M' || (p_partkey % 5)"
LAYER = f"CASE p_partkey % 6 WHEN 0 THEN 'SCADA-' || {_N} WHEN 1 THEN 'COMM-' || {_N} WHEN 2 THEN 'POWER-LV' || {_N} WHEN 3 THEN 'PIPE ' || {_N} WHEN 4 THEN 'TRENCH_' || {_N} ELSE 'X' || {_N} || '.dwg' END"
CONCEPT = f"CASE p_partkey % 3 WHEN 0 THEN '管線' || {_N} WHEN 1 THEN '弱電電纜' || {_N} ELSE '電力' END"
PATTERNS = [f"CASE p_partkey % 3 WHEN 0 THEN 'PIPE ' || {_N} WHEN 1 THEN 'comm-' || ({_N} % 10) || '?' ELSE '' END", f"CASE p_partkey % 3 WHEN 0 THEN 'TRENCH_' || {_N} || '*' WHEN 1 THEN '*-[1-3]' || ({_N} % 10) ELSE '' END"]
TERM = f"""CASE p_partkey % 10 WHEN 0 THEN 'SCADA-' || {_N} WHEN 1 THEN 'scada' WHEN 2 THEN '管線' || {_N} WHEN 3 THEN '弱電電纜' || {_N} WHEN 4 THEN '管線' || {_N} || '、弱電電纜' || {_N} WHEN 5 THEN 'COMM/trench'
WHEN 6 THEN 'nothing' || p_partkey WHEN 7 THEN 'PIPE ' || {_N} || '/管線' || {_N} WHEN 8 THEN '弱電' ELSE 'SYS' || (p_partkey - p_partkey % 50 + p_partkey % 5) || ' 系統' END"""
SYSTEMS = [("SCADA", "^SCADA-"), ("弱電", "^(SCADA|COMM)-"), ("TRENCH", "^TRENCH"), ("POWER", "^POWER"), ("COMM 通信", "^COMM"), ("NONE", "^NOPE")]


def _duck(sql: str) -> str:
    return sql.replace("(p_partkey div 30)", "(p_partkey//30)")



def context(spark, sf_dir) -> M.Context:
    p = D.read(spark, sf_dir, "part")
    layers = once(spark, sf_dir, "layers", lambda: p.selectExpr(f"{PROJECT} AS project", f"{LAYER} AS layer").distinct())
    base = layers.select("project").distinct().select("project", F.posexplode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(r).alias("layer_regex")) for n, r in SYSTEMS])).alias("pos", "s"))
    more = p.where("p_partkey % 50 < 5").selectExpr(f"{PROJECT} AS project", f"CAST(p_partkey + {len(SYSTEMS)} AS INT) AS pos", "'SYS' || p_partkey AS name", f"'-' || {_N} || '$' AS layer_regex")
    systems = once(spark, sf_dir, "systems", lambda: base.select("project", "pos", "s.name", "s.layer_regex").unionByName(more))
    rows = p.selectExpr(f"{PROJECT} AS project", f"{CONCEPT} AS concept", "CAST(p_partkey AS INT) AS pos", f"filter(array({', '.join(PATTERNS)}), x -> x <> '') AS patterns")
    own = rows.groupBy("project", "concept").agg(F.min("pos").alias("pos"), F.max_by("patterns", "pos").alias("patterns"))
    return M.Context(layers, systems, once(spark, sf_dir, "glossary", lambda: M.effective_glossary(layers, own)))


_DEFAULTS = " UNION ALL ".join(f"SELECT '{c}' concept, {i - len(M.DEFAULT_GLOSSARY)} pos, {p} patterns" for i, (c, p) in enumerate(M.DEFAULT_GLOSSARY.items()))
_CONTEXT = _duck(
    f"""ly AS MATERIALIZED (SELECT DISTINCT {PROJECT} project, {LAYER} layer FROM part),
sy AS MATERIALIZED (SELECT project, pos, name, rx FROM (SELECT DISTINCT project FROM ly), (VALUES {", ".join(f"({i},'{n}','{r}')" for i, (n, r) in enumerate(SYSTEMS))}) v(pos, name, rx) UNION ALL SELECT {PROJECT}, p_partkey+{len(SYSTEMS)}, 'SYS'||p_partkey, '-'||{_N}||'$' FROM part WHERE p_partkey%50<5),
ow AS (SELECT project, concept, min(pos) pos, max_by(patterns, pos) patterns FROM (SELECT {PROJECT} project, {CONCEPT} concept, p_partkey pos, list_filter([{", ".join(PATTERNS)}], lambda x: x<>'') patterns FROM part) GROUP BY 1, 2),
df AS (SELECT project, d.* FROM (SELECT DISTINCT project FROM ly), ({_DEFAULTS}) d),
gl AS MATERIALIZED (SELECT coalesce(df.project, ow.project) project, coalesce(df.concept, ow.concept) concept, coalesce(df.pos, ow.pos) pos, coalesce(ow.patterns, df.patterns) patterns FROM df FULL JOIN ow ON ow.project=df.project AND ow.concept=df.concept WHERE len(coalesce(ow.patterns, df.patterns))>0),
gp AS MATERIALIZED (SELECT DISTINCT project, lower(unnest(patterns)) pat, unnest(patterns) pattern FROM gl), gm AS MATERIALIZED (SELECT gp.project, pattern, layer FROM gp JOIN ly ON ly.project=gp.project AND lower(layer) GLOB pat),
sl AS MATERIALIZED (SELECT sy.project, name, pos, list(layer ORDER BY layer) layers FROM sy JOIN ly ON ly.project=sy.project AND regexp_matches(layer, rx, 'i') GROUP BY 1, 2, 3),
cl AS MATERIALIZED (SELECT project, concept, pos, list(layer ORDER BY layer) layers FROM (SELECT DISTINCT g.project, concept, pos, layer FROM (SELECT project, concept, pos, unnest(patterns) pattern FROM gl) g JOIN gm ON gm.project=g.project AND gm.pattern=g.pattern) GROUP BY 1, 2, 3)"""
)


@query("j20_glossary_layers", f"WITH {_CONTEXT} SELECT project, pattern, layer FROM gm")
def j20(spark, sf_dir):
    """Every wildcard pattern of a project's glossary with the layers that it matches."""
    c = context(spark, sf_dir)
    return M.layers_of_patterns(c.glossary.select("project", F.explode("patterns").alias("pattern")), c.layers)


@query("f26_effective_glossary", f"WITH {_CONTEXT} SELECT project, concept, array_to_string(patterns, ', ') patterns FROM gl")
def f26(spark, sf_dir):
    return context(spark, sf_dir).glossary.select("project", "concept", F.array_join("patterns", ", ").alias("patterns"))


_LINE = "CASE p_partkey % 6 WHEN 0 THEN ' 管線' || (p_partkey % 9) || ' = PIPE，TRENCH_*、 ' WHEN 1 THEN '# 電力 = none' WHEN 2 THEN '' WHEN 3 THEN '弱電' || (p_partkey % 4) || '=COMM-?, SCADA-[1-3]' || p_size WHEN 4 THEN '通信' || (p_partkey % 5) || ' =' ELSE 'no sign ' || p_partkey END"


@query(
    "f26_glossary_text",
    f"""WITH ln AS (SELECT 'G'||(p_partkey//60) project, p_partkey, {_LINE} l FROM part), e AS (SELECT project, p_partkey, trim(split_part(l, '=', 1)) concept, substr(l, strpos(l,'=')+1) rest FROM ln WHERE trim(l)<>'' AND NOT starts_with(trim(l), '#') AND contains(l, '=')),
g AS (SELECT project, concept, max_by(rest, p_partkey) rest FROM e WHERE concept<>'' GROUP BY 1, 2) SELECT project, concept, coalesce(array_to_string(list_filter(list_transform(string_split(replace(replace(rest,'，',','),'、',','), ','), lambda x: trim(x)), lambda x: x<>''), ','),'') patterns FROM g""",
)
def f26_text(spark, sf_dir):
    """Glossary texts of sixty lines, read into concepts."""
    p = D.read(spark, sf_dir, "part").selectExpr("'G' || (p_partkey div 60) AS project", "p_partkey", f"{_LINE} AS line")
    texts = p.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return M.parse_glossary(texts).select("project", "concept", F.array_join("patterns", ",").alias("patterns"))


@query(
    "a26_selector_layers",
    _duck(
        f"""WITH {_CONTEXT}, sc AS (SELECT DISTINCT {PROJECT} project, p_partkey%4 g, CASE p_partkey%4 WHEN 0 THEN 'SYS'||p_partkey WHEN 1 THEN 'SCADA' ELSE lower({LAYER}) END v FROM part),
h AS (SELECT sc.project, g, v, layer FROM sc JOIN sy ON sy.project=sc.project AND sy.name=v AND g<2 LEFT JOIN ly ON ly.project=sc.project AND regexp_matches(layer, rx, 'i') UNION SELECT sc.project, g, v, layer FROM sc JOIN ly ON ly.project=sc.project AND g>=2 AND lower(layer)=v)
SELECT sc.project, CASE WHEN sc.g<2 THEN 'system' WHEN sc.g=2 THEN 'layer' ELSE 'layers' END kind, sc.v AS first_value, coalesce(string_agg(layer, '|' ORDER BY layer),'') layers, count(h.v)>0 valid FROM sc LEFT JOIN h ON h.project=sc.project AND h.g=sc.g AND h.v=sc.v GROUP BY ALL"""
    ),
)
def a26(spark, sf_dir):
    """What selectors made of parts cover: systems, a layer in small letters, a layer and one that no drawing has."""
    v = f"CASE p_partkey % 4 WHEN 0 THEN 'SYS' || p_partkey WHEN 1 THEN 'SCADA' ELSE lower({LAYER}) END"
    kind = "CASE p_partkey % 4 WHEN 0 THEN 'system' WHEN 1 THEN 'system' WHEN 2 THEN 'layer' ELSE 'layers' END"
    s = D.read(spark, sf_dir, "part").selectExpr(f"{PROJECT} AS project", f"named_struct('kind', {kind}, 'values', CASE WHEN p_partkey % 4 = 3 THEN array({v}, 'no such layer') ELSE array({v}) END) AS selector")
    out = M.selector_layers(s, context(spark, sf_dir))
    return out.select("project", "selector.kind", F.get("selector.values", F.lit(0)).alias("first_value"), F.array_join("layers", "|").alias("layers"), "valid")


def norm_text_sql(t: str) -> str:
    return rf"""regexp_replace(lower({t}),'[\s,.;:、，。；：()"''「」『』《》\-_/]+','','g')"""


_RESOLVED = _duck(
    f"""{_CONTEXT}, nm AS MATERIALIZED (SELECT project, 0 rnk, 0 pos, layer nam, 'layer' kind, layer vals, [layer] layers FROM ly UNION ALL SELECT project, 1, pos, name, 'system', name, layers FROM sl
 UNION ALL SELECT project, 2, pos, concept, CASE WHEN len(layers)=1 THEN 'layer' ELSE 'layers' END, array_to_string(list_sort(list_transform(layers, lambda x: lower(x)||chr(1)||x)), chr(2)), layers FROM cl),
nn AS MATERIALIZED (SELECT * REPLACE (CASE WHEN rnk=2 THEN array_to_string(list_transform(string_split(vals, chr(2)), lambda x: split_part(x, chr(1), 2)), '|') ELSE vals END AS vals), {norm_text_sql("nam")} n FROM nm),
tm AS MATERIALIZED (SELECT DISTINCT {PROJECT} project, {TERM} txt FROM part),
tk AS MATERIALIZED (SELECT *, {norm_text_sql("tok")} tn FROM (SELECT project, txt, trim(unnest(string_split(replace(txt,'/','、'),'、'))) tok, generate_subscripts(string_split(replace(txt,'/','、'),'、'),1) a FROM tm)),
hit AS (SELECT tk.project, txt, a, CASE WHEN n=tn THEN 0 ELSE 1 END tier, rnk, pos, kind, vals, layers FROM tk JOIN nn ON nn.project=tk.project AND (n=tn OR (rnk>0 AND length(n)>=2 AND length(tn)>=2 AND (contains(n, tn) OR contains(tn, n))))),
tr AS (SELECT project, txt, a, min(tier) tier FROM hit GROUP BY 1, 2, 3),
st AS (SELECT h.project, h.txt, h.a, layers, min({{'o': rnk<>1, 'r': rnk, 'p': pos, 'k': kind, 'v': vals}}) f FROM hit h JOIN tr ON tr.project=h.project AND tr.txt=h.txt AND tr.a=h.a AND tr.tier=h.tier GROUP BY 1, 2, 3, 4),
ct AS (SELECT project, txt, a, count(*) sets, any_value(f) f, any_value(layers) layers FROM st GROUP BY 1, 2, 3),
al AS (SELECT tk.project, tk.txt, tk.a, coalesce(sets,0) sets, f, layers FROM tk LEFT JOIN ct ON ct.project=tk.project AND ct.txt=tk.txt AND ct.a=tk.a),
rs AS (SELECT project, txt, min(CASE WHEN sets<>1 THEN a*10+CASE WHEN sets=0 THEN 0 ELSE 1 END END) bad, count(DISTINCT f.k||f.v) sel, min_by(f, a) f, list_sort(list_distinct(flatten(list(layers)))) layers FROM al GROUP BY 1, 2),
rv AS MATERIALIZED (SELECT project, txt, CASE WHEN bad IS NULL THEN 'ok' WHEN bad%10=0 THEN 'none' ELSE 'multiple' END how, CASE WHEN bad IS NULL THEN CASE WHEN sel=1 THEN f.k ELSE 'layers' END END kind,
 CASE WHEN bad IS NULL THEN CASE WHEN sel=1 THEN f.v ELSE array_to_string(list_transform(list_sort(list_transform(layers, lambda x: lower(x)||chr(1)||x)), lambda x: split_part(x, chr(1), 2)), '|') END END vals FROM rs)"""
)


def resolved(spark, sf_dir):
    terms = D.read(spark, sf_dir, "part").selectExpr(f"{PROJECT} AS project", f"{TERM} AS text")
    return once(spark, sf_dir, "resolved", lambda: M.resolve(terms, context(spark, sf_dir)))


@query("v01_j19_terms", f"WITH {_RESOLVED} SELECT project, txt AS text, how, kind, vals FROM rv")
def v01(spark, sf_dir):
    """Terms with none, one or several meanings."""
    return resolved(spark, sf_dir).select("project", "text", "how", F.col("selector.kind").alias("kind"), F.array_join("selector.values", "|").alias("vals"))


@query("j19_phrase_tiers", f"WITH {_RESOLVED} SELECT DISTINCT al.project, tok AS token, tier, sets, f.k kind, f.v vals FROM al JOIN tk ON tk.project=al.project AND tk.txt=al.txt AND tk.a=al.a JOIN tr ON tr.project=al.project AND tr.txt=al.txt AND tr.a=al.a WHERE sets=1")
def j19(spark, sf_dir):
    """Phrases that name one set of layers, with the tier at which they do."""
    t = D.read(spark, sf_dir, "part").selectExpr(f"{PROJECT} AS project", f"{TERM} AS text").select("project", F.explode(M.split_phrases(F.col("text"))).alias("token"))
    found = M.candidates(t, M.named(context(spark, sf_dir))).where("sets = 1")
    return found.select("project", "token", "tier", "sets", "selector.kind", F.array_join("selector.values", "|").alias("vals"))


@query("u03_layer_unions", f"WITH {_RESOLVED} SELECT project, txt AS text, vals FROM rv WHERE how='ok' AND contains(txt, '、')")
def u03(spark, sf_dir):
    """Terms of several phrases: the union of their layers."""
    return resolved(spark, sf_dir).where("how = 'ok' AND contains(text, '、')").select("project", "text", F.array_join("selector.values", "|").alias("vals"))
