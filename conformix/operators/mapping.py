"""Names in specifications to layers of drawings: wildcard glossaries, selectors, and the tiers by which a phrase matches.

Everything belongs to a project: layers (project, layer), systems (project, pos, name, layer_regex), glossaries (project, concept, pos,
patterns). A selector is struct<kind, values>: kind system, layer or layers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conformix.functions import text as X
from conformix.sources.tables import materialise

# Concepts and the layer names that usually carry them; a project's own glossary replaces them one by one.
DEFAULT_GLOSSARY = {
    "SCADA": ["SCADA", "SCADA-*"],
    "通信": ["COMM", "COMM-*", "COM-*", "TEL", "TEL-*"],
    "通訊": ["COMM", "COMM-*", "COM-*", "TEL", "TEL-*"],
    "電力": ["POWER", "POWER-*", "PWR", "PWR-*", "ELEC", "ELEC-*"],
    "號誌": ["SIGNAL", "SIGNAL-*", "SIG", "SIG-*"],
}
SELECTOR = "struct<kind:string,values:array<string>>"
#: Characters at most of the pieces by which patterns and layers meet, systems and layers, and phrases and names.
PIECE = 32
#: Expressions that are a text with anchors at most; characters that no other one equals but for ASCII's letters and their capitals.
_PLAIN, _OTHER = r"^\^?([^\\.\[\](){}*+?|^$]+)\$?$", r"[^\x00-\x7F\p{Lo}\p{P}]"


def selector(kind: Column | str, values: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), values.alias("values"))


def by_letter(names: Column) -> Column:
    """Names in the order of their small letters."""
    return F.transform(F.array_sort(F.transform(names, lambda x: F.struct(F.lower(x).alias("a"), x.alias("b")))), lambda x: x["b"])


# -- glossaries --------------------------------------------------------------------------------------


def parse_glossary(texts: DataFrame) -> DataFrame:
    """(project, concept, pos, patterns) of glossary texts (project, text): lines "concept = pattern, pattern"; of lines with one concept
    the last counts; nothing after the sign leaves an empty list; lines without a sign and remarks (#) are no entries."""
    lines = texts.select("project", F.posexplode(F.split("text", r"\R")).alias("pos", "line")).withColumn("line", X.strip(F.col("line")))
    lines = lines.where("line <> '' AND NOT startswith(line, '#') AND contains(line, '=')")
    concept = X.strip(F.regexp_extract("line", "^([^=]*)=", 1))
    rest = F.split(F.regexp_replace(F.regexp_extract("line", "^[^=]*=(.*)$", 1), "[，、]", ","), ",")
    patterns = F.filter(F.transform(rest, X.strip), lambda x: x != "")
    rows = lines.select("project", "pos", concept.alias("concept"), patterns.alias("patterns")).where("concept <> ''")
    return rows.groupBy("project", "concept").agg(F.min("pos").alias("pos"), F.max_by("patterns", "pos").alias("patterns"))


def effective_glossary(projects: DataFrame, own: DataFrame) -> DataFrame:
    """The defaults of every project, overlaid by its own concepts; empty lists switch a concept off."""
    standard = F.explode(F.array(*[F.struct(F.lit(c).alias("concept"), F.lit(i - len(DEFAULT_GLOSSARY)).alias("dpos"), F.array(*map(F.lit, p)).alias("standard")) for i, (c, p) in enumerate(DEFAULT_GLOSSARY.items())]))
    every = projects.select("project").distinct().select("project", standard.alias("d")).select("project", "d.*")
    both = every.join(own.hint("merge"), ["project", "concept"], "full")
    out = both.select("project", "concept", F.coalesce("dpos", "pos").alias("pos"), F.coalesce("patterns", "standard").alias("patterns"))
    return out.where(F.size("patterns") > 0)


def glossary_text(glossary: DataFrame) -> DataFrame:
    """(project, text): the lines that parse_glossary() reads."""
    line = F.concat_ws(" = ", "concept", F.concat_ws(", ", "patterns"))
    return glossary.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "concept", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


# -- wildcards ---------------------------------------------------------------------------------------

_TOKENS = r"(\[!?\]?[^\]]*\]|\*|\?|\[|[^*?\[]+)"


def _tokens(pattern: Column) -> Column:
    return F.regexp_extract_all(pattern, F.lit(_TOKENS), F.lit(1))


def _is_set(t: Column) -> Column:
    return (F.length(t) > 2) & F.startswith(t, F.lit("["))


def wildcard_regex(pattern: Column) -> Column:
    """The regular expression of a file-name pattern: * any text, ? one character, [ab] and [!ab] sets; all else is itself."""
    literal = lambda t: F.regexp_replace(t, r"([\\.\[\]{}()+*?^$|])", r"\\$1")
    body = lambda t: F.regexp_replace(F.regexp_replace(F.substring(t, 2, 1_000_000), r"([\\\[^&])", r"\\$1"), r"^\]", r"\\]")
    in_set = lambda t: F.when(F.startswith(t, F.lit("[!")), F.concat(F.lit("[^"), body(F.concat(F.lit("["), F.substring(t, 3, 1_000_000))))).otherwise(F.concat(F.lit("["), body(t)))
    one = lambda t: F.when(t == "*", ".*").when(t == "?", ".").when(_is_set(t), in_set(t)).otherwise(literal(t))
    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(_tokens(pattern), one), ""), F.lit("$"))


def longest_piece(pattern: Column) -> Column:
    """The longest text that every match holds as it stands; empty if there is none."""
    pieces = F.filter(_tokens(pattern), lambda t: ~t.isin("*", "?") & ~_is_set(t))
    return F.coalesce(F.array_max(F.transform(pieces, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"], F.lit(""))


def _grams(c: Column, size: Column | int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    n = F.length(c) - size
    return F.when((n >= 0) & (size > 0), F.array_distinct(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.substring(c, i, size)))).otherwise(F.array().cast("array<string>"))


def _meet(asked: DataFrame, held: DataFrame, text: str) -> DataFrame:
    """Rows of held (project, text, ...) beside every piece of asked (project, piece) that their text holds: an equi-join of pieces with the
    texts' own substrings of those lengths, so that its work grows with texts and matches, not with their product."""
    asked = materialise(asked.select("project", "piece").distinct(), "pieces")
    # PIECE lengths at most
    lengths = sorted(r[0] for r in asked.select(F.length("piece")).distinct().collect())
    if not lengths:
        return held.withColumn("piece", F.lit(None).cast("string")).where("false")
    parts = F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, lengths)), lambda n: _grams(F.col(text), n))))
    return held.withColumn("piece", F.explode(parts)).join(asked.hint("merge"), ["project", "piece"], "left_semi")


def layers_of_patterns(patterns: DataFrame, layers: DataFrame) -> DataFrame:
    """(project, pattern, layer): which layers of its project a wildcard pattern matches, in any case.

    A pattern meets the layers that hold its longest piece (the first PIECE characters of it); patterns without one, like *, meet all layers of
    their project, which most of them match. What meets is matched by its expression.
    """
    p = patterns.select("project", "pattern").distinct().withColumns({"low": F.lower("pattern")})
    p = materialise(p.withColumns({"piece": F.substring(longest_piece(F.col("low")), 1, PIECE), "regex": wildcard_regex(F.col("low"))}).drop("low"), "patterns")
    y = materialise(layers.where("layer <> ''").select("project", "layer", F.lower("layer").alias("low_layer")).distinct(), "layers")
    met = _meet(p.where("piece <> ''"), y, "low_layer").join(p.where("piece <> ''").hint("merge"), ["project", "piece"]).select("project", "pattern", "regex", "layer", "low_layer")
    free = p.where("piece = ''").select("project", "pattern", "regex").join(y.hint("merge"), "project").select("project", "pattern", "regex", "layer", "low_layer")
    return met.unionByName(free).where(F.expr("regexp_like(low_layer, regex)")).select("project", "pattern", "layer")


# -- what a selector covers --------------------------------------------------------------------------


@dataclass
class Context:
    """What a project offers: its layers, systems, and effective glossary."""

    layers: DataFrame
    systems: DataFrame
    glossary: DataFrame

    def system_layers(self) -> DataFrame:
        """(project, name, pos, layers): layers in which a system's expression is found.

        An expression that is a text but for its anchors meets the layers that hold that text; any other one meets all layers of its project, and so
        does every expression a layer with letters beyond ASCII that have capitals. What meets is matched by the expression.
        """
        text = F.regexp_extract("layer_regex", _PLAIN, 1)
        piece = F.when((text != "") & ~text.rlike(_OTHER), F.substring(F.lower(text), 1, PIECE))
        s = materialise(self.systems.select("project", "name", "pos", "layer_regex", piece.alias("piece")), "systems")
        head = F.substring("layer", 1, 2000)
        y = materialise(self.layers.where("layer <> ''").select("project", "layer", head.alias("head"), F.lower(head).alias("low"), head.rlike(_OTHER).alias("other")).distinct(), "layers")
        asked, rest = s.where("piece IS NOT NULL"), s.where("piece IS NULL").drop("piece")
        pick = lambda df: df.select("project", "name", "pos", "layer_regex", "layer", "head")
        met = pick(_meet(asked, y.where("NOT other"), "low").join(asked.hint("merge"), ["project", "piece"]))
        met = met.unionByName(pick(asked.join(y.where("other").hint("merge"), "project"))).unionByName(pick(rest.join(y.hint("merge"), "project")))
        hit = met.where(F.expr("regexp_like(head, concat('(?iu)', layer_regex))")).select("project", "name", "pos", "layer")
        every = s.select("project", "name", "pos", F.lit(None).cast("string").alias("layer"))
        return hit.unionByName(every).groupBy("project", "name", "pos").agg(F.sort_array(F.collect_set("layer")).alias("layers"))

    def concept_layers(self) -> DataFrame:
        """(project, concept, pos, layers) of concepts that match any layer."""
        g = self.glossary.select("project", "concept", "pos", F.explode("patterns").alias("pattern"))
        met = layers_of_patterns(g, self.layers)
        return g.join(met.hint("merge"), ["project", "pattern"]).groupBy("project", "concept", "pos").agg(F.sort_array(F.collect_set("layer")).alias("layers"))


def selector_layers(selectors: DataFrame, context: Context) -> DataFrame:
    """(project, selector, layers, valid): the layers that a selector covers, and whether it names what its project has: a known
    system (even of no layer), or at least one layer, in any case."""
    s = selectors.where("selector IS NOT NULL").select("project", "selector").distinct()
    named = context.system_layers().select("project", F.col("name"), F.col("layers").alias("_l"))
    systems = s.where("selector.kind = 'system'").withColumn("name", F.get("selector.values", F.lit(0))).join(named.hint("merge"), ["project", "name"], "left")
    systems = systems.groupBy("project", "selector").agg(F.flatten(F.collect_list(F.coalesce("_l", F.array().cast("array<string>")))).alias("layers"), F.max(F.col("_l").isNotNull()).alias("valid"))
    y = context.layers.where("layer <> ''").select("project", "layer", F.lower("layer").alias("low")).distinct()
    wanted = s.where("selector.kind IN ('layer', 'layers')").withColumn("low", F.explode_outer("selector.values")).withColumn("low", F.lower("low"))
    layers = wanted.join(y.hint("merge"), ["project", "low"], "left").groupBy("project", "selector").agg(F.collect_set("layer").alias("layers"), (F.count("layer") > 0).alias("valid"))
    return systems.unionByName(layers).withColumn("layers", F.sort_array(F.array_distinct("layers")))


# -- phrases -----------------------------------------------------------------------------------------


def named(context: Context) -> DataFrame:
    """(project, rank, pos, norm, selector, layers): everything that a phrase may name and that covers a layer, in the order in which it is looked at:
    layers (rank 0), systems (1), concepts of the glossary (2)."""
    one = context.layers.where("layer <> ''").select("project", "layer").distinct()
    layers = one.select("project", F.lit(0).alias("rank"), F.lit(0).alias("pos"), X.norm_text(F.col("layer")).alias("norm"), selector("layer", F.array("layer")).alias("selector"), F.array("layer").alias("layers"))
    s = context.system_layers().where(F.size("layers") > 0)
    systems = s.select("project", F.lit(1).alias("rank"), F.col("pos").cast("int").alias("pos"), X.norm_text(F.col("name")).alias("norm"), selector("system", F.array("name")).alias("selector"), "layers")
    c = context.concept_layers()
    several = selector(F.when(F.size("layers") == 1, "layer").otherwise("layers"), by_letter(F.col("layers")))
    concepts = c.select("project", F.lit(2).alias("rank"), F.col("pos").cast("int").alias("pos"), X.norm_text(F.col("concept")).alias("norm"), several.alias("selector"), "layers")
    return layers.unionByName(systems).unionByName(concepts)


def _containing(inner: DataFrame, outer: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of inner and outer of one project where text a (of inner) is part of text b: they meet on a's first PIECE characters."""
    asked = inner.select("project", a, F.substring(a, 1, PIECE).alias("piece"))
    met = _meet(asked, outer.select("project", b), b).join(asked.hint("merge"), ["project", "piece"])
    return met.where(F.contains(F.col(b), F.col(a))).select("project", a, b)


def candidates(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(project, token, tier, sets, selector, layers): for each phrase its best tier, how many layer sets that gives, and the first of them.

    Tier 0: the phrase is the name; tier 1: it holds the name of a system or concept or is held by it, both of two characters at least. Names
    that cover the same layers count once, a system before others. Sets of layers and selectors go by numbers until the first of the best tier is
    known, since any number of phrases may hold the name of one large system or concept.
    """
    t = materialise(tokens.select("project", "token").distinct().withColumn("tn", X.norm_text(F.col("token"))), "phrases")
    names = materialise(names, "names")
    layers = materialise(names.select("project", "layers").distinct().withColumn("set", F.monotonically_increasing_id()), "layer-sets")
    # a selector's number is its place among those of its set, which follows rank and position
    place = Window.partitionBy("project", "set").orderBy("rank", "pos", "selector")
    numbered = materialise(names.join(layers.hint("merge"), ["project", "layers"]).drop("layers").withColumn("sel", F.dense_rank().over(place)), "numbered")
    n, at = numbered.drop("selector"), ["project", "set", "sel"]
    own = n.where("rank = 0 OR norm <> ''")
    equal = t.join(own.withColumnRenamed("norm", "tn").hint("merge"), ["project", "tn"]).withColumn("tier", F.lit(0))
    long_t, long_n = t.where(F.length("tn") >= 2).select("project", "tn").distinct(), n.where((F.col("rank") > 0) & (F.length("norm") >= 2)).select("project", "norm").distinct()
    met = _containing(long_n, long_t, "norm", "tn").select("project", "tn", "norm").union(_containing(long_t, long_n, "tn", "norm").select("project", "tn", "norm")).where("tn <> norm").distinct()
    part = t.join(materialise(met, "contained").hint("merge"), ["project", "tn"]).join(n.where("rank > 0").hint("merge"), ["project", "norm"]).withColumn("tier", F.lit(1))
    every = equal.select("project", "token", "tier", "rank", "pos", "sel", "set").unionByName(part.select("project", "token", "tier", "rank", "pos", "sel", "set"))
    first = F.struct((F.col("rank") != 1).alias("other"), "rank", "pos", "sel")
    sets = materialise(every.groupBy("project", "token", "tier", "set").agg(F.min(first).alias("f")), "sets")
    tiers = sets.groupBy("project", "token", "tier").agg(F.count("*").alias("sets"), F.min(F.struct("f.rank", "f.pos")).alias("g"))
    best = tiers.groupBy("project", "token").agg(F.min(F.struct("tier", "sets", "g")).alias("b")).select("project", "token", "b.tier", "b.sets", "b.g")
    lead = sets.join(best.hint("merge"), ["project", "token", "tier"]).where(F.struct("f.rank", "f.pos") == F.col("g"))
    selectors = numbered.select(*at, "selector").dropDuplicates(at)
    lead = lead.select("project", "token", "tier", "sets", "set", "f.sel").join(layers.hint("merge"), ["project", "set"]).join(selectors.hint("merge"), at)
    lead = lead.groupBy("project", "token", "tier", "sets").agg(F.min(F.struct("layers", "selector")).alias("c"))
    return lead.select("project", "token", "tier", "sets", "c.selector", "c.layers")


def split_phrases(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(text, "[/／]", "、"), "、"), X.strip), lambda x: x != "")


def resolve(terms: DataFrame, context: Context) -> DataFrame:
    """(project, text, how, selector, layers) of terms (project, text): how is ok, none or multiple, and tells of the first phrase that is not ok.

    A term's phrases (A、B or A/B) each have to name one set of layers; different selectors become the union of their layers.
    """
    t = materialise(terms.select("project", "text").distinct(), "terms")
    phrases = t.select("project", "text", F.posexplode(split_phrases(F.col("text"))).alias("at", "token"))
    found = candidates(phrases, named(context))
    one = phrases.join(found.hint("merge"), ["project", "token"], "left")
    how = F.when(F.col("sets").isNull(), "none").when(F.col("sets") > 1, "multiple").otherwise("ok")
    got = one.groupBy("project", "text").agg(
        F.min(F.when(how != "ok", F.struct("at", how.alias("how")))).alias("bad"),
        F.count_distinct("selector").alias("selectors"),
        F.min(F.struct("at", "selector")).alias("first"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("layers")))).alias("layers"),
    )
    out = t.join(got.hint("merge"), ["project", "text"], "left")
    bad = F.when(F.col("first").isNull(), "none").otherwise(F.col("bad.how"))
    chosen = F.when(F.col("selectors") == 1, F.col("first.selector")).otherwise(selector("layers", by_letter(F.col("layers"))))
    return out.select("project", "text", F.coalesce(bad, F.lit("ok")).alias("how"), F.when(bad.isNull(), chosen).alias("selector"), F.when(bad.isNull(), F.col("layers")).alias("layers"))
