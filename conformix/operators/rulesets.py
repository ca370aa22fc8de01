"""Rule sets built from confirmed candidates beside the rules that people wrote, as tables: plan, coverage, replacement, gate.

Rules are rows (RULE). The parties of a rule are lists of selectors, whose layers count together; null stands for a predicate that no
list of selectors can say, an absent party has no row value either, so has_<party> tells the two apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conformix.operators import mapping as M
from conformix.operators.assessment import PARTIES, SLOTS, _lookup_list
from conformix.operators.reports import general
from conformix.operators.requirements import ORDER
from conformix.plans.rules import CATALOG, TEMPLATES
from conformix.schema import UNIT_MM
from conformix.sources.tables import materialise

ORIGIN = "spec-extraction"
_SELECTORS = f"array<{M.SELECTOR}>"
RULE = (
    "project string, rule_id string, origin string, enabled boolean, measurement string, operator string, value double, unit string, severity string, name string, "
    + ", ".join(f"has_{n} boolean, {n} {_SELECTORS}" for n in PARTIES)
    + ", evidence_id string, document string, quote string, candidate_id string"
)
RULE_COLUMNS = [f.split(" ")[0] for f in RULE.replace(M.SELECTOR, "x").split(", ")]
# Why a candidate gives no rule.
EDITED, COVERED, INVALID = "同編號的規則已被手動修改", "手動規則「%s」已經涵蓋", "規則不完整"


def _selector_text(s: Column) -> Column:
    return F.when(s.isNull(), "").otherwise(F.array_join(s["values"], "、"))


def sentence(template: Column, words: dict[str, Column]) -> Column:
    """A template's sentence with its blanks filled in."""
    out = F.try_element_at(F.create_map(*[F.lit(x) for name, t in TEMPLATES.items() for x in (name, t.sentence)]), template)
    for blank, word in words.items():
        out = F.replace(out, F.lit("{" + blank + "}"), word)
    return out


def built(views: DataFrame) -> DataFrame:
    """RULE rows of enabled candidates, with ok: whether all that the template needs is there; the id is made of template and candidate."""
    v = views.where("enabled")
    slots = F.coalesce(_lookup_list(SLOTS, F.col("template")), F.array().cast("array<string>"))
    has = {n: F.array_contains(slots, n) for n in PARTIES}
    stem = F.upper(F.replace("template", F.lit("_"), F.lit("-")))
    rule_id = F.concat(F.lit("SPEC-"), stem, F.lit("-"), F.upper(F.substring("candidate_id", 6, 8)))
    lengths = [m for m, c in CATALOG.items() if c.units and "mm" in c.units]
    value = F.col("value")
    sound = value.isNotNull() & (value >= 0) & ~F.isnan(value) & ((F.col("measurement") != "entity_count") | (value == F.floor(value))) & (~F.col("measurement").isin(*lengths) | F.col("unit").isin(*UNIT_MM))
    for n in PARTIES:
        sound = sound & (~has[n] | F.col(f"{n}_selector").isNotNull())
    words = {n: _selector_text(F.col(f"{n}_selector")) for n in PARTIES} | {"value": general(value), "unit": F.coalesce("unit", F.lit(""))}
    party = [x for n in PARTIES for x in (has[n].alias(f"has_{n}"), F.when(has[n], F.array(f"{n}_selector")).alias(n))]
    return v.select(
        "project", rule_id.alias("rule_id"), F.lit(ORIGIN).alias("origin"), F.lit(True).alias("enabled"), "measurement", "operator", "value", "unit", "severity", sentence(F.col("template"), words).alias("name"), *party,
        "evidence_id", F.col("filename").alias("document"), F.col("sentence").alias("quote"), "candidate_id", F.coalesce(sound, F.lit(False)).alias("ok"), F.struct("document_id", *ORDER).alias("o"),
    )


def with_coverage(rules: DataFrame, context: M.Context) -> DataFrame:
    """Adds covers: one text of all parties' layers by which equal coverage is told, null where a party is unclear or covers nothing."""
    rules = materialise(rules, "rules")
    rows = rules.select("project", "rule_id", F.explode(F.array(*[F.struct(F.lit(n).alias("slot"), F.col(n).alias("parts")) for n in PARTIES])).alias("x")).select("project", "rule_id", "x.slot", F.explode("x.parts").alias("selector"))
    # a system may be one of several names, each a selector of its own
    single = F.when(F.col("selector.kind") == "system", F.transform("selector.values", lambda v: F.struct(F.lit("system").alias("kind"), F.array(v).alias("values")))).otherwise(F.array("selector"))
    rows = materialise(rows.select("project", "rule_id", "slot", F.explode(single).alias("selector")), "parts")
    held = materialise(M.selector_layers(rows.select("project", "selector"), context), "covered")
    rows = rows.join(held.select("project", "selector", "layers").hint("merge"), ["project", "selector"], "left")
    per = rows.groupBy("project", "rule_id", "slot").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("layers")))).alias("layers"))
    wide = per.groupBy("project", "rule_id").agg(*[F.max(F.when(F.col("slot") == n, F.col("layers"))).alias(f"_{n}") for n in PARTIES])
    out = rules.join(wide.hint("merge"), ["project", "rule_id"], "left")
    text = lambda n: F.when(~F.coalesce(F.col(f"has_{n}"), F.lit(False)), F.lit("-")).when(F.size(f"_{n}") > 0, F.concat(F.lit("+"), F.array_join(f"_{n}", "\u0001")))
    parts = [text(n) for n in PARTIES]
    known = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    return out.withColumn("covers", F.when(known, F.concat_ws("\u0002", *parts))).drop(*[f"_{n}" for n in PARTIES])


def in_mm(value: Column, unit: Column) -> Column:
    return value * F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in UNIT_MM.items() for x in kv]), unit), F.lit(1.0))


def plan(views: DataFrame, rules: DataFrame, context: M.Context) -> tuple[DataFrame, DataFrame]:
    """RULE rows that candidates give, and (project, candidate_id, reason) of enabled candidates that give none.

    A candidate gives none if it is not complete, if a rule that a person wrote has its id, or if an enabled one checks the same already: equal
    measurement, comparison and value (a 1e-9 millimetre apart at most), and the same layers for every party. Of equal ids the first read counts.
    """
    manual = materialise(rules.where(F.coalesce(F.col("origin") != ORIGIN, F.lit(True))), "manual")
    made = with_coverage(built(views), context)
    first = made.where("ok").groupBy("project", "rule_id").agg(F.min_by("candidate_id", "o").alias("_first"))
    taken = manual.select("project", "rule_id").distinct().withColumn("_taken", F.lit(True))
    by_hand = with_coverage(manual.where("enabled"), context).where("covers IS NOT NULL").select("project", "measurement", "operator", "covers", F.col("rule_id").alias("_by"), in_mm(F.col("value"), F.col("unit")).alias("_mm"))
    same = ["project", "measurement", "operator", "covers"]
    close = made.select(*same, "candidate_id", "value", "unit").join(by_hand.hint("merge"), same).where(F.abs(in_mm(F.col("value"), F.col("unit")) - F.col("_mm")) < 1e-9)
    twins = close.groupBy("project", "candidate_id").agg(F.min("_by").alias("_by"))
    out = made.join(first.hint("merge"), ["project", "rule_id"], "left").join(taken.hint("merge"), ["project", "rule_id"], "left").join(twins.hint("merge"), ["project", "candidate_id"], "left")
    clash = F.col("_taken") | (F.col("_first") != F.col("candidate_id"))
    reason = F.when(~F.col("ok"), INVALID).when(clash, EDITED).when(F.col("_by").isNotNull(), F.format_string(COVERED, "_by"))
    out = materialise(out.withColumn("skip", reason), "plan")
    return out.where("skip IS NULL").select(*RULE_COLUMNS), out.where("skip IS NOT NULL").select("project", "candidate_id", F.col("skip").alias("reason"))


def apply(views: DataFrame, rules: DataFrame, context: M.Context) -> tuple[DataFrame, DataFrame]:
    """The new rules, hand-written ones beside those of candidates, which replace all earlier ones; and (project, applied, manual, changed)."""
    made, _ = plan(views, rules, context)
    new = rules.where(F.coalesce(F.col("origin") != ORIGIN, F.lit(True))).select(*RULE_COLUMNS).unionByName(made)
    new = materialise(new, "ruleset")
    print_ = lambda df: df.select("project", F.xxhash64(F.to_json(F.struct(*RULE_COLUMNS[1:]))).alias("h"))
    differ = print_(new).exceptAll(print_(rules)).union(print_(rules).exceptAll(print_(new))).select("project").distinct().withColumn("_d", F.lit(True))
    spec = F.col("origin") == ORIGIN
    every = new.groupBy("project").agg(F.count_if(spec).alias("applied"), F.count_if(~F.coalesce(spec, F.lit(False))).alias("manual"))
    projects = rules.select("project").union(new.select("project")).distinct()
    out = projects.join(every.hint("merge"), "project", "left").join(differ.hint("merge"), "project", "left")
    return new, out.select("project", F.coalesce("applied", F.lit(0)).alias("applied"), F.coalesce("manual", F.lit(0)).alias("manual"), F.coalesce("_d", F.lit(False)).alias("changed"))


def gate(views: DataFrame, rules: DataFrame, context: M.Context) -> DataFrame:
    """(project, will_run, from_spec, manual, review, conflict, not_enforceable, runnable): what an analysis would run; one rule is enough."""
    made, _ = plan(views, rules, context)
    spec = made.groupBy("project").agg(F.count("*").alias("from_spec"))
    hand = rules.where(F.coalesce(F.col("origin") != ORIGIN, F.lit(True)) & F.col("enabled")).groupBy("project").agg(F.count("*").alias("manual"))
    state = views.groupBy("project").agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in ("review", "conflict", "not_enforceable")])
    out = state.join(spec.hint("merge"), "project", "full").join(hand.hint("merge"), "project", "full").na.fill(0)
    run = F.col("from_spec") + F.col("manual")
    return out.select("project", run.alias("will_run"), "from_spec", "manual", "review", "conflict", "not_enforceable", (run >= 1).alias("runnable"))

