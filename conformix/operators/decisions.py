"""What people decide about rule candidates: a log of changes merged into one keyed table, and the lookup of a candidate's decision.

A decision belongs to a key of a project: a candidate's id, or a group of conflicting candidates. Changes say, field by field, what is
set and what is cleared; whoever merges a log, in one go or in any split of it, gets the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conformix.operators.mapping import SELECTOR
from conformix.schema import UNIT_MM

#: Fields of a decision; chosen is the meaning that a group's conflict was decided for.
FIELDS = {"disabled": "boolean", "accept": "boolean", "subject": SELECTOR, "target": SELECTOR, "zone": SELECTOR, "template": "string", "operator": "string", "unit": "string", "value": "double", "chosen": "string"}
#: A change: at orders the log, reset clears all fields first, cleared names fields that go.
CHANGE = "project string, key string, meaning string, at long, reset boolean, cleared array<string>, " + ", ".join(f"{n} {t}" for n, t in FIELDS.items())
# Templates among which an axis is chosen, comparisons that may be set.
AXES = ("clearance", "vertical_clearance")


def change_faults(c: Column | None = None) -> Column:
    """array<string>: what is wrong with a change: field names and values that no decision holds."""
    g = lambda n: F.col(n) if c is None else c[n]
    known = F.array(*map(F.lit, FIELDS))
    rows = [
        F.when(g("key").isNull() | (g("key") == ""), "key"), F.when(g("template").isNotNull() & ~g("template").isin(*AXES), "template"), F.when(g("operator").isNotNull() & ~g("operator").isin(">=", "<="), "operator"),
        F.when(g("unit").isNotNull() & ~g("unit").isin(*UNIT_MM), "unit"), F.when(g("value").isNotNull() & (F.isnan(g("value")) | (g("value") < 0) | (g("value") == float("inf"))), "value"),
        F.when(F.size(F.array_except(F.coalesce(g("cleared"), F.array().cast("array<string>")), known)) > 0, "cleared"),
    ]
    return F.array_compact(F.array(*rows))


_FACTS = ["project", "key", "field", "at", "held"]


def _facts(changes: DataFrame) -> DataFrame:
    """One row for each field that a change sets (held) or clears (null); a reset clears every field just before its own change."""
    ok = changes.where(F.size(change_faults()) == 0)
    # false takes a mark away, as clearing does
    marks = {"disabled", "accept"}
    given = {n: (F.when(F.col(n), F.col(n)) if n in marks else F.col(n)) for n in FIELDS}
    said = {n: F.col(n).isNotNull() | F.array_contains(F.coalesce("cleared", F.array().cast("array<string>")), n) for n in FIELDS}
    held = lambda n: F.struct(*[(given[m] if m == n else F.lit(None)).cast(t).alias(m) for m, t in FIELDS.items()])
    nothing = F.struct(*[F.lit(None).cast(t).alias(m) for m, t in FIELDS.items()])
    fact = lambda n, when, late, value: F.when(when, F.struct(F.lit(n).alias("field"), F.struct(F.col("at").alias("at"), F.lit(late).alias("late")).alias("at"), value.alias("held")))
    rows = [fact(n, said[n], 1, held(n)) for n in FIELDS] + [fact(n, F.coalesce("reset", F.lit(False)), 0, nothing) for n in FIELDS]
    rows.append(F.when(F.col("meaning").isNotNull(), F.struct(F.lit("meaning").alias("field"), F.struct(F.col("at").alias("at"), F.lit(1).alias("late")).alias("at"), nothing.alias("held"))))
    return ok.select("project", "key", "meaning", F.explode(F.array_compact(F.array(*rows))).alias("f")).select("project", "key", "f.field", "f.at", "f.held", F.when(F.col("f.field") == "meaning", F.col("meaning")).alias("meaning"))


def merge(stored: DataFrame | None, changes: DataFrame) -> DataFrame:
    """The table of facts (project, key, field, at, held, meaning) after more changes: of each field the latest one. Faulty changes are left out.

    The same log gives the same table in whatever parts and order it is merged, also if a part is merged twice.
    """
    new = _facts(changes)
    every = new if stored is None else stored.unionByName(new)
    last = every.groupBy("project", "key", "field").agg(F.max_by(F.struct("at", "held", "meaning"), "at").alias("f"))
    return last.select("project", "key", "field", "f.*")


def decisions(facts: DataFrame) -> DataFrame:
    """(project, key, meaning, at, decision): one row for each key with a field that is set; cleared keys have none."""
    value = lambda n, t: F.max_by(F.when(F.col("field") == n, F.col("held")[n]), F.when(F.col("field") == n, 1)).cast(t).alias(n)
    one = facts.groupBy("project", "key").agg(F.max("meaning").alias("meaning"), F.max("at").alias("at"), *[value(n, t) for n, t in FIELDS.items()])
    some = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(True)) for n in FIELDS], F.lit(False))
    return one.where(some).select("project", "key", "meaning", "at.at", F.struct(*FIELDS).alias("decision"))


def for_candidates(candidates: DataFrame, held: DataFrame) -> DataFrame:
    """Candidates (project, candidate_id, meaning, ...) with decision: that of their id, else the latest one of a candidate of the same meaning."""
    by_id = held.where("startswith(key, 'cand_')")
    mine = by_id.select("project", F.col("key").alias("candidate_id"), F.col("decision").alias("_own"))
    alike = by_id.where("meaning IS NOT NULL").groupBy("project", "meaning").agg(F.max_by("decision", F.struct("at", "key")).alias("_alike"))
    out = candidates.join(mine.hint("merge"), ["project", "candidate_id"], "left").join(alike.hint("merge"), ["project", "meaning"], "left")
    return out.withColumn("decision", F.coalesce("_own", "_alike")).drop("_own", "_alike")


def choices(held: DataFrame) -> DataFrame:
    """(project, group_id, chosen): the meaning that a person chose for a group."""
    return held.where("startswith(key, 'grp_') AND decision.chosen IS NOT NULL").select("project", F.col("key").alias("group_id"), F.col("decision.chosen").alias("chosen"))
