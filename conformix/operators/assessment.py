"""Rule candidates judged: what a person decided, which layers their parties are, whether the evidence holds, and what they end up as.

Statuses are derived, never stored: candidates, context, decisions and evidence give them anew. Candidates are R.from_chunks() rows
with a project; reading order is document, then place in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conformix.functions import requirements as Q
from conformix.functions import text as X
from conformix.operators import decisions as Dec
from conformix.operators import mapping as M
from conformix.operators.reports import MEASURED
from conformix.operators.requirements import ORDER, group_id
from conformix.schema import UNIT_MM
from conformix.sources.tables import materialise

# Parties of a template; the comparison it can check; the measurement of an axis.
SLOTS = {
    "clearance": ("subject", "target"), "vertical_clearance": ("subject", "target"), "no_crossing": ("subject", "target"), "max_distance": ("subject", "target"),
    "keep_out": ("subject", "zone"), "inside_zone": ("subject", "zone"), "max_length": ("subject",), "orthogonal": ("subject",), "min_count": ("subject",),
}
CHECKED = {"clearance": ">=", "vertical_clearance": ">=", "max_length": "<=", "max_distance": "<=", "orthogonal": "<=", "min_count": ">="}
AXES = {"clearance": "horizontal_clearance", "vertical_clearance": "vertical_clearance"}
PARTIES = ("subject", "target", "zone")
# Problems and how they are said; those that a person may accept as they are; those that keep a candidate out of comparison.
LABELS = {
    "SUBJECT_UNMAPPED": "檢查對象對應不到圖面的系統／圖層", "TARGET_UNMAPPED": "附近物件對應不到圖面的系統／圖層", "ZONE_UNMAPPED": "區域對應不到圖面的圖層",
    "SUBJECT_MISSING": "規範沒有寫出檢查對象", "TARGET_MISSING": "規範沒有寫出附近物件（與誰比較）", "ZONE_MISSING": "規範沒有寫出區域", "AMBIGUOUS_PARTIES": "同一句出現多組對象，無法判斷誰和誰比較",
    "NO_DRAWING": "尚未匯入圖面，無法對應圖層", "NO_UNIT": "數值沒有單位（不會自行當成 mm）", "NO_VALUE": "找不到數值", "NO_DIRECTION": "無法判斷是「不得小於」還是「不得大於」", "BOTH_DIRECTIONS": "同一句同時出現兩種比較方向",
    "UNSPECIFIED_AXIS": "沒有說明是水平淨距還是垂直淨距", "UNSUPPORTED_DIRECTION": "目前的規則只支援另一個比較方向", "ADVISORY": "用語是「宜／建議／儘量」，不是強制規定", "NO_MODAL": "沒有「應／不得」等規定性用語",
    "INHERITED_PARTIES": "對象是沿用前一個子句，需確認", "MISSING_TOLERANCE": "沒有寫出容許偏差（度）", "EVIDENCE_MISSING": "找不到這條規則的規範原文（沒有依據不會自動採用）", "EVIDENCE_MISMATCH": "原文與擷取的數值對不上", "UNIT_MISMATCH": "單位與這類規則不符",
}
SOFT = ("ADVISORY", "NO_MODAL", "INHERITED_PARTIES")
BLOCKING = (
    "ADVISORY", "NO_MODAL", "NO_DIRECTION", "BOTH_DIRECTIONS", "UNSUPPORTED_DIRECTION", "NO_UNIT", "UNIT_MISMATCH", "UNSPECIFIED_AXIS", "NO_VALUE", "MISSING_TOLERANCE", "EVIDENCE_MISSING", "EVIDENCE_MISMATCH",
    "SUBJECT_MISSING", "TARGET_MISSING", "ZONE_MISSING", "AMBIGUOUS_PARTIES", "INHERITED_PARTIES",
)
STATUSES, BUCKETS = ("CONFIRMED", "NEEDS_REVIEW", "CONFLICTING", "NOT_ENFORCEABLE"), ("usable", "review", "conflict", "not_enforceable", "off")
SYMBOLS = {">=": "≥", "<=": "≤", "==": "＝", ">": ">", "<": "<", "!=": "≠"}
ALL_KNOWN, CONFIRM, NOT_MEASURABLE = "原文的檢查類型、比較方向、數值與單位都已讀出，對象也對應到圖面的系統／圖層。", "需要人工確認：", "目前無法由 2D DXF 自動量化。"
OTHER_CHOSEN, CHOOSE = "與其他規範的要求不同，你已選擇另一個數值。", "同一組對象在規範中有不同的要求，請選擇採用哪一個。"


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _without(problems: Column, *gone: str) -> Column:
    return F.filter(problems, lambda p: ~p.isin(*gone))


def _has(problems: Column, *any_of: str) -> Column:
    return F.exists(problems, lambda p: p.isin(*any_of))


def requirement_text(template: Column, measurement: Column, op: Column, value: Column, unit: Column) -> Column:
    """What a candidate asks for, in words."""
    name = F.when(template == "max_distance", "與最近物件的距離").otherwise(F.coalesce(_lookup(MEASURED, measurement), measurement))
    open_ = F.concat(name, F.lit("（"), F.when(value.isNull(), "數值").otherwise("比較方向"), F.lit("未確定）"))
    u = F.when(unit == "deg", "°").when(unit == "count", " 個").when(F.coalesce(unit, F.lit("")) == "", "").otherwise(F.concat(F.lit(" "), unit))
    said = F.concat(name, F.lit(" "), F.coalesce(_lookup(SYMBOLS, op), op), F.lit(" "), Q.fmt_num(value), u)
    out = F.when(measurement == "intersection", "不得交叉").when(measurement == "outside_zone", "不得進入區域").when(measurement == "inside_zone", "必須位於區域內").when(measurement.isNull(), "")
    return out.when(value.isNull() | op.isNull(), open_).otherwise(said)


def primaries(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each meaning in a project the candidate that is read first; and (project, primary_id, candidate_id) of the others.

    The others are rows, not a list: a meaning may stand in any number of documents.
    """
    order = F.struct("document_id", *ORDER)
    rest = [c for c in candidates.columns if c not in ("project", "meaning")]
    first = candidates.groupBy("project", "meaning").agg(F.min_by(F.struct(*rest), order).alias("c")).select("project", "meaning", "c.*")
    first = materialise(first, "primaries")
    named = first.select("project", "meaning", F.col("candidate_id").alias("primary_id"))
    others = candidates.select("project", "meaning", "candidate_id").join(named.hint("merge"), ["project", "meaning"]).where("candidate_id <> primary_id")
    return first, others.select("project", "primary_id", "candidate_id")


def decided(df: DataFrame) -> DataFrame:
    """Applies decisions to the limit (axis, direction, unit, tolerance): template, measurement, operator, value, unit and problems change."""
    d, p = F.col("decision"), F.col("problems")
    df = df.withColumns({"by_user": F.lit(False), "problems": F.coalesce("problems", F.array().cast("array<string>"))})
    axis = F.coalesce(_has(p, "UNSPECIFIED_AXIS") & d["template"].isin(*AXES), F.lit(False))
    df = df.withColumn("_hit", axis).withColumns({"measurement": F.when(F.col("_hit"), _lookup(AXES, d["template"])).otherwise(F.col("measurement")), "template": F.when(F.col("_hit"), d["template"]).otherwise(F.col("template")), "problems": F.when(F.col("_hit"), _without(p, "UNSPECIFIED_AXIS")).otherwise(p), "by_user": F.col("by_user") | F.col("_hit")})
    way = F.coalesce(_has(p, "NO_DIRECTION", "BOTH_DIRECTIONS") & (_lookup(CHECKED, F.col("template")) == d["operator"]), F.lit(False))
    df = df.withColumn("_hit", way).withColumns({"operator": F.when(F.col("_hit"), d["operator"]).otherwise(F.col("operator")), "problems": F.when(F.col("_hit"), _without(p, "NO_DIRECTION", "BOTH_DIRECTIONS")).otherwise(p), "by_user": F.col("by_user") | F.col("_hit")})
    unit = F.coalesce(_has(p, "NO_UNIT") & d["unit"].isin(*UNIT_MM) & F.col("value").isNotNull(), F.lit(False))
    df = df.withColumn("_hit", unit).withColumns({"value": F.when(F.col("_hit"), Q.to_mm(F.col("value"), d["unit"])).otherwise(F.col("value")), "unit": F.when(F.col("_hit"), "mm").otherwise(F.col("unit")), "problems": F.when(F.col("_hit"), _without(p, "NO_UNIT")).otherwise(p), "by_user": F.col("by_user") | F.col("_hit")})
    slack = F.coalesce(_has(p, "MISSING_TOLERANCE") & (d["value"] >= 0), F.lit(False))
    df = df.withColumn("_hit", slack).withColumns({"value": F.when(F.col("_hit"), d["value"]).otherwise(F.col("value")), "unit": F.when(F.col("_hit"), "deg").otherwise(F.col("unit")), "problems": F.when(F.col("_hit"), _without(p, "MISSING_TOLERANCE")).otherwise(p), "by_user": F.col("by_user") | F.col("_hit")})
    return df.drop("_hit")


def mapped(df: DataFrame, context: M.Context) -> DataFrame:
    """Adds <slot>_selector and <slot>_layers for the parties of each template: what a person picked, if the project has it, else what the
    term means; problems tell which party is missing or not found, and whether the project has a drawing at all."""
    p = F.col("problems")
    slots = F.coalesce(_lookup_list(SLOTS, F.col("template")), F.array().cast("array<string>"))
    df = materialise(df.withColumn("slots", slots), "candidates")
    party = lambda n: F.struct(F.lit(n).alias("slot"), F.col(n).alias("text"), F.col("decision")[n].alias("picked"))
    rows = df.where("enforceable").select("project", "candidate_id", "slots", F.explode(F.array(*map(party, PARTIES))).alias("x")).where(F.array_contains("slots", F.col("x.slot"))).select("project", "candidate_id", "x.*")
    rows = materialise(rows, "parties")
    covers = materialise(M.selector_layers(rows.where("picked IS NOT NULL").select("project", F.col("picked").alias("selector")), context), "picked")
    terms = materialise(M.resolve(rows.where("text <> ''").select("project", "text"), context), "terms")
    drawn = context.layers.where("layer <> ''").select("project").distinct().withColumn("drawn", F.lit(True))
    rows = rows.join(covers.where("valid").select("project", F.col("selector").alias("picked"), F.col("layers").alias("picked_layers")).hint("merge"), ["project", "picked"], "left")
    rows = rows.join(terms.select("project", "text", "how", "selector", "layers").hint("merge"), ["project", "text"], "left").join(drawn.hint("merge"), "project", "left")
    taken = F.col("picked_layers").isNotNull()
    one = rows.select("project", "candidate_id", "slot", taken.alias("taken"), F.coalesce("drawn", F.lit(False)).alias("drawn"), F.when(taken, F.col("picked")).alias("picked"), "picked_layers", "selector", "layers")
    got = one.groupBy("project", "candidate_id").agg(*[F.max(F.when(F.col("slot") == n, F.struct("taken", "drawn", "picked", "picked_layers", "selector", "layers"))).alias(f"_{n}") for n in PARTIES])
    df = df.join(got.hint("merge"), ["project", "candidate_id"], "left")
    took = {n: F.coalesce(F.col(f"_{n}.taken"), F.lit(False)) for n in PARTIES}
    wants = {n: F.array_contains("slots", n) for n in PARTIES}
    none_open = ~F.exists(F.array(*[wants[n] & ~took[n] for n in PARTIES]), lambda x: x)
    some = F.exists(F.array(*[wants[n] & took[n] for n in PARTIES]), lambda x: x)
    missing = F.array_compact(F.array(*[F.when(took[n], f"{n.upper()}_MISSING") for n in PARTIES]))
    df = df.withColumn("problems", F.array_except(p, missing)).withColumn("problems", F.when(none_open, _without(p, "AMBIGUOUS_PARTIES")).otherwise(p))
    heir = _has(p, "INHERITED_PARTIES") & F.coalesce(F.col("decision.accept"), F.lit(False))
    df = df.withColumns({"by_user": F.col("by_user") | some | heir, "problems": F.when(heir, _without(p, "INHERITED_PARTIES")).otherwise(p)})
    # a party that is neither picked nor missing is looked up, if there is a drawing
    looked = {n: wants[n] & ~took[n] & (F.col(n) != "") & ~_has(p, "AMBIGUOUS_PARTIES", f"{n.upper()}_MISSING") for n in PARTIES}
    seen = {n: F.col(f"_{n}.drawn") for n in PARTIES}
    more = [F.when(F.exists(F.array(*[looked[n] & ~F.coalesce(seen[n], F.lit(False)) for n in PARTIES]), lambda x: x), "NO_DRAWING")]
    more += [F.when(looked[n] & seen[n] & F.col(f"_{n}.selector").isNull(), f"{n.upper()}_UNMAPPED") for n in PARTIES]
    df = df.withColumns(
        {f"{n}_selector": F.when(took[n], F.col(f"_{n}.picked")).when(looked[n] & seen[n], F.col(f"_{n}.selector")) for n in PARTIES}
        | {f"{n}_layers": F.when(took[n], F.col(f"_{n}.picked_layers")).when(looked[n] & seen[n], F.col(f"_{n}.layers")) for n in PARTIES}
        | {"problems": F.concat(p, F.array_compact(F.array(*more)))}
    )
    return df.drop("_subject", "_target", "_zone")


def _lookup_list(table: dict, key: Column) -> Column:
    out = F.lit(None).cast("array<string>")
    for name, held in table.items():
        out = F.when(key == name, F.array(*map(F.lit, held))).otherwise(out)
    return out


def evidenced(df: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds EVIDENCE_MISSING, or EVIDENCE_MISMATCH where the chunk lacks the sentence or the sentence lacks the number as written."""
    held = chunks.select(F.col("id").alias("evidence_id"), X.normalize(F.col("text")).alias("_text"), "filename", "section")
    df = df.join(held.hint("merge"), "evidence_id", "left")
    sentence, number = X.normalize(F.col("sentence")), X.normalize(F.coalesce("value_text", F.lit("")))
    off = ~F.contains(F.col("_text"), sentence) | ((number != "") & ~F.contains(sentence, number))
    more = F.array_compact(F.array(F.when(F.col("_text").isNull(), "EVIDENCE_MISSING").when(off, "EVIDENCE_MISMATCH")))
    return df.withColumn("problems", F.when(F.col("enforceable"), F.concat("problems", more)).otherwise(F.col("problems"))).drop("_text")


def fixes(problems: Column, template: Column) -> Column:
    """What a person can still supply: parties, axis, direction (and which), unit, tolerance, acceptance."""
    slots = F.array_compact(F.array(*[F.when(_has(problems, f"{n.upper()}_MISSING", f"{n.upper()}_UNMAPPED"), n) for n in PARTIES]))
    both = F.coalesce(_lookup_list(SLOTS, template), F.array(F.lit("subject"), F.lit("target")))
    return F.struct(
        F.when(_has(problems, "AMBIGUOUS_PARTIES"), both).otherwise(slots).alias("slots"), _has(problems, "UNSPECIFIED_AXIS").alias("axis"), _has(problems, "NO_DIRECTION", "BOTH_DIRECTIONS").alias("direction"),
        _lookup(CHECKED, template).alias("direction_op"), _has(problems, "NO_UNIT").alias("unit"), _has(problems, "MISSING_TOLERANCE").alias("tolerance"), _has(problems, *SOFT).alias("accept"),
    )


def judged(df: DataFrame) -> DataFrame:
    """Adds severity, status, bucket, reason, requirement, fix and confirmed_by from the problems that are left."""
    p, d, ok = F.col("problems"), F.col("decision"), F.col("enforceable")
    soft = ok & _has(p, "ADVISORY", "NO_MODAL") & F.coalesce(d["accept"], F.lit(False))
    df = df.withColumns({"severity": F.when(soft, "WARNING").otherwise("FAIL"), "by_user": F.col("by_user") | soft, "problems": F.array_distinct(F.when(soft, _without(p, "ADVISORY", "NO_MODAL")).otherwise(p))})
    clean = F.size("problems") == 0
    said = requirement_text(F.col("template"), F.col("measurement"), F.col("operator"), F.col("value"), F.col("unit"))
    said = F.when(_has(F.col("problems"), "UNSPECIFIED_AXIS"), F.regexp_replace(said, "^水平淨距", "淨距（水平或垂直未定）")).otherwise(said)
    labels = F.transform("problems", lambda x: F.coalesce(_lookup(LABELS, x), x))
    reason = F.when(~ok, F.coalesce("reason", F.lit(NOT_MEASURABLE))).when(clean, ALL_KNOWN).otherwise(F.concat(F.lit(CONFIRM), F.array_join(labels, "；")))
    return df.withColumns(
        {
            "status": F.when(~ok, "NOT_ENFORCEABLE").when(clean, "CONFIRMED").otherwise("NEEDS_REVIEW"), "bucket": F.when(~ok, "not_enforceable").when(clean, "usable").otherwise("review"),
            "reason": reason, "requirement": said, "fix": fixes(F.col("problems"), F.col("template")),
            "confirmed_by": F.when(ok & clean, F.when(F.col("by_user") | (F.col("severity") == "WARNING"), "user").otherwise("auto")),
        }
    )


def family(df: DataFrame) -> Column:
    """Measurement and parties, by their layers where they are known, else by their words."""
    covered = lambda n: F.when(F.col(f"{n}_selector").isNotNull() & (F.size(F.coalesce(f"{n}_layers", F.array().cast("array<string>"))) > 0), F.concat(F.lit("L:"), F.array_join(F.sort_array(f"{n}_layers"), ",")))
    words = lambda c: F.concat(F.lit("T:"), X.norm_text(c))
    paired = F.col("template").isin("clearance", "vertical_clearance", "no_crossing", "max_distance")
    # with neither a target nor a zone found, the words are the target's
    third_words = F.when(F.coalesce(paired, F.lit(False)) | (F.col("zone_selector").isNull() & F.col("target_selector").isNull()), F.col("target")).otherwise(F.col("zone"))
    third = F.coalesce(F.when(F.coalesce(paired, F.lit(False)), covered("target")).otherwise(covered("zone")), words(third_words))
    return F.concat_ws("|", F.coalesce("measurement", F.lit("?")), F.coalesce(covered("subject"), words(F.col("subject"))), third)


def one_of_each(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates that ask for the same of the same layers are one: the first read; and (project, primary_id, candidate_id) of the others."""
    df = materialise(df.withColumn("family", family(df)), "families")
    same = F.col("status").isin("CONFIRMED", "NEEDS_REVIEW") & F.col("value").isNotNull() & F.col("operator").isNotNull() & F.col("template").isNotNull()
    signature = ["project", "family", "operator", "_value", "unit", "severity"]
    order = F.struct("document_id", *ORDER)
    alike = df.where(same).select("project", "family", "operator", Q.fmt_num(F.col("value")).alias("_value"), F.coalesce("unit", F.lit("")).alias("unit"), "severity", "candidate_id", order.alias("o"))
    first = alike.groupBy(*signature).agg(F.min_by("candidate_id", "o").alias("primary_id"), F.count("*").alias("n")).where("n > 1")
    others = materialise(alike.join(first.hint("merge"), signature).where("candidate_id <> primary_id").select("project", "primary_id", "candidate_id"), "alike")
    return df.join(others.select("project", "candidate_id").hint("merge"), ["project", "candidate_id"], "left_anti"), others


def with_conflicts(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds conflict_group and options (how many ways a group asks); members of a group are CONFLICTING unless a person chose their meaning."""
    off = F.coalesce(F.col("decision.disabled"), F.lit(False))
    comparable = (F.col("status") != "NOT_ENFORCEABLE") & F.col("value").isNotNull() & F.col("operator").isNotNull() & F.col("template").isNotNull() & F.col("unit").isNotNull() & ~_has(F.col("problems"), *BLOCKING) & ~off
    df = df.withColumn("_c", comparable)
    ways = df.where("_c").groupBy("project", "family", "operator", Q.fmt_num(F.col("value")).alias("_v"), "unit").agg(F.count("*").alias("n"))
    groups = ways.groupBy("project", "family").agg(F.count("*").alias("options")).where("options >= 2").withColumn("conflict_group", group_id(F.col("family")))
    named = chosen.select("project", F.col("group_id").alias("conflict_group"), "chosen")
    groups = groups.join(named.hint("merge"), ["project", "conflict_group"], "left")
    # a choice counts while a member of its meaning is there
    alive = df.where("_c").select("project", "family", F.col("meaning").alias("chosen")).distinct().withColumn("alive", F.lit(True))
    groups = materialise(groups.join(alive.hint("merge"), ["project", "family", "chosen"], "left"), "conflicts")
    out = df.join(groups.hint("merge"), ["project", "family"], "left")
    inside = F.col("_c") & F.col("conflict_group").isNotNull()
    mine, settled = F.coalesce(F.col("alive") & (F.col("chosen") == F.col("meaning")), F.lit(False)), F.coalesce("alive", F.lit(False))
    out = out.withColumns({"_in": inside, "_mine": mine, "_settled": settled})
    lost, open_ = F.col("_in") & F.col("_settled") & ~F.col("_mine"), F.col("_in") & ~F.col("_settled")
    return out.withColumns(
        {
            "confirmed_by": F.when(F.col("_in") & F.col("_mine") & (F.col("status") == "CONFIRMED"), "user").otherwise(F.col("confirmed_by")),
            "reason": F.when(lost, OTHER_CHOSEN).when(open_, CHOOSE).otherwise(F.col("reason")),
            "bucket": F.when(lost, "off").when(open_, "conflict").otherwise(F.col("bucket")),
            "status": F.when(lost | open_, "CONFLICTING").otherwise(F.col("status")),
            "options": F.when(F.col("_in"), F.col("options")),
            "conflict_group": F.when(F.col("_in"), F.col("conflict_group")),
        }
    ).drop("_c", "_in", "_mine", "_settled", "chosen", "alive")


def evaluate(candidates: DataFrame, context: M.Context, held: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Views of candidates (one row each that is left after merging), and (project, primary_id, candidate_id) of what was merged into them.

    held: Dec.decisions(); chunks: evidence. A view has status and bucket (see STATUSES and BUCKETS), enabled, reason, problems, fix, selectors
    and layers of its parties, requirement, severity, family, conflict_group.
    """
    first, again = primaries(candidates)
    views = Dec.for_candidates(first, held)
    views = judged(evidenced(mapped(decided(views), context), chunks))
    views, alike = one_of_each(views)
    views = with_conflicts(views, Dec.choices(held))
    off = F.coalesce(F.col("decision.disabled"), F.lit(False))
    views = views.withColumns({"bucket": F.when(off & (F.col("status") != "NOT_ENFORCEABLE"), "off").otherwise(F.col("bucket")), "enabled": (F.col("status") == "CONFIRMED") & ~off})
    moved = again.join(alike.select("project", F.col("candidate_id").alias("primary_id"), F.col("primary_id").alias("to")).hint("merge"), ["project", "primary_id"], "left")
    sources = alike.select("project", "primary_id", "candidate_id").unionByName(moved.select("project", F.coalesce("to", "primary_id").alias("primary_id"), "candidate_id"))
    return materialise(views, "views"), materialise(sources, "sources")


def summary(views: DataFrame) -> DataFrame:
    """(project, total, a count for every bucket and status)"""
    return views.groupBy("project").agg(F.count("*").alias("total"), *[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS], *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def ordered(views: DataFrame) -> list[Column]:
    """Sort keys of a list: usable, then conflicts, then what needs review (most parties found, fewest problems first), then the rest, in reading order."""
    rank = F.coalesce(_lookup({"usable": 0, "conflict": 1, "review": 2, "not_enforceable": 3, "off": 4}, F.col("bucket")), F.lit(5))
    found = sum((F.col(f"{n}_selector").isNotNull().cast("int") for n in PARTIES[1:]), F.col("subject_selector").isNotNull().cast("int"))
    review = F.col("bucket") == "review"
    return [rank, F.when(review, -found).otherwise(0), F.when(review, F.size("problems")).otherwise(0), F.col("document_id"), *[F.col(c) for c in ORDER]]


def matching(views: DataFrame, words: str) -> DataFrame:
    """Views whose sentence, parties, file, section or requirement hold every word, in comparison form."""
    text = X.norm_text(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("sentence", "subject", "target", "zone", "filename", "section", "requirement")]))
    for w in words.split():
        w = X.norm_text(F.lit(w))
        views = views.where((w == "") | F.contains(text, w))
    return views
