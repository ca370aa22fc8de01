"""Tables of a run's results: issue rows, links, payloads, markers, CSV, history lists. A run is one drawing's check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conformix.functions.text import fixed, safe_cell
from conformix.sources.tables import checked_join, materialise

# How many rows a report shows, by run.
DETAILS, PASS_ROWS, MARKERS, PLAN_ENTITIES = 500, 300, 20000, 20000
# Layers of markers, columns of the CSV file, wording of yes/no measurements.
MARKER_LAYERS = {"FAIL": "ERI_FAIL", "WARNING": "ERI_WARNING", "UNKNOWN": "ERI_UNKNOWN"}
CSV_COLUMNS = "問題編號 狀態 規則嚴重度 信心 規則編號 規則名稱 檢查方式 圖層 系統 Handle X Y 實測值 規則要求 單位 證據編號 證據出處 說明 判定依據 建議處理 與基準比較 專案".split()
ZONE_RULES = {"outside_zone": ("必須進入區域（不在區域外）", "必須在區域外"), "inside_zone": ("不得完全在區域內", "必須完全在區域內")}
ZONE_FOUND = {"outside_zone": ("進入了區域", "在區域外"), "inside_zone": ("不在（或未完全在）區域內", "完全在區域內")}
# Words of statuses, confidences and states.
STATUS_WORDS = {"FAIL": "不合格", "WARNING": "警告", "PASS": "合格", "UNKNOWN": "無法判定"}
CONFIDENCE_WORDS = {"CONFIRMED": "已確認", "INFERRED": "推算", "UNKNOWN": "無法判定"}
STATE_WORDS = {"NEW": "新增", "CHANGED": "有變化", "UNCHANGED": "未變"}
# Names of the measurements.
MEASURED = {
    "distance": "距離", "minimum_distance": "最短距離", "horizontal_clearance": "水平淨距", "vertical_clearance": "垂直淨距", "intersection": "交叉", "overlap": "重疊長度", "inside_zone": "位於區域內", "outside_zone": "位於區域外",
    "length": "長度", "angle": "角度", "off_axis_angle": "偏離正交角度", "entity_count": "物件數量", "entity_exists": "指定物件存在", "connectivity": "路徑連通性",
}
ANY_RESULT, NO_RESULT = "任何結果都符合（沒有限制）", "沒有任何結果能符合"


def severity_rank(status: Column) -> Column:
    return F.when(status == "FAIL", 0).when(status == "WARNING", 1).when(status == "UNKNOWN", 2).otherwise(3)


#: Orders of an issue list.
SORTS = {
    "severity": lambda: [severity_rank(F.col("status")), F.col("rule_id"), F.col("seq")],
    "rule": lambda: [F.col("rule_id"), F.col("seq")],
    "measured": lambda: [F.asc_nulls_last("measured"), F.col("seq")],
}


def general(v: Column) -> Column:
    """Six significant digits without trailing zeros, as C's %g writes them between 1e-4 and 1e6."""
    size = F.floor(F.log10(F.abs(v)))
    plain = F.when(v == 0, "0").when(size.between(-4, 5), fixed(v, F.lit(5) - size)).otherwise(F.format_string("%.5e", v))
    return F.when(plain.contains(".") & ~plain.contains("e"), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)


def _suffix(unit: Column) -> Column:
    return F.when(unit == "deg", "°").when(unit.isNull() | unit.isin("", "count"), "").otherwise(F.concat(F.lit(" "), unit))


def _accepts(flag: int, op: Column, value: Column) -> Column:
    x = F.lit(float(flag))
    return F.when(op == ">=", x >= value).when(op == ">", x > value).when(op == "<=", x <= value).when(op == "<", x < value).when(op == "==", x == value).when(op == "!=", x != value)


def required_text(measurement: Column, op: Column, value: Column, unit: Column) -> Column:
    """What the rule asks for, in words; zone rules measure a flag, so the words say which flag they accept."""
    out = F.when(value.isNull(), "")
    no, yes = _accepts(0, op, value), _accepts(1, op, value)
    for name, words in ZONE_RULES.items():
        zone = F.when(no & yes, ANY_RESULT).when(no, words[0]).when(yes, words[1]).when(no.isNotNull(), NO_RESULT).otherwise(F.concat_ws(" ", op, general(value)))
        out = out.when(measurement == name, zone)
    return out.when(measurement == "intersection", F.concat(F.lit("交叉數 "), op, F.lit(" "), general(value))).otherwise(F.concat(op, F.lit(" "), general(value), _suffix(unit)))


def measured_text(measurement: Column, value: Column, unit: Column) -> Column:
    out = F.when(value.isNull(), "")
    for name, words in ZONE_FOUND.items():
        out = out.when(measurement == name, F.when(value >= 1, words[1]).otherwise(words[0]))
    return out.when(measurement == "intersection", F.when(value >= 1, "有交叉").otherwise("沒有交叉")).otherwise(F.concat(general(value), _suffix(unit)))


def evidence_reference(filename: Column, page: Column, start: Column, end: Column) -> Column:
    """File, page and lines of an evidence row; the empty string where there is none."""
    lines = F.when(start == end, F.format_string("第%d行", start)).otherwise(F.format_string("第%d-%d行", start, end))
    return F.when(filename.isNull(), "").otherwise(F.concat(filename, F.when(page.isNull(), "").otherwise(F.format_string(" 第%d頁", page)), F.lit(" "), lines))


def entity_label(system: Column, entity_type: Column, layer: Column, handle: Column) -> Column:
    return F.concat(F.when(F.coalesce(system, F.lit("")) == "", "").otherwise(F.concat(system, F.lit(" "))), entity_type, F.lit("（圖層 "), layer, F.lit("，Handle "), handle, F.lit("）"))


def numbered(results: DataFrame) -> DataFrame:
    """Results as rows of a run, which is a drawing's: seq within the run, in rule order; x and y of the location.

    A run is numbered range by range: rows are counted by rule first, so that no run is sorted in one task.
    """
    order = ["rule_pos", "subject_seq", "target_handles"]
    runs = results.withColumnRenamed("drawing_key", "run_id")
    # a rule's rows of a run are cut into buckets of a few thousand subjects; what comes before each is a sum
    bucket = F.coalesce(F.floor(F.col("subject_seq") / SUBJECTS), F.lit(-1))
    # counted, then numbered: written so that the rules are evaluated once
    runs = materialise(runs.withColumn("_b", bucket), "numbered")
    sizes = runs.groupBy("run_id", "rule_pos", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("run_id").orderBy("rule_pos", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("run_id", "rule_pos", "_b", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("run_id", "rule_pos", "_b").orderBy(*order))
    out = runs.withColumn("_place", place).join(starts.hint("merge"), ["run_id", "rule_pos", "_b"])
    return out.withColumns({"seq": (F.col("_before") + F.col("_place") - 1).cast("long"), "x": F.col("loc_x"), "y": F.col("loc_y")}).drop("_b", "_place", "_before")


#: Subjects of a rule that are numbered together.
SUBJECTS = 16_384


def issue_rows(results: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows of evaluate.issue_ids() as a run stores them, with the limits of their rule and details as JSON."""
    limits = [(r["id"], r["severity"], r["measurement"], r["operator"], float(r["value"]) if r.get("value") is not None else None, r.get("unit")) for r in rules]
    known = results.sparkSession.createDataFrame(limits, "rule_id string, severity string, measurement string, required_op string, required_value double, unit string")
    # the list of rules is part of the job's text, so its size is known
    return with_details(numbered(results).join(F.broadcast(known), "rule_id"))


def with_details(issues: DataFrame) -> DataFrame:
    """Adds details_json: violations with handles, closest points, components, matches, surroundings, routes and reasons, as far as there are any."""
    has = set(issues.columns)
    parts = [F.struct(F.col("violations").alias("count"), F.col("listed_handles").alias("handles")).alias("violations")] if "listed_handles" in has else [F.col("violations")]
    parts += [F.col(c).alias(n) for c, n in (("contained", "contained"), ("closest", "closest_points"), ("groups", "components"), ("nearby", "nearby"), ("route_ids", "route_ids"), ("confidence_reasons", "confidence_reasons")) if c in has]
    return issues.withColumn("details_json", F.to_json(F.struct(*parts)))


def issue_links(issues: DataFrame) -> DataFrame:
    """(run_id, issue_id, role, handle), each once."""
    targets = F.transform("target_handles", lambda h: F.struct(F.lit("target").alias("role"), h.alias("handle")))
    subject = F.when(F.col("subject_handle").isNotNull(), F.array(F.struct(F.lit("subject").alias("role"), F.col("subject_handle").alias("handle"))))
    both = F.array_distinct(F.concat(F.coalesce(subject, F.array().cast("array<struct<role:string,handle:string>>")), targets))
    return issues.select("run_id", "issue_id", F.explode(both).alias("l")).select("run_id", "issue_id", "l.role", "l.handle")


def ranked(issues: DataFrame, sort: str = "severity") -> DataFrame:
    return issues.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(*SORTS[sort]())))


def select_issues(issues: DataFrame, statuses: list[str] | None = None, rule_id: str | None = None, search: str | None = None) -> DataFrame:
    """Issues of the given statuses and rule whose id, handles, layer or rule hold the searched text, in any case."""
    if statuses:
        issues = issues.where(F.col("status").isin(statuses))
    if rule_id:
        issues = issues.where(F.col("rule_id") == rule_id)
    if search:
        hit = F.lit(False)
        for c in ("issue_id", "handle", "layer", "rule_id"):
            hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(search.lower()))
        issues = issues.where(hit)
    return issues


def details(issues: DataFrame, most: int = DETAILS) -> DataFrame:
    """The first `most` issues of a run that do not pass, FAIL first, and how many of the run are not shown."""
    w = Window.partitionBy("run_id")
    bad = issues.where("status <> 'PASS'").withColumns({"rank": F.row_number().over(w.orderBy(severity_rank(F.col("status")), "seq")), "_n": F.count("*").over(w)})
    return bad.where(F.col("rank") <= most).withColumn("hidden", F.greatest(F.col("_n") - most, F.lit(0))).drop("_n")


# How a report says that units were assumed.
UNITS_ASSUMED = "圖面未宣告單位，以 mm 推定"


def report_lines(issues: DataFrame, drawings: DataFrame) -> DataFrame:
    """(run_id, section, item, content): the tables of a report beside its details, as lines.

    header: units; coverage: rules that were evaluated, and how they ended; result: issues by status; rule: counts by status and outcome of every
    rule; comparison: issues by their state against the baseline, if they carry one. drawings: (drawing_key, unit_to_mm, units_assumed).
    """
    line = lambda section, item, content: F.struct(F.lit(section).alias("section"), (F.lit(item) if isinstance(item, str) else item).alias("item"), content.cast("string").alias("content"))
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    statuses = ("FAIL", "WARNING", "UNKNOWN", "PASS")
    per = issues.groupBy("run_id", "rule_id").agg(*map(count, statuses))
    outcome = F.coalesce(*[F.when(F.col(s) > 0, s) for s in statuses])
    rules = per.select("run_id", line("rule", F.col("rule_id"), F.concat_ws(" ", *[F.concat(F.lit(f"{s}="), F.col(s)) for s in statuses], outcome)).alias("l"))
    ended = per.withColumn("o", outcome).groupBy("run_id").agg(F.count("*").alias("evaluated"), *[F.count_if(F.col("o") == s).alias(s) for s in statuses])
    coverage = ended.select("run_id", F.explode(F.array(line("coverage", "evaluated", F.col("evaluated")), *[line("coverage", s, F.col(s)) for s in statuses])).alias("l"))
    totals = per.groupBy("run_id").agg(*[F.sum(s).alias(s) for s in statuses])
    result = totals.select("run_id", F.explode(F.array(*[line("result", s, F.col(s)) for s in statuses])).alias("l"))
    units = F.when(F.col("units_assumed"), UNITS_ASSUMED).otherwise(F.concat(F.lit("1 圖面單位 = "), general(F.col("unit_to_mm")), F.lit(" mm")))
    header = drawings.select(F.col("drawing_key").alias("run_id"), line("header", "單位", units).alias("l"))
    out = header.unionByName(coverage).unionByName(result).unionByName(rules)
    if "baseline_state" in issues.columns:
        states = issues.where("baseline_state IS NOT NULL").groupBy("run_id", "baseline_state").agg(F.count("*").alias("n"))
        out = out.unionByName(states.select("run_id", line("comparison", F.col("baseline_state"), F.col("n")).alias("l")))
    return out.select("run_id", "l.section", "l.item", "l.content")


def payload(issues: DataFrame, passes: int = PASS_ROWS) -> DataFrame:
    """What a report page shows: every issue that does not pass and the first passes of a run, with texts."""
    n = F.row_number().over(Window.partitionBy("run_id", F.col("status") == "PASS").orderBy("seq"))
    shown = issues.withColumn("_r", n).where((F.col("status") != "PASS") | (F.col("_r") <= passes)).drop("_r")
    m, u = F.col("measurement"), F.col("unit")
    return shown.withColumns({"measured_text": measured_text(m, F.col("measured"), u), "required_text": required_text(m, F.col("required_op"), F.col("required_value"), u)})


def _worded(words: dict, c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), c), c, F.lit(""))


def with_reference(issues: DataFrame, chunks: DataFrame) -> DataFrame:
    """Issues with evidence_ref, the file, page and lines of their evidence, and its text; empty and null where there is none."""
    said = chunks.select(F.col("id").alias("evidence_id"), evidence_reference(F.col("filename"), F.col("page"), F.col("line_start"), F.col("line_end")).alias("evidence_ref"), F.col("text").alias("evidence_text"))
    # issues rest on as many rows of evidence as there are rules: dealt by evidence, those of one rule would meet in one task
    said = materialise(said.join(issues.select("evidence_id").distinct().hint("merge"), "evidence_id", "left_semi"), "said")
    longest = said.agg(F.max(F.octet_length("evidence_text") + F.octet_length("evidence_ref"))).first()[0] or 0
    return checked_join(issues, said, "evidence_id", "left", 100 + longest).withColumn("evidence_ref", F.coalesce("evidence_ref", F.lit("")))


def csv_rows(issues: DataFrame, project: str) -> DataFrame:
    """Issues in the columns of the CSV file; texts that a spreadsheet would run are made harmless. What issues do not carry is empty."""
    empty, m, u = F.lit(""), F.col("measurement"), F.col("unit")
    own = lambda c: F.coalesce(F.col(c), empty) if c in issues.columns else empty
    cells = [
        F.col("issue_id"), _worded(STATUS_WORDS, F.col("status")), F.col("severity"), _worded(CONFIDENCE_WORDS, own("confidence")), safe_cell(F.col("rule_id")), safe_cell(own("rule_name")), _worded(MEASURED, m), safe_cell(F.col("layer")), safe_cell(F.col("system")),
        safe_cell(F.col("handle")), F.coalesce(fixed(F.col("x"), 3), empty), F.coalesce(fixed(F.col("y"), 3), empty), F.when(F.col("measured").isNull(), "").otherwise(general(F.col("measured"))),
        required_text(m, F.col("required_op"), F.col("required_value"), u), F.coalesce(u, empty), own("evidence_id"), safe_cell(own("evidence_ref")), safe_cell(own("message")), safe_cell(own("reason")), safe_cell(own("fix")),
        _worded(STATE_WORDS, own("baseline_state")), safe_cell(F.lit(project)),
    ]
    return issues.select(*[c.alias(n) for c, n in zip(cells, CSV_COLUMNS, strict=True)])


def marker_label(issue_id: Column, status: Column, measured: Column, op: Column, value: Column, unit: Column) -> Column:
    """ASCII only: part of the id, status, measurement against limit."""
    u = F.when(unit.isNull() | unit.isin("", "count"), "").otherwise(unit)
    against = F.when(measured.isNotNull() & value.isNotNull(), F.concat(F.lit(" "), general(measured), u, F.lit(" vs "), op, general(value), u)).otherwise("")
    return F.concat(F.substring(issue_id, 5, 8), F.lit(" "), status, against)


def markers(issues: DataFrame, extents: DataFrame, most: int = MARKERS) -> DataFrame:
    """Circle, cross hairs and label of every located issue that does not pass, and a line between closest points that lie apart. extents: (run_id, span, unit_to_mm), one row a run."""
    located = issues.where("status <> 'PASS' AND x IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(severity_rank(F.col("status")), "seq"))).where(F.col("rank") <= most)
    m = located.join(extents.hint("merge"), "run_id").withColumn("size", F.greatest(F.col("span") * 0.006, F.lit(20.0) / F.col("unit_to_mm")))
    x, y, s = F.col("x"), F.col("y"), F.col("size")

    def mark(kind, x1, y1, x2, y2):
        return F.struct(F.lit(kind).alias("kind"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    shapes = F.array(mark("circle", x, y, x + s, y), mark("line", x - s, y, x + s, y), mark("line", x, y - s, x, y + s), mark("text", x + s * 1.3, y + s * 0.3, x + s * 1.3, y + s * 1.1))
    if "closest" in issues.columns:
        a, b = F.col("closest.pa"), F.col("closest.pb")
        apart = a.isNotNull() & b.isNotNull() & ((a["x"] != b["x"]) | (a["y"] != b["y"]))
        shapes = F.when(apart, F.concat(shapes, F.array(mark("closest", a["x"], a["y"], b["x"], b["y"])))).otherwise(shapes)
    layer = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in MARKER_LAYERS.items()])
    label = marker_label(F.col("issue_id"), F.col("status"), F.col("measured"), F.col("required_op"), F.col("required_value"), F.col("unit"))
    return m.select("run_id", "issue_id", layer.alias("marker_layer"), label.alias("label"), F.explode(shapes).alias("m")).select("run_id", "issue_id", "marker_layer", "label", "m.*")


def plan_entities(entities: DataFrame, links: DataFrame, most: int = PLAN_ENTITIES) -> DataFrame:
    """Entities of a plan view: those of issues first, then others but texts, up to `most` a drawing; left_out counts the rest."""
    hit = links.select(F.col("run_id").alias("drawing_key"), "handle").distinct().withColumn("involved", F.lit(True))
    e = entities.join(hit.hint("merge"), ["drawing_key", "handle"], "left").withColumn("involved", F.coalesce("involved", F.lit(False))).where("involved OR kind <> 'text'")
    w = Window.partitionBy("drawing_key")
    e = e.withColumns({"_r": F.row_number().over(w.orderBy(F.desc("involved"), "seq")), "_n": F.count("*").over(w)})
    return e.where((F.col("_r") <= most) | F.col("involved")).withColumn("left_out", F.greatest(F.col("_n") - most, F.lit(0))).drop("_r", "_n")


def default_baselines(runs: DataFrame) -> DataFrame:
    """(run_id, baseline): the latest other completed run of the same project and name.

    The two latest of a name are enough: a run that is the latest takes the second one.
    """
    name = ["project", "logical_name"]
    done = runs.where("status = 'completed'").withColumn("_o", F.struct("finished_at", "run_id"))
    first = done.groupBy(*name).agg(F.max("_o").alias("a"))
    second = done.join(first.hint("merge"), name).where("_o < a").groupBy(*name).agg(F.max("_o").alias("b"))
    top = first.join(second.hint("merge"), name, "left")
    own = F.col("a.run_id") == F.col("run_id")
    return runs.join(top.hint("merge"), name, "left").select("run_id", F.when(own, F.col("b.run_id")).otherwise(F.col("a.run_id")).alias("baseline"))


def fingerprint(rules: DataFrame, key: str) -> DataFrame:
    """(key, sha256) of each set of rules, whatever the order of its rows and fields: rules are (key, id, and other columns)."""
    fields = sorted(c for c in rules.columns if c != key)
    one = F.to_json(F.struct(*fields))
    return rules.groupBy(key).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(one))), 256).alias("sha256"))
