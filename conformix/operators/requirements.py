"""Requirements of specification sentences as rows: shape, parties, limit, problems; one candidate for each meaning.

Every step is a projection over columns; only equal sentences, their clauses and equal meanings meet in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conformix.functions import requirements as Q
from conformix.functions import text as X
from conformix.sources.tables import checked_join, materialise

LONGEST = 600

# Wording of the shapes, and of what belongs to none.
AXIS = "(淨距|間距|距離|淨空|間隔|間隙|淨高)"
LEVEL = r"(?:水平|橫向|平面)\s*(?:方向)?(?:之|的)?" + AXIS
UPRIGHT = r"(?:垂直|豎向|垂向|高程差|上下)\s*(?:方向)?(?:之|的)?(?:" + AXIS + ")?"
SPACING = "保持|維持|預留|留設|保留|間隔|相距|淨空"
SQUARE = "水平或垂直|垂直或水平|平行或垂直|垂直或平行|正交|橫平豎直"
DEVIATION = "偏差|誤差|偏離|傾斜|角度"
FORBIDDEN, CROSS = "(?:不得|不可|不應|禁止|嚴禁)", "(?:相)?(?:交叉|交錯|相交)"
BAN_CROSS = rf"(?:禁止|嚴禁)(.+?)(?:與|和|跟)(.+?){CROSS}"
PAIR_CROSS = rf"(.+?){FORBIDDEN}(?:與|和|跟)(.+?){CROSS}"
MUTUAL_CROSS = rf"(.+?){FORBIDDEN}{CROSS}"
KEEP_OUT = rf"(.*?){FORBIDDEN}(?:進入|侵入|穿越|穿入|佔用|占用)(.+)"
INSIDE = "(.+?)(?:必須|應|須|需)(?:完全)?(?:位於|設置於|設於|布設於|佈設於|敷設於|限於)(.+?)(?:之?內|範圍內|區域內)"
COUNTED = r"(?<![\d.])(\d+|[一二兩三四五六七八九十]+)\s*(個|處|組|支|條|只|台|根|座|點|套|盞)"
PLACES = "[內中裡間處]$"
VAGUE = (
    "(?i)適當|適度|適宜|足夠|充足|充分|方便|便於|易於|整齊|美觀|儘量|盡量|儘可能|盡可能|避免影響|不影響|妥善|合理|縮短|最短路徑|良好|必要時|視需要|視情況|依需要|"
    "appropriate|adequate|sufficient|convenient|as far as practicable"
)
ROUTING = (
    "(?i)管線|電纜|線纜|纜線|光纜|線槽|線架|管架|橋架|支架|拉線箱|接線箱|導管|配管|風管|水管|管道|管路|機房|間距|淨距|距離|間隔|淨空|交叉|穿越|路徑|走向|敷設|佈設|布設|"
    "維修|檢修|操作空間|pipe|cable|duct|tray|conduit|clearance|routing"
)
ABOUT_DOCUMENTS = "(?i)逕自|逾越|引用|認定|等同|證據|文件|版本|Findings?|Source|Evidence|檔案|欄位"
LAYING = (
    "保持|維持|預留|留設|設置|設於|設在|佈設|布設|敷設|配置|穿越|通過|跨越|距離|間距|淨距|間隔|淨空|交叉|固定|支撐|隔離|分離|檢修|維修|安裝|裝設|排列|走向|路徑"
)
# Words around the name of a party, and words that no name holds.
LEADS = ("^(?:另外|此外|同時|且|並|而|但|惟|其|凡是|凡|所有|各類|各)+", "^(?:最近的|最近之|最近|該|其|各|所有)+")
TAIL = "(?:兩者|雙方|二者)?(?:之間|間)?(?:之|的)?(?:應|須|必須|需)?(?:保持|維持|預留|留設|保留|具有|有)?(?:之|的)?(?:最小|最低|最大)?$"
CONNECTORS = "與|和|及|跟|距離?|至(?!少)"
CLAUSAL = "應|須|不得|不應|不宜|預留|保持|維持|滿足|考慮|必須|需要|宜|可|得|至少|最小|最大|不小於|不大於|以上|以下|以內|時|若|如|避免|發生|^為"
EACH = "(?:單一|單段|單根|單支|每一段|每段|每根|每支|每一)$"

#: shape -> (template, measurement); a distance with an upper limit becomes max_distance.
TEMPLATES = {
    "ban_cross": ("no_crossing", "intersection"), "pair_cross": ("no_crossing", "intersection"), "mutual_cross": ("no_crossing", "intersection"),
    "keep_out": ("keep_out", "outside_zone"), "inside": ("inside_zone", "inside_zone"), "level": ("clearance", "horizontal_clearance"),
    "upright": ("vertical_clearance", "vertical_clearance"), "length": ("max_length", "length"), "square": ("orthogonal", "off_axis_angle"),
    "count": ("min_count", "entity_count"), "distance": ("clearance", "horizontal_clearance"),
}
LIMITED = ("level", "upright", "length", "distance")
PAIRED = ("level", "upright", "distance", "mutual_cross")
CROSSINGS, ZONES = ("ban_cross", "pair_cross", "mutual_cross"), ("keep_out", "inside")
VAGUE_REASON, DIRECTION_REASON, SHAPE_REASON = "VAGUE_WORDING", "UNSUPPORTED_DIRECTION", "UNSUPPORTED_SHAPE"

_QUANTITY = X.QUANTITY.replace("(?i)", "")
_NUMBER = "(?i)" + _QUANTITY.replace(r"\s*(", r"\s*(?:(", 1) + ")?"
_AFTERWARDS = _NUMBER + r"\s*(以上|以下|以內|以外)"


def _nothing(c: Column) -> Column:
    return F.when(c != "", c)


def name_of(c: Column) -> Column:
    """A party's bare name: no joining words, determiners or verbs at its ends. Each turn that finds an ending shortens the name, so
    as many turns as it has characters are enough."""
    c = F.regexp_replace(c, "^[ ,，、]+|[ ,，、]+$", "")
    for lead in LEADS:
        c = F.regexp_replace(c, lead, "")
    c = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), c, lambda name, _: F.trim(F.regexp_replace(name, TAIL, "")))
    return F.trim(F.regexp_replace(c, "(?:之|的|等|與|和|及|跟)$", ""))


def last_clause(c: Column) -> Column:
    """The last clause whose name is longer than one character, else the first one."""
    clauses = F.filter(F.split(c, "[,:;]"), lambda x: F.trim(x) != "")
    named = F.filter(clauses, lambda x: F.length(name_of(x)) > 1)
    return F.coalesce(F.try_element_at(named, F.lit(-1)), F.get(clauses, F.lit(0)), F.lit(""))


def plausible(c: Column, longest: Column) -> Column:
    """The phrase if it can name objects of a drawing: short, no verb, no quantity; else the empty string."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when((F.length(t) <= longest) & ~t.rlike(CLAUSAL) & ~t.rlike(X.QUANTITY), t).otherwise("")


def clauses(sentences: DataFrame) -> DataFrame:
    """Adds part (0: the sentence; from 1: its clauses, where both axes are named apart), nf and modality; longer sentences than LONGEST are no requirements."""
    nf = F.regexp_replace(X.nfkc(Q.without_numbering(F.col("sentence"))), r"\*\*|`", "")
    df = sentences.where(F.length("sentence") <= LONGEST).withColumn("_all", nf).where("_all <> ''").withColumn("modality", Q.modality(F.col("_all")))
    df = df.withColumns({"_h": F.regexp_extract("_all", LEVEL, 0), "_v": F.regexp_extract("_all", UPRIGHT, 0), "_va": F.regexp_extract("_all", UPRIGHT, 1)})
    two = (F.col("_h") != "") & (F.col("_va") != "") & (F.regexp_instr("_all", F.lit(LEVEL)) != F.regexp_instr("_all", F.lit(UPRIGHT)))
    own = F.filter(F.split("_all", "[,;]"), lambda x: x.rlike(LEVEL) | (F.regexp_extract(x, UPRIGHT, 1) != ""))
    parts = F.concat(F.array("_all"), F.when(two, own).otherwise(F.array().cast("array<string>")))
    return df.select(*sentences.columns, "modality", F.posexplode_outer(parts).alias("part", "nf"))


def shaped(df: DataFrame) -> DataFrame:
    """Adds shape: the first of the fixed order that the clause has, or null."""
    nf = F.col("nf")
    inch = F.regexp_replace(nf, r"(?i)(\d\s*)(in|inch|inches|吋|英吋)(?=\s+[A-Za-z])", "$1#")
    df = df.withColumns(
        {
            "_q": inch, "_vague": nf.rlike(VAGUE), "_level": F.regexp_extract(nf, LEVEL, 0), "_up": F.regexp_extract(nf, UPRIGHT, 0), "_upaxis": F.regexp_extract(nf, UPRIGHT, 1),
            "_lengths": F.exists(X.quantities_in(nf), lambda q: q["unit"] != "deg"), "_duty": F.col("modality") != "unknown",
        }
    ).withColumn("_counted", F.col("_q").rlike(X.QUANTITY) | nf.rlike(COUNTED))
    tests = [
        ("ban_cross", nf.rlike(BAN_CROSS)), ("pair_cross", nf.rlike(PAIR_CROSS)), ("mutual_cross", nf.rlike(MUTUAL_CROSS)),
        ("keep_out", F.trim(F.regexp_extract(nf, KEEP_OUT, 2)) != ""), ("inside", nf.rlike(INSIDE)), ("level", F.col("_level") != ""),
        ("upright", (F.col("_upaxis") != "") | F.contains("_up", F.lit("高程差"))), ("length", F.contains(nf, F.lit("長度")) & ~nf.rlike(AXIS)),
        ("square", nf.rlike(SQUARE) & F.col("_duty")), ("count", nf.rlike("至少.*?" + COUNTED)), ("distance", nf.rlike(AXIS) | (nf.rlike(SPACING) & F.col("_lengths") & F.col("_duty"))),
    ]
    return df.withColumn("shape", F.coalesce(*[F.when(test, name) for name, test in tests]))


def with_parties(df: DataFrame) -> DataFrame:
    """Adds subject, target, zone (empty if not named) and _party: what is wrong with the pair."""
    nf, shape = F.col("nf"), F.col("shape")
    word = (
        F.when(shape == "level", F.col("_level")).when(shape == "upright", F.col("_up")).when(shape == "length", "長度").when(shape == "square", F.regexp_extract(nf, SQUARE, 0))
        .when(shape == "count", "至少").when(shape == "distance", F.coalesce(_nothing(F.regexp_extract(nf, AXIS, 0)), F.regexp_extract(nf, SPACING, 0)))
    )
    first = second = F.lit(None).cast("string")
    for name, form in (("ban_cross", BAN_CROSS), ("pair_cross", PAIR_CROSS), ("mutual_cross", MUTUAL_CROSS), ("keep_out", KEEP_OUT), ("inside", INSIDE)):
        first = F.when(shape == name, F.regexp_extract(nf, form, 1)).otherwise(first)
        if name != "mutual_cross":
            second = F.when(shape == name, F.regexp_extract(nf, form, 2)).otherwise(second)
    df = df.withColumn("_word", word).withColumns({"_first": F.coalesce(first, F.expr("substring_index(nf, _word, 1)")), "_second": second})
    df = df.withColumn("_raw", Q.without_numbering(last_clause(F.col("_first")))).withColumn("_name", F.get(F.transform(F.array("_raw"), name_of), F.lit(0)))
    df = df.withColumn("_joints", F.regexp_count("_name", F.lit(CONNECTORS)))
    counted = F.regexp_replace(F.regexp_extract(nf, f"至少.*?{COUNTED}(.*)$", 3), r"^\s*(?:設置|設|有|裝設|配置|佈設|布設|安裝)?", "")
    paired, several = shape.isin(*PAIRED), F.col("_joints") > 1
    phrases = {
        "name": ("_raw", F.when(paired & several, 60).otherwise(24)),
        "left": (F.regexp_extract("_name", f"^(.*?)(?:{CONNECTORS})", 1), 24),
        "right": (F.regexp_extract("_name", f"^.*?(?:{CONNECTORS})(.*)$", 1), 24),
        "other": ("_second", 24),
        "place": (F.when(shape == "keep_out", F.get(F.split("_second", "[,;]"), F.lit(0))).otherwise(F.col("_second")), 40),
        "single": (F.regexp_replace("_name", EACH, ""), 24),
        "things": (F.get(F.split(counted, "[,;]"), F.lit(0)), 24),
        "before": (F.regexp_replace("_first", "(?:應|須|必須|需)?(?:設置|設|有|裝設|配置)?$", ""), 24),
    }
    made = F.array(*[F.struct((F.col(c) if isinstance(c, str) else c).alias("c"), (n if isinstance(n, Column) else F.lit(n)).alias("n")) for c, n in phrases.values()])
    # one function over all phrases keeps the generated code small
    df = df.withColumn("_names", F.transform(made, lambda p: plausible(name_of(p["c"]), p["n"])))
    named = {k: F.get("_names", F.lit(i)) for i, k in enumerate(phrases)}
    one = paired & (F.col("_joints") == 1)
    subject = F.when(one, named["left"]).when(shape == "length", named["single"]).when(shape == "count", F.coalesce(_nothing(named["things"]), named["before"])).otherwise(named["name"])
    target = F.when(one, named["right"]).when(shape.isin("ban_cross", "pair_cross"), named["other"]).otherwise("")
    df = df.withColumns({"subject": subject, "target": target, "zone": F.when(shape.isin(*ZONES), named["place"]).otherwise("")})
    lacking = F.when(F.col("_joints") > 1, "AMBIGUOUS_PARTIES").when((F.col("_joints") == 0) | (F.col("target") == ""), "TARGET_MISSING")
    return df.withColumn("_party", F.when(paired, lacking))


def with_limit(df: DataFrame) -> DataFrame:
    """Adds operator, value, unit and _limit: what is wrong with the comparison. A number without a unit stays without one."""
    nf, shape = F.col("nf"), F.col("shape")
    angle = (shape == "square") & nf.rlike(DEVIATION)
    read = shape.isin(*LIMITED) | angle
    df = df.withColumns({"_read": read, "_d": Q.direction(nf), "_after": F.regexp_extract("_q", _AFTERWARDS, 3)})
    stated, trailing = F.col("_d.operator"), F.col("_d.operator").isNull() & F.col("_d.problem").isNull() & (F.col("_after") != "")
    rest = F.expr("substring(_q, locate(_d.words, _q) + length(_d.words))")
    at = F.regexp_instr(rest, F.lit(_NUMBER))
    place = F.when(trailing, F.regexp_extract("_q", _AFTERWARDS, 0)).when(stated.isNotNull() & (at > 0) & (at <= 31), rest).otherwise(F.col("_q"))
    df = df.withColumns({"_trailing": trailing, "_where": place})
    df = df.withColumns({"_number": _nothing(F.regexp_extract("_where", _NUMBER, 1)), "_u": X.canonical_unit(_nothing(F.regexp_extract("_where", _NUMBER, 2)))})
    number = F.replace(F.col("_number"), F.lit(","), F.lit("")).cast("double")
    operator = F.when(F.col("_trailing"), F.when(F.col("_after") == "以上", ">=").when(F.col("_after") != "以外", "<=")).otherwise(F.col("_d.operator"))
    length = F.col("_u").isNotNull() & (F.col("_u") != "deg")
    counted = Q.count_of(F.regexp_extract(nf, f"至少.*?{COUNTED}", 1)).cast("double")
    fixed = shape.isin(*CROSSINGS, *ZONES)
    written = F.concat(F.trim(F.regexp_extract("_where", _NUMBER, 0)), F.when(F.col("_trailing"), F.col("_after")).otherwise(""))
    df = df.withColumns(
        {
            "_op": operator,
            "value_text": F.when(F.col("_read") & F.col("_number").isNotNull(), written).when(shape == "count", F.regexp_extract(nf, f"至少.*?({COUNTED})", 1)).otherwise(""),
            "value": F.when(shape.isin(*CROSSINGS), 0.0).when(shape.isin(*ZONES), 1.0).when(shape == "count", counted).when(F.col("_read"), F.when(length & (shape != "square"), Q.to_mm(number, F.col("_u"))).otherwise(number)),
            "unit": F.when(fixed | ((shape == "count") & counted.isNotNull()), "count").when(F.col("_read"), F.when(length & (shape != "square"), "mm").otherwise(F.col("_u"))),
            "operator": F.when(fixed, "==").when(shape == "count", ">=").when(shape == "square", "<=").when(F.col("_read"), operator),
        }
    )
    both, undirected = F.when(F.col("_d.problem").isNotNull(), "BOTH_DIRECTIONS"), F.when(F.col("_op").isNull() & F.col("_d.problem").isNull(), "NO_DIRECTION")
    fits = F.when(shape == "square", F.col("_u") == "deg").otherwise(F.col("_u") != "deg")
    unitless = F.when(F.col("_number").isNull(), F.when(shape != "square", "NO_VALUE")).when(F.col("_u").isNull(), "NO_UNIT").when(~fits, "UNIT_MISMATCH")
    problems = F.when(F.col("_read"), F.array(both, undirected, unitless)).when((shape == "count") & F.col("value").isNull(), F.array(F.lit("NO_VALUE"))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("_limit", problems)


def judged(df: DataFrame) -> DataFrame:
    """Adds template, measurement, problems, enforceable and reason; clauses that require nothing leave."""
    nf, shape, duty, value, op = F.col("nf"), F.col("shape"), F.col("_duty"), F.col("value"), F.col("_op")
    limited, wanted = shape.isin("level", "upright", "length"), F.when(shape == "length", "<=").otherwise(">=")
    wordy = duty & nf.rlike(ROUTING) & ~nf.rlike(ABOUT_DOCUMENTS) & (F.col("_vague") | ~F.col("_counted")) & nf.rlike(LAYING)
    firm = nf.rlike("不得|應|須|必須|禁止|嚴禁") & (F.length(nf) >= 8)
    wrong_way = F.when(duty, DIRECTION_REASON).otherwise("-")
    # a reason, "-" for clauses that are dropped, null for requirements that can be checked
    reason = (
        F.when(shape.isNull(), F.when(wordy & F.col("_vague"), VAGUE_REASON).when(wordy & firm, SHAPE_REASON).otherwise("-"))
        .when(limited & F.col("_vague") & value.isNull(), VAGUE_REASON)
        .when((shape == "distance") & F.col("_vague") & ~F.col("_counted"), VAGUE_REASON)
        .when((limited | (shape == "distance")) & value.isNull() & ~duty, "-")
        .when(limited & ~duty & op.isNull() & F.col("unit").isNull(), "-")
        .when(limited & (op != wanted), wrong_way)
        .when((shape == "square") & F.col("_read") & (op == ">="), wrong_way)
    )
    # through a generator, since a filter would be pushed below all steps with each step's text put in the next
    kept = F.when(~reason.eqNullSafe("-"), F.array(F.struct(reason.alias("reason"))))
    df = df.select("*", F.explode_outer(kept).alias("_kept")).where("_kept IS NOT NULL").withColumn("reason", F.col("_kept.reason"))
    far = (shape == "distance") & (op == "<=")
    pick = lambda i: F.coalesce(*[F.when(shape == k, v[i]) for k, v in TEMPLATES.items()])
    one_party = shape.isin("keep_out", "inside", "length", "square", "count") & F.col("subject").rlike(CONNECTORS)
    problems = F.concat(
        F.array(F.when(F.col("modality") == "advisory", "ADVISORY").when(~duty, "NO_MODAL")),
        F.col("_limit"),
        F.array(
            F.when((shape == "square") & value.isNull(), "MISSING_TOLERANCE"),
            F.col("_party"),
            F.when((shape == "distance") & ~far.eqNullSafe(True), "UNSPECIFIED_AXIS"),
            F.when((shape == "keep_out") & F.col("subject").rlike(PLACES), "AMBIGUOUS_PARTIES"),
            F.when(F.col("subject") == "", "SUBJECT_MISSING"),
            F.when(shape.isin(*CROSSINGS) & (F.col("target") == "") & ~F.col("_party").eqNullSafe("AMBIGUOUS_PARTIES"), "TARGET_MISSING"),
            F.when(shape.isin(*ZONES) & (F.col("zone") == ""), "ZONE_MISSING"),
            F.when(one_party, "AMBIGUOUS_PARTIES"),
        ),
    )
    ok = F.col("reason").isNull()
    none = F.array().cast("array<string>")
    return df.withColumns(
        {
            "template": F.when(ok, F.when(far, "max_distance").otherwise(pick(0))),
            "measurement": F.when(ok, F.when(far, "distance").otherwise(pick(1))),
            "operator": F.when(ok, F.col("operator")), "value": F.when(ok, value), "unit": F.when(ok, F.col("unit")), "value_text": F.when(ok, F.col("value_text")).otherwise(""),
            "subject": F.when(ok, F.col("subject")).otherwise(""), "target": F.when(ok, F.col("target")).otherwise(""), "zone": F.when(ok, F.col("zone")).otherwise(""),
            "problems": F.when(ok, F.array_distinct(F.array_compact(problems))).otherwise(none), "enforceable": ok,
        }
    )


FIELDS = ["part", "modality", "template", "measurement", "operator", "value", "unit", "value_text", "subject", "target", "zone", "problems", "enforceable", "reason"]


def requirements(sentences: DataFrame, key: list[str]) -> DataFrame:
    """Requirements of (key, sentence): one row each, or one a clause where a sentence limits both axes.

    A clause without parties takes those of the sentence's first clause, which a person has to confirm (INHERITED_PARTIES).
    Sentences that require nothing give no row; a null sentence is such a one. What a sentence requires depends on its text alone, so each
    different one is read once, and rows are given their sentence's requirements.
    """
    df = sentences.select(*key, "sentence")
    read = materialise(_read(df.select("sentence").where("sentence IS NOT NULL").distinct()), "read")
    return checked_join(df, read, "sentence", "inner", 1000).select(*key, "sentence", *FIELDS)


def _read(sentences: DataFrame) -> DataFrame:
    """requirements() of different sentences."""
    df = judged(with_limit(with_parties(shaped(clauses(sentences)))))
    df = df.select("sentence", *FIELDS)
    own = F.col("part") > 0
    w = Window.partitionBy("sentence")
    lead = F.min(F.when(own, F.struct("part", "subject", "target"))).over(w)
    df = df.withColumns({"_n": F.count(F.when(own, 1)).over(w), "_t": F.size(F.collect_set(F.when(own, F.coalesce("template", F.lit("-")))).over(w)), "_lead": lead})
    apart = (F.col("_n") >= 2) & (F.col("_t") >= 2)
    df = df.where((apart & own) | (~apart & ~own))
    heir = (F.col("part") > F.coalesce("_lead.part", F.lit(0))) & own & (F.col("subject") == "")
    settled = F.concat(F.filter("problems", lambda p: ~p.isin("SUBJECT_MISSING", "TARGET_MISSING")), F.array(F.lit("INHERITED_PARTIES")))
    df = df.withColumns({"problems": F.when(heir, settled).otherwise(F.col("problems")), "target": F.when(heir, F.col("_lead.target")).otherwise(F.col("target")), "subject": F.when(heir, F.col("_lead.subject")).otherwise(F.col("subject"))})
    return df.drop("_n", "_t", "_lead")


def with_identity(df: DataFrame) -> DataFrame:
    """Adds family (measurement and parties) and meaning: family with limit; an unfinished requirement is told apart by its sentence too."""
    text = lambda c: F.coalesce(F.col(c), F.lit("?"))
    other = F.coalesce(_nothing(X.norm_text(F.col("target"))), X.norm_text(F.col("zone")))
    family = F.concat_ws("|", text("measurement"), X.norm_text(F.col("subject")), other)
    meaning = F.concat_ws("|", family, text("operator"), Q.fmt_num(F.col("value")), text("unit"))
    finished = F.col("enforceable") & (F.size("problems") == 0)
    return df.withColumns({"family": family, "meaning": F.when(finished, meaning).otherwise(F.concat(meaning, F.lit("|s:"), F.substring(F.sha2(X.norm_text(F.col("sentence")), 256), 1, 10)))})


def candidate_id(document_hash: Column, meaning: Column) -> Column:
    return F.concat(F.lit("cand_"), F.substring(F.sha2(F.concat_ws("|", document_hash, meaning), 256), 1, 16))


def group_id(family: Column) -> Column:
    return F.concat(F.lit("grp_"), F.substring(F.sha2(family, 256), 1, 16))


ORDER = ["page", "line_start", "sentence_no", "part"]


def from_chunks(chunks: DataFrame) -> DataFrame:
    """Candidates of evidence chunks: the first statement of each meaning in a document, with its sentence and place."""
    s = chunks.select("document_id", F.col("id").alias("evidence_id"), "page", "line_start", F.posexplode_outer(Q.sentences(F.col("text"))).alias("sentence_no", "sentence")).where("sentence IS NOT NULL")
    found = with_identity(requirements(s, ["document_id", "evidence_id", "page", "line_start", "sentence_no"]))
    # one row of each meaning and document, combined before the shuffle
    rest = [c for c in found.columns if c not in ("document_id", "meaning", *ORDER)]
    first = found.groupBy("document_id", "meaning").agg(F.min_by(F.struct(*ORDER, *rest), F.struct(*ORDER)).alias("c"))
    return first.select("document_id", "meaning", "c.*").withColumn("candidate_id", candidate_id(F.col("document_id"), F.col("meaning")))


def merged(candidates: DataFrame) -> DataFrame:
    """One row of each meaning over all documents: the first document's candidate and the number of sources."""
    order = F.struct("document_id", *ORDER)
    rest = [c for c in candidates.columns if c not in ("meaning", "document_id", *ORDER)]
    m = candidates.groupBy("meaning").agg(F.min_by(F.struct("document_id", *ORDER, *rest), order).alias("c"), F.count("*").alias("sources"))
    return m.select("meaning", "c.*", "sources")


def conflicts(candidates: DataFrame) -> DataFrame:
    """(group_id, family, signatures, members) of families whose finished requirements differ in operator, value or unit."""
    finished = candidates.where("enforceable AND size(problems) = 0 AND value IS NOT NULL AND operator IS NOT NULL AND unit IS NOT NULL")
    signatures = finished.groupBy("family", "operator", Q.fmt_num(F.col("value")).alias("_v"), "unit").agg(F.count("*").alias("n"))
    out = signatures.groupBy("family").agg(F.count("*").alias("signatures"), F.sum("n").alias("members")).where("signatures >= 2")
    return out.select(group_id(F.col("family")).alias("group_id"), "family", "signatures", "members")
