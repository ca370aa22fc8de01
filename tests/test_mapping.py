"""Glossaries, wildcards and phrases against plain Python."""

import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from conformix.operators import mapping as M

LAYERS = {
    "p": ["SCADA-CABLE", "SCADA", "scada-tray", "COMM-1", "TEL", "POWER", "POWER-LV", "ELEC-HV", "管溝", "ZONE-A", "ZONE A", "給水管", "-", "W[1]", "a.b", "SIG-1"],
    "q": ["SCADA", "Power", "X1"],
    "r": [],
}
SYSTEMS = {"p": [("SCADA 系統", "^SCADA"), ("弱電", "^(COMM|TEL)"), ("給排水", "給水"), ("空的", "^NOPE"), ("弱電二", "^(COMM|TEL)")], "q": [("SCADA", "^SCADA$")], "r": [("S", "x")]}
TEXTS = {"p": "# remark\n\n弱電電纜 = COMM-*, TEL\n電力 = POWER*，ELEC-??\n號誌 =\nno sign\n管線 = 給水管、管溝\n 管線 = 管溝 \n = x\n怪 = [W]*[[]?]", "q": "SCADA=", "r": ""}
TERMS = ["SCADA", "SCADA 電纜", "弱電電纜", "電力電纜", "弱電", "給水管", "給排水", "管線", "管線/給水管", "管溝、管線", "號誌", "ZONE-A", "zone a", "通信線纜架", "", "、", "-", "電", "弱電/電力", "電力、弱電", "SCADA/弱電電纜、nothing", "nothing", "系統", "怪", "POWER", "空的", "弱電二", "通訊／通信"]


def norm(t):
    import unicodedata

    return re.sub(r"[\s,.;:、，。；：()\"'「」『』《》\-_/]+", "", unicodedata.normalize("NFKC", t or "").casefold())


def glossary(project):
    own = {}
    for line in TEXTS[project].splitlines():
        key, sign, rest = line.strip().partition("=")
        if sign and key.strip() and not key.startswith("#"):
            own[key.strip()] = [x.strip() for x in re.split("[,，、]", rest) if x.strip()]
    return {k: v for k, v in (M.DEFAULT_GLOSSARY | own).items() if v}


def brute(project, text):
    layers = sorted(set(LAYERS[project]), key=str.casefold)
    systems = {n: frozenset(x for x in layers if re.search(p, x, re.I)) for n, p in SYSTEMS[project]}
    phrases = [x.strip() for x in re.split("[/／、]", text) if x.strip()]
    if not phrases:
        return "none", None
    chosen = []
    for phrase in phrases:
        tn, found = norm(phrase), ({}, {})

        def put(tier, sel, held, system=False, found=found):
            if held and (held not in found[tier] or system and found[tier][held][0] != "system"):
                found[tier][held] = sel

        def tier(name, tn=tn):
            nn = norm(name)
            return None if not nn else 0 if nn == tn else 1 if min(len(nn), len(tn)) >= 2 and (nn in tn or tn in nn) else None

        for x in layers:
            if norm(x) == tn:
                put(0, ("layer", (x,)), frozenset({x}))
        for n, held in systems.items():
            if tier(n) is not None:
                put(tier(n), ("system", (n,)), held, True)
        for c, patterns in glossary(project).items():
            held = frozenset(x for x in layers if any(fnmatch.fnmatchcase(x.casefold(), p.casefold()) for p in patterns))
            if tier(c) is not None:
                put(tier(c), ("layer" if len(held) == 1 else "layers", tuple(sorted(held, key=lambda x: (x.lower(), x)))), held)
        best = found[0] or found[1]
        if len(best) != 1:
            return ("multiple" if best else "none"), None
        chosen += [(sel, held) for held, sel in best.items()]
    if len({s for s, _ in chosen}) == 1:
        return "ok", chosen[0][0]
    return "ok", ("layers", tuple(sorted(frozenset().union(*(h for _, h in chosen)), key=lambda x: (x.lower(), x))))


@pytest.fixture(scope="module")
def context(spark):
    layers = spark.createDataFrame([(p, x) for p, xs in LAYERS.items() for x in [*xs, *xs[:2], ""]], "project string, layer string")
    systems = spark.createDataFrame([(p, i, n, r) for p, s in SYSTEMS.items() for i, (n, r) in enumerate(s)], "project string, pos int, name string, layer_regex string")
    own = M.parse_glossary(spark.createDataFrame(list(TEXTS.items()), "project string, text string"))
    return M.Context(layers, systems, M.effective_glossary(layers, own))


def test_glossaries(context):
    got = {}
    for r in context.glossary.collect():
        got.setdefault(r["project"], {})[r["concept"]] = r["patterns"]
    assert got == {p: glossary(p) for p in LAYERS}
    again = M.parse_glossary(M.glossary_text(context.glossary))
    assert {(r["project"], r["concept"], tuple(r["patterns"])) for r in again.collect()} == {(p, c, tuple(x)) for p in LAYERS for c, x in glossary(p).items()}


def test_wildcards_equal_file_name_matching(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("ABab-.[]!^1\\") for _ in range(rng.randint(1, 6))) for _ in range(120)] + ["a\\b", "x^", "&&"]
    patterns = ["".join(rng.choice(["A", "b", "-", ".", "*", "?", "[ab]", "[!a]", "[a-c]", "[", "]", "^", "\\", "+", "1", "[^]", "[]a]", "[&&]"]) for _ in range(rng.randint(1, 5))) for _ in range(150)] + ["*", "?", "**", ""]
    got = M.layers_of_patterns(spark.createDataFrame([("p", x) for x in patterns], "project string, pattern string"), spark.createDataFrame([("p", x) for x in names], "project string, layer string"))
    want = {(p, n) for p in patterns for n in names if fnmatch.fnmatchcase(n.casefold(), p.casefold())}
    assert {(r["pattern"], r["layer"]) for r in got.collect()} == want and len(want) > 500


def test_terms_equal_a_scan(spark, context):
    df = spark.createDataFrame([(p, t) for p in LAYERS for t in TERMS], "project string, text string")
    got = {(r["project"], r["text"]): (r["how"], r["selector"] and (r["selector"]["kind"], tuple(r["selector"]["values"]))) for r in M.resolve(df, context).collect()}
    want = {(p, t): brute(p, t) for p in LAYERS for t in TERMS}
    assert got == want and {h for h, _ in want.values()} == {"ok", "none", "multiple"}


def test_selectors(spark, context):
    asked = [("p", "system", ["弱電"]), ("p", "system", ["空的"]), ("p", "system", ["?"]), ("p", "layer", ["power"]), ("p", "layers", ["TEL", "tel", "none"]), ("p", "layers", ["none"]), ("q", "layer", ["POWER"]), ("r", "system", ["S"])]
    df = spark.createDataFrame(asked, "project string, kind string, values array<string>").select("project", M.selector(F.col("kind"), F.col("values")).alias("selector"))
    got = {(r["project"], r["selector"]["kind"], tuple(r["selector"]["values"])): (r["layers"], r["valid"]) for r in M.selector_layers(df, context).collect()}
    assert list(got[p, k, tuple(v)] for p, k, v in asked) == [(["COMM-1", "TEL"], True), ([], True), ([], False), (["POWER"], True), (["TEL"], True), ([], False), (["Power"], True), ([], True)]


def test_systems_meet_only_layers_that_hold_their_text(spark):
    names = [f"{a}-{i}" for a in ("SCADA", "PUMP", "x") for i in range(400)] + ["ſcada-7", "SCADA-7\n", "İ-1", "ı-1", "K-5", "k-5", "管溝-12", "É-3", "é-3", "straße-9"]
    regexes = [f"-{i}$" for i in range(400)] + ["^scada-", "^S", "i-1", "K-5", "É", "é-3", "溝-1", "^(PUMP|X)-9$", "", "$", "^", "STRASSE", "ß-9", "s.ada", "a" * 40, "x-1"]
    layers = spark.createDataFrame([("p", x) for x in names], "project string, layer string")
    systems = spark.createDataFrame([("p", i, f"S{i}", r) for i, r in enumerate(regexes)] + [("none", 0, "S0", "x")], "project string, pos int, name string, layer_regex string")
    got = {(r["project"], r["pos"]): r["layers"] for r in M.Context(layers, systems, None).system_layers().collect()}
    both = systems.join(layers, "project").where(F.expr("regexp_like(layer, concat('(?iu)', layer_regex))"))
    want = {(r["project"], r["pos"]): sorted(r["layers"]) for r in both.groupBy("project", "pos").agg(F.collect_set("layer").alias("layers")).collect()}
    assert {k: v for k, v in got.items() if v} == want and len(got) == len(regexes) + 1 and len(want) > 400
    pieces = systems.where("startswith(layer_regex, '-')").select("project", F.regexp_replace("layer_regex", r"\$", "").alias("piece"))
    # 400 texts and 1200 layers: 480,000 pairs, of which those stay whose layer holds the text
    assert M._meet(pieces, layers, "layer").count() < 4500


def test_selectors_are_not_carried_by_phrases(spark, monkeypatch):
    """Every phrase holds the name of a concept that covers all layers: what is kept of a phrase has none of them."""
    layers = spark.createDataFrame([("p", f"SCADA-{i}") for i in range(300)], "project string, layer string")
    systems = spark.createDataFrame([("p", 0, "泵站", "^SCADA-1$"), ("p", None, "甲方", "^SCADA-2"), ("p", None, "乙方", "^SCADA-2")], "project string, pos int, name string, layer_regex string")
    own = spark.createDataFrame([("p", "SCADA", 0, ["SCADA-*"])], "project string, concept string, pos int, patterns array<string>")
    written, write = {}, M.materialise

    def kept(df, name):
        written[name] = write(df, name)
        return written[name]

    monkeypatch.setattr(M, "materialise", kept)
    tokens = spark.createDataFrame([("p", t) for t in ("SCADA-7", "scada 泵站x", "甲方乙方", *(f"SCADA no{i}" for i in range(50)))], "project string, token string")
    got = {r["token"]: r for r in M.candidates(tokens, M.named(M.Context(layers, systems, own))).collect()}
    assert "array<" not in written["sets"].schema.simpleString()
    assert got["SCADA-7"]["tier"] == 0 and got["SCADA-7"]["layers"] == ["SCADA-7"] and got["scada 泵站x"]["sets"] == 2 and got["scada 泵站x"]["layers"] == ["SCADA-1"]
    assert got["甲方乙方"]["sets"] == 1 and got["甲方乙方"]["selector"]["values"] == ["乙方"] and len(got["甲方乙方"]["layers"]) == 111
    assert all(len(got[f"SCADA no{i}"]["selector"]["values"]) == 300 for i in range(50)) and len(got) == 53
