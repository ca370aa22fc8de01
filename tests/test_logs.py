"""Redaction of logs line by line, against what each line should become."""

from conformix.operators import documents as Docs

LINES = [
    ("2024-01-01 worker said: ValueError: bad 17", "2024-01-01 worker said: ValueError: <內容已省略>"), ("  detail of it", None), ("more: of it", None), ("2024-01-02 INFO ok", "2024-01-02 INFO ok"), ("plain follows", "plain follows"),
    ("x core.rules.PredicateError : y", "x core.rules.PredicateError : <內容已省略>"), ("lost", None), ("json.Decoder: z", "json.Decoder: <內容已省略>"), ("Traceback (most recent call last):", "Traceback (most recent call last):"), ('  File "a.py", line 1', '  File "a.py", line 1'), ("    call(x)", "    call(x)"),
    ("KeyError('drawing')", "KeyError(<內容已省略>)"), ("kept, since nothing was said", "kept, since nothing was said"), ("note: no exception", "note: no exception"), ("a" * 2100, "a" * 2000 + "…"), ("StopIteration: s", "StopIteration: <內容已省略>"), ("", ""), ("after blank", "after blank"),
]


def test_exceptions_lose_what_they_say(spark):
    df = spark.createDataFrame([("k", i, x) for i, (x, _) in enumerate(LINES)], "key string, at int, line string")
    got = Docs.redact(Docs.drop_continuations(df, "key", "at")).orderBy("at").collect()
    assert [(r["at"], r["line"]) for r in got] == [(i, y) for i, (_, y) in enumerate(LINES) if y is not None]


def test_paths_and_names(spark):
    rows = ["open /srv/data/projects/p_0123456789abcdef/drawings/my plan.dxf now", "GET /api/projects/p_0123456789abcdef/drawings/d_1 200", r"C:\srv\data\x and /srv/x", "Plan A.dxf, ab", "projects/p_0123456789abcdef/exports/<file>"]
    df = spark.createDataFrame([(x,) for x in rows], "line string")
    got = [r[0] for r in Docs.scrub(df, {"/srv/data": "<data>", "/srv": "<app>"}, ["Plan A.dxf", "A.dxf", "ab", None]).collect()]
    assert got == ["open <data>/projects/p_0123456789abcdef/drawings/<file>", "GET /api/projects/p_0123456789abcdef/drawings/d_1 200", r"C:<data>\x and <app>/x", "<file>, ab", "projects/p_0123456789abcdef/exports/<file>"]


def test_files_without_a_document_are_read_again_and_orphans_go(spark):
    cols = "root string, rel_path string, size_bytes long, mtime_ns long, sha256 string, document_id string, status string, created_document boolean"
    stored = spark.createDataFrame([("r", "a", 1, 1, "h", "d1", "OK", True), ("r", "b", 1, 1, None, None, "UNREADABLE", False), ("r", "c", 1, 1, None, None, "TOO_LARGE", False), ("r", "d", 1, 1, "g", "d2", "OK", True), ("r", "e", 1, 1, "g", "d2", "OK", True), ("r", "f", 1, 1, "i", "d3", "OK", False)], cols)
    found = stored.where("rel_path IN ('a', 'b', 'c', 'e')")
    assert {r["rel_path"]: r["action"] for r in Docs.scan_diff(found, stored).collect()} == {"a": "reused", "b": "reparsed", "c": "reused", "d": "removed", "e": "reused", "f": "removed"}
    assert [r[0] for r in Docs.orphans(stored, stored.where("rel_path <> 'a' AND rel_path <> 'd'")).collect()] == ["d1"]
