"""First import wins, incremental analysis in any split, decoding, Word and PDF lines."""

import pytest
from pyspark.sql import functions as F

from conformix.operators import documents as Docs
from conformix.plans.rules import normalise
from conformix.sources import documents as Src
from conformix.sources import store
from conformix.streaming import analysis as Inc
from tests.test_routes import frame, line

ROWS = "project string, stored_name string, seq long, layer string"


def held(spark, path):
    return sorted(tuple(r) for r in store.read_drawings(spark, path, ROWS).collect())


def test_first_import_wins(spark, tmp_path):
    path = str(tmp_path / "store")
    assert held(spark, path) == []
    first = spark.createDataFrame([("p", "a", 0, "old"), ("p", "a", 1, "old"), ("p", "b", 0, "old")], ROWS)
    assert store.write_drawings(first, path).count() == 2
    again = spark.createDataFrame([("p", "a", 0, "new"), ("q", "a", 0, "new"), ("p", "c", 0, "new")], ROWS)
    assert sorted(tuple(r) for r in store.write_drawings(again, path).collect()) == [("p", "c"), ("q", "a")]
    assert held(spark, path) == [("p", "a", 0, "old"), ("p", "a", 1, "old"), ("p", "b", 0, "old"), ("p", "c", 0, "new"), ("q", "a", 0, "new")]
    assert store.write_drawings(again, path).count() == 0 and len(held(spark, path)) == 5


def test_of_two_writers_one_has_a_drawing(spark, tmp_path):
    """The second writer starts and ends between the first one's reading and its claim."""
    path, state = str(tmp_path / "store"), {"calls": 0}
    slow = spark.createDataFrame([("p", "a", 0, "slow"), ("p", "b", 0, "slow"), ("p", "b", 1, "slow")], ROWS)
    quick = spark.createDataFrame([("p", "a", 0, "quick"), ("p", "c", 0, "quick")], ROWS)

    def interfere():
        state["calls"] += 1
        if state["calls"] == 1:
            assert store.write_drawings(quick, path).count() == 2

    assert [tuple(r) for r in store.write_drawings(slow, path, interfere).collect()] == [("p", "b")]
    assert state["calls"] == 2 and held(spark, path) == [("p", "a", 0, "quick"), ("p", "b", 0, "slow"), ("p", "b", 1, "slow"), ("p", "c", 0, "quick")]


# -- incremental analysis ----------------------------------------------------------------------------------

RULES = [normalise({"id": "LEN", "subject": {"system": "S"}, "measurement": "length", "operator": "<=", "value": 10})]


def landed(spark, runs):
    """runs: (run_id, name, at, {seq: length})."""
    rows = [line(r, seq, (0, seq), (n, seq)) for r, _, _, lengths in runs for seq, n in lengths.items()]
    about = spark.createDataFrame([(r, "p", name, at, 1.0, False) for r, name, at, _ in runs], "run_id string, project string, name string, at long, unit_to_mm double, units_assumed boolean")
    e = frame(spark, rows).drop("system").withColumnRenamed("drawing_key", "run_id").join(about, "run_id")
    return e.select(*[c.split(" ")[0] for c in Inc.LANDED.split(", ") if not c.startswith("y:")])


#: Issue ids rest on handles and places: a line that grows by less than a unit keeps its rounded centre.
HISTORY = [
    ("r1", "A", 1, {1: 20, 2: 5, 3: 30, 4: 40}), ("r2", "B", 2, {1: 50}), ("r3", "A", 3, {1: 20, 2: 20, 3: 30.8, 4: 8}), ("r4", "A", 4, {1: 20, 2: 20, 3: 30.8, 4: 40}),
]
WANT = {
    ("r1", 1): None, ("r1", 3): None, ("r1", 4): None, ("r2", 1): None, ("r3", 1): "UNCHANGED", ("r3", 2): "NEW", ("r3", 3): "CHANGED", ("r4", 1): "UNCHANGED", ("r4", 2): "UNCHANGED", ("r4", 3): "UNCHANGED", ("r4", 4): "NEW",
}


def state(spark, path):
    bad = Inc.stored_issues(spark, path).where("status <> 'PASS'").collect()
    return {(r["run_id"], int(r["handle"][1:])): r["baseline_state"] for r in bad}, sorted((r["run_id"], r["baseline"]) for r in Inc.stored_runs(spark, path).collect()), len(bad)


def test_any_split_of_batches_gives_one_table(spark, tmp_path):
    systems = [("S", "^A")]
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    Inc.append(landed(spark, HISTORY), whole, RULES, systems)
    for i, part in enumerate((HISTORY[:1], HISTORY[1:3], HISTORY[3:])):
        landed(spark, part).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    for i in range(3):
        batch = spark.read.schema(Inc.LANDED).parquet(str(tmp_path / f"in/{i}"))
        Inc.append(batch, parts, RULES, systems)
    Inc.append(batch, parts, RULES, systems)
    baselines = [("r1", None), ("r2", None), ("r3", "r1"), ("r4", "r3")]
    # an id rests on the place too: r3's third line has its centre within half a unit of the old one
    assert state(spark, whole) == (WANT, baselines, 11) and state(spark, parts) == (WANT, baselines, 11)
    # an attempt that wrote issues but no runs does not count
    Inc.stored_issues(spark, parts).limit(3).withColumn("attempt", F.lit("failed")).write.mode("append").parquet(f"{parts}/issues")
    assert state(spark, parts)[2] == 11


def test_stream_of_landed_files(spark, tmp_path):
    for i, run in enumerate(HISTORY):
        landed(spark, [run]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for _ in range(2):
        Inc.analyse_stream(spark, str(tmp_path / "in"), out, str(tmp_path / "checkpoint"), RULES, [("S", "^A")], files_per_batch=10).awaitTermination()
    assert state(spark, out)[0] == WANT


def test_a_batch_of_many_files_is_one_and_known_runs_are_not_moved(spark, tmp_path):
    for i, run in enumerate(HISTORY):
        landed(spark, [run]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = Inc.analyse_stream(spark, str(tmp_path / "in"), out, str(tmp_path / "checkpoint"), RULES, [("S", "^A")], files_per_batch=None)
    stream.awaitTermination()
    assert len({r["attempt"] for r in Inc.stored_runs(spark, out).collect()}) == 1 and state(spark, out)[0] == WANT
    joins = []
    keep, Inc.materialise = Inc.materialise, lambda df, name: (joins.append((name, df._jdf.queryExecution().optimizedPlan().toString())), keep(df, name))[1]
    try:
        Inc.append(landed(spark, HISTORY[1:3]), out, RULES, [("S", "^A")])
    finally:
        Inc.materialise = keep
    # a known run's entities are dropped where they are read: its id is not sought by dealing out all of the batch
    assert [n for n, _ in joins] == ["landed", "runs"] and "strategy=broadcast" in joins[0][1]
    assert state(spark, out)[2] == 11


# -- documents -----------------------------------------------------------------------------------------------

TEXT = "電纜與水管\r\n淨距 300 mm\n\n末行"
LINES = ["電纜與水管", "淨距 300 mm", "", "末行"]


def test_bytes_of_four_encodings_give_the_same_lines(spark, tmp_path):
    for name, data in {"a.txt": TEXT.encode(), "b.txt": b"\xef\xbb\xbf" + TEXT.encode(), "c.txt": TEXT.encode("cp950"), "d.txt": "汉字线缆\n".encode("gb18030"), "e.txt": b"\x81", "f.txt": b"", "g.txt": "嗰啲\n".encode("big5hkscs")}.items():
        (tmp_path / name).write_bytes(data)
    lines, failed = Src.text_lines(Src.read_files(spark, str(tmp_path)))
    got = {}
    for r in lines.orderBy("filename", "line_no").collect():
        got.setdefault(r["filename"], []).append(r["text"])
    assert got["a.txt"] == got["b.txt"] == got["c.txt"] == LINES and got["d.txt"] == [_first("汉字线缆\n".encode("gb18030"))] and got["g.txt"] == ["嗰啲"]
    assert [(r["filename"], r["reason"]) for r in failed.collect()] == [("e.txt", Src.UNKNOWN_ENCODING)] and "f.txt" not in got


def _first(data):
    for name in Src.ENCODINGS:
        try:
            return data.decode(name).rstrip("\n")
        except UnicodeDecodeError:
            pass


def test_word_and_pdf(spark):
    paragraphs = spark.createDataFrame([("d", "d.docx", 1, "Heading 1", " 總則 "), ("d", "d.docx", 2, "Normal", "內文一"), ("d", "d.docx", 3, None, "  "), ("d", "d.docx", 4, "標題 2", "配置"), ("d", "d.docx", 5, "Normal", "4.2 間距"), ("d", "d.docx", 6, "Normal", "內文二"), ("e", "e.docx", 1, "", "無節")], "document_id string, filename string, number int, style string, text string")
    tables = spark.createDataFrame([("d", "d.docx", 1, 1, ["淨距", "淨距", None, " 300 mm ", ""]), ("d", "d.docx", 2, 3, ["", None])], "document_id string, filename string, table_no int, row_no int, cells array<string>")
    got = [(r["document_id"], r["line_start"], r["section"], r["text"], r["page"]) for r in Src.word_chunks(paragraphs, tables).orderBy("document_id", "line_start").collect()]
    assert got == [("d", 1, "總則", "總則", None), ("d", 2, "總則", "內文一", None), ("d", 4, "配置", "配置", None), ("d", 5, "4.2 間距", "4.2 間距", None), ("d", 6, "4.2 間距", "內文二", None), ("d", 100001, "表格 1 第 1 列", "淨距 | 300 mm", None), ("e", 1, "", "無節", None)]
    pages = spark.createDataFrame([("d", "d.pdf", 1, "4.1 章\n甲\n"), ("d", "d.pdf", 2, " \n\t"), ("d", "d.pdf", 3, "乙\n丙"), ("e", "e.pdf", 1, None)], "document_id string, filename string, page int, text string")
    lines, empty = Src.page_lines(pages)
    chunks = [(r["page"], r["line_start"], r["line_end"], r["section"], r["text"]) for r in Docs.chunk_lines(lines).orderBy("page", "line_start").collect()]
    assert chunks == [(1, 1, 1, "4.1 章", "4.1 章"), (1, 2, 2, "4.1 章", "甲"), (3, 1, 2, "4.1 章", "乙\n丙")]
    assert sorted((r["document_id"], r["empty_pages"], r["warning"][:3]) for r in empty.collect()) == [("d", 1, "1 頁"), ("e", 1, "1 頁")]
    none = pytest.importorskip("pyspark") and spark.createDataFrame([], pages.schema)
    assert Src.page_lines(none)[0].count() == 0
