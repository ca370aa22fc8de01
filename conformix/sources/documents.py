"""Lines of documents from bytes, Word paragraphs and tables, and PDF pages that were extracted before."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conformix.functions import text as X

# Encodings in the order in which they are tried after UTF-8, and what is said of bytes that fit none.
ENCODINGS = ("cp950", "big5hkscs", "gb18030")
UNKNOWN_ENCODING = "文字編碼無法辨識（請存成 UTF-8）。"
# Section of a table row, number of a table's first line, warning about pages without text.
TABLE_SECTION, TABLE_LINES = "表格 %d 第 %d 列", 100_000
EMPTY_PAGES = "%d 頁沒有文字層（可能是掃描影像），這些頁無法作為證據；本工具不做 OCR。"
_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: A byte-order mark in UTF-8.
_MARK = "﻿"


def split_lines(text: Column) -> Column:
    """Lines of a text; an end of line at its end begins no further line, an empty text has none."""
    lines = F.split(text, _ENDS)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def decoded(files: DataFrame) -> DataFrame:
    """files (..., content) with text and encoding: UTF-8 if the bytes are, without its mark, else the first of ENCODINGS that reads them.

    Valid UTF-8 is told and read on the JVM; only other bytes go to a task of Python, in Arrow batches. What nothing reads has a null text and
    encoding; null content is an empty text.
    """
    raw = F.coalesce("content", F.lit(b"")).cast("string")
    valid = files.withColumn("_ok", F.is_valid_utf8(raw))
    good = valid.where("_ok").withColumns({"text": F.regexp_replace(raw, f"^{_MARK}", ""), "encoding": F.lit("utf-8")}).drop("_ok", "content")
    rest = valid.where("NOT _ok").drop("_ok")
    names = [c for c in rest.columns if c != "content"]
    schema = rest.select(*names).schema.add("text", "string").add("encoding", "string")

    def run(batches):
        for b in batches:
            texts, how = [], []
            for data in b.column("content"):
                text = code = None
                for name in ENCODINGS:
                    try:
                        text, code = data.as_py().decode(name), name
                        break
                    except UnicodeDecodeError:
                        continue
                texts.append(text)
                how.append(code)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(texts, pa.string()), pa.array(how, pa.string())], [*names, "text", "encoding"])

    return good.select(*names, "text", "encoding").unionByName(rest.mapInArrow(run, schema))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, filename, content) of files below `path`; a document is known by the hash of its bytes."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.sha2("content", 256).alias("document_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def text_lines(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document_id, filename, page, line_no, text) of text files, one page each; and (document_id, filename, reason) of those that nothing reads."""
    d = decoded(files.select("document_id", "filename", "content"))
    lines = d.where("text IS NOT NULL").select("document_id", "filename", F.lit(1).alias("page"), F.posexplode(split_lines(F.col("text"))).alias("i", "text"))
    return lines.select("document_id", "filename", "page", (F.col("i") + 1).alias("line_no"), "text"), d.where("text IS NULL").select("document_id", "filename", F.lit(UNKNOWN_ENCODING).alias("reason"))


def word_chunks(paragraphs: DataFrame, table_rows: DataFrame) -> DataFrame:
    """Evidence of Word documents, as documents.chunk_lines() gives it, without pages.

    paragraphs: (document_id, filename, number, style, text): each is a chunk; its line is its number; a heading style or a heading's form names the
    section from there on. table_rows: (document_id, filename, table_no, row_no, cells): different cells of a row joined by bars, in a section of
    their own. Merged cells, which repeat their text, count once; blank paragraphs and rows are left out.
    """
    p = paragraphs.withColumn("text", X.strip(F.coalesce("text", F.lit(""))))
    style = F.coalesce("style", F.lit(""))
    styled = F.startswith(F.lower(style), F.lit("heading")) | F.startswith(style, F.lit("標題"))
    title = F.when(F.col("text") == "", None).when(X.is_heading(F.col("text")), F.trim(F.regexp_replace("text", "^#+", ""))).when(styled, F.col("text"))
    w = Window.partitionBy("document_id").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("section", F.coalesce(F.last(title, ignorenulls=True).over(w), F.lit(""))).where("text <> ''")
    p = p.select("document_id", "filename", F.col("number").cast("int").alias("line"), "section", "text")
    cells = F.array_distinct(F.filter(F.transform("cells", lambda c: X.strip(F.coalesce(c, F.lit("")))), lambda c: c != ""))
    t = table_rows.select("document_id", "filename", (TABLE_LINES * F.col("table_no") + F.col("row_no")).cast("int").alias("line"), F.format_string(TABLE_SECTION, F.col("table_no").cast("int"), F.col("row_no").cast("int")).alias("section"), F.array_join(cells, " | ").alias("text")).where("text <> ''")
    none = F.lit(None).cast("int")
    c = p.unionByName(t)
    return c.select(X.evidence_id(F.col("document_id"), none, F.col("line"), F.col("text")).alias("id"), "document_id", "filename", none.alias("page"), F.col("line").alias("line_start"), F.col("line").alias("line_end"), "section", "text", F.sha2("text", 256).alias("hash"))


def page_lines(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document_id, filename, page, line_no, text) of pages (document_id, filename, page, text) that have text; and (document_id, empty_pages,
    warning) of documents with pages that have none."""
    blank = X.strip(F.coalesce("text", F.lit(""))) == ""
    lines = pages.where(~blank).select("document_id", "filename", F.col("page").cast("int").alias("page"), F.posexplode(split_lines(F.col("text"))).alias("i", "text"))
    empty = pages.where(blank).groupBy("document_id").agg(F.count("*").alias("empty_pages"))
    return lines.select("document_id", "filename", "page", (F.col("i") + 1).alias("line_no"), "text"), empty.withColumn("warning", F.format_string(EMPTY_PAGES, "empty_pages"))
