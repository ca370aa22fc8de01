"""Evidence paragraphs of document lines, search, quotes; document bookkeeping; log redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conformix.functions import text as X

CHUNK_LINES = 12
#: Columns of evidence.
CHUNKS = "id string, document_id string, filename string, page int, line_start int, line_end int, section string, text string, hash string"


def chunk_lines(lines: DataFrame, doc_hash: str = "document_id") -> DataFrame:
    """Evidence chunks of (document_id, filename, page, line_no, text): runs of lines that are not blank, of at most
    CHUNK_LINES; a heading is a chunk of its own and names the section from there on, across pages."""
    doc = Window.partitionBy("document_id").orderBy("page", "line_no")
    page = Window.partitionBy("document_id", "page").orderBy("line_no")
    df = lines.withColumn("text", F.rtrim(F.coalesce("text", F.lit(""))))
    df = df.withColumns({"blank": F.trim("text") == "", "head": X.is_heading(F.col("text"))})
    title = F.when(F.col("head"), F.trim(F.regexp_replace(F.trim("text"), "^#+", "")))
    df = df.withColumn("section", F.coalesce(F.last(title, ignorenulls=True).over(doc.rowsBetween(Window.unboundedPreceding, 0)), F.lit("")))
    starts = F.col("blank") | F.col("head") | F.coalesce(F.lag("head").over(page), F.lit(False))
    df = df.withColumn("island", F.sum(starts.cast("int")).over(page.rowsBetween(Window.unboundedPreceding, 0))).where("NOT blank")
    n = F.row_number().over(Window.partitionBy("document_id", "page", "island").orderBy("line_no")) - 1
    df = df.withColumn("part", F.floor(n / CHUNK_LINES))
    got = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    out = df.groupBy("document_id", "filename", "page", "island", "part", "section").agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.array_join(F.transform(got, lambda x: x["text"]), "\n").alias("text"))
    out = out.withColumn("text", F.trim("text"))
    return out.select(X.evidence_id(F.col(doc_hash), F.col("page"), F.col("line_start"), F.col("text")).alias("id"), "document_id", "filename", "page", "line_start", "line_end", "section", "text", F.sha2("text", 256).alias("hash"))


def search(chunks: DataFrame, words: str) -> DataFrame:
    """Chunks whose normalised text and section hold every word."""
    for w in words.split():
        chunks = chunks.where(F.contains(X.normalize(F.concat("text", "section")), X.normalize(F.lit(w))))
    return chunks


#: Statuses of files that need no document to count as known.
KNOWN = ("NOT_EXTRACTABLE", "TOO_LARGE")


def scan_diff(found: DataFrame, stored: DataFrame) -> DataFrame:
    """(root, rel_path, action) of files (root, rel_path, size_bytes, mtime_ns, sha256): new, reused, touched, reparsed or removed.

    A stored file with document_id and status, if those columns are there, is reused by its size and time only if it has a document or one of KNOWN.
    """
    key = ["root", "rel_path"]
    usable = F.col("document_id").isNotNull() | F.col("status").isin(*KNOWN) if {"document_id", "status"} <= set(stored.columns) else F.lit(True)
    f = found.select(*key, F.struct("size_bytes", "mtime_ns", "sha256").alias("f"))
    s = stored.select(*key, F.struct("size_bytes", "mtime_ns", "sha256", F.coalesce(usable, F.lit(False)).alias("usable")).alias("s"))
    same = (F.col("f.size_bytes") == F.col("s.size_bytes")) & (F.col("f.mtime_ns") == F.col("s.mtime_ns")) & F.col("s.usable")
    equal = (F.col("f.sha256") == F.col("s.sha256")) & F.col("s.usable")
    action = F.when(F.col("s").isNull(), "new").when(F.col("f").isNull(), "removed").when(same, "reused").when(equal, "touched").otherwise("reparsed")
    return f.join(s, key, "full").select(*key, action.alias("action"))


def orphans(stored: DataFrame, after: DataFrame) -> DataFrame:
    """(document_id) of documents that a scan made for a stored file and that no file refers to after the scan.

    stored, after: (document_id, created_document, ...) of files before and after.
    """
    made = stored.where("created_document AND document_id IS NOT NULL").select("document_id").distinct()
    return made.join(after.where("document_id IS NOT NULL").select("document_id").distinct().hint("merge"), "document_id", "left_anti")


def first_of_content(files: DataFrame, order: str = "rel_path") -> DataFrame:
    """Each file with the first one of the same content."""
    first = files.groupBy("sha256").agg(F.min(order).alias("first"))
    return files.join(first, "sha256").withColumn("duplicate", F.col("first") != F.col(order))


# Names of exceptions, what stands for what they said, and what begins a record of a log.
_LAST = r"(?:\w*(?:[Ee]rror|Exception|Warning|Exit|Interrupt|Failure|Timeout|Fault)|StopIteration|StopAsyncIteration|BadZipFile|Cancelled|UploadTooLarge|RunGone|RunInProgress)"
SAYS = rf"(?<![\w.])(?:(?:[A-Za-z_]\w*\.)*(?=[A-Za-z_]){_LAST}|(?:[A-Za-z_]\w*\.)+[A-Z]\w*)\s*:"
SHOWN = r"(?<![\w.])([A-Za-z_][\w.]*?(?:[Ee]rror|Exception))\(.*$"
OMITTED = "<內容已省略>"
RECORD = r"^(?:\s*$|\d{4}-\d\d-\d\d|Traceback|\s*File \"|During handling|The above exception)"
STORAGE = r"(?i)(?<!/api/)(projects[\\/][a-z]{1,4}_[0-9a-f]{16}[\\/](?:drawings|documents|exports))[\\/](?!<file>)[^\r\n]*"
LONGEST = 2000


def redact(lines: DataFrame, line: str = "line") -> DataFrame:
    """What an exception says goes, its class stays: all after "Class:", or the arguments of "Class(...)". Lines are cut at LONGEST characters first."""
    c = F.when(F.length(line) > LONGEST, F.concat(F.substring(line, 1, LONGEST), F.lit("…"))).otherwise(F.col(line))
    said = F.regexp_replace(c, f"^(.*?{SAYS}).*$", f"$1 {OMITTED}")
    return lines.withColumn(line, F.when(c.rlike(SAYS), said).otherwise(F.regexp_replace(c, SHOWN, f"$1({OMITTED})")))


def scrub(lines: DataFrame, roots: dict[str, str], names: list[str] = (), line: str = "line") -> DataFrame:
    """Folders become their marks, longest first and with either slash; known file names of three letters or more, and what stands in a
    project's storage, become <file>. Addresses of requests keep theirs."""
    every = {v: mark for k, mark in roots.items() for v in (k, k.replace("\\", "/"), k.replace("/", "\\")) if v}
    c = F.col(line)
    for k in sorted(every, key=len, reverse=True):
        c = F.replace(c, F.lit(k), F.lit(every[k]))
    for n in sorted({n for n in names if n and len(n) >= 3}, key=len, reverse=True):
        c = F.replace(c, F.lit(n), F.lit("<file>"))
    return lines.withColumn(line, F.regexp_replace(c, STORAGE, "$1/<file>"))


def drop_continuations(lines: DataFrame, key: str, order: str, line: str = "line") -> DataFrame:
    """Lines go that continue what an exception said: those after a line with "Class:" up to the next one that begins a record or names an exception."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    says = F.col(line).rlike(SAYS)
    start = F.col(line).rlike(RECORD) | says
    df = lines.withColumns({"_start": start, "_in": F.coalesce(F.last(F.when(start, says), ignorenulls=True).over(w), F.lit(False))})
    return df.where(F.col("_start") | ~F.col("_in")).drop("_start", "_in")
