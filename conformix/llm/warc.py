"""Web archives: captures written as WARC records, read back and assembled into one nested row each."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conformix.llm.common import checked_join, materialise, shared_dir

#: Payloads of at least this many bytes are stored once; equal ones become revisits.
REVISIT_FROM = 100
#: What the archives say of every capture, since pages carry no time.
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the format: version line, end of a line, end of a record, profile of a revisit by equal payload.
VERSION, EOL, END = "WARC/1.1", "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "kind string, record_id string, concurrent_to array<string>, target_uri string, headers map<string,string>, block_headers map<string,string>, status string, "
    "payload_digest string, payload_bytes long, digest_ok boolean, payload binary"
)


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit(""))


def _record(kind: Column | str, record_id: Column, uri: Column, content: str, block: Column, *more: Column) -> Column:
    """One record as text: version, named fields, the length of its block in bytes, the block."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = [
        F.lit(VERSION + EOL), _header("WARC-Type", kind), _header("WARC-Record-ID", record_id), _header("WARC-Date", F.lit(DATE)), _header("WARC-Target-URI", uri),
        *more, _header("Content-Type", F.lit(content)), _header("Content-Length", F.octet_length(block).cast("string")),
    ]
    return F.concat(*head, F.lit(EOL), block)


def one_line(c: Column) -> Column:
    """A value for a header: blanks at its ends and line ends become percent codes."""
    return F.regexp_replace(F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), "^ | $", "%20")


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", at_least: int = REVISIT_FROM) -> None:
    """Write gzip archives to `path`: for every row a request, a response or revisit, and a metadata record that names its key.

    Of equal payloads of `at_least` bytes or more those with the smallest key are responses (rows that repeat that key too),
    the others revisits without payload, which name the payload's digest and the response's URI. Only payloads that occur
    several times take part in a join, by digest: the smallest keys are counted and broadcast if small, else a merge join
    whose skewed partitions Spark splits. Spark's text writer puts the end of a record after every row, so files are
    committed by task. A null payload is empty, a null url or key leaves its field out (null keys come last); an
    empty table gives archives without records. Other columns are not read.
    """
    df = pages.select(F.col(key).cast("string").alias("key"), F.col(key).alias("k"), one_line(F.col(url)).alias("uri"), F.coalesce(F.col(payload), F.lit("")).alias("body"))
    digest = F.sha2(F.col("body").cast("binary"), 256)
    large = F.octet_length("body") >= at_least
    # the smallest key of each payload that occurs more than once, with its URI
    same = df.where(large).groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.min("k").alias("low"), F.min_by("uri", F.when(F.col("k").isNotNull(), F.struct("k", "uri"))).alias("first_uri")).where("n > 1")
    same = materialise(same.select("digest", "low", "first_uri"), "payloads")
    df = checked_join(df.withColumn("digest", digest), same, "digest", "left", 200)
    repeat = large & F.col("low").isNotNull() & ~F.col("k").eqNullSafe(F.col("low"))
    # one identifier a row, drawn once; what belongs to the capture refers to it
    df = df.withColumns({"revisit": F.coalesce(repeat, F.lit(False)), "id": F.expr("uuid()")})
    name = lambda part: F.concat(F.lit("<urn:uuid:"), F.lit(part), F.substring("id", 2, 35), F.lit(">"))
    main, uri, to = name("a"), F.col("uri"), _header("WARC-Concurrent-To", name("a"))
    host = F.coalesce(F.nullif(F.regexp_extract("uri", "^[a-zA-Z]+://([^/?#]+)", 1), F.lit("")), F.lit("-"))
    place = F.coalesce(F.nullif(F.regexp_extract("uri", "^[a-zA-Z]+://[^/?#]+(/[^#]*)", 1), F.lit("")), F.lit("/"))
    asked = F.concat(F.lit("GET "), place, F.lit(f" HTTP/1.1{EOL}Host: "), host, F.lit(END))
    answer = lambda body: F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.octet_length("body").cast("string"), F.lit(END), body)
    found = F.concat(F.lit("sha256:"), F.col("digest"))
    more = [to, _header("WARC-Payload-Digest", found)]
    stored = F.when(
        F.col("revisit"),
        _record("revisit", main, uri, "application/http;msgtype=response", answer(F.lit("")), more[1], _header("WARC-Profile", F.lit(PROFILE)), _header("WARC-Refers-To-Target-URI", F.col("first_uri")), _header("WARC-Refers-To-Date", F.lit(DATE))),
    ).otherwise(_record("response", main, uri, "application/http;msgtype=response", answer(F.col("body")), more[1]))
    fields = _header("page-id", F.col("key"))
    records = F.array(_record("request", name("b"), uri, "application/http;msgtype=request", asked, to), stored, _record("metadata", name("c"), uri, "application/warc-fields", fields, to))
    df.select(F.explode(records).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def _fields(text: bytes) -> list[tuple[str, str]]:
    """Named fields of a header; lines that begin with a blank continue the one before."""
    out: list[tuple[str, str]] = []
    for line in text.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip().decode('utf-8', 'replace')}")
        elif b":" in line:
            name, _, value = line.partition(b":")
            out.append((name.strip().decode("latin-1").lower(), value.strip().decode("utf-8", "replace")))
    return out


def parsed(record: bytes, block_at: int, block: bytes, kinds: set[str], with_payload: bool) -> dict | None:
    """A row of RECORD; None for kinds that nobody asked for."""
    fields = _fields(record[:block_at])
    named = dict(fields)
    kind = named.get("warc-type", "")
    if kind not in kinds:
        return None
    http = named.get("content-type", "").startswith("application/http")
    head, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    inner = dict(_fields(head.partition(b"\r\n")[2] if http else block)) if http or named.get("content-type", "").startswith("application/warc-fields") else {}
    status = head.split(b"\r\n")[0].split(b" ")[1].decode("latin-1") if http and head.startswith(b"HTTP/") and b" " in head.split(b"\r\n")[0] else None
    said = named.get("warc-payload-digest")
    said = said.removeprefix("sha256:").lower() if said and said.startswith("sha256:") else None
    digest = hashlib.sha256(body).hexdigest() if kind == "response" else said if kind == "revisit" else None
    return {
        "kind": kind, "record_id": named.get("warc-record-id"), "concurrent_to": [v for n, v in fields if n == "warc-concurrent-to"], "target_uri": named.get("warc-target-uri"), "headers": list(named.items()),
        "block_headers": list(inner.items()), "status": status, "payload_digest": digest, "payload_bytes": len(body) if kind == "response" else None,
        "digest_ok": said == digest if said and kind == "response" else None, "payload": body if with_payload and kind == "response" else None,
    }


class Reader:
    """Cuts one archive's bytes, which come in order and in pieces, into records by the lengths that they state."""

    def __init__(self, path: str):
        self.path, self.held, self.size, self.need, self.head = path, [], 0, 0, None

    def feed(self, piece: bytes):
        self.held.append(piece)
        self.size += len(piece)
        while self.size >= self.need and self.size:
            data = b"".join(self.held)
            if self.head is None:
                data = data.lstrip(b"\r\n")
                end = data.find(b"\r\n\r\n")
                if end < 0:
                    self.held, self.size, self.need = [data], len(data), len(data) + 1
                    return
                if not data.startswith(b"WARC/"):
                    raise ValueError(f"{self.path}: no record begins with {data[:20]!r}")
                length = next((v for n, v in _fields(data[:end]) if n == "content-length"), "")
                if not length.isdigit():
                    raise ValueError(f"{self.path}: a record without Content-Length")
                self.head, self.need = end, end + 4 + int(length)
                self.held, self.size = [data], len(data)
                continue
            yield data, self.head, data[self.head + 4 : self.need]
            rest = data[self.need :]
            self.held, self.size, self.need, self.head = [rest], len(rest), 0, None


def records(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("request", "response", "revisit", "metadata"), with_payload: bool = True) -> DataFrame:
    """RECORD rows of gzip archives below `path`, which any program wrote, one task a file, bytes in order.

    Spark's text reader inflates a file and hands on pieces between ends of records; records are cut by their stated lengths, so a
    payload may hold anything. A task holds one record at most. What has no such length raises ValueError with the file's name.
    """
    pieces = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path).select("_metadata.file_path", F.col("value").cast("binary").alias("value"))
    names = [f.split(" ")[0] for f in RECORD.split(", ")]
    wanted = set(kinds)
    kind = {"concurrent_to": pa.list_(pa.string()), "headers": pa.map_(pa.string(), pa.string()), "block_headers": pa.map_(pa.string(), pa.string()), "payload_bytes": pa.int64(), "digest_ok": pa.bool_(), "payload": pa.binary()}
    schema = pa.schema([(n, kind.get(n, pa.string())) for n in names])

    def run(batches):
        reader, rows, size = None, [], 0
        for b in batches:
            for file, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if reader is None or reader.path != file:
                    reader = Reader(file)
                for data, head, block in reader.feed(value + b"\r\n\r\n"):
                    row = parsed(data, head, block, wanted, with_payload)
                    if row:
                        rows.append(row)
                        size += len(row["payload"] or b"") + 1000
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pieces.mapInArrow(run, RECORD)


def captures(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One nested row a capture: key, url, record_type, refers_to, payload_bytes, payload_digest, digest_ok, request, response, metadata.

    Request and metadata records are gathered by the identifier that they are concurrent to (there are a handful to a capture, since
    identifiers are unique) and joined to the response or revisit of that identifier. A revisit takes size and first key from the
    responses of its payload digest; without one in these archives they stay null. A capture without metadata has a null key.
    """
    main = records(spark, path, ("response", "revisit"), with_payload)
    side = records(spark, path, ("request", "metadata"), False)
    side = side.select(F.explode("concurrent_to").alias("capture"), "kind", F.struct("record_id", "target_uri", "headers", "block_headers").alias("r"))
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("r"))).alias(kind)
    side = side.groupBy("capture").agg(of("request"), of("metadata"))
    whole = main.join(side.hint("merge"), F.col("record_id") == F.col("capture"), "left")
    key = F.filter(F.transform("metadata", lambda m: F.try_element_at(m["block_headers"], F.lit("page-id"))), lambda x: x.isNotNull())
    return whole.select(
        F.get(key, F.lit(0)).cast("long").alias("page_id"), F.col("target_uri").alias("url"), F.col("kind").alias("record_type"), "payload_bytes", "payload_digest", "digest_ok",
        F.col("request"), F.struct("record_id", "status", "headers", "block_headers", "payload").alias("response"), F.col("metadata"),
    )


def resolved(found: DataFrame, at_least: int = REVISIT_FROM) -> DataFrame:
    """captures() with refers_to, and payload_bytes of revisits: both from the response of their payload digest with the smallest page_id."""
    revisits = found.where("record_type = 'revisit'").select("payload_digest").distinct()
    first = found.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= at_least)).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.min("payload_bytes").alias("_bytes"))
    first = materialise(first.join(revisits.hint("merge"), "payload_digest", "left_semi"), "responses")
    out = checked_join(found, first, "payload_digest", "left", 100)
    again = F.col("record_type") == "revisit"
    return out.withColumns({"refers_to": F.when(again, F.col("_first")), "payload_bytes": F.when(again, F.col("_bytes")).otherwise(F.col("payload_bytes"))}).drop("_first", "_bytes")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", at_least: int = REVISIT_FROM) -> DataFrame:
    """Writes `pages` to archives in the shared folder and returns the captures read back from them, without payloads:
    page_id, url, payload_bytes, payload_digest, record_type, refers_to, digest_ok, request, metadata. Edge cases: see write()."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/conformix/warc-{uuid.uuid4().hex}"
    write(pages, path, key, url, payload, at_least)
    found = materialise(captures(spark, path, with_payload=False).drop("response"), "captures")
    return resolved(found, at_least).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok", "request", "metadata")
