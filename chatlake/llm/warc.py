"""WARC archives: write request, response and metadata records, read them back, assemble one nested row per capture.

**Writing.** Every page becomes three records: the request, the response (or, where another page has the same payload, a
revisit) and a metadata record with the page's id; request and metadata name the response in ``WARC-Concurrent-To``. A
payload's first page is found by grouping digests, aggregated before the shuffle; pages then join that table, and a
payload that a third of all pages share stays splittable. One row holds a page's three records, and Spark's own text
writer puts them into gzip files with the record end as line separator, so files appear only when a task commits and a
lost executor leaves none behind. Pages are written by size (``SIZES``: equal payloads are equally long, so a size's pages find their
first ones among themselves), and each size has its number of pages a file, so a file holds about 64 MB at most, or one larger page.

**Reading.** Each file is parsed by ``Content-Length``, never by looking for separators, so payloads may hold anything. The
payload's digest is computed again and compared with the header. Request, response and metadata records are then
joined through the concurrent-to identifiers into one nested row per capture.

Record ids are random, made once per row when it is written; results do not depend on them.

Defined results: a null payload is empty; a null url has no target URI (null when read back); line breaks in a url are
percent-encoded; a page without an id has a null page_id and refers to the smallest id that shares its payload, or is a
response where no such page has an id; rows that repeat an id and a payload are all responses; an empty table writes no
record and gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.common import new_path, ship, text_or_empty

#: (bytes from, below, pages a file)
SIZES = ((0, 1 << 16, 1000), (1 << 16, 1 << 22, 16), (1 << 22, None, 1))
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1, as archives write it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, record_id: str, url: str | None, block: str, **more: str) -> str:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url}")
    head += [f"{k.replace('_', '-')}: {v}" for k, v in more.items()]
    return "\r\n".join([*head, f"Content-Length: {len(block.encode())}"]) + END + block


def records_of(page_id: int | None, url: str | None, payload: str, refers_to: int | None) -> str:
    """The three records of one capture, each but the last with its end."""
    request, response, metadata = (f"urn:uuid:{uuid.uuid4()}" for _ in range(3))
    body = payload.encode()
    url = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    try:
        parts = urlsplit(url or "")
        host, path = parts.netloc, parts.path or "/"
    except ValueError:  # not a URL: the record still names it as its target
        host, path = "", "/"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}{END}"
    digest = {"WARC_Payload_Digest": f"sha1:{payload_digest(body)}", "Content_Type": "application/http; msgtype=response"}
    if refers_to is None:
        main = _record("response", response, url, http + payload, **digest)
    else:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        main = _record("revisit", response, url, http, WARC_Profile=profile, WARC_Refers_To_Page=str(refers_to), **digest)
    link = {"WARC_Concurrent_To": f"<{response}>"}
    ask = _record("request", request, url, f"GET {path} HTTP/1.1\r\nHost: {host}{END}", Content_Type="application/http; msgtype=request", **link)
    note = "" if page_id is None else f"pageId: {page_id}\r\n"
    about = _record("metadata", metadata, url, note, Content_Type="application/warc-fields", **link)
    return END.join([ask, main, about])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_revisit_bytes: int = 0) -> str:
    """Write the archives of ``pages`` to the folder ``path`` (shared); payloads below ``min_revisit_bytes`` never revisit."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        text_or_empty(payload_col).alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= min_revisit_bytes) if min_revisit_bytes else rows
    for low, high, most in SIZES:
        of_size = F.octet_length("payload") >= low
        of_size = of_size if high is None else of_size & (F.octet_length("payload") < high)
        first = large.where(of_size).groupBy("key").agg(F.min("page_id").alias("first_id"))
        joined = rows.where(of_size).join(first.hint("merge"), "key", "left")
        refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to")
        out = _records(joined.select("page_id", "url", "payload", refers), min(200, most))
        out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{path}/from={low}")
    return path


def _records(rows: DataFrame, at_once: int) -> DataFrame:
    """(value): the records of each row (page_id, url, payload, refers_to)."""
    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, at_once):
                part = batch.slice(low, at_once).to_pydict()
                values = [records_of(*row) for row in zip(part["page_id"], part["url"], part["payload"], part["refers_to"])]
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["value"])

    return ship(rows).mapInArrow(run, "value string")


def parse(content: bytes):
    """(headers, block) of every record of one archive, gzip or plain."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content))
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            head[name.decode().lower()] = value.strip().decode()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("the archive ends inside a record")
        yield head, block


def _row(head: dict, block: bytes) -> dict:
    bare = lambda x: x and x.strip("<>")
    out = {"record_id": bare(head["warc-record-id"]), "record_type": head["warc-type"], "url": head.get("warc-target-uri"),
           "concurrent_to": bare(head.get("warc-concurrent-to"))}
    if out["record_type"] in ("response", "revisit"):
        http, _, body = block.partition(END.encode())
        fields = dict(x.partition(b":")[::2] for x in http.split(b"\r\n")[1:])
        out["payload_bytes"] = int(fields[b"Content-Length"])
        out["payload_digest"] = head["warc-payload-digest"].removeprefix("sha1:")
        out["refers_to"] = int(head["warc-refers-to-page"]) if "warc-refers-to-page" in head else None
        if out["record_type"] == "response":
            if len(body) != out["payload_bytes"] or payload_digest(body) != out["payload_digest"]:
                raise ValueError(f"the payload of {out['record_id']} differs from its digest")
            out["payload"] = body.decode()
    elif out["record_type"] == "request":
        out["request_line"] = block.partition(b"\r\n")[0].decode()
    else:
        fields = dict(x.partition(b": ")[::2] for x in block.split(b"\r\n"))
        out["page_id"] = int(fields[b"pageId"]) if b"pageId" in fields else None
    return out


_RESPONSE = ("record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, "
             "payload string")
_REQUEST = "record_id string, concurrent_to string, request_line string"
_METADATA = "record_id string, concurrent_to string, page_id long"
_ARROW = {"string": pa.string(), "long": pa.int64()}


def read_records(spark: SparkSession, path: str, kinds: tuple[str, ...], schema: str) -> DataFrame:
    """The records of these kinds, one row each."""
    names, types = zip(*(x.split() for x in schema.split(", ")))
    arrow = pa.schema([(n, _ARROW[t]) for n, t in zip(names, types)])

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for head, block in parse(content.as_py()):
                    if head["warc-type"] in kinds:
                        row = _row(head, block)
                        rows.append({n: row.get(n) for n in names})
                        size += len(block)
                    if len(rows) >= 500 or size > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
    return ship(files).select("content").mapInArrow(run, schema)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """One nested row per capture: page_id, response, request and metadata structs."""
    response = read_records(spark, path, ("response", "revisit"), _RESPONSE)
    request = read_records(spark, path, ("request",), _REQUEST)
    metadata = read_records(spark, path, ("metadata",), _METADATA)
    response = response.select(F.col("record_id").alias("capture"), F.struct(*response.columns).alias("response"))
    request = request.select(F.col("concurrent_to").alias("capture"), F.struct("record_id", "request_line").alias("request"))
    metadata = metadata.select(F.col("concurrent_to").alias("capture"), F.struct("record_id", "page_id").alias("metadata"))
    joined = response.join(request, "capture", "left").join(metadata, "capture", "left")
    return joined.select(F.col("metadata.page_id").alias("page_id"), "response", "request", "metadata")


def archive_and_read(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write ``pages`` as archives (to a new shared folder by default), read them and return the captures."""
    spark = pages.sparkSession
    return captures(spark, write_archives(pages, path or new_path(spark, "warc"), **columns))
