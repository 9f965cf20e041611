"""Web archives: write captures as WARC records, read them, and assemble transactions.

A capture is written as a request, a response (or a revisit of an equal payload) and a
metadata record.  The request and the metadata name the response in WARC-Concurrent-To.
Records are rows of text that end in the blank lines WARC asks for, so Spark's text writer
makes the archives on any file system it can reach, and its text reader cuts them at the
version lines of 1.0 and 1.1.  A payload that holds a version line is put together again by
its Content-Length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import answer_by_runs, as_bytes

#: Fixed values of the format (ISO 28500).
VERSION = "WARC/1.1"
VERSIONS = "WARC/1."
CRLF = "\r\n"
RECORD_END = CRLF + CRLF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

CAPTURE_SCHEMA = "uri string, date string, payload_bytes long, payload_digest string"


def payload_digests(pages: DataFrame, payload: Column) -> DataFrame:
    """``pages`` with ``_payload`` (null is empty), ``_bytes`` and ``_digest`` (hex SHA-256)."""
    binary = F.coalesce(payload, F.lit("")).cast("binary")
    return pages.select(
        "*",
        F.coalesce(payload, F.lit("")).alias("_payload"),
        F.octet_length(binary).cast("long").alias("_bytes"),
        F.sha2(binary, 256).alias("_digest"),
    )


def first_captures(digested: DataFrame, id_column: str, min_bytes: int, run: str) -> DataFrame:
    """Per digest that repeats among payloads of at least ``min_bytes``: the smallest id."""
    known = digested.where((F.col("_bytes") >= min_bytes) & F.col(id_column).isNotNull())
    runs = known.groupBy("_digest", run).agg(F.min(id_column).alias("first_id"), F.count("*").alias("n"))
    whole = runs.groupBy("_digest").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"))
    return whole.where("n > 1").select("_digest", "first_id")


def _header(*fields: tuple[str, Column | str]) -> list[Column]:
    parts: list[Column] = [F.lit(VERSION + CRLF)]
    for name, value in fields:
        parts += [F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(CRLF)]
    return [*parts, F.lit(CRLF)]


def _record_id(kind: str, row_key: Column) -> Column:
    """A URN that every capture and kind of record has to itself."""
    h = F.md5(F.concat(F.lit(kind + ":"), row_key))
    dashed = [F.substring(h, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *dashed), F.lit(">"))


def capture_records(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
                    min_bytes: int = 100) -> DataFrame:
    """One row ``value`` per WARC record, three per page, without the record's end.

    Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the smallest
    id is a response and the others are revisits of it; repeated rows of that id are all
    responses.  Pages without an id, and small payloads, are responses.  Null payloads are
    empty; a null address is written as an empty one; CR and LF in an address are encoded.
    """
    runs = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = pages.select(
        F.col(id_column).cast("long").alias("_id"),
        F.regexp_replace(F.coalesce(F.col(url_column), F.lit("")), "[\\r\\n]", "%0A").alias("_url"),
        F.col(payload_column).cast("string").alias("_html"),
    )
    rows = payload_digests(narrow, F.col("_html")).drop("_html")
    rows = rows.withColumn("_run", F.pmod(F.xxhash64("_id", "_url"), F.lit(runs)))
    placed = answer_by_runs(rows, first_captures(rows, "_id", min_bytes, "_run"), ["_digest"], "_run")
    revisit = F.col("first_id").isNotNull() & (F.col("_bytes") >= min_bytes) & (F.col("_id") != F.col("first_id"))
    placed = placed.withColumn("_revisit", F.coalesce(revisit, F.lit(False)))
    # repeated rows of a page are captures of their own
    key = F.concat_ws("/", F.coalesce(F.col("_id").cast("string"), F.lit("-")), F.monotonically_increasing_id())
    placed = placed.withColumn("_response", _record_id("response", key)).withColumn("_key", key)

    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("_bytes").cast("string"),
        F.lit(RECORD_END),
    )
    body = F.when(F.col("_revisit"), http).otherwise(F.concat(http, F.col("_payload")))
    common = [("WARC-Target-URI", F.col("_url")), ("WARC-Date", DATE)]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest")))
    length = lambda block: ("Content-Length", F.octet_length(block).cast("string"))
    response = F.concat(
        *_header(("WARC-Type", "response"), ("WARC-Record-ID", F.col("_response")), *common, digest,
                 ("Content-Type", "application/http; msgtype=response"), length(body)), body)
    revisited = F.concat(
        *_header(("WARC-Type", "revisit"), ("WARC-Record-ID", F.col("_response")), *common, digest,
                 ("WARC-Profile", REVISIT_PROFILE),
                 ("WARC-Refers-To-Capture", F.col("first_id").cast("string")),
                 ("Content-Type", "application/http; msgtype=response"), length(body)), body)
    asked = F.concat(F.lit("GET "), F.col("_url"), F.lit(f" HTTP/1.1{RECORD_END}"))
    request = F.concat(
        *_header(("WARC-Type", "request"), ("WARC-Record-ID", _record_id("request", F.col("_key"))), *common,
                 ("WARC-Concurrent-To", F.col("_response")),
                 ("Content-Type", "application/http; msgtype=request"), length(asked)), asked)
    fields = F.concat(
        F.lit("captureId: "), F.coalesce(F.col("_id").cast("string"), F.lit("")),
        F.lit(f"{CRLF}payloadBytes: "), F.col("_bytes").cast("string"), F.lit(CRLF))
    metadata = F.concat(
        *_header(("WARC-Type", "metadata"), ("WARC-Record-ID", _record_id("metadata", F.col("_key"))), *common,
                 ("WARC-Concurrent-To", F.col("_response")),
                 ("Content-Type", "application/warc-fields"), length(fields)), fields)
    either = F.when(F.col("_revisit"), revisited).otherwise(response)
    return placed.select(F.explode(F.array(request, either, metadata)).alias("value"))


def write_archives(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Archives under ``path``, one per task; each record ends in two blank lines."""
    records.write.option("lineSep", RECORD_END).option("compression", compression).text(path)


RECORD_SCHEMA = (
    "record_id string, record_type string, concurrent_to array<string>, uri string, date string, refers_to string, "
    "declared_digest string, payload_digest string, block_bytes long, payload binary, fields map<string,string>"
)
_ARROW = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.list_(pa.string())),
    *[(name, pa.string()) for name in ("uri", "date", "refers_to", "declared_digest", "payload_digest")],
    ("block_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string())),
])
_START = VERSIONS.encode()
_BLANK = RECORD_END.encode()
#: Ends of names of files that Spark never splits.
UNSPLIT = (".gz", ".deflate", ".zst", ".lz4", ".snappy")


def _fields(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.split(CRLF.encode()):
        name, colon, value = line.partition(b":")
        if colon:
            found[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return found


def _concurrent(head: bytes) -> list[str]:
    """All records that a header names as concurrent, each once, in its order."""
    found = (line.partition(b":") for line in head.split(CRLF.encode()))
    named = (value.strip().decode("utf-8", "replace") for name, _, value in found
             if name.strip().lower() == b"warc-concurrent-to")
    return list(dict.fromkeys(filter(None, named)))


def _declared(head: dict[str, str]) -> int | None:
    """The Content-Length, or None where it is missing or no number."""
    value = head.get("content-length", "")
    return int(value) if value.isascii() and value.isdigit() else None


def _record(head: dict[str, str], concurrent: list[str], block: bytes, keep_payload: bool) -> tuple:
    kind = head.get("warc-type")
    http = kind in ("response", "revisit") and head.get("content-type", "").startswith("application/http")
    fields, payload = {}, block
    if http:
        first, _, payload = block.partition(_BLANK)
        fields = _fields(first.partition(CRLF.encode())[2])
    elif kind == "metadata":
        fields = _fields(block)
    return (
        head.get("warc-record-id"), kind, concurrent, head.get("warc-target-uri"),
        head.get("warc-date"), head.get("warc-refers-to-capture"),
        head.get("warc-payload-digest", "").removeprefix("sha256:") or None,
        hashlib.sha256(payload).hexdigest() if kind == "response" else None,
        len(block), payload if keep_payload and kind == "response" else None, list(fields.items()),
    )


def _parse(keep_payload: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size = [], None, 0

        def flush():
            columns = list(zip(*out)) if out else [()] * len(_ARROW)
            return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

        archive, loose = None, False  # loose: a record of unknown length has begun

        def done(held: bytes, want: int | None) -> tuple:
            head, _, rest = held.partition(_BLANK)
            block = rest.removesuffix(_BLANK) if want is None else rest[:want]
            return _record(_fields(head), _concurrent(head), block, keep_payload)

        for batch in batches:
            names = batch.column(1).to_pylist()
            for piece, name in zip(batch.column(0).to_pylist(), names):
                # a piece is what stands between two version marks
                starts = piece[:1] in b"01" and piece[1:3] == b"\r\n"
                if loose and (starts or name != archive):
                    out.append(done(held, None))
                    held, loose = None, False
                if name != archive:
                    if held is not None:
                        raise ValueError("an archive ends within a record")
                    archive = name
                if held is None and not starts:
                    continue  # before the first version line of an archive
                held = piece if held is None else held + _START + piece
                head, blank, rest = held.partition(_BLANK)
                if not blank:
                    continue
                want = _declared(_fields(head))
                if want is None:
                    loose = True
                    continue
                if len(rest) < want:
                    continue  # the payload itself holds a version mark
                out.append(done(held, want))
                size += want if keep_payload else 200
                held = None
                if size > 8 << 20 or len(out) >= 4096:
                    yield flush()
                    out, size = [], 0
        if loose:
            out.append(done(held, None))
        elif held is not None:
            raise ValueError("an archive ends within a record")
        yield flush()

    return parse


def read_records(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per record.  ``payload_digest`` is of the payload that was read.

    Without ``keep_payload`` payloads are still read and hashed, but not passed on.
    An archive is read by one task, record by record.  Files that Spark would split go
    through a shuffle by file, sorted by place.  A record whose Content-Length is missing
    or no number ends at the next version line.  Repeated WARC-Concurrent-To headers all
    count.  An archive that ends before a record's declared length is refused.
    """
    found = spark.read.option("lineSep", VERSIONS).text(path)
    value, name = F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("name")
    if all(file.endswith(UNSPLIT) for file in found.inputFiles()):
        pieces = found.select(value, name)
    else:
        place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place")
        pieces = found.select(value, name, place).repartition("name").sortWithinPartitions("name", "place").drop("place")
    return pieces.mapInArrow(_parse(keep_payload), RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id``, ``response``, ``requests``, ``metadata``.

    Requests and metadata join their response or revisit by WARC-Concurrent-To.  Several
    of them for one response are kept in an array, and a record that names several
    responses stands in each of their captures.  One that names no known response, or
    none at all, becomes a capture without a response, so no record is lost; without an
    id of its own either, its capture has none.
    """
    primary = F.col("record_type").isin("response", "revisit")
    inner = F.struct("record_id", "record_type", "uri", "date", "refers_to", "declared_digest", "payload_digest",
                     "block_bytes", "payload", "fields")
    named = F.filter("concurrent_to", lambda x: x.isNotNull())
    named = F.when(primary | (F.coalesce(F.size(named), F.lit(0)) == 0), F.array("record_id")).otherwise(named)
    keyed = records.select(
        F.explode(named).alias("capture_id"),
        F.col("record_type").alias("kind"),
        primary.alias("is_primary"),
        inner.alias("record"),
    )
    responses = keyed.where("is_primary").select("capture_id", F.col("record").alias("response"))
    narrow = F.col("record").withField("payload", F.lit(None).cast("binary"))
    others = (
        keyed.where("not coalesce(is_primary, false)")
        # records without any id are captures of their own
        .withColumn("_own", F.when(F.col("capture_id").isNull(), F.monotonically_increasing_id()))
        .groupBy("capture_id", "_own")
        .agg(
            F.collect_list(F.when(F.col("kind") == "request", narrow)).alias("requests"),
            F.collect_list(F.when(F.coalesce(F.col("kind") != "request", F.lit(True)), narrow)).alias("metadata"),
        )
    )
    return responses.join(others.drop("_own"), "capture_id", "full_outer")


def captures(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    return assemble(read_records(spark, path, keep_payload))
