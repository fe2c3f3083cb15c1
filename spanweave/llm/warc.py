"""Operator 6: write captures as WARC archives and assemble them again.

Writing: each page gives three records: a request, a response (or a revisit of the response with
the same payload) and a metadata record; the request and the metadata name the second in
``WARC-Concurrent-To``. Records are built with SQL functions and written by Spark's text writer as
gzip files whose separator is the end of a WARC record, so the shared file system is the only
place they go to. Of records with equal payloads (SHA-256) of ``least`` bytes or more, that with
the smallest page id is the response; the smallest is a partially aggregated minimum, so a
payload with very many copies is no single task.

Reading: archives (``.warc`` or ``.warc.gz``, one gzip member or one a record) are inflated piece by piece and
parsed by ``Content-Length`` (separators may occur in payloads), so that a task holds the compressed file and
one record, never the inflated archive; and the
records of a transaction are joined on the identifier they share: one aggregation on it, which
also bears repeated captures. One nested row per capture comes out.

Defined cases: null html is the empty payload; a null page id is carried through and is never
the smallest; pages that share the smallest id and the payload are all responses; equal rows
are captures of their own; null urls leave the target out; other columns are ignored. Of foreign archives, records of
other types are left out, fields that are not there are null, and bytes that are no UTF-8 are replaced in the payload column
(its digest and length are those of the bytes).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanweave.llm.common import shared_path

LEAST = 100
RECORDS_PER_FILE = 30_000
PIECE = 1 << 18
#: rows of a batch end at this many payload bytes
BATCH_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(*parts: Column) -> Column:
    """<urn:uuid:...> derived from the parts."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("\0")) for p in parts]).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field with a null value is left out."""
    return F.concat_ws("\r\n", *[F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in fields])


def _record(kind: Column, own: Column, block: Column, *fields: tuple[str, Column]) -> Column:
    head = _lines(("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", F.lit(DATE)), *fields,
                  ("Content-Length", F.octet_length(block)))
    return F.concat(F.lit("WARC/1.1\r\n"), head, F.lit(END), block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", least: int = LEAST) -> None:
    """Write the captures of ``pages`` as gzip-compressed WARC files below ``path``."""
    one_line = F.replace(F.replace(F.col(url_col).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    p = pages.select(F.col(id_col).alias("id"), one_line.alias("url"),
                     F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    p = p.withColumn("bytes", F.octet_length("html").cast("bigint")).withColumn(
        "digest", F.sha2(F.col("html").cast("binary"), 256))
    first = p.where((F.col("bytes") >= least) & F.col("id").isNotNull()).groupBy("digest").agg(
        F.min(F.struct("id", "url")).alias("first"))
    p = p.join(first, "digest", "left")
    again = ((F.col("bytes") >= least) & F.col("first.id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id")))
    p = p.withColumn("again", again).withColumn("main", _uuid(F.col("id"), F.col("url"), F.col("digest")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _lines(("Content-Type", F.lit("text/html; charset=utf-8")),
                                                        ("Content-Length", F.col("bytes"))), F.lit(END))
    target = ("WARC-Target-URI", F.col("url"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    concurrent = ("WARC-Concurrent-To", F.col("main"))
    request = _record(F.lit("request"), _uuid(F.col("main"), F.lit("request")),
                      F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1" + END)),
                      target, concurrent, ("Content-Type", F.lit("application/http;msgtype=request")))
    only = lambda c: F.when(F.col("again"), c)
    answer = _record(F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response")), F.col("main"),
                     F.concat(http, F.when(F.col("again"), F.lit("")).otherwise(F.col("html"))),
                     target, digest, ("WARC-Profile", only(F.lit(PROFILE))),
                     ("WARC-Refers-To", only(_uuid(F.col("first.id"), F.col("first.url"), F.col("digest")))),
                     ("WARC-Refers-To-Target-URI", only(F.col("first.url"))),
                     ("Content-Type", F.lit("application/http;msgtype=response")))
    word = lambda c: F.url_encode(c.cast("string"))
    about = F.concat(_lines(("page-id", word(F.col("id"))), ("refers-to-page", only(word(F.col("first.id"))))),
                     F.lit("\r\n"))
    metadata = _record(F.lit("metadata"), _uuid(F.col("main"), F.lit("metadata")), about, target, concurrent,
                       ("Content-Type", F.lit("application/warc-fields")))
    (p.select(F.explode(F.array(request, answer, metadata)).alias("value"))
      .write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE)
      .text(path))


def _fields(block: bytes) -> dict[str, str]:
    got = {}
    for line in block.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            got[name.strip().lower()] = value.strip()
    return got


def inflated(data: bytes) -> Iterator[bytes]:
    """Pieces of an archive: all gzip members one after another, or the bytes as they are. What follows the last
    whole member and is no member is left out, as are the missing bytes of a member that is cut off."""
    view = memoryview(data)
    if bytes(view[:2]) != b"\x1f\x8b":
        yield from (bytes(view[k:k + PIECE]) for k in range(0, len(view), PIECE))
        return
    at = 0
    while bytes(view[at:at + 2]) == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof and at < len(view):
            piece = bytes(view[at:at + PIECE])
            at += len(piece)
            out = b""
            while not member.eof and (piece or len(out) == PIECE):    # a full piece may leave more inside
                out = member.decompress(piece, PIECE)
                piece = member.unconsumed_tail
                yield out
            at -= len(member.unused_data)


def records(pieces: Iterator[bytes]):
    """(WARC fields, block) of every record of an archive, by Content-Length; a record that is cut off is left out."""
    held, at = bytearray(), 0

    def more(upto: int) -> bool:
        """Hold at least ``upto`` bytes from ``at``; False if the archive ends before."""
        nonlocal at
        while len(held) - at < upto:
            piece = next(pieces, None)
            if piece is None:
                return False
            if at > PIECE:
                del held[:at]
                at = 0
            held.extend(piece)
        return True

    while more(1):
        if held[at] in b"\r\n":       # the line ends after a record
            at += 1
            continue
        seen = 0
        while (stop := held.find(b"\r\n\r\n", at + seen)) < 0:
            seen = max(0, len(held) - at - 3)
            if not more(len(held) - at + 1):
                return
        head = stop - at + 4
        fields = _fields(bytes(held[at:stop]))
        size = int(fields.get("content-length", 0))
        if not more(head + size):
            return
        at += head
        yield fields, bytes(memoryview(held)[at:at + size])
        at += size


_COLUMNS = ("transaction", "kind", "record_id", "uri", "date", "refers_to", "about_page", "about_refers",
            "payload_bytes", "payload_digest", "payload")
_SCHEMA = ("transaction string, kind string, record_id string, uri string, date string, refers_to string, "
           "about_page string, about_refers string, payload_bytes bigint, payload_digest string, payload string")


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> dict:
    kind, own = fields.get("warc-type"), fields.get("warc-record-id")
    row = dict.fromkeys(_COLUMNS) | {
        "transaction": fields.get("warc-concurrent-to", own), "kind": kind, "record_id": own,
        "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date")}
    if kind == "metadata":
        about = _fields(block)
        row["about_page"], row["about_refers"] = about.get("page-id"), about.get("refers-to-page")
    elif kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        stated = _fields(head).get("content-length", "")
        row["payload_bytes"] = len(payload) if kind == "response" else int(stated) if stated.isdigit() else None
        row["payload_digest"] = (hashlib.sha256(payload).hexdigest() if kind == "response"
                                 else fields.get("warc-payload-digest", "").rpartition(":")[2] or None)
        row["refers_to"] = fields.get("warc-refers-to")
        if with_payload and kind == "response":
            row["payload"] = payload.decode("utf-8", "replace")
    return row


def read_captures(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per capture: ``request``, ``answer`` and ``metadata`` as nested records."""
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in records(inflated(content.as_buffer())):
                    rows.append(_row(fields, block, with_payload))
                    held += len(rows[-1]["payload"] or "")
                    if len(rows) == 2000 or held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.string()) for n in _COLUMNS])
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content").mapInArrow(
        run, _SCHEMA)
    kind = F.col("kind")
    part = {
        "request": (kind == "request", F.struct("record_id", "uri", "date")),
        "answer": (kind.isin("response", "revisit"),
                   F.struct("record_id", "kind", "uri", "date", "refers_to", "payload_bytes", "payload_digest",
                            *["payload"] * with_payload)),
        "metadata": (kind == "metadata", F.struct("record_id", "about_page", "about_refers")),
    }
    # the copies of a repeated capture are equal, so any of them will do, once for each answer
    whole = found.groupBy("transaction").agg(*[F.max(F.when(which, what)).alias(name) for name, (which, what) in part.items()],
                                             F.count_if(part["answer"][0]).alias("copies"))
    return whole.select("transaction", "request", "answer", "metadata",
                        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).where("copies > 0")


def page_ids(col: Column, kind: str) -> Column:
    """Ids as the metadata records hold them, decoded."""
    return F.url_decode(col).cast(kind)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    from spanweave.llm.common import table
    pages = table(spark, sf_dir, "pages")
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType.simpleString()
    return read_captures(spark, path, with_payload=False).select(
        page_ids(F.col("metadata.about_page"), kind).alias("page_id"),
        F.col("answer.payload_bytes").alias("payload_bytes"), F.col("answer.payload_digest").alias("payload_digest"),
        F.col("answer.kind").alias("record_type"), page_ids(F.col("metadata.about_refers"), kind).alias("refers_to"))


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
