"""Web archives: pages to WARC records and back, with segment reassembly.

``write_archives`` writes gzip-compressed files of WARC/1.1 records through Spark's writer. Payloads are framed as chunked
HTTP responses; a block above ``SEGMENT_BYTES`` is split into a first segment and continuation records that name the
first one's record as their origin, the last with the total length. Equal payloads are stored once: the record of the
largest page id is the response, others are revisits that name it. ``read_archives`` reads any archive: it takes record
by record from the decompressor, groups the segments by origin, puts them in order, verifies numbers and total length and
decodes the transfer framing that the HTTP headers state. The parsed records are written once; only segmented ones are
shuffled.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.session import materialize, shuffles_removed

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 8_192
# Pages in one archive file.
FILE_RECORDS = 2_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{name}: {value}" for name, value in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _chunked(payload: bytes) -> bytes:
    parts, cuts = [], _cuts(payload, CHUNK_BYTES)
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            parts += [b"%x\r\n" % (b - a), payload[a:b], b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Decode chunked transfer framing; raises ValueError where it is broken."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        part = body[end + 2 : end + 2 + size]
        if len(part) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk is cut short")
        parts.append(part)
        at = end + 4 + size


def _cuts(block: bytes, size: int) -> list[int]:
    """Where a block is cut: every ``size`` bytes, moved back to the start of a UTF-8 character."""
    cuts, at = [0], 0
    while len(block) - at > size:
        at += size
        while block[at] & 0xC0 == 0x80:
            at -= 1
        cuts.append(at)
    return [*cuts, len(block)]


def _uri(url: str | None) -> str:
    """A header value: one line, never empty."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:x-page:none"


def _page_records(segment_bytes: int):
    def records(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                page = "" if row["page_id"] is None else str(row["page_id"])
                name = f"<urn:x-page:{page}/{row['own_name']}>"
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                common = [
                    ("WARC-Record-ID", name),
                    ("WARC-Date", "1970-01-01T00:00:00Z"),
                    ("WARC-Target-URI", _uri(row["url"])),
                    ("Content-Type", "application/http; msgtype=response"),
                    ("WARC-Payload-Digest", f"sha1:{digest}"),
                ]
                if row["refers_to"] is not None:
                    extra = [("WARC-Profile", PROFILE)]
                    if row["response"] is not None:
                        extra.append(("WARC-Refers-To", f"<urn:x-page:{row['refers_to']}/{row['response']}>"))
                    rows.append(_record([("WARC-Type", "revisit"), *common, *extra], _HEAD))
                    continue
                block = _HEAD + _chunked(row["payload"].encode())
                cuts = _cuts(block, segment_bytes)
                if len(cuts) == 2:
                    rows.append(_record([("WARC-Type", "response"), *common], block))
                    continue
                parts = []
                for number, (a, b) in enumerate(zip(cuts, cuts[1:]), 1):
                    headers = [("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1")]
                    if number > 1:
                        headers = [
                            ("WARC-Type", "continuation"),
                            ("WARC-Record-ID", f"{name[:-1]}/{number}>"),
                            ("WARC-Date", "1970-01-01T00:00:00Z"),
                            ("WARC-Segment-Origin-ID", name),
                            ("WARC-Segment-Number", str(number)),
                        ]
                    if b == len(block):
                        headers.append(("WARC-Segment-Total-Length", str(len(block))))
                    parts.append(_record(headers, block[a:b]))
                rows.append(b"".join(parts))
            # The writer ends each line with the record's last line feed.
            yield pa.RecordBatch.from_pydict({"value": pa.array([r[:-1].decode() for r in rows], pa.string())})

    return records


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, file_records: int = FILE_RECORDS
) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html), its html in UTF-8 as payload.

    Null html is an empty payload. Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest
    page id is a response and the others are revisits of it; smaller payloads are all responses. Rows without page id are
    revisits where another row has the payload and an id, else responses. Rows that repeat a page id with its payload have
    the role that the id has; as no single record is the response then, its revisits are tied to them by digest alone. An
    empty table gives an empty archive. Other columns are ignored.
    """
    hashed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    by_page = (
        hashed.filter((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull())
        .groupBy("digest", "page_id")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    first = by_page.groupBy("digest").agg(F.max(F.struct("page_id", "rows")).alias("first"))
    other = ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    alone = F.col("first.rows") == 1
    place = F.monotonically_increasing_id().cast("string")
    # A response that is the only row of its page and payload is named by its digest, so that revisits can name it.
    records = hashed.join(first, "digest", "left").select(
        "page_id",
        "url",
        F.when(other & F.col("first").isNotNull(), F.lit(None)).otherwise(F.col("payload")).alias("payload"),
        "digest",
        F.when(other, F.col("first.page_id")).alias("refers_to"),
        F.when(other & alone, F.col("digest")).alias("response"),
        F.when(~other & alone, F.col("digest")).otherwise(place).alias("own_name"),
    ).mapInArrow(_page_records(segment_bytes), "value string")
    # The join moves whole payloads; they are in the archives once it is over.
    with shuffles_removed(pages.sparkSession):
        records.write.option("maxRecordsPerFile", file_records).text(folder, compression="gzip", lineSep="\n")


_ROW = pa.schema(
    [
        ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()),
        ("digest", pa.string()), ("refers_to_id", pa.string()), ("refers_to", pa.int64()), ("http", pa.bool_()),
        ("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("block", pa.binary()),
        ("payload", pa.binary()), ("payload_digest", pa.string()), ("problem", pa.string()),
    ]
)
_ROW_DDL = (
    "record_id string, page_id long, record_type string, target_uri string, digest string, refers_to_id string, "
    "refers_to long, http boolean, origin string, number long, total long, block binary, payload binary, "
    "payload_digest string, problem string"
)
# A batch of parsed records ends above this many bytes.
_BATCH_BYTES = 1 << 22


def _page(name: str | None) -> int | None:
    found = re.match(r"<urn:x-page:(-?\d+)", name or "")
    return int(found[1]) if found else None


def _fields(lines) -> dict[str, str]:
    """Header lines up to an empty one; names in lower case, folded lines joined, of repeated names the first."""
    fields, name = {}, None
    for raw in lines:
        line = raw.decode("utf-8", "replace").rstrip("\r\n")
        if not line:
            break
        if line[0] in " \t" and name is not None:
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon:
            raise ValueError(f"no header: {line[:80]}")
        if name not in fields:
            fields[name] = value.strip()
        else:
            name = None
    return fields


def parse_records(data):
    """(headers, block) of every record in an uncompressed archive, bytes or a stream; names of headers in lower case."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    while True:
        at = stream.tell()
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = _fields(iter(stream.readline, b""))
        if not headers.get("content-length", "").isdecimal():
            raise ValueError(f"record at byte {at} has no length")
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield headers, block


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _decoded(row: dict, block: bytes) -> dict:
    """Take the payload out of a complete block and compare it with the digest in the headers.

    The payload of an HTTP message is its body without the transfer framing, that of any other record its block. Some
    writers take the digest of a body with its framing, so either agrees.
    """
    body = payload = block
    problem = None
    if row["http"]:
        end = block.find(b"\r\n\r\n")
        if end < 0:
            return row | {"problem": "no end of the HTTP headers"}
        body = payload = block[end + 4 :]
        try:
            fields = _fields(block[:end].split(b"\r\n")[1:])
            if "chunked" in fields.get("transfer-encoding", "").lower():
                payload = unchunked(body)
            elif fields.get("content-length", "").isdecimal() and int(fields["content-length"]) > len(body):
                problem = "body is cut short"
        except ValueError as error:
            return row | {"problem": f"framing: {error}"}
    digest = _sha1(payload)
    if row["digest"] not in (None, digest) and (payload is body or row["digest"] != _sha1(body)):
        problem = "digest differs"
    return row | {"payload": payload, "payload_digest": digest, "problem": problem}


def _parsed(headers: dict[str, str], block: bytes) -> dict:
    kind, name = headers.get("warc-type"), headers.get("warc-record-id")
    content = headers.get("content-type")
    algorithm, _, digest = headers.get("warc-payload-digest", "").partition(":")
    refers_to = headers.get("warc-refers-to")
    row = dict.fromkeys(_ROW.names) | {
        "record_id": name,
        "page_id": _page(name),
        "record_type": kind,
        "target_uri": headers.get("warc-target-uri"),
        "digest": digest.upper() if algorithm.lower() == "sha1" and len(digest) == 32 else None,
        "refers_to_id": refers_to,
        "refers_to": _page(refers_to),
        "http": kind in ("response", "request") if content is None else content.lower().startswith("application/http"),
    }
    number = headers.get("warc-segment-number")
    if number is not None:
        total = headers.get("warc-segment-total-length")
        return row | {
            "origin": headers.get("warc-segment-origin-id", name),
            "number": int(number),
            "total": int(total) if total else None,
            "block": block,
        }
    if kind == "revisit":
        return row | {"payload_digest": row["digest"]}
    return _decoded(row, block)


def _parse(batches):
    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            # Archives mostly compress each record as a member of its own; a truncated one raises EOFError.
            with gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())) as stream:
                for headers, block in parse_records(stream):
                    rows.append(_parsed(headers, block))
                    held += len(block)
                    if held > _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ROW)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ROW)


def _reassemble(batches):
    for batch in batches:
        for row in batch.to_pylist():
            segments = row.pop("segments")
            row = dict.fromkeys(_ROW.names) | row
            block = b"".join(s["block"] for s in segments)
            if [s["number"] for s in segments] != list(range(1, len(segments) + 1)) or row["record_type"] is None:
                row["problem"] = "segments are missing"
            elif row["total"] != len(block):
                row["problem"] = "total length differs"
            else:
                row = _decoded(row, block)
            yield pa.RecordBatch.from_pylist([row], _ROW)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, target_uri, record_type, refers_to, payload, payload_bytes, payload_digest, problem, record_id,
    refers_to_id) of every record, of whatever type, in the ``.gz`` files of a folder.

    Segments are put together: ``problem`` names missing segments, a wrong total length, broken framing, a body shorter
    than its Content-Length or a digest that differs from the header; such a record has no payload, or the one found if only
    its length or digest differs. A revisit has no payload of its own; its size is that of the response with the same
    digest, null if the archive has none; a revisit without WARC-Refers-To refers to the largest page id among those.
    ``page_id`` and ``refers_to`` are null for records that ``write_archives`` did not name. Digests by other algorithms
    than SHA-1 are not compared. A file that is no archive raises an error. A task holds one compressed file and one batch
    of records.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").schema(
        "path string, modificationTime timestamp, length long, content binary"
    ).load(folder)
    records = materialize(files.select("content").mapInArrow(_parse, _ROW_DDL), "zstd")
    first = F.col("number") == 1
    of_origin = ("record_id", "page_id", "record_type", "target_uri", "digest", "refers_to_id", "refers_to", "http")
    joined = (
        records.filter(F.col("number").isNotNull())
        .groupBy("origin")
        .agg(
            *[F.max(F.when(first, F.col(c))).alias(c) for c in of_origin],
            F.max("total").alias("total"),
            F.sort_array(F.collect_list(F.struct("number", "block"))).alias("segments"),
        )
        .mapInArrow(_reassemble, _ROW_DDL)
    )
    found = records.filter(F.col("number").isNull()).union(joined).select(
        "page_id",
        "target_uri",
        "record_type",
        "refers_to",
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "payload_digest",
        "problem",
        "record_id",
        "refers_to_id",
    )
    is_revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    responses = (
        found.filter((F.col("record_type") == "response") & F.col("payload_bytes").isNotNull())
        .groupBy(F.col("payload_digest").alias("of"))
        .agg(F.max("payload_bytes").alias("same_bytes"), F.max("page_id").alias("same_page"))
    )
    revisits = found.filter(is_revisit).join(responses, F.col("payload_digest") == F.col("of"), "left")
    by_digest = F.when(F.col("refers_to_id").isNull(), F.col("same_page"))
    return found.filter(~is_revisit).unionByName(
        revisits.withColumns(
            {"payload_bytes": F.col("same_bytes"), "refers_to": F.coalesce("refers_to", by_digest)}
        ).drop("of", "same_bytes", "same_page")
    )
