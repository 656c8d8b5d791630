"""WARC archives with segmented records: written from pages, read back, reassembled, verified and decoded.

A page's HTTP response is stored as it went over the wire, with a chunked body. A block longer than the segment size is
spread over a first record and continuation records; the reader groups these by origin, orders them by number, verifies
the total length, takes the chunked framing off and checks the payload's digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import shared_folder, small_batches, written

SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS, LEAST_REVISIT = 8192, 2048, 8192, 0
_END = b"\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_LAST = (1 << 63) - 1


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324 - the format's digest


def chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[at:at + size]), payload[at:at + size]) for at in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped. ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size line is not ended")
        size = int(body[at:line].split(b";")[0].strip(), 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk is shorter than its size")
        out.append(body[at:at + size])
        at += size + 2


def _head(**fields: object) -> bytes:
    lines = ["WARC/1.1", *[f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]]
    return "\r\n".join(lines).encode() + _END


def record_name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def page_records(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, segment: int, chunk: int) -> list[bytes]:
    """The records of one page without their closing empty lines."""
    digest = digest32(payload)
    name = record_name(page_id, digest)
    uri = "".join(c for c in (url or f"urn:page:{page_id}") if c.isprintable() and c != " ")
    common = {"WARC_Date": _DATE, "WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha1:{digest}", "X_Page_Id": page_id}
    if revisit:
        return [_head(WARC_Type="revisit", WARC_Record_ID=name, **common, WARC_Refers_To=record_name(first, digest),
                      WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", Content_Length=0)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    pieces = [block[at:at + segment] for at in range(0, len(block), segment)]
    http = "application/http; msgtype=response"
    if len(pieces) == 1:
        return [_head(WARC_Type="response", WARC_Record_ID=name, **common, Content_Type=http, Content_Length=len(block)) + block]
    out = [_head(WARC_Type="response", WARC_Record_ID=name, **common, Content_Type=http, WARC_Segment_Number=1, Content_Length=len(pieces[0])) + pieces[0]]
    for k, piece in enumerate(pieces[1:], 2):
        out.append(_head(
            WARC_Type="continuation", WARC_Record_ID=f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{k}')}>", WARC_Date=_DATE,
            WARC_Segment_Origin_ID=name, WARC_Segment_Number=k, WARC_Segment_Total_Length=len(block) if k == len(pieces) else None,
            Content_Length=len(piece)) + piece)
    return out


def write_archives(pages: DataFrame, folder: str, least_revisit: int = LEAST_REVISIT, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES,
                   file_records: int = FILE_RECORDS) -> None:
    """Writes a record per row of ``page_id, url, html`` below ``folder`` as gzipped archives of at most ``file_records`` records.

    Of rows with equal payloads of at least ``least_revisit`` bytes, that with the smallest page_id (nulls last) becomes a
    response and the others revisits of it. Rows equal in page_id and payload are one page.
    """
    small_batches(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    hashed = own.withColumn("sha", F.sha1("payload"))
    # Only payloads that occur more than once take part in the join. They are written, so that Spark knows their size and
    # leaves the payloads where they are if these are few.
    shared = written(hashed.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first"))
    marked = hashed.join(shared, "sha", "left").withColumn(
        "revisit", (F.octet_length("payload") >= least_revisit) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pylist()
                out = [x for r in rows for x in page_records(r["page_id"], r["url"], r["payload"], r["first"], r["revisit"], segment, chunk)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    records = marked.select("page_id", "url", "payload", "first", "revisit").mapInArrow(run, "value binary")
    # The text writer copies the bytes as they are and ends each record with the two empty lines of the format.
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option(
        "compression", "gzip").option("maxRecordsPerFile", file_records).text(folder)


def _inflated(data: bytes) -> bytes:
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out) if out else data


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record of an archive, gzipped by record, as a whole or not at all."""
    data = _inflated(data)
    at = 0
    while at < len(data):
        end = data.find(_END, at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else []
        if not lines or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(fields["content-length"])
        if data[stop:stop + 4] != _END:
            raise ValueError(f"the record at byte {at} is not ended")
        yield fields, data[start:stop]
        at = stop + 4


def payload_of(block: bytes) -> bytes:
    """The decoded body of an HTTP response."""
    head, end, body = block.partition(_END)
    if not end:
        raise ValueError("no HTTP header")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return dechunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


_PARTS = ("record_id string, record_type string, page_id long, refers_to_id string, header_digest string, segment int, total_length long, "
          "block binary, payload_bytes long, payload_digest string, error string")


def _parts(files: DataFrame) -> DataFrame:
    """A row per record: whole responses decoded at once, segments with their blocks."""
    def row(fields: dict[str, str], block: bytes) -> dict:
        number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
        page = fields.get("x-page-id")
        out = dict.fromkeys(("block", "payload_bytes", "payload_digest", "error"))
        out |= {"record_id": fields.get("warc-segment-origin-id", fields.get("warc-record-id")), "record_type": fields.get("warc-type"),
                "page_id": None if page in (None, "None") else int(page), "refers_to_id": fields.get("warc-refers-to"),
                "header_digest": fields.get("warc-payload-digest"), "segment": int(number) if number else None, "total_length": int(total) if total else None}
        if number:
            out["block"] = block
        elif out["record_type"] == "response":
            out |= _decoded(block, out["header_digest"])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in records(content.as_py()):
                    rows.append(row(fields, block))
                    if len(rows) == 1024:
                        schema = schema or _arrow(_PARTS)
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    schema = schema or _arrow(_PARTS)
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("content").mapInArrow(run, _PARTS)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _decoded(block: bytes, header_digest: str | None) -> dict:
    try:
        payload = payload_of(block)
    except ValueError as broken:
        return {"payload_bytes": None, "payload_digest": None, "error": str(broken)}
    own = digest32(payload)
    wrong = header_digest is not None and header_digest.rpartition(":")[2] != own
    return {"payload_bytes": len(payload), "payload_digest": own, "error": "the payload's digest differs" if wrong else None}


def read_archives(files: DataFrame) -> DataFrame:
    """``record_id, page_id, record_type, payload_bytes, payload_digest, refers_to, error`` per response and revisit of ``files`` (``content``).

    Segments are grouped by origin, put in order and joined if they are numbered 1 to n and have the total length that the
    last one states; otherwise ``error`` says what is wrong and the payload columns are null. A revisit has the length of
    the response that it refers to (null if that is not in the files). Records that occur twice count once.
    """
    parts = _parts(files)
    # One group per record, so a group is as large as its block; whole records bring a row without a block.
    joined = parts.groupBy("record_id").agg(
        F.min_by(F.struct("record_type", "page_id", "refers_to_id", "header_digest"), F.coalesce("segment", F.lit(0))).alias("head"),
        F.array_sort(F.collect_set(F.when(F.col("segment").isNotNull(), F.struct("segment", "block")))).alias("segments"),
        F.max("total_length").alias("total_length"), F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"),
        F.max("error").alias("error"))

    @F.pandas_udf("payload_bytes long, payload_digest string, error string")
    def assembled(blocks: pd.Series, numbers: pd.Series, total: pd.Series, digest: pd.Series) -> pd.DataFrame:
        out = []
        for own, order, size, stated in zip(blocks, numbers, total, digest):
            if len(order) == 0:
                out.append({"payload_bytes": None, "payload_digest": None, "error": None})
                continue
            block = b"".join(own)
            problem = ("segments are missing or repeated" if list(order) != list(range(1, len(order) + 1))
                       else "no total length" if pd.isna(size) else "the total length differs" if size != len(block) else None)
            out.append({"payload_bytes": None, "payload_digest": None, "error": problem} if problem else _decoded(block, stated))
        return pd.DataFrame(out, columns=["payload_bytes", "payload_digest", "error"]).astype({"payload_bytes": "Int64"})

    got = joined.withColumn("own", assembled(F.col("segments.block"), F.col("segments.segment"), "total_length", "head.header_digest"))
    flat = got.select(
        "record_id", "head.page_id", "head.record_type", "head.refers_to_id", F.coalesce("payload_bytes", "own.payload_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "own.payload_digest", F.substring_index("head.header_digest", ":", -1)).alias("payload_digest"),
        F.coalesce("error", "own.error").alias("error"))
    responses = flat.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("target"), F.col("payload_bytes").alias("target_bytes"))
    revisits = flat.filter("record_type = 'revisit'").join(responses, "refers_to_id", "left").select(
        "record_id", "page_id", "record_type", F.col("target_bytes").alias("payload_bytes"), "payload_digest", F.col("target").alias("refers_to"), "error")
    plain = flat.filter("record_type in ('response', 'continuation')").select(
        "record_id", "page_id", "record_type", "payload_bytes", F.when(F.col("error").isNull(), F.col("payload_digest")).alias("payload_digest"),
        F.lit(None).cast("long").alias("refers_to"), "error")
    return plain.unionByName(revisits)


def round_trip(pages: DataFrame, **settings: int) -> DataFrame:
    """The pages written as archives in a new folder of the shared checkpoint folder and read back: see the two functions above."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/archives/{uuid.uuid4().hex}"
    write_archives(pages, folder, **settings)
    return read_archives(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))
