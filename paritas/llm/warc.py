"""WARC archives: writing pages as records, and reading archives back with segmented records joined.

A record's block is an HTTP response in chunked transfer framing. Blocks above a limit are cut into
a first record and continuation records, which name the first one as their origin, their number and,
at the last, the total length. The reader parses archives file by file, brings the segments of one
origin together, checks numbers and lengths, and decodes the chunks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .common import counted_broadcast, text_or_empty

#: Equal payloads of at least this many bytes are stored once.
LEAST_REVISIT = 100
SEGMENT_BYTES, CHUNK_BYTES = 32_768, 8_192
RECORDS_PER_FILE = 5_000
CRLF = b"\r\n"
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

PLANNED = "record_id string, page_id long, url string, html string, digest string, refers_to string"
RECORD = ("record_id string, record_type string, page_id long, url string, declared_digest string, refers_to string, "
          "origin_id string, segment int, total_length long, block binary")
READ = "record_id string, record_type string, page_id long, url string, declared_digest string, refers_to string, payload binary, problem string"


def planned_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Each page with its record id, payload digest and, for a revisit, the record it refers to.

    Among equal payloads the smallest page_id (null last, then place in the input) is stored.
    Only digests that occur twice reach the join with the pages.
    """
    html = text_or_empty("html")
    keyed = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"),
        F.sha2(html, 256).alias("digest"))
    named = keyed.withColumn("record_id", F.concat_ws(":", F.lit("urn:page"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "row"))
    first = F.struct(F.col("page_id").isNull().alias("n"), "page_id", "row", "record_id")
    shared = cut_lineage(
        named.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min(first).alias("first"))
        .filter("n > 1").select(F.col("digest").alias("_digest"), F.col("first.record_id").alias("_first")))
    joined = named.join(counted_broadcast(shared), F.col("digest") == F.col("_digest"), "left")
    return joined.select("record_id", "page_id", "url", "html", "digest",
                         F.when(F.col("_first") != F.col("record_id"), F.col("_first")).alias("refers_to"))


def cuts(block: bytes, size: int) -> list[bytes]:
    """The block in pieces of at most ``size`` bytes, cut where no character is split."""
    pieces, at = [], 0
    while len(block) - at > size:
        to = at + size
        while block[to] & 0xC0 == 0x80:
            to -= 1
        pieces.append(block[at:to])
        at = to
    return [*pieces, block[at:]]


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [b"%x\r\n%b\r\n" % (len(piece), piece) for piece in cuts(payload, size) if piece]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        piece = body[end + 2:end + 2 + size]
        if len(piece) != size or body[end + 2 + size:end + 4 + size] != CRLF:
            raise ValueError("a chunk ends early")
        parts.append(piece)
        at = end + 4 + size


def header(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: {re.sub(r'[\x00-\x1f\x7f]', '', str(v))}" for k, v in fields if v is not None]
    return VERSION + CRLF + "\r\n".join(lines).encode() + CRLF + CRLF


def records_of(page: tuple, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page, without the two line ends that close a record."""
    record_id, page_id, url, html, digest, refers_to = page
    block = HTTP_HEAD if refers_to else HTTP_HEAD + chunked(html.encode())
    pieces = cuts(block, segment_bytes)
    for k, piece in enumerate(pieces, 1):
        fields: list[tuple[str, object]] = [("WARC-Type", "continuation" if k > 1 else "revisit" if refers_to else "response")]
        fields += [("WARC-Record-ID", f"<{record_id}>" if k == 1 else f"<{record_id}:{k}>"), ("WARC-Date", DATE)]
        if k == 1:
            fields += [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
            fields += [("X-Page-ID", None if pd.isna(page_id) else int(page_id))]
            fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)] if refers_to else []
        if len(pieces) > 1:
            fields += [("WARC-Segment-Number", k)]
            fields += [("WARC-Segment-Origin-ID", f"<{record_id}>")] if k > 1 else []
            fields += [("WARC-Segment-Total-Length", len(block))] if k == len(pieces) else []
        yield header([*fields, ("Content-Length", len(piece))]) + piece


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes one response or revisit record per page (with continuations) as gzip WARC files at path.

    Null html is an empty payload, a null url leaves its header out; repeated rows are records of
    their own, revisits of the first if their payload is long enough; an empty table writes no record.
    """
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [r.decode() for page in batch.itertuples(index=False, name=None) for r in records_of(page, segment_bytes)]
            yield pd.DataFrame({"value": lines})

    planned_records(pages).mapInPandas(build, "value string").write.option("lineSep", "\r\n\r\n").option(
        "compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def unpacked(content: bytes) -> bytes:
    """The content with all its gzip members inflated; plain content as it is."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content))
        content = member.unused_data
    return b"".join(parts)


def bare(value: str | None) -> str | None:
    return value.strip().strip("<>") if value else None


def parsed_records(content: bytes) -> Iterator[tuple]:
    """The records of one archive, with the fields of RECORD."""
    data, at = unpacked(content), 0
    while (at := data.find(VERSION[:5], at)) >= 0:
        end = data.index(CRLF + CRLF, at)
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        size = int(fields.get("content-length", 0))
        block = data[end + 4:end + 4 + size]
        segment, total, page = (fields.get(k) for k in ("warc-segment-number", "warc-segment-total-length", "x-page-id"))
        record = bare(fields.get("warc-record-id"))
        yield (record, fields.get("warc-type"), int(page) if page else None, fields.get("warc-target-uri"),
               (fields.get("warc-payload-digest") or "").rpartition(":")[2] or None, bare(fields.get("warc-refers-to")),
               bare(fields.get("warc-segment-origin-id")) or record, int(segment) if segment else None, int(total) if total else None, block)
        at = end + 4 + size


def payload_of(block: bytes) -> tuple[bytes | None, str | None]:
    """The payload of an HTTP response block, or what is wrong with it."""
    head, found, body = block.partition(CRLF + CRLF)
    if not found:
        return None, "no HTTP header"
    if not re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        return body, None
    try:
        return unchunked(body), None
    except ValueError as e:
        return None, f"broken chunks: {e}"


def frame(rows: list[tuple], columns: str) -> pd.DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    for c in columns.split(", "):
        name, kind = c.split()
        if kind in ("long", "int"):
            out[name] = out[name].astype("Int64" if kind == "long" else "Int32")
    return out


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives at path with their payloads; the columns of READ.

    Only the segments of cut records are shuffled, by their origin: a group is one record. A record
    with a missing or doubled segment, a wrong total length or broken chunks has a null payload and
    says so in ``problem``. Revisits carry no payload. An archive file is parsed as a whole, so its
    size bounds a task's memory.
    """
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                held: list[tuple] = []
                for record in parsed_records(content):
                    held.append(record)
                    if len(held) == 500:
                        yield frame(held, RECORD)
                        held = []
                if held:
                    yield frame(held, RECORD)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(None, None) if kind == "revisit" else payload_of(block) for kind, block in zip(batch["record_type"], batch["block"])]
            out = batch[["record_id", "record_type", "page_id", "url", "declared_digest", "refers_to"]].copy()
            out["payload"], out["problem"] = [p for p, _ in found], [e for _, e in found]
            yield out

    def join(segments: pd.DataFrame) -> pd.DataFrame:
        ordered = segments.sort_values("segment")
        first, block = ordered.iloc[0], b"".join(ordered["block"])
        totals = [int(x) for x in ordered["total_length"] if not pd.isna(x)]
        if list(ordered["segment"]) != list(range(1, len(ordered) + 1)) or first["record_id"] != first["origin_id"]:
            payload, problem = None, "segments are missing or doubled"
        elif totals != [len(block)]:
            payload, problem = None, f"total length {totals}, found {len(block)}"
        else:
            payload, problem = payload_of(block)
        row = first[["record_id", "record_type", "page_id", "url", "declared_digest", "refers_to"]].to_dict()
        return frame([(*[None if v is None or pd.isna(v) else v for v in row.values()], payload, problem)], READ)

    files = spark.read.format("binaryFile").load(path).select("content")
    records = cut_lineage(files.mapInPandas(parse, RECORD))
    whole = records.filter("segment IS NULL").mapInPandas(decode, READ)
    return whole.unionByName(records.filter("segment IS NOT NULL").groupBy("origin_id").applyInPandas(join, READ))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives of all pages into the shared folder, reads them back, and reports per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to (the page the revisit refers to).
    Sizes and digests are those of the payloads as read; a revisit has those of the record that it
    refers to, found by a join on its id.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    records = cut_lineage(read_archives(spark, path).select(
        "record_id", "record_type", "page_id", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest")))
    stored = records.filter("record_type = 'response'")
    target = stored.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("target"), "payload_bytes", "payload_digest")
    again = records.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(target, "refers_to", "left")
    return stored.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        again.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("target").alias("refers_to")))
