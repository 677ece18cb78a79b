"""WARC archives: one gzip member per record, written by tasks and read back from any byte range.

Writing: Spark's text writer puts the members one after the other (its committed files survive lost executors). Its line
end is the byte 0, with which nearly every member ends (the top byte of the length of less than 16 MB), so that byte is
left to it; a member that ends otherwise is followed by an empty member, which ends with 0.

Reading: Spark deals the files out by byte ranges. A task scans its range for the gzip magic (the text reader with the
magic as its delimiter), takes a piece for a member only if its header decodes and its data begin as a WARC record, and
owns the members that start inside its range. Pieces that begin with a magic inside compressed data are put back to
the member before them; where such a piece lies across the end of a range, head and tail are joined in a second step that
sees only these leftovers.

Names of archives must not end with the suffix of a codec (".gz"): Spark would unpack such files as a whole.

Cases: a null html is an empty payload; a null url is written as "urn:none"; line breaks in urls are escaped; null page ids are kept
and come last when the first of equal payloads is chosen; of rows with one page id and equal payloads one is response; an empty table
gives an empty archive, which reads as no records. Other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import shared_path

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
_EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31).flush()


def plan_records(pages: DataFrame, least_bytes: int = 0, salts: int = 16) -> DataFrame:
    """page_id, url, html, digest (hexadecimal SHA-1), refers_to: which rows are revisits, and of which page.

    The first page of each payload is a grouped minimum of narrow rows, combined before the shuffle. Only payloads that occur
    twice or more are joined back, each to ``salts`` copies, so a payload that a third of the pages share is dealt to many tasks.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id")
    first = rows.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    shared = first.where("n > 1").select(
        F.col("digest").alias("_digest"), "first.page_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_copy")
    ).withColumnRenamed("page_id", "first_id")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    joined = salted.join(shared, (F.col("digest") == F.col("_digest")) & (F.col("_salt") == F.col("_copy")), "left")
    again = F.col("_digest").isNotNull() & (F.octet_length("html") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", "html", "digest", F.when(again, F.col("first_id")).alias("refers_to"), F.coalesce(again, F.lit(False)).alias("revisit")
    )


def _name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, html: str, refers_to: int | None, revisit: bool) -> bytes:
    payload = html.encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else "urn:none"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_name(refers_to)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    return out if out.endswith(b"\0") else out + _EMPTY


def write(planned: DataFrame, path: str) -> None:
    """Writes the planned records as archives into the folder ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                rows = batch.slice(a, 64).to_pylist()
                made = [member(record(r["page_id"], r["url"], r["html"], r["refers_to"], r["revisit"]))[:-1] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])

    members = planned.select("page_id", "url", "html", "refers_to", "revisit").mapInArrow(run, "member binary")
    # a cast of bytes to text keeps them as they are
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def _starts(piece: bytes) -> bool:
    """Whether the bytes are a gzip member's header with the beginning of a WARC record."""
    if len(piece) < 10 or piece[3] & 0xE0:
        return False
    try:
        return zlib.decompressobj(31).decompress(piece[:4096], 64).startswith(b"WARC/")
    except zlib.error:
        return False


def _unpacked(data: bytes) -> bytes | None:
    """The contents of the first member of ``data``, or None if it does not end there."""
    unpacker = zlib.decompressobj(31)
    try:
        out = unpacker.decompress(data)
    except zlib.error:
        return None
    return out if unpacker.eof else None


def parse(data: bytes) -> dict:
    """One record's contents as a row; the digest is taken of the payload itself where it is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    length = len(payload)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if revisit:
        length = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda name: int(fields[name]) if fields.get(name, "") not in ("", "None") else None
    return {
        "page_id": number("X-Page-ID"),
        "url": fields.get("WARC-Target-URI"),
        "payload": None if revisit else payload,
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"),
    }


_PIECES = "file string, start long, place int, piece binary, record binary"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Complete records of a byte range, and as leftovers the pieces before its first member and its last member if that is open."""
    where: tuple[str, int] | None = None
    open_: list[bytes] = []
    heading, place = True, 0
    rows: list[dict] = []

    def close(done: bool):
        """Ends the member that is open: as a record, or as leftovers at the end of a range."""
        nonlocal place
        whole = _unpacked(b"".join(open_)) if open_ else None
        if whole is not None:
            rows.append({"file": None, "start": None, "place": None, "piece": None, "record": whole})
        elif open_ and done:
            place += 1
            rows.append({"file": where[0], "start": where[1], "place": place, "piece": b"".join(open_), "record": None})
        elif open_:
            raise ValueError(f"{where[0]}: a member does not end before the next one starts")
        open_.clear()

    for batch in batches:
        for file, start, piece in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "piece"))):
            if (file, start) != where:
                close(True)
                where, heading, place = (file, start), True, 0
            piece = MAGIC + piece
            if len(piece) == len(MAGIC) and heading and start == 0:
                continue  # what stands before the first magic of a file
            if _starts(piece):
                close(False)
                heading = False
                open_.append(piece)
            elif heading:
                place += 1
                rows.append({"file": file, "start": start, "place": place, "piece": piece, "record": None})
            else:
                open_.append(piece)  # a magic inside compressed data, or an empty member
            if len(rows) >= 256:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                rows.clear()
    close(True)
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


_SCHEMA = pa.schema(
    [("file", pa.string()), ("start", pa.int64()), ("place", pa.int32()), ("piece", pa.binary()), ("record", pa.binary())]
)
_ROWS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
)


def _join_leftovers(pieces: pa.Table) -> pa.Table:
    """Members that lie across ranges, from the leftovers of one file in their order."""
    rows = sorted(pieces.to_pylist(), key=lambda r: (r["start"], r["place"]))
    out, held = [], b""
    for r in rows:
        if _starts(r["piece"]):
            held = b""
        held += r["piece"]
        whole = _unpacked(held) if _starts(held) else None
        if whole is not None:
            out.append(parse(whole))
            held = b""
    return pa.Table.from_pylist(out, schema=_ROWS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in ``path``: columns of RECORD."""
    raw = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    pieces = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece")
    ).mapInArrow(_members, _PIECES)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([parse(x) for x in batch.column("record").to_pylist()], schema=_ROWS)

    whole = pieces.where("record is not null").select("record").mapInArrow(rows, RECORD)
    left = pieces.where("record is null").groupBy("file").applyInArrow(_join_leftovers, RECORD)
    return whole.unionByName(left)


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` into archives in the shared folder and reads them back."""
    path = shared_path(pages.sparkSession, "warc")
    write(plan_records(pages, least_bytes), path)
    return read(pages.sparkSession, path)
