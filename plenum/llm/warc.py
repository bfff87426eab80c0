"""WARC archives: a writer of one gzip member per record, and a splittable reader.

Writer: every record is a gzip member of its own, appended to the archive of
its task, `part-<task>-<attempt>.warc.gz`, in the shared folder. A task
reports its archive only when it has closed it, and only reported archives are
read, so the leftovers of a lost or repeated attempt are never taken for data.

Reader: every task gets a byte range of an archive. It scans the range for the
gzip magic, validates a candidate by decoding the start of the member and
asking for a WARC header, and owns the records that start inside the range;
the last of them may end beyond it. The bytes between a validated member's
start and end are skipped, so a magic inside compressed data is not tried
unless the range begins there, and then it fails the header check.

Nulls: a null payload is empty; a null page_id is written as an empty id and
read back as null; a null url is written without a target. Equal payloads of
`MIN_REVISIT` bytes or more become revisits of the one with the smallest id;
repeated ids with equal payload give a response each, and every record has an
id of its own. Payloads of any length are written and read whole. Records of
other writers are read with the fields that they have. An empty table gives no
archive and an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, scratch_path, table

MIN_REVISIT = 100
#: Bytes of an archive that one reading task owns.
SPLIT = 8 << 20
MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
RECORDS = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, target string, payload binary, archive string, at long"


def filesystem(uri: str):
    """(file system, path) of a URI or plain path."""
    import os

    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else fs.FileSystem.from_uri(f"file://{os.path.abspath(uri)}")


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest and refers_to: the smallest id of an equal payload, or null for a response."""
    rows = pick(pages, "page_id", "url", "html").select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    # only digests that occur twice, without payloads
    firsts = rows.filter(F.length("payload") >= MIN_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    got = rows.join(firsts, "payload_digest", "left")
    return got.select("page_id", "url", "payload", "payload_digest", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).alias("refers_to"))


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    revisit = refers_to is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}/{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows of with_revisits under folder; one row (archive, bytes, records) per archive."""
    def write(batches):
        from pyspark import TaskContext

        out = name = None
        size = n = 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "refers_to")), strict=True):
                if out is None:
                    files, path = filesystem(folder)
                    files.create_dir(path, recursive=True)
                    ctx = TaskContext.get()
                    name = f"part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}.warc.gz"
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                data = member(_record(*r))
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

    return rows.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(write, "archive string, bytes long, records long")


def _inflate(source, at: int, want_all: bool) -> tuple[bytes, int] | None:
    """The member at `at` and the offset after it; None if it is no gzip member that begins with a WARC header."""
    z, out, pos = zlib.decompressobj(31), [], at
    got = 0
    step = 1 << 12
    while not z.eof:
        chunk = source(pos, step)
        if not chunk:
            return None
        try:
            part = z.decompress(chunk)
        except zlib.error:
            return None
        pos += len(chunk)
        if got < 8 and part:
            head = (b"".join(out) + part)[:8]
            if not b"WARC/1.".startswith(head[:7]):
                return None
        out.append(part)
        got += len(part)
        step = min(step * 4, BLOCK)
    return b"".join(out), pos - len(z.unused_data)


def parse(data: bytes) -> dict:
    """The fields of a record; of records that this writer has not made, those that they have."""
    head, _, body = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    length = fields.get("content-length", "")
    body = body[: int(length)] if length.isdigit() else body

    def ident(name: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?[0-9]+)(?:/[0-9a-f-]+)?>", fields.get(name, ""))
        return int(found[1]) if found else None

    kind = fields.get("warc-type")
    payload = (body.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else body) if kind == "response" else None
    algorithm, _, digest = fields.get("warc-payload-digest", "").rpartition(":")
    size = fields.get("x-payload-length", "")
    return {
        "page_id": ident("warc-record-id"), "record_type": kind, "refers_to": ident("warc-refers-to"), "payload_digest": digest if algorithm.lower() in ("", "sha256") and digest else None,
        "payload_bytes": int(size) if size.isdigit() else None if payload is None else len(payload), "target": fields.get("warc-target-uri"), "payload": payload,
    }


def records_in(uri: str, start: int, end: int):
    """The records whose member starts in [start, end), each with its offset."""
    files, path = filesystem(uri)
    with files.open_input_file(path) as f:
        size = f.size()
        cache = [0, b""]

        def source(pos: int, n: int) -> bytes:
            base, block = cache
            if not base <= pos < base + len(block):
                f.seek(pos)
                cache[:] = pos, f.read(max(n, BLOCK))
                base, block = cache
            return block[pos - base : pos - base + n]

        pos = start
        while pos < min(end, size):
            block = source(pos, min(BLOCK, min(end, size) - pos) + len(MAGIC) - 1)
            hit = block.find(MAGIC)
            if hit < 0:
                pos += max(1, len(block) - len(MAGIC) + 1)
                continue
            at = pos + hit
            got = _inflate(source, at, True) if at < end else None
            if got is None:
                pos = at + 1
                continue
            yield at, got[0]
            pos = got[1]


def read_archives(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """RECORDS of all archives (columns archive, bytes), each byte range a row of work."""
    n = F.greatest(F.ceil(F.col("bytes") / split), F.lit(1))
    ranges = archives.select("archive", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("i")).select("archive", (F.col("i") * F.lit(split).cast("long")).alias("start"))
    count = max(1, ranges.count())

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for at, data in records_in(uri, start, start + split):
                    rows.append(parse(data) | {"archive": uri, "at": at})
                    held += len(data)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return ranges.repartition(min(count, 4096)).mapInArrow(read, RECORDS)


SCHEMA = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("target", pa.string()), ("payload", pa.binary()), ("archive", pa.string()), ("at", pa.int64())])


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    folder = scratch_path(spark, "warc")
    return read_archives(materialize(write_archives(with_revisits(pages), folder), "warc-list"))


def op2_warc(spark, sf_dir: str) -> DataFrame:
    got = round_trip(spark, table(spark, sf_dir, "pages"))
    # a response's figures come from the payload that was read back, a revisit's from its header
    full = F.col("record_type") == "response"
    return got.select(
        "page_id", F.when(full, F.length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )


SQL = f"""
with p as (select page_id, encode(coalesce(html, '')) as b, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first_id from p where octet_length(b) >= {MIN_REVISIT} group by d)
select page_id, cast(octet_length(b) as bigint) as payload_bytes, d as payload_digest,
 case when first_id is not null and page_id <> first_id then 'revisit' else 'response' end as record_type,
 case when page_id <> first_id then first_id end as refers_to
from p left join f using (d)
"""
