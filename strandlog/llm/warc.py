"""WARC archives, index first.

Writing: each task writes its rows as gzip members of one archive in the shared folder and returns, for each record,
archive, offset, length, URL and digest; these rows are the index, a table of its own. An archive's name is unique to
the attempt that wrote it, so a lost executor's half-written file is never referred to.

Reading: selected index rows are dealt by archive and stripe, sorted by offset, and neighbouring records are fetched in
one byte-range read; every response's digest is verified against its payload.

Of records with equal payloads of at least ``REVISIT_FROM`` bytes, those with the largest page_id are responses, the
others revisits that refer to it. Payloads that occur once need no lookup; the repeated ones are joined as a broadcast
up to ``BROADCAST_ROWS`` of them and by a salted shuffle beyond, so that one payload with a third of all rows spreads.

Edge cases: null html is an empty payload; a null page_id is written as such, and gives way to any other id; repeated
rows with the largest page_id are all responses; line breaks in a URL are percent-encoded and a null URL is empty; an
empty table has an empty index; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import cut, new_folder, shuffle_partitions, table

REVISIT_FROM = 1000
BROADCAST_ROWS = 100_000
SALTS = 32
#: Records closer than GAP are read together, up to STRIPE bytes at once.
STRIPE, GAP = 8 << 20, 64 << 10
DATE = "2024-01-01T00:00:00Z"
_INDEX = (
    "archive string, offset long, length long, url string, payload_digest string, record_type string, page_id long"
)
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _from_urn(urn: str) -> int | None:
    number = urn[len("<urn:page:") : -1]
    return int(number) if number else None


def encode(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, as a gzip member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    base32 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Date: {DATE}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Payload-Digest: sha1:{base32}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [
            f"WARC-Refers-To: {_urn(refers_to)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def decode(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a gzip member."""
    record = zlib.decompress(member, 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages as archives below ``folder``; returns the index, from a table in the shared folder."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    repeated = cut(
        rows.filter(F.col("n") >= REVISIT_FROM)
        .groupBy("digest", "n")
        .agg(F.max("page_id").alias("last"), F.count("*").alias("times"))
        .filter("times > 1")
        .select(F.col("digest").alias("d2"), F.col("n").alias("n2"), "last"),
        "payloads",
    )
    if repeated.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(repeated), (rows["digest"] == repeated["d2"]) & (rows["n"] == repeated["n2"]), "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        spread = repeated.withColumn("s2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on = (salted["digest"] == spread["d2"]) & (salted["n"] == spread["n2"]) & (salted["salt"] == spread["s2"])
        joined = salted.join(spread, on, "left")
    decided = joined.select(
        "page_id", "url", "payload", "digest", "last",
        (F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))).alias("revisit"),
    )

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _place(folder)
        out, at, name = None, 0, f"pages-{uuid.uuid4().hex}.warc.gz"
        try:
            for batch in batches:
                if out is None:
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(f"{base}/{name}", compression=None)  # members are compressed already
                index = []
                for r in batch.to_pylist():
                    member = encode(r["page_id"], r["url"], r["payload"], r["digest"], r["last"], r["revisit"])
                    out.write(member)
                    kind = "revisit" if r["revisit"] else "response"
                    index.append((name, at, len(member), r["url"], r["digest"], kind, r["page_id"]))
                    at += len(member)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
                columns = zip(*index, strict=True) if index else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                    names=[x.split()[0] for x in _INDEX.split(", ")],
                )
        finally:
            if out is not None:
                out.close()

    index = cut(decided.mapInArrow(archive, _INDEX), "warc-index")
    return index


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records of the index rows given, by coalesced byte-range reads."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _place(folder)
        for batch in batches:
            runs: list[tuple[str, list[tuple[int, int]]]] = []
            for name, at, n in zip(*(batch.column(k).to_pylist() for k in ("archive", "offset", "length")), strict=True):
                last = runs[-1] if runs else None
                end = last[1][-1][0] + last[1][-1][1] if last else 0
                near = last and last[0] == name and 0 <= at - end <= GAP and at + n - last[1][0][0] <= STRIPE
                if near:
                    last[1].append((at, n))
                else:
                    runs.append((name, [(at, n)]))
            found = []
            for name, parts in runs:
                first, end = parts[0][0], parts[-1][0] + parts[-1][1]
                with files.open_input_file(f"{base}/{name}") as f:
                    data = f.read_at(end - first, first)
                for at, n in parts:
                    fields, http, payload = decode(data[at - first : at - first + n])
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    kind = fields["WARC-Type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{name} at {at}: the payload doesn't have its digest")
                    refers = _from_urn(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    page = _from_urn(fields["WARC-Record-ID"])
                    found.append((page, int(http["Content-Length"]), digest, kind, refers))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = zip(*found, strict=True) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                names=[x.split()[0] for x in _RECORD.split(", ")],
            )

    stripe = F.floor(F.col("offset") / STRIPE)
    dealt = index.select("archive", "offset", "length").repartition(
        shuffle_partitions(index.sparkSession), "archive", stripe
    )
    return dealt.sortWithinPartitions("archive", "offset").mapInArrow(fetch, _RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    index = write(table(spark, sf_dir, "pages"), folder)
    return read(index, folder)


QUERY = {"op4_warc_index_first": query}
ORACLE = {
    "op4_warc_index_first": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
           FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to FROM m"""
}
