"""WARC archives: payload revisits, a monolithic-gzip normaliser and a sidecar offset index."""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenstep.llm.common import one_each, open_shared, small_batches, work_path, written

LEAST_REVISIT = 1000
#: Groups of equal payloads (40 bytes each) up to which they are broadcast, and the bits of the map of more (16 MB).
MOST_GROUPS, MAP_BITS = 100_000, 1 << 27
STEP = 1 << 20


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """One uncompressed WARC/1.1 record."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page: int | None, url: str, payload: bytes, sha1: str, refers_to: int | None, revisits: bool) -> bytes:
    """A page's record; a revisit has the payload's length but not the payload."""
    one_line = "".join(c for c in url if c.isprintable() and not c.isspace())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {"WARC-Record-ID": f"<urn:page:{'' if page is None else page}>", "WARC-Target-URI": one_line, "WARC-Date": "2020-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha1:{sha1}", "Content-Type": "application/http; msgtype=response"}
    if not revisits:
        return record("response", headers, http + payload)
    headers["WARC-Refers-To"] = f"<urn:page:{'' if refers_to is None else refers_to}>"
    headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return record("revisit", headers, http)


class _Inflated(io.RawIOBase):
    """The bytes of a gzip file of one or many members, inflated once and in bounded steps."""

    def __init__(self, source: BinaryIO):
        self.source, self.machine, self.rest = source, zlib.decompressobj(31), b""

    def readable(self):
        return True

    def readinto(self, room):
        while True:
            if not self.rest:
                self.rest = self.source.read(STEP)
                if not self.rest:
                    if not self.machine.eof and self._begun:
                        raise ValueError("the gzip stream ends within a member")
                    return 0
            if self.machine.eof:
                self.machine, self._begun = zlib.decompressobj(31), False
            out = self.machine.decompress(self.rest, len(room))
            self._begun = True
            self.rest = self.machine.unused_data if self.machine.eof else self.machine.unconsumed_tail
            if out:
                room[: len(out)] = out
                return len(out)

    _begun = False


def read_record(stream: BinaryIO) -> tuple[dict[str, str], bytes, bytes] | None:
    """(headers, head, block) of the next record of an inflated stream; None at its end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    head, headers = [line], {}
    while True:
        line = stream.readline()
        head.append(line)
        if not line:
            raise ValueError("the stream ends within a record's headers")
        if line in (b"\r\n", b"\n"):
            break
        name, _, value = line.decode("utf-8", "replace").partition(":")
        headers[name.strip().lower()] = value.strip()
    want = int(headers["content-length"])
    block = stream.read(want)
    if len(block) != want:
        raise ValueError("the stream ends within a record's block")
    return headers, b"".join(head), block


def normalise(source: BinaryIO, target: BinaryIO, level: int = 6) -> list[dict]:
    """Rewrites a gzip WARC file, whatever its members, as one member per record; returns the index.

    The whole-file stream is inflated once, record by record, so memory holds one record. Index
    entries: offset and length of the member, id, type and target. An empty file gives none.
    """
    stream, index, offset = io.BufferedReader(_Inflated(source), STEP), [], 0
    while (found := read_record(stream)) is not None:
        headers, head, block = found
        machine = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = machine.compress(head + block + b"\r\n\r\n") + machine.flush()
        target.write(member)
        index.append({"offset": offset, "length": len(member), "id": headers.get("warc-record-id", ""), "type": headers.get("warc-type", ""), "target": headers.get("warc-target-uri", "")})
        offset += len(member)
    return index


def with_origins(rows: DataFrame, groups: DataFrame, most_groups: int = MOST_GROUPS, map_bits: int = MAP_BITS) -> DataFrame:
    """rows with `origin` of their group (groups: sha256, origin), null without one.

    Few groups are broadcast. Of many a map of hashed places is, by which rows that are certainly
    in no group stay where they are; only the others, copies nearly all, go through the join's shuffle.
    """
    if groups.count() <= most_groups:
        return rows.join(F.broadcast(groups), "sha256", "left")
    place = F.pmod(F.xxhash64("sha256"), F.lit(map_bits)) + 1
    bucket, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    maps = groups.select(bucket.alias("bucket"), bit.alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.call_function("div", F.col("bit"), F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("getbit", byte, F.pmod("bit", F.lit(8)).cast("int")) == 1, F.lit(False))
    marked = rows.withColumn("bucket", bucket).withColumn("bit", bit).join(F.broadcast(maps), "bucket", "left").withColumn("hit", hit)
    out = lambda df: df.select(*rows.columns, "origin")
    return out(marked.where("not hit").withColumn("origin", F.lit(None).cast("long"))).unionByName(out(marked.where("hit").join(groups, "sha256", "left")))


def write_archives(pages: DataFrame, least: int = LEAST_REVISIT, key: str = "page_id", url: str = "url", payload: str = "html", most_groups: int = MOST_GROUPS, map_bits: int = MAP_BITS) -> DataFrame:
    """Writes the pages as WARC files and normalises them; returns one row per file: file, index, records.

    Of rows with equal payloads of at least `least` bytes, the one with the largest key is the
    response and the others revisit it; shorter ones are all responses. A task streams its rows
    into one monolithic gzip file, rewrites that with a member per record and a JSON-lines index
    beside it, and removes the first. Null payloads are empty. Null keys are kept; they never
    are the largest, and a group of null keys alone has responses only. Rows repeated with the
    largest key are responses too. What lost attempts leave behind is not listed.
    """
    spark = pages.sparkSession
    folder = work_path(spark, "warc")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("html"))
    rows = rows.withColumn("sha256", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    long = rows.where(F.octet_length("html") >= least)
    groups = long.groupBy("sha256").agg(F.max("page_id").alias("origin"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("sha256", "origin")
    # a table, so that Spark can split the pages of a payload with very many copies
    groups = written(groups, "payload-groups")
    whole = with_origins(rows, groups, most_groups, map_bits).select("page_id", "url", "html", (F.col("origin").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("origin"))).alias("revisits"), "origin")

    def run(batches: Iterator[pa.RecordBatch]):
        filesystem, root = open_shared(folder)
        name, out, raw, n = uuid.uuid4().hex, None, None, 0
        for batch in small_batches(batches, "html"):
            if out is None:
                filesystem.create_dir(root, recursive=True)
                out, raw = filesystem.open_output_stream(f"{root}/{name}.whole"), zlib.compressobj(1, zlib.DEFLATED, 31)
            for page, link, html, revisits, origin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = html.encode("utf-8", "surrogatepass")
                out.write(raw.compress(page_record(page, link, data, hashlib.sha1(data).hexdigest(), origin, revisits)))
                n += 1
        if out is None:
            return
        out.write(raw.flush())
        out.close()
        with filesystem.open_input_stream(f"{root}/{name}.whole", compression=None) as source, filesystem.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as target:
            index = normalise(source, target)
        with filesystem.open_output_stream(f"{root}/{name}.index.jsonl", compression=None) as beside:
            for entry in index:
                beside.write(json.dumps(entry).encode() + b"\n")
        filesystem.delete_file(f"{root}/{name}.whole")
        if len(index) != n:
            raise AssertionError("the rewritten file has another number of records")
        yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}.warc.gz"], "index": [f"{folder}/{name}.index.jsonl"], "records": [n]}, pa.schema([("file", pa.string()), ("index", pa.string()), ("records", pa.int64())]))

    return written(whole.mapInArrow(run, "file string, index string, records long"), "warc-files")


def parse_page(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a member.

    A response's figures are taken from its payload and held against its headers; a revisit's
    come from its headers.
    """
    headers, _, block = read_record(io.BytesIO(zlib.decompress(member, 31)))
    number = lambda name: int(x) if (x := headers[name].removeprefix("<urn:page:").removesuffix(">")) else None
    head, _, data = block.partition(b"\r\n\r\n")
    length = int(head.rpartition(b"Content-Length: ")[2])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "revisit":
        return number("warc-record-id"), length, digest, "revisit", number("warc-refers-to")
    if len(data) != length or hashlib.sha1(data).hexdigest() != digest:
        raise ValueError("a payload differs from its headers")
    return number("warc-record-id"), length, digest, "response", None


def read_archives(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Reads the listed files by their indexes, member by member: one row per record."""

    def run(batches):
        for batch in batches:
            for file, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                filesystem, name = open_shared(file)
                with filesystem.open_input_stream(open_shared(index)[1], compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                with filesystem.open_input_file(name) as f:
                    for k in range(0, len(entries), 2000):
                        found = []
                        for e in entries[k : k + 2000]:
                            f.seek(e["offset"])
                            found.append(parse_page(f.read(e["length"])))
                        columns = list(zip(*found, strict=True))
                        yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.int64())], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # the list has a short row for each task that wrote
    todo = one_each(spark, [(r["file"], r["index"]) for r in files.select("file", "index").collect()], "file string, index string")
    return todo.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages
), g AS (
  SELECT h, max(page_id) AS origin FROM p WHERE n >= 1000 GROUP BY h
)
SELECT page_id, n AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN origin IS NULL OR origin = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN origin <> page_id THEN origin END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h AND p.n >= 1000
"""
