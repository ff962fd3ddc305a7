"""WARC archives: a deterministic sharded writer, and its reader.

Records are dealt to shards by ranges of page_id whose bounds follow from exact byte counts, sorted
there, and written to files that roll at a compressed size.  Files carry temporary names until the
manifest of the finished tasks is safe; only files that it lists get their final names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.staging import bound_batches, cut, fresh_path
from folioforge.sources.files import table

_NAMESPACE = uuid.UUID("6f2b8b0e-4a8e-5f0e-9d3c-0c6d1f1b7a52")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Layout:
    """Sizes of the archive; dates are a parameter so that a rewrite gives the same bytes."""

    shard_bytes: int = 64 << 20
    file_bytes: int = 32 << 20
    revisit_bytes: int = 1000
    date: str = "2020-01-01T00:00:00Z"
    level: int = 6


def _member(data: bytes, level: int) -> bytes:
    """One gzip member without a time or name: equal bytes give equal members."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _uri(url: str | None) -> str:
    """A target URI without white space or control characters; the reader undoes the escapes."""
    return quote(url or "", safe="!#$&'()*+,/:;=?@[]~-._")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, layout: Layout) -> bytes:
    """A response, or a revisit if `refers_to` names the page that holds the payload; headers and digests made anew."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = _sha1(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {layout.date}", f"WARC-Target-URI: {_uri(url)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        lines.insert(3, f"X-Page: {page_id}")
    if url is None:
        lines.append("X-Target-URI: none")
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def info_record(name: str, layout: Layout) -> bytes:
    body = f"software: folioforge\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>", f"WARC-Date: {layout.date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join([*head, "", ""]).encode() + body + b"\r\n\r\n"


_MANIFEST = "temporary string, final string, records long, bytes long, sha1 string"
_MANIFEST_NAMES = ["temporary", "final", "records", "bytes", "sha1"]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if re.match(r"[a-z][a-z0-9+.-]*:", folder) else f"file://{folder}")


class _File:
    """A file under its temporary name; the first record names the final one."""

    def __init__(self, folder: str, attempt: str, final: str, layout: Layout):
        self.store, root = _open(folder)
        self.temporary, self.final = f"_temporary/{attempt}/{final}.{uuid.uuid4().hex}", final
        self.store.create_dir(f"{root}/_temporary/{attempt}", recursive=True)
        self.out = self.store.open_output_stream(f"{root}/{self.temporary}", compression=None)
        self.sha, self.size, self.records, self.level = hashlib.sha1(usedforsecurity=False), 0, 0, layout.level
        self.add(info_record(final, layout))

    def add(self, record: bytes) -> None:
        member = _member(record, self.level)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        return self.temporary, self.final, self.records, self.size, self.sha.hexdigest()


def _write(folder: str, attempt: str, layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        file, now, roll, refers = None, None, 0, {}
        page = object()
        for batch in batches:
            for shard, page_id, kind, refers_to, digest, url, html in zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "kind", "refers_to", "digest", "url", "html")), strict=True):
                if shard != now or (file and kind and file.size >= layout.file_bytes):
                    if file:
                        done.append(file.close())
                    roll = roll + 1 if shard == now else 0
                    now, file = shard, _File(folder, attempt, f"part-{shard:06d}-{roll:05d}.warc.gz", layout)
                if page_id != page:
                    page, refers = page_id, {}
                if kind:
                    payload = (html or "").encode()
                    file.add(build_record(page_id, url, payload, refers.get(hashlib.sha1(payload, usedforsecurity=False).hexdigest()) if refers else None, layout))
                else:
                    refers[digest] = refers_to
        if file:
            done.append(file.close())
        columns = list(zip(*done, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], _MANIFEST_NAMES)

    return run


def _commit(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for temporary, final in zip(batch.column("temporary").to_pylist(), batch.column("final").to_pylist(), strict=True):
                if store.get_file_info(f"{root}/{temporary}").type == fs.FileType.File:  # else an earlier attempt moved it
                    store.move(f"{root}/{temporary}", f"{root}/{final}")
            yield batch

    return run


def _shard_bounds(sized: DataFrame, layout: Layout, buckets: int = 4096) -> list[tuple[int, int]]:
    """First (page_id, salt) of the shards after the first, from exact byte sums over equal slices of the ids.

    Slices are powers of two wide, so no difference of ids is ever formed.  A slice that is too large for
    a shard is sliced again, and an id that is too large by the salt of its rows, so clustered ids and
    rows that share one are split as well; at most `buckets` sums a round come to the driver.
    """
    low, high, total = sized.agg(F.min("page_id"), F.max("page_id"), F.sum("size")).first()
    cuts: list[tuple[int, int]] = []
    todo = [(low, high)] if low is not None and (total or 0) > layout.shard_bytes else []
    while todo:
        low, high = todo.pop()
        shift = 0
        while (high >> shift) - (low >> shift) >= buckets:
            shift += 1
        by_salt = low == high
        cell = F.col("salt") if by_salt else F.shiftright("page_id", shift)
        sums = sized.where(F.col("page_id").between(low, high)).groupBy(cell.cast("long").alias("cell")).agg(F.sum("size").alias("size")).orderBy("cell").collect()
        held = 0
        for row in sums:
            first = (low, row["cell"]) if by_salt else (max(low, row["cell"] << shift), 0)
            if held and held + row["size"] > layout.shard_bytes:
                cuts.append(first)
                held = 0
            held += row["size"]
            if row["size"] > layout.shard_bytes and not by_salt:
                todo.append((first[0], min(((row["cell"] + 1) << shift) - 1, high)))
    return sorted(set(cuts))


#: Salts that rows of one page_id are told apart by.
SALTS = 1024


def write_warc(pages: DataFrame, folder: str, layout: Layout = Layout()) -> DataFrame:
    """Write `pages` (`page_id`, `url`, `html`) to WARC files in `folder`; returns the manifest, one row a file.

    Of rows with equal payloads (html in UTF-8; null is empty) of at least `layout.revisit_bytes`, that
    with the largest page_id is a response and the others are revisits of it; smaller ones are all
    responses.  Rows that share the largest page_id are all responses; a null page_id counts as the
    least and is a response.  Ids may be any longs; a null url is marked and read as null again.  An
    empty table gives no files; other columns are dropped.  A payload of any length is one record, so
    memory follows the longest one.  The same rows give the same files, whatever their order and
    partitions, and a repeated task writes other temporary names, which go with the commit.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    salt = F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)).cast("int")
    frame = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", salt.alias("salt"))
    sized = frame.select("page_id", "salt", F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"), F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    sized = cut(sized)
    bounds = _shard_bounds(sized.select("page_id", "salt", (F.col("size") + 400).alias("size")), layout)
    large = sized.where(f"size >= {layout.revisit_bytes} AND page_id IS NOT NULL")
    last = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").select("digest", "refers_to")
    marks = large.join(last, "digest").where("page_id < refers_to").select("page_id", "salt", "refers_to", "digest").distinct()
    nothing = F.lit(None).cast("string")
    events = frame.select("page_id", "salt", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), nothing.alias("digest"), "url", "html").unionByName(
        marks.select("page_id", "salt", F.lit(0).alias("kind"), "refers_to", "digest", nothing.alias("url"), nothing.alias("html"))
    )
    dealt = events.mapInArrow(_to_shards(bounds), f"{_EVENT}, shard int")
    ordered = dealt.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "salt", "kind", "url", "html")
    attempt = uuid.uuid4().hex
    manifest = cut(ordered.mapInArrow(_write(folder, attempt, layout), _MANIFEST))
    files = manifest.count()
    cut(manifest.repartition(-(-files // _MOVES) or 1, "final").mapInArrow(_commit(folder), _MANIFEST))
    manifest.drop("temporary").coalesce(1).write.mode("overwrite").json(f"{folder.rstrip('/')}/_manifest")
    store, root = _open(folder)
    if store.get_file_info(f"{root}/_temporary/{attempt}").type == fs.FileType.Directory:
        store.delete_dir(f"{root}/_temporary/{attempt}")
    return spark.read.schema("final string, records long, bytes long, sha1 string").json(f"{folder.rstrip('/')}/_manifest")


#: Files that a task of the commit moves.
_MOVES = 64
_EVENT = "page_id long, salt int, kind int, refers_to long, digest string, url string, html string"


def _to_shards(bounds: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, salts = batch.column("page_id").to_pylist(), batch.column("salt").to_pylist()
            shard = [0 if i is None else bisect_right(bounds, (i, s)) for i, s in zip(ids, salts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], [*batch.schema.names, "shard"])

    return run


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        yield headers, block


_READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, sound boolean"
_READ_KINDS = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_())
_READ_NAMES = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "sound"]
_length = re.compile(rb"\r\nContent-Length: (\d+)\r\n")


def _read(folder: str, payloads: bool):
    from urllib.parse import unquote

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        rows: list[tuple] = []
        size = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _READ_KINDS, strict=True)], _READ_NAMES)

        for batch in batches:
            for final in batch.column("final").to_pylist():
                with store.open_input_stream(f"{root}/{final}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in read_records(stream):
                        if head["warc-type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        number = int(_length.search(http + b"\r\n")[1])
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        whole = head["warc-type"] == "revisit" or len(payload) == number and hashlib.sha1(payload, usedforsecurity=False).hexdigest() == digest
                        sound = whole and _sha1(block) == head["warc-block-digest"]
                        page, refers = head.get("x-page"), head.get("x-refers-to-page")
                        rows.append((page and int(page), None if "x-target-uri" in head else unquote(head["warc-target-uri"]), head["warc-type"], refers and int(refers), number, digest, payload if payloads else None, sound))
                        size += len(payload) * payloads + 200
                        if size > 8 << 20:
                            yield full()
                            rows, size = [], 0
        if rows:
            yield full()

    return run


#: Compressed bytes that a task reads, where there are more than cores.
READ_BYTES = 128 << 20


def read_warc(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the files that a manifest lists, streamed file by file: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest (bare hex SHA-1), payload (null without `payloads`; empty in revisits)
    and sound (lengths and digests agree; see `check_revisits`).  Files without a place in the manifest are not read.

    Files are dealt one by one to as many tasks as their bytes ask for, and at least one a core.
    """
    spark = manifest.sparkSession
    files, size = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(files, max(spark.sparkContext.defaultParallelism, -(-size // READ_BYTES))))
    numbered = manifest.select("final").coalesce(1).withColumn("at", (F.monotonically_increasing_id() % tasks).cast("int"))
    return numbered.repartitionById(tasks, F.col("at")).select("final").mapInArrow(_read(folder, payloads), _READ)


def check_revisits(records: DataFrame) -> DataFrame:
    """Records without their payloads; a revisit is sound only if the page it refers to has a sound response of its digest and length."""
    records = cut(records.drop("payload"))
    responses = records.where("record_type = 'response' AND sound").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes", F.lit(True).alias("found")).distinct()
    # Spark takes the records for as small as the manifest that names their files, and would broadcast them.
    revisits = records.where("record_type = 'revisit'").hint("merge").join(responses.hint("merge"), ["refers_to", "payload_digest", "payload_bytes"], "left")
    revisits = revisits.withColumn("sound", F.col("sound") & F.coalesce("found", F.lit(False))).select(*records.columns)
    return records.where("record_type <> 'revisit'").unionByName(revisits)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    manifest = write_warc(table(spark, f"{sf_dir}/pages.parquet"), folder)
    records = check_revisits(read_warc(manifest, folder, payloads=False))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound")


SQL = """
WITH sized AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
last AS (SELECT payload_digest, max(page_id) AS last_id FROM sized WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, s.payload_digest, CASE WHEN page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last_id THEN last_id END AS refers_to, true AS sound
FROM sized s LEFT JOIN last l ON s.payload_digest = l.payload_digest AND payload_bytes >= 1000
"""
