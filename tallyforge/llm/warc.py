"""Operator 8, WARC: archives of pages with a two-level capture index, and reads through that index.

* ``write_archives``: each task writes its pages, in the order it reads them, as gzip members of WARC files; payloads do not
  move. Of records with equal payloads the one with the largest page_id is a response, the others revisit it.
* ``build_index``: captures, range-partitioned and sorted by the head of their line (the reversed-host URL key, encoded as
  in the line, and the padded page_id), are packed into compressed blocks of lines. An index file is a run of blocks; a
  sparse directory (first key and place of each block) lies beside it. Both levels are files; only one first key for each
  index file is held in memory.
* ``locate``: sorted queries binary-search the index files, then the directory of a file, then the lines of a block, and
  give each capture's archive, offset and length. ``fetch`` sorts those by place, joins neighbours into larger range
  reads and parses the records.

Files are named by task attempt, and a table written by Spark's own commit protocol names those that count, so a task
that runs again after a lost executor leaves at worst a file that nobody reads. Paths may be of any store that
``pyarrow.fs`` opens by URI.

Edge cases: null html is an empty payload, and empty payloads are equal ones; a null URL is archived as that of its page;
a row without page_id is a response that nothing revisits; rows that repeat a page_id are records of their own; line ends
in URLs are percent-encoded; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import map_batches, materialize, scratch_dir

CAPTURES = "key string, page_id long, url string, payload_digest string, record_type string, file string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: Up to so many revisits (about 36 bytes each) they reach the writers by broadcast, beyond it by a shuffle of the pages.
BROADCAST_ROWS = 1_000_000


def url_key(url: F.Column) -> F.Column:
    """``com,example,www)/path?query``: lower-case host reversed, no scheme, user, port 80/443 or fragment."""
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/?#]*)([^#]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, parts, 1)), r":(80|443)?$", "")
    path = F.regexp_extract(url, parts, 2)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))
    return F.when(url.rlike(parts), key).otherwise(F.coalesce(url, F.lit("")))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def _attempt() -> str:
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return f"{ctx.partitionId():06d}-{ctx.taskAttemptId()}"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str) -> tuple[bytes, str, str]:
    """A WARC record, its payload digest and its type. A revisit keeps the HTTP head, which has the payload's length."""
    digest = base32(hashlib.sha1(payload).digest())
    kind = "response" if refers_to is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest, kind


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """The fields of RECORDS; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.decode().rpartition("Content-Length: ")[2].split("\r\n")[0])
    number = lambda urn: None if urn is None or urn.endswith(":None>") else int(urn[len("<urn:x-page:") : -1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return number(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To")), payload if fields["WARC-Type"] == "response" else None


def payload() -> F.Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to: pages whose payload a page with a larger id has; an id that is repeated with different
    payloads is told apart by the digest. Only digests are shuffled; groups of any size are reduced on the map side."""
    keys = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha1(payload())).alias("digest"), F.octet_length(payload()).alias("n"))
    keys = materialize(keys, "digests")
    groups = keys.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
    return keys.join(groups, ["digest", "n"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, root: str, date: str = "2000-01-01T00:00:00Z", most: int = 1 << 30, level: int = 4) -> DataFrame:
    """Write the archives below ``root`` and return their captures, a table in the shared folder: one record a row of pages."""
    seen = materialize(revisits(pages), "revisits")
    if seen.count() <= BROADCAST_ROWS:
        seen = F.broadcast(seen)
    url = F.coalesce(F.col("url"), F.concat(F.lit("urn:x-page:"), F.col("page_id").cast("string")), F.lit("urn:x-page:"))
    url = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), "html", F.unhex(F.sha1(payload())).alias("digest"))
    rows = rows.withColumn("key", url_key(F.col("url"))).join(seen, ["page_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        fs.create_dir(f"{base}/archive", recursive=True)
        out, name, at, files = None, "", 0, 0
        for batch in batches:
            made = []
            for page_id, target, html, key, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None or at >= most:
                    if out is not None:
                        out.close()
                    name, at, files = f"archive/{_attempt()}-{files}.warc.gz", 0, files + 1
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                raw, digest, kind = record(page_id, target, (html or "").encode(), refers_to, date)
                member = gzip.compress(raw, level, mtime=0)
                out.write(member)
                made.append((key, page_id, target, digest, kind, name, at, len(member)))
                at += len(member)
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            cols = zip(*made, strict=True) if made else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["key", "page_id", "url", "payload_digest", "record_type", "file", "offset", "length"])
        if out is not None:
            out.close()

    return materialize(rows.select("page_id", "url", "html", "key", "refers_to").transform(map_batches, run, CAPTURES), "captures")


def build_index(captures: DataFrame, root: str, lines: int = 512, per_file: int = 20_000, most_files: int = 10_000) -> list[tuple[str, str]]:
    """Write index files and directories; returns (first line key, file) in key order, at most about ``most_files``."""
    n = captures.count()
    parts = max(1, min(most_files, -(-n // per_file)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        fs.create_dir(f"{base}/index", recursive=True)
        name, out, at, block, places = f"index/{_attempt()}", None, 0, [], []

        def flush() -> None:
            nonlocal at
            body = zlib.compress("\n".join(block).encode(), 6)
            out.write(body)
            places.append([block[0].rpartition(" ")[0], at, len(body)])
            at += len(body)
            block.clear()

        for batch in batches:
            out = out or fs.open_output_stream(f"{base}/{name}.cdx", compression=None)
            for head, url, digest, kind, file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                rest = json.dumps([url, digest, kind, file, offset, length], separators=(",", ":"), ensure_ascii=True).replace(" ", "\\u0020")
                block.append(f"{head} {rest}")
                if len(block) == lines:
                    flush()
        if block:
            flush()
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{base}/{name}.dir", compression=None) as d:
                d.write(zlib.compress(json.dumps(places).encode(), 6))
            yield pa.RecordBatch.from_arrays([pa.array([places[0][0]]), pa.array([name])], ["first", "file"])

    # the order of the files is that of the lines: by their bytes, which Spark and Python's bisect agree on
    headed = captures.select(line_head(F.col("key"), F.col("page_id")).alias("head"), "url", "payload_digest", "record_type", "file", "offset", "length")
    ordered = headed.repartitionByRange(parts, "head").sortWithinPartitions("head")
    heads = materialize(ordered.transform(map_batches, run, "first string, file string"), "index_heads").collect()
    return sorted((r["first"], r["file"]) for r in heads)


def line_head(key: F.Column, page_id: F.Column) -> F.Column:
    """The sortable head of an index line: white space and control characters are encoded, numbers padded, null first."""
    clean = key = F.coalesce(key, F.lit(""))
    for c in range(33):
        clean = F.replace(clean, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    number = F.lpad((page_id.cast("decimal(20,0)") + F.lit(Decimal(1 << 63))).cast("decimal(20,0)").cast("string"), 20, "0")
    return F.concat(F.when(key.rlike(r"[\x00-\x20]"), clean).otherwise(key), F.lit(" "), F.coalesce(number, F.lit("-")))


class Reader:
    """Binary search over index files, directories and blocks; the last directory and block are kept."""

    def __init__(self, root: str, heads: list[tuple[str, str]]):
        self.fs, self.base = _open(root)
        self.firsts, self.files = [h[0] for h in heads], [h[1] for h in heads]
        self.directory: tuple[int, list[list]] = (-1, [])
        self.block: tuple[int, int, list[str]] = (-1, -1, [])

    def _places(self, file: int) -> list[list]:
        if self.directory[0] != file:
            with self.fs.open_input_file(f"{self.base}/{self.files[file]}.dir") as f:
                self.directory = (file, json.loads(zlib.decompress(f.read())))
        return self.directory[1]

    def _lines(self, file: int, at: int) -> list[str]:
        if self.block[:2] != (file, at):
            _, offset, length = self._places(file)[at]
            with self.fs.open_input_file(f"{self.base}/{self.files[file]}.cdx") as f:
                self.block = (file, at, zlib.decompress(f.read_at(length, offset)).decode().split("\n"))
        return self.block[2]

    def find(self, head: str) -> Iterator[list]:
        """Captures whose line begins with ``head`` (it ends in a space), over as many blocks and files as they fill."""
        begin = head[:-1]  # blocks and files that begin with the wanted head itself come after the one to start in
        file = max(0, bisect.bisect_left(self.firsts, begin) - 1)
        while file < len(self.files):
            places = self._places(file)
            at = max(0, bisect.bisect_left(places, begin, key=lambda p: p[0]) - 1)
            while at < len(places):
                lines = self._lines(file, at)
                i = bisect.bisect_left(lines, head)
                while i < len(lines) and lines[i].startswith(head):
                    yield json.loads(lines[i].rpartition(" ")[2])
                    i += 1
                if i < len(lines):
                    return
                at += 1
            file += 1


def locate(queries: DataFrame, root: str, heads: list[tuple[str, str]], per_task: int = 20_000) -> DataFrame:
    """url, file, offset, length, record_type of every capture of each (key, page_id) query; a null page_id asks for all
    of its URL key."""
    number = F.col("page_id").cast("long")
    head = line_head(F.col("key"), number)
    # without a number the wanted head ends after the key
    whole = F.when(number.isNull(), F.substring(head, F.lit(1), F.length(head) - 1)).otherwise(F.concat(head, F.lit(" ")))
    wanted = queries.select(whole.alias("head")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(root, heads)
        for batch in batches:
            found = []
            for head in batch.column(0).to_pylist():
                found += reader.find(head)
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            cols = zip(*found, strict=True) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["url", "payload_digest", "record_type", "file", "offset", "length"])

    parts = max(1, -(-queries.count() // per_task))
    spread = wanted.repartitionByRange(parts, "head").sortWithinPartitions("head")
    return spread.transform(map_batches, run, "url string, payload_digest string, record_type string, file string, offset long, length long")


def fetch(places: DataFrame, root: str, most: int = 4 << 20, gap: int = 64 << 10, per_task: int = 16 << 20) -> DataFrame:
    """RECORDS of the given archive places. Places near each other are read at once, up to ``most`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def read(group: list[tuple[str, int, int]]) -> pa.RecordBatch:
            start, end = group[0][1], max(o + n for _, o, n in group)
            with fs.open_input_file(f"{base}/{group[0][0]}") as f:
                raw = f.read_at(end - start, start)
            rows = [parse(gzip.decompress(raw[o - start : o - start + n])) for _, o, n in group]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

        group: list[tuple[str, int, int]] = []
        for batch in batches:
            for place in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if group and (place[0] != group[0][0] or place[1] > group[-1][1] + group[-1][2] + gap or place[1] + place[2] - group[0][1] > most):
                    yield read(group)
                    group = []
                group.append(place)
        if group:
            yield read(group)

    parts = max(1, -(-int(places.agg(F.sum("length")).first()[0] or 0) // per_task))
    near = places.select("file", "offset", "length").distinct().repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return near.transform(map_batches, run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages, index them, look every page up in the index and read its record back."""
    root = scratch_dir(pages.sparkSession)
    captures = write_archives(pages, root)
    heads = build_index(captures, root)
    places = materialize(locate(captures.select("key", "page_id"), root, heads).select("file", "offset", "length").distinct(), "places")
    if (found := places.count()) != (archived := captures.count()):
        raise RuntimeError(f"the index leads to {found} of {archived} captures")
    return fetch(places, root)
