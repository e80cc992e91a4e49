"""WARC archives with a two-level capture index.

``write_archives`` writes one record a page (ISO 28500, a gzip member each) into files in the shared folder. Of pages
with equal payloads of at least ``least_bytes`` the one with the smallest page_id is a response, the others are
revisits that refer to it. ``build_index`` sorts the captures by reversed-host key, packs them into compressed blocks,
and ends each index file with a sparse directory: the first key and place of each block. ``read_captures`` finds
captures by key: binary search among the index files, then in a file's directory, then in one decompressed block; then
it reads just the record's range, and for a revisit the range of the record that it refers to.

Files are named by task attempt and listed only by attempts that succeeded, so a lost task leaves nothing but an
unlisted file. Only the list of index files (one row each, at most a partition count) reaches the driver.

Defined results: null html is an empty payload; a null or unparsable url has a key of its own kind; a null page_id is
written as "-", sorts first and never wins over an id; rows that repeat page_id, url and payload are separate records,
and all that hold the smallest page_id of a payload are responses; an empty table gives no records; further columns are
ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.llm.common import fresh_path, keep, small_batches

LEAST_BYTES = 100
BLOCK_LINES = 1000
#: Captures that a reading task looks up: some tens of megabytes of pages.
CAPTURES_A_TASK = 4000
#: Repeated payloads (a digest, an id and a url each) that are broadcast at most; beyond, the join shuffles.
BROADCAST_ROWS = 20_000
DATE = "2024-01-01T00:00:00Z"
_LEVEL = 3
_FILE_BYTES = 1 << 30


def surt(url: str | None) -> str:
    """The url with its host reversed, for sorting: com,example,blog)/path?query. Fragments go; blanks are escaped."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        host, port, parts = "", None, None
    if not host:
        key = "-)" + text
    else:
        place = ",".join(reversed(host.removeprefix("www.").split(".")))
        key = place + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", key)


def capture_key(url: str | None, page_id: int | None) -> str:
    """Sorts by url key, then page_id."""
    return f"{surt(url)} {'-' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'-' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, date: str = DATE) -> bytes:
    """One WARC record. A revisit has the response's HTTP head and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    line = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date), ("WARC-Target-URI", line), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to)), ("WARC-Refers-To-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", refers_url or ""))]
    block = http + (payload if refers_to is None else b"")
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))]) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return fields, block.partition(b"\r\n\r\n")[2]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


class _Writer:
    """One open file of a task attempt; ``roll`` starts the next."""

    def __init__(self, folder: str, kind: str) -> None:
        from pyspark import TaskContext

        self.fs, self.folder = _filesystem(folder)
        self.fs.create_dir(self.folder, recursive=True)
        context = TaskContext.get()
        self.stem, self.kind, self.n, self.out = f"{context.partitionId():06d}-{context.taskAttemptId()}", kind, 0, None

    def roll(self) -> None:
        self.close()
        self.name, self.at = f"{self.stem}-{self.n:04d}.{self.kind}", 0
        self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        self.n += 1

    def put(self, data: bytes) -> int:
        self.out.write(data)
        at, self.at = self.at, self.at + len(data)
        return at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


_CAPTURES = "key string, page_id long, url string, file string, offset long, length long, digest string, record_type string, refers_to long, refers_url string"


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    writer = None
    names = [x.split()[0] for x in _CAPTURES.split(", ")]
    for batch in batches:
        rows = []
        for page_id, url, html, digest, first, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if writer is None or writer.at > _FILE_BYTES:
                writer = writer or _Writer(folder, "warc.gz")
                writer.roll()
            refers = None if first is None or first == page_id else first
            raw = gzip.compress(record(page_id, url, (html or "").encode(), digest, refers, first_url, date), _LEVEL, mtime=0)
            rows.append((capture_key(url, page_id), page_id, url, writer.name, writer.put(raw), len(raw), digest, "response" if refers is None else "revisit", refers, first_url if refers is not None else None))
        kinds = [pa.int64() if n in ("page_id", "offset", "length", "refers_to") else pa.string() for n in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names)
    if writer is not None:
        writer.close()


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES, date: str = DATE) -> tuple[str, DataFrame]:
    """Writes the archives; gives their folder and a row for each capture."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.sha2(payload, 256).alias("digest"))
    ids = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha2(payload, 256).alias("digest"), F.octet_length("html").alias("n"))
    # A row for each payload that occurs again: sent to all tasks if these are few, else joined by a shuffle.
    shared = keep(ids.filter((F.col("n") >= least_bytes) & F.col("digest").isNotNull()).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")), "warc-shared")
    few = shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(shared) if few else shared, "digest", "left").select("page_id", "url", "html", "digest", "first", "first_url")
    return folder, keep(joined.mapInArrow(lambda it: _write(it, folder, date), _CAPTURES), "warc-captures")


def _pack_index(batches: Iterator[pa.RecordBatch], folder: str, lines: int) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted lines, then the directory. Gives one row a file: first key and where its directory is."""
    writer, held, directory, total = None, [], [], 0

    def flush() -> None:
        raw = zlib.compress("\n".join(held).encode(), 6)
        directory.append(f"{held[0].split(chr(9), 1)[0]}\t{writer.put(raw)}\t{len(raw)}")
        held.clear()

    for batch in batches:
        for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if writer is None:
                writer = _Writer(folder, "index")
                writer.roll()
            held.append(f"{key}\t{file}\t{offset}\t{length}")
            total += 1
            if len(held) == lines:
                flush()
    if writer is not None:
        if held:
            flush()
        raw = zlib.compress("\n".join(directory).encode(), 6)
        at = writer.put(raw)
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (directory[0].split("\t")[0], writer.name, at, len(raw), total)], ["first_key", "file", "offset", "length", "captures"])


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, str, int, int, int]]:
    """The index files: (first key, file, where its directory begins, directory bytes, captures), sorted by key."""
    lines = captures.select("key", "file", "offset", "length").repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    made = keep(lines.mapInArrow(lambda it: _pack_index(it, folder, block_lines), "first_key string, file string, offset long, length long, captures long"), "warc-index")
    return sorted(tuple(r) for r in made.select("first_key", "file", "offset", "length", "captures").collect())


class Reader:
    """Looks captures up: index file, directory, block, record; each by binary search, then one range read."""

    def __init__(self, folder: str, shards: list[tuple[str, str, int, int, int]], handles: int = 32, blocks: int = 64) -> None:
        self.fs, self.folder = _filesystem(folder)
        self.shards, self.firsts = shards, [s[0] for s in shards]
        self.files: OrderedDict = OrderedDict()
        self.known: OrderedDict = OrderedDict()
        self.handles, self.blocks = handles, blocks

    def _range(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.files:
            self.files[name] = self.fs.open_input_file(f"{self.folder}/{name}")
            if len(self.files) > self.handles:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(name)
        return self.files[name].read_at(length, offset)

    def _lines(self, name: str, offset: int, length: int) -> tuple[list[str], list[list[str]]]:
        place = (name, offset)
        if place not in self.known:
            rows = [x.split("\t") for x in zlib.decompress(self._range(name, offset, length)).decode().split("\n")]
            self.known[place] = [r[0] for r in rows], rows
            if len(self.known) > self.blocks:
                self.known.popitem(last=False)
        self.known.move_to_end(place)
        return self.known[place]

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """File, offset and length of every capture with the key, wherever a run of equal keys begins and ends."""
        for _, shard, at, n, _ in self.shards[max(bisect_left(self.firsts, key) - 1, 0) : bisect_right(self.firsts, key)]:
            firsts, rows = self._lines(shard, at, n)
            for _, offset, length in rows[max(bisect_left(firsts, key) - 1, 0) : bisect_right(firsts, key)]:
                keys, lines = self._lines(shard, int(offset), int(length))
                for _, file, start, size in lines[bisect_left(keys, key) : bisect_right(keys, key)]:
                    yield file, int(start), int(size)

    def read(self, file: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        return parse(gzip.decompress(self._range(file, offset, length)))

    def close(self) -> None:
        for f in self.files.values():
            f.close()


_FOUND = "key string, page_id long, url string, record_type string, refers_to long, payload binary, declared_digest string"


def _page(urn: str | None) -> int | None:
    value = urn[10:-1] if urn else "-"
    return None if value == "-" else int(value)


def _lookup(batches: Iterator[pa.RecordBatch], folder: str, shards: list) -> Iterator[pa.RecordBatch]:
    reader, origin = Reader(folder, shards), OrderedDict()
    names = [x.split()[0] for x in _FOUND.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def full(fields: dict[str, str]) -> bytes:
        """The payload that a revisit refers to; the last few are remembered."""
        digest = fields["warc-payload-digest"]
        if digest not in origin:
            key = capture_key(fields["warc-refers-to-target-uri"], _page(fields["warc-refers-to"]))
            origin[digest] = next(p for f, p in (reader.read(*place) for place in reader.find(key)) if f["warc-payload-digest"] == digest and f["warc-type"] == "response")
            if len(origin) > 8:
                origin.popitem(last=False)
        origin.move_to_end(digest)
        return origin[digest]

    for batch in batches:
        rows, size = [], 0
        for key in batch.column(0).to_pylist():
            for place in reader.find(key):
                fields, payload = reader.read(*place)
                revisit = fields["warc-type"] == "revisit"
                payload = full(fields) if revisit else payload
                if hashlib.sha256(payload).hexdigest() != fields["warc-payload-digest"].removeprefix("sha256:"):
                    raise ValueError(f"a payload differs from its digest: {fields['warc-record-id']}")
                rows.append((key, _page(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], _page(fields.get("warc-refers-to")), payload, fields["warc-payload-digest"]))
                size += len(payload)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    reader.close()


def keys_of(pages: DataFrame) -> DataFrame:
    """The distinct capture keys of rows of page_id and url."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, i) for i, u in zip(ids, urls, strict=True)], pa.string())], ["key"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(run, "key string").distinct()


def read_captures(spark: SparkSession, folder: str, shards: list[tuple[str, str, int, int, int]], keys: DataFrame) -> DataFrame:
    """Every capture of the (distinct) keys, with its full payload. Keys are sorted first, so a task reads neighbours.

    Keys are small and records are not, so the number of tasks follows the captures.
    """
    tasks = max(1, -(-sum(s[4] for s in shards) // CAPTURES_A_TASK))
    sorted_keys = keys.select("key").repartitionByRange(tasks, "key").sortWithinPartitions("key")
    return sorted_keys.mapInArrow(lambda it: _lookup(it, folder, shards), _FOUND)
