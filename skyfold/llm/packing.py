"""Hierarchical multi-length packing of tokenised documents.

Each document is tokenised whole and ends with an end id. What does not fill a window of the longest context goes to
the tier of its size; windows of a tier are opened by that tier's own pieces, their gaps are filled from the shorter
tiers (best fit, then by cutting), and full windows are dealt out to step groups of equal token counts. A task packs
what it reads: there is no shuffle, memory is bounded by ``round_tokens``, and a lost task is simply run again.

Defined results: null and empty texts are the end id alone; null or repeated doc_ids are packed as rows of their own;
an empty table gives no pieces; further columns of the input are ignored.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from skyfold.llm.common import small_batches, worker_store

TIERS = (2048, 1024, 512, 256)
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())])


class Encoder:
    """Ids of a byte-level BPE tokenizer file, as little-endian unsigned 32-bit integers.

    The file's pre-tokenizer never joins what stands on both sides of a space: a space goes with the letters, digits or
    marks after it. So the ids of a text are those of its space-separated parts, each with its space, and the parts'
    ids can be remembered. Where a part is empty or starts with white space, runs of white space would be cut apart:
    such texts are encoded whole. Added tokens of the file, wherever they stand, are their own ids and cut the text.
    """

    def __init__(self, path: str, most: int = 600_000) -> None:
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {x["content"] for x in model["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in special}
        self.whole = tiktoken.Encoding("from_file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.special = {x["content"]: array("I", [x["id"]]).tobytes() for x in model["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.parts: dict[str, bytes] = {}
        self.most = most

    def _text(self, text: str) -> bytes:
        return array("I", self.whole.encode_ordinary(text)).tobytes()

    def _part(self, part: str) -> bytes:
        if part.isalpha():
            ids = array("I", self.whole.encode_single_piece(b" " + part.encode())).tobytes()
        elif part[-1:] in (".", ",") and part[:-1].isalpha():
            ids = self.part(part[:-1]) + self._text(part[-1])
        elif not part or part[0].isspace():
            raise KeyError(part)
        else:
            ids = self._text(" " + part)
        self.parts[part] = ids
        return ids

    def part(self, part: str) -> bytes:
        return self.parts.get(part) or self._part(part)

    def encode(self, text: str) -> bytes:
        if self.split and self.split.search(text):
            return b"".join([self.special.get(x) or self._plain(x) for x in self.split.split(text) if x])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if len(self.parts) > self.most:
            self.parts.clear()
        head, space, rest = text.partition(" ")
        if not space:
            return self._text(text)
        known, words = self.parts, rest.split(" ")
        try:
            for w in words:
                if w not in known:
                    self._part(w)
            return self._text(head) + b"".join([known[w] for w in words])
        except KeyError:
            return self._text(text)


class Packer:
    """Packs pieces (row, start, ids) into windows; ``emit`` gets each window's tier and pieces."""

    def __init__(self, tiers: tuple[int, ...], emit) -> None:
        self.tiers, self.emit = tiers, emit
        self.pools: dict[int, list] = {t: [] for t in tiers}  # pieces by length, shortest first
        self.n = 0
        self.held = 0

    def tier_of(self, length: int) -> int:
        return min(t for t in self.tiers if t >= length)

    def put(self, row, start: int, ids: memoryview) -> None:
        n = len(ids) // 4
        self.n += 1
        self.held += n
        insort(self.pools[self.tier_of(n)], (n, self.n, row, start, ids))

    def add(self, row, ids: bytes) -> None:
        """A document: whole windows of the longest tier leave at once, the rest goes to a pool."""
        view, top, n = memoryview(ids), self.tiers[0], len(ids) // 4
        whole = n // top * top
        for s in range(0, whole, top):
            self.emit(top, [(row, s, view[4 * s : 4 * (s + top)])])
        if n > whole:
            self.put(row, whole, view[4 * whole :])

    def take(self, pool: list, at: int):
        n, _, row, start, ids = pool.pop(at)
        self.held -= n
        return n, row, start, ids

    def fill(self, gap: int, tiers: tuple[int, ...]) -> list | None:
        """Pieces of the tiers for a gap: the longest that fit, then the start of a longer one; None if they run out."""
        got = []
        while gap:
            for t in tiers:
                pool = self.pools[t]
                if at := bisect_right(pool, (gap, float("inf"))):
                    n, row, start, ids = self.take(pool, at - 1)
                    got.append((row, start, ids))
                    gap -= n
                    break
            else:
                t = next((t for t in reversed(tiers) if self.pools[t]), None)
                if t is None:
                    for x in got:
                        self.put(*x)
                    return None
                _, row, start, ids = self.take(self.pools[t], 0)
                got.append((row, start, ids[: 4 * gap]))
                self.put(row, start + gap, ids[4 * gap :])
                gap = 0
        return got

    def pack(self) -> None:
        """Windows of each tier, the longest first. Pieces that no window can be filled with stay for the next round."""
        for i, t in enumerate(self.tiers):
            shorter = self.tiers[i + 1 :]
            while self.pools[t]:
                n, row, start, ids = self.take(self.pools[t], -1)
                rest = self.fill(t - n, shorter or (t,))
                if rest is None:
                    self.put(row, start, ids)
                    break
                self.emit(t, [(row, start, ids), *rest])

    def finish(self) -> None:
        """What is left joins end to end: windows of the longest tier, then of each shorter one, then a partial one."""
        self.pack()
        rest = sorted((x for pool in self.pools.values() for x in pool), reverse=True)
        total = sum(x[0] for x in rest)
        sizes = []
        for t in self.tiers:
            sizes += [t] * (total // t)
            total %= t
        sizes += [total] * (total > 0)
        rest.reverse()
        for size in sizes:
            window, room = [], size
            while room:
                n, i, row, start, ids = rest.pop()
                window.append((row, start, ids[: 4 * room]))
                if n > room:
                    rest.append((n - room, i, row, start + room, ids[4 * room :]))
                room -= min(n, room)
            self.emit(self.tier_of(size) if size in self.tiers else self.tiers[0], window)
        self.pools = {t: [] for t in self.tiers}


class Groups:
    """Deals full windows to step groups of ``budget`` tokens, so that each has its share of every tier."""

    def __init__(self, tiers: tuple[int, ...], budget: int) -> None:
        self.tiers, self.budget = tiers, budget
        self.room: list[int] = [budget]
        self.first = 0

    def of(self, windows: list[int]) -> list[int]:
        """The group of each window of a round (given by size): long ones first, to the groups with most room."""
        import heapq

        total = sum(windows)
        while sum(self.room) < total:
            self.room.append(self.budget)
        heap = [(-r, i) for i, r in enumerate(self.room)]
        heapq.heapify(heap)
        out = [0] * len(windows)
        for w in sorted(range(len(windows)), key=lambda k: -windows[k]):
            r, i = heapq.heappop(heap)
            out[w] = self.first + i
            heapq.heappush(heap, (r + windows[w], i))
        room = dict((i, -r) for r, i in heap)
        left = [i for i in sorted(room) if room[i] >= self.tiers[-1]]
        base = min(left, default=len(self.room))
        self.room = [max(room[i], 0) for i in range(base, len(self.room))] or [self.budget]
        self.first += base
        return out


def _packed(batches: Iterator[pa.RecordBatch], path: str, tiers, end_id: int, group_tokens: int, round_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    store = worker_store("packing")
    if path not in store:
        store[path] = Encoder(path)
    encode, end = store[path].encode, array("I", [end_id]).tobytes()
    if array("I", [1]).tobytes() != b"\x01\x00\x00\x00":
        raise RuntimeError("ids are written as little-endian 32-bit integers")
    base = TaskContext.get().partitionId() << 33
    windows: list[tuple[int, list]] = []
    groups, made = Groups(tiers, group_tokens), 0
    packer = Packer(tiers, lambda t, pieces: windows.append((t, pieces)))

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal made
        of = groups.of([t for t, _ in windows])
        rows: list[tuple] = []
        size = 0
        for (t, pieces), g in zip(windows, of, strict=True):
            offset = 0
            for (doc_id, doc_tokens), start, ids in pieces:
                n = len(ids) // 4
                rows.append((doc_id, start, n, bytes(ids), doc_tokens, base + made, offset, t, base + g))
                offset += n
                size += len(ids)
            made += 1
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
        windows.clear()

    fresh = 0
    for batch in batches:
        ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
        for k, doc_id in enumerate(ids_of):
            ids = encode(texts[k].as_py() or "") + end
            packer.add((doc_id, len(ids) // 4), ids)
            fresh += len(ids) // 4
            if fresh >= round_tokens:
                packer.pack()
                yield from out()
                fresh = 0
    packer.finish()
    yield from out()


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, group_tokens: int = 64 * 2048, round_tokens: int = 2_000_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of all documents in their sequences, with the ids of each (``ids``: little-endian unsigned 32-bit).

    ``tokenizer`` is the path of a byte-level BPE file; ``tiers`` are window sizes, longest first, powers of two.
    A sequence is as long as its tier; only the last one of a task may be partial.
    """
    rows = small_batches(docs).selectExpr(f"cast(`{id_column}` as bigint) doc_id", f"`{text_column}` text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(batches, tokenizer, tiers, end_id, group_tokens, round_tokens)

    return rows.mapInArrow(run, SCHEMA)


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns: a checksum in place of the ids."""
    return pieces.selectExpr("doc_id", "start", "length", "crc32(ids) ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")


__all__ = ["Encoder", "Groups", "Packer", "TIERS", "digest", "pack", "tokenizer_path"]
