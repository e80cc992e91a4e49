"""Substring dedup: fuzzy passages that documents share, by chaining collinear k-mer seeds.

1. Seeds are the minimizers of all word k-mers: the smallest hash in each window of ``window`` k-mers. Two texts that
   share k + window - 1 words in a row share a seed there, wherever it stands.
2. Every seed's occurrences are joined with its occurrence in the smallest doc_id (its source), not with each other, so
   a passage in m documents makes m matches. Documents with both a source's and other seeds meet each of their sources.
3. For each document and source, matches on one diagonal become segments, and segments are chained in order with a
   cost for gaps; a Fenwick tree over the source's positions gives each segment its best predecessor.
4. Chains are aligned: between segments by word edit distance, beyond their ends by an x-drop extension.
5. Aligned chains of a document that touch or overlap make a passage, whatever their sources. Passages of at least
   ``min_words`` words are the result, one row for each chain.
6. A source that shares only a short stretch may be the smallest for each seed of a passage. So from each seed that
   occurs in two documents, the run of such seeds that spans MIN_CHAIN words makes a long seed, and what no aligned
   chain covers is joined with the smallest doc_id that has the same long seed. That source shares MIN_CHAIN words or
   more there, so its chain is long enough, and steps 3 to 5 put the chains of a passage together.

7. Equal long seeds that follow each other at one distance of MAX_GAP words at most (a phrase or a line again and again)
   are one stretch: first place, period, count. A document's stretch is laid along its source's longest one, repeat by
   repeat. One of short periods that is a passage in itself also has a key of its own, so its source is the smallest
   document with such a passage; it is laid along that again and again, one chain a round, to its end.

A run of MIN_CHAIN + 2 (k + window) words or more that stands in two documents is always found, whether it repeats itself
or not, but for k + window words at its ends where a shorter source owns the seeds there; a passage whose words differ
more often may be lost where smaller documents hold all of its seeds in short stretches.

Defined results: null and empty texts have no seeds; rows with null ids take no part; each different text of an id that
repeats is compared with other ids (``row_key`` is the id for the largest of its texts and a hash of id and text for the others, which
may have a larger id as their source); a document is not compared with itself (so repeats inside a document
are not reported); an empty table gives no
rows; further columns are ignored. Words are split at ASCII white space and compared with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm import shingles
from skyfold.llm.common import SPACE, Kept, ascii_lower, perhaps_in, small_batches

K, WINDOW = 5, 9
MIN_CHAIN, MIN_WORDS, MIN_IDENTITY, GAP_COST, MARGIN, JOIN_GAP = 15, 45, 0.75, 0.3, 12, 8
#: Words that a chain may leave out between two segments, on either side.
MAX_GAP = 60


def minimizers(hashes: np.ndarray, firsts: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, word position) of the selected k-mers of a run of texts."""
    counts = np.diff(firsts)
    long_ = counts >= k
    keep = np.repeat(long_, counts)
    hashes, counts = hashes[keep], counts[long_]
    starts = np.concatenate([[0], np.cumsum(counts)])
    value, of = shingles.shingle_hashes(hashes, starts, k)
    n = len(value)
    if not n:
        return value, of, of
    sizes = counts - k + 1
    begin = np.concatenate([[0], np.cumsum(sizes)])
    least = value.copy()
    for s in range(1, window):
        np.minimum(least[: n - s], value[s:], out=least[: n - s])
    # a window is one that stays inside its text; a shorter text is a single window
    at = np.arange(n) - np.repeat(begin[:-1], sizes)
    fits = at <= np.repeat(np.maximum(sizes - window, 0), sizes)
    small = np.repeat(sizes < window, sizes)
    least[~fits] = 0
    if small.any():
        whole = np.minimum.reduceat(value, begin[:-1])
        least[small] = np.repeat(whole, sizes)[small]
    best = least.copy()
    for s in range(1, window):
        np.maximum(best[s:], np.where(at[s:] >= s, least[: n - s], 0), out=best[s:])
    chosen = best == value
    rows = np.flatnonzero(long_)
    return value[chosen], rows[of[chosen]], at[chosen]


def _seeds(batches: Iterator[pa.RecordBatch], k: int, window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in shingles.groups(batch.column(1)):
            value, row, pos = minimizers(*shingles.words(data, offsets), k, window)
            ids = batch.column(0)[at : at + len(offsets) - 1].take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), ids, pa.array(pos.astype(np.int32))], ["seed", "doc_id", "pos"])


def segments(pos: np.ndarray, src: np.ndarray, k: int, gap: int) -> np.ndarray:
    """Matches to (start, source start, length) of runs on a diagonal, sorted by start."""
    order = np.lexsort((pos, pos - src))
    p, s = pos[order], src[order]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (p[1:] - s[1:] != p[:-1] - s[:-1]) | (p[1:] - p[:-1] > gap)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(p)) - 1
    out = np.stack([p[first], s[first], p[last] - p[first] + k], 1)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def _runs(batches: Iterator[pa.RecordBatch], k: int, least: int, most: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, pos, end, seed) sorted by doc_id, where a null seed marks a covered stretch: for each seed the run of
    seeds from it on that spans ``least`` words (``most`` words apart at most), and whether no covered stretch holds it.
    Equal runs at one distance are one row with their period and count, open if one of them is; ``whole`` says that each
    repeat counts, for the period is that long or (a second row) all of them are a passage."""
    names = ["key", "doc_id", "pos", "apart", "period", "count", "open", "whole"]

    def finish(doc: np.ndarray, pos: np.ndarray, end: np.ndarray, seed: np.ndarray, is_seed: np.ndarray) -> pa.RecordBatch:
        place = (np.cumsum(np.append(False, doc[1:] != doc[:-1])) << 32) + pos
        spans = np.flatnonzero(~is_seed)
        spans = spans[np.argsort(place[spans], kind="stable")]
        reach = np.append(-1, np.maximum.accumulate(place[spans] - pos[spans] + end[spans]))
        own = np.flatnonzero(is_seed)
        own = own[np.argsort(place[own], kind="stable")]
        at, doc, pos, seed = place[own], doc[own], pos[own], seed[own]
        last = np.searchsorted(at, at + (least - k))
        fits = np.flatnonzero(last < len(at))
        fits = fits[at[last[fits]] - at[fits] <= most]
        last = last[fits]
        apart = at[last] - at[fits]
        sums = np.append(np.uint64(0), np.cumsum(shingles.mix64(seed ^ np.uint64(0x94D049BB133111EB))))
        key = shingles.mix64(seed[fits] * np.uint64(0x9E3779B97F4A7C15) ^ (sums[last + 1] - sums[fits]) ^ (apart.astype(np.uint64) << np.uint64(56)))
        is_open = reach[np.searchsorted(place[spans], at[fits], "right")] < at[last] + k
        order = np.lexsort((at[fits], key))
        fits, apart, key, is_open = fits[order], apart[order], key[order], is_open[order]
        step = np.diff(at[fits], append=0)
        step[(key != np.append(key[1:], 0)) | (step > MAX_GAP)] = 0  # to the next equal run of the same text
        before = np.append(0, step[:-1])[: len(step)]
        joins = np.append(False, ((step != 0) & ((before == 0) | (before == step)))[:-1])[: len(step)]
        first = np.flatnonzero(~joins)
        count = np.diff(np.append(first, len(joins)))
        is_open = np.logical_or.reduceat(is_open, first) if len(first) else is_open
        fits, apart, key, period = fits[first], apart[first], key[first], np.where(count > 1, step[first], 0)
        passage = np.flatnonzero((period > 0) & (period < least) & ((count - 1) * period + apart + k >= min_words))
        rows = np.append(np.arange(len(fits)), passage)
        whole = np.append(period >= least, np.ones(len(passage), bool))
        key = np.append(key, shingles.mix64(key[passage] ^ np.uint64(0xD6E8FEB86659FD93)))
        fits, apart, period, count, is_open = fits[rows], apart[rows], period[rows], count[rows], is_open[rows]
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc[fits]), *(pa.array(c.astype(np.int32)) for c in (pos[fits], apart, period, count)), pa.array(is_open), pa.array(whole)], names)

    held: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        seed = batch.column(3)
        rows = (*(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)), seed.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64), seed.is_valid().to_numpy(zero_copy_only=False))
        cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last document may go on
        if held and cut == 0 and held[-1][0][-1] == rows[0][0]:
            held.append(rows)
            continue
        if held or cut:
            done = [*held, tuple(c[:cut] for c in rows)]
            yield finish(*(np.concatenate(c) for c in zip(*done, strict=True)))
        held = [tuple(c[cut:] for c in rows)]
    if held:
        yield finish(*(np.concatenate(c) for c in zip(*held, strict=True)))


class Fenwick:
    """Largest (value, item) over a prefix."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (n + 1)

    def put(self, i: int, entry: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if entry > self.best[i]:
                self.best[i] = entry
            i += i & -i

    def top(self, n: int) -> tuple[float, int]:
        """Over the first n items."""
        found = (-np.inf, -1)
        while n:
            found = max(found, self.best[n])
            n -= n & -n
        return found


def chains(parts: np.ndarray, gap_cost: float) -> list[tuple[float, list[int]]]:
    """Chains of segments, best first; each segment is in one chain. Gaps cost ``gap_cost`` a word on either side."""
    n = len(parts)
    if n == 1:
        return [(float(parts[0, 2]), [0])]
    ends, source_ends = parts[:, 0] + parts[:, 2], parts[:, 1] + parts[:, 2]
    places = np.sort(source_ends)
    score, before = np.zeros(n), np.full(n, -1)
    tree, by_end, j = Fenwick(n), np.argsort(ends, kind="stable"), 0
    for i in range(n):  # by start
        while j < n and ends[by_end[j]] <= parts[i, 0]:
            e = by_end[j]
            tree.put(int(np.searchsorted(places, source_ends[e])), (score[e] + gap_cost * (ends[e] + source_ends[e]), int(e)))
            j += 1
        value, prior = tree.top(int(np.searchsorted(places, parts[i, 1], "right")))
        joined = value - gap_cost * (parts[i, 0] + parts[i, 1])
        if joined > 0 and max(parts[i, 0] - ends[prior], parts[i, 1] - source_ends[prior]) <= MAX_GAP:
            score[i], before[i] = parts[i, 2] + joined, prior
        else:
            score[i] = parts[i, 2]
    used, out = np.zeros(n, bool), []
    for i in np.argsort(-score, kind="stable"):
        own, at, total = [], int(i), float(score[i])
        while at >= 0 and not used[at]:
            used[at] = True
            own.append(at)
            at = int(before[at])
        if own:
            out.append((total - (float(score[at]) if at >= 0 else 0.0), own[::-1]))
    return out


_CHAINS = "doc_id long, src_doc_id long, chain int, score double, parts array<struct<start: int, src: int, length: int>>"
_PART = pa.list_(pa.struct([("start", pa.int32()), ("src", pa.int32()), ("length", pa.int32())]))


def _chain(batches: Iterator[pa.RecordBatch], k: int, gap: int, gap_cost: float, least: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (doc_id, src_doc_id): one pair of documents is held at a time."""
    held: list[np.ndarray] = []
    rows: list[tuple] = []

    def finish(table: np.ndarray) -> None:
        parts = segments(table[:, 2], table[:, 3], k, gap)
        for c, (score, own) in enumerate(chains(parts, gap_cost)):
            if score >= least:
                rows.append((int(table[0, 0]), int(table[0, 1]), c, score, [dict(zip(("start", "src", "length"), map(int, parts[i]), strict=True)) for i in own]))

    def out() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), _PART]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["doc_id", "src_doc_id", "chain", "score", "parts"])

    for batch in batches:
        table = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
        if not len(table):
            continue
        cuts = np.flatnonzero((table[1:, :2] != table[:-1, :2]).any(1)) + 1
        for part in np.split(table, cuts):
            if held and (held[-1][-1, :2] != part[0, :2]).any():
                finish(np.concatenate(held))
                held.clear()
            held.append(part)
        if len(rows) > 5000:
            yield out()
            rows.clear()
    if held:
        finish(np.concatenate(held))
    yield out()


def _edit(a: list, b: list) -> int:
    """Most words of a and b that agree in an alignment of least edit distance."""
    width = len(b) + 1
    row = [(j, 0) for j in range(width)]  # (distance, -matches)
    for i, x in enumerate(a, 1):
        fresh = [(i, 0)]
        for j in range(1, width):
            d, m = row[j - 1]
            same = (d, m - 1) if x == b[j - 1] else (d + 1, m)
            fresh.append(min(same, (row[j][0] + 1, row[j][1]), (fresh[j - 1][0] + 1, fresh[j - 1][1])))
        row = fresh
    return -row[-1][1]


def _extend(a: list, b: list, drop: int = 3) -> tuple[int, int]:
    """Words to go on, and how many of them agree: ungapped, until the score falls by ``drop``."""
    best = score = agree = 0
    length = matches = 0
    for i, (x, y) in enumerate(zip(a, b, strict=False), 1):
        agree += x == y
        score += 1 if x == y else -1
        if score > best:
            best, length, matches = score, i, agree
        elif score < best - drop:
            break
    return length, matches


def align(parts: list[dict], a: list[str], b: list[str], a0: int, b0: int) -> tuple[int, int, int, int, int]:
    """start, end, source start, source end and agreeing words; a and b are words from a0 and b0 on."""
    start, src = parts[0]["start"], parts[0]["src"]
    matches, at, at_src = 0, start, src
    for p in parts:
        matches += _edit(a[at - a0 : p["start"] - a0], b[at_src - b0 : p["src"] - b0]) if p["start"] > at and p["src"] > at_src else 0
        one, two = a[p["start"] - a0 : p["start"] + p["length"] - a0], b[p["src"] - b0 : p["src"] + p["length"] - b0]
        matches += sum(x == y for x, y in zip(one, two, strict=False))
        at, at_src = p["start"] + p["length"], p["src"] + p["length"]
    back, agree = _extend(a[: start - a0][::-1], b[: src - b0][::-1])
    ahead, more = _extend(a[at - a0 :], b[at_src - b0 :])
    return start - back, at + ahead, src - back, at_src + ahead, matches + agree + more


_ALIGNED = "doc_id long, src_doc_id long, start_word long, end_word long, src_start long, src_end long, matches long, score double"


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _ALIGNED.split(", ")]
    for batch in batches:
        rows = []
        for doc, src, score, parts, a0, b0, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append((doc, src, *align(parts, a, b, a0, b0), score))
        columns = zip(*rows, strict=True) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "score" else pa.int64()) for c, n in zip(columns, names, strict=True)], names)


def row_keys(texts: DataFrame) -> tuple[DataFrame, Kept | None]:
    """texts(doc_id, text) with a key for each different text of an id, as doc_id; and rows (row_key, _id) of the keys that are no ids.

    Only ids that repeat are gathered, and of these one text in each task and id is.
    """
    repeats = Kept(texts.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "seed-repeats", counted=True)
    if not repeats.rows:
        return texts, None
    again = texts.join(repeats.side(), "doc_id", "left_semi")
    largest = Kept(again.groupBy("doc_id").agg(F.max("text").alias("_largest")).withColumn("_largest", F.sha2("_largest", 256)), "seed-largest", counted=True)
    own = F.when(F.sha2("text", 256).eqNullSafe(F.col("_largest")), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "text"))
    again = again.filter("text is not null").join(largest.side(), "doc_id").select(own.alias("row_key"), F.col("doc_id").alias("_id"), "text").dropDuplicates(["row_key"])
    again = Kept(again, "seed-again")
    named = Kept(again.df.filter("row_key != _id").select("row_key", "_id"), "seed-names", counted=True)
    return texts.join(repeats.side(), "doc_id", "left_anti").union(again.df.select("row_key", "text")), named


def along(met: DataFrame) -> DataFrame:
    """Stretches with the source's (src, src_period, src_count) to matches (doc_id, src_doc_id, pos, src) of seeds.

    Repeat r is laid on the source's repeat r modulo its count: all of them where ``whole``, else as many as the source
    has, and the last. Where repeats are close, matches of every 24 words are enough for one segment.
    """
    stride = F.greatest(F.lit(1), F.least(F.expr("24 div greatest(period, 1)"), F.expr("24 div greatest(src_period, 1)")))
    last = F.when(F.col("whole"), F.col("count")).otherwise(F.least("count", "src_count")) - 1
    at = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(1)), F.array(last, F.col("count") - 1)))
    in_round = F.col("r") % F.col("src_count")
    rows = met.select("doc_id", "src_doc_id", "pos", "src", "apart", "period", "src_period", "count", "src_count", stride.alias("stride"), F.explode(at).alias("r"))
    rows = rows.filter((in_round % F.col("stride") == 0) | (in_round == F.col("src_count") - 1) | (F.col("r") == F.col("count") - 1))
    rows = rows.withColumn("pos", F.col("pos") + F.col("r") * F.col("period")).withColumn("src", F.col("src") + in_round * F.col("src_period"))
    return rows.select("doc_id", "src_doc_id", F.explode(F.array(F.lit(0), "apart")).alias("step"), "pos", "src").selectExpr("doc_id", "src_doc_id", "pos + step pos", "src + step src").distinct()


def passages(docs: DataFrame, k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS, min_chain: int = MIN_CHAIN, min_identity: float = MIN_IDENTITY, gap_cost: float = GAP_COST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, start_word, end_word (exclusive), src_doc_id, src_start, src_end, matches, identity, score, row_key, src_row_key, passage_start, passage_end."""
    texts = small_batches(docs).select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text")).filter("doc_id is not null")
    texts, named = row_keys(texts)
    seeds = Kept(texts.mapInArrow(lambda it: _seeds(it, k, window), "seed long, doc_id long, pos int"), "seeds", hashes=True)
    repeated = Kept(seeds.df.groupBy("seed").agg(F.min("doc_id").alias("src_doc_id"), F.max("doc_id").alias("_last")).filter("src_doc_id < _last").select("seed", "src_doc_id"), "seed-sources", counted=True, hashes=True)
    met = Kept(perhaps_in(seeds.df, repeated.df, "seed").join(repeated.side(), "seed"), "seed-matches", hashes=True)
    seeds.drop()
    repeated.drop()
    sources = Kept(met.df.filter("doc_id = src_doc_id").groupBy("seed").agg(F.min("pos").alias("src")), "seed-places", counted=True, hashes=True)
    matches = met.df.filter("doc_id != src_doc_id").join(sources.side(), "seed").select("doc_id", "src_doc_id", "pos", "src")
    gap = 2 * (k + window)
    words = F.array_remove(F.split(ascii_lower(F.col("text")), SPACE), "")

    def cut(first: str, begin: str):
        """The words around the chain on one side, from word ``first`` on."""
        last = F.element_at("parts", -1)
        return F.slice("words", F.col(first) + 1, last[begin] + last["length"] - F.col(first) + MARGIN)

    def aligned(matches: DataFrame, name: str) -> Kept:
        ordered = matches.repartition("doc_id", "src_doc_id").sortWithinPartitions("doc_id", "src_doc_id")
        linked = Kept(ordered.mapInArrow(lambda it: _chain(it, k, gap, gap_cost, min_chain), _CHAINS), f"{name}-chains")
        ids = Kept(linked.df.select("doc_id").union(linked.df.select("src_doc_id")).distinct(), f"{name}-ids", counted=True)
        needed = Kept(texts.join(ids.side(), "doc_id", "left_semi").select("doc_id", words.alias("words")), f"{name}-texts")
        here = linked.df.withColumn("a0", F.greatest(F.lit(0), F.col("parts")[0]["start"] - MARGIN)).withColumn("b0", F.greatest(F.lit(0), F.col("parts")[0]["src"] - MARGIN))
        here = here.join(needed.df, "doc_id").withColumn("a", cut("a0", "start")).drop("words")
        here = here.join(needed.df.withColumnRenamed("doc_id", "src_doc_id"), "src_doc_id").withColumn("b", cut("b0", "src")).drop("words")
        rows = here.select("doc_id", "src_doc_id", "score", "parts", "a0", "b0", "a", "b").mapInArrow(_align, _ALIGNED)
        identity = F.col("matches") / F.greatest(F.col("end_word") - F.col("start_word"), F.col("src_end") - F.col("src_start"))
        out = Kept(rows.withColumn("identity", identity).filter(F.col("identity") >= min_identity), f"{name}-aligned")
        needed.drop()
        linked.drop()
        return out

    found = aligned(matches, "seed").df
    stretches = found.selectExpr("doc_id", "cast(start_word as int) pos", "cast(end_word as int) end", "cast(null as long) seed")
    places = met.df.selectExpr("doc_id", "pos", "pos end", "seed").union(stretches)
    runs = places.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(lambda it: _runs(it, k, min_chain, gap, min_words), "key long, doc_id long, pos int, apart int, period int, count int, open boolean, whole boolean")
    runs = Kept(runs, "runs", hashes=True)
    met.drop()
    owners = runs.df.groupBy("key").agg(F.min("doc_id").alias("src_doc_id"), F.max(F.when(F.col("open"), F.col("doc_id"))).alias("_open")).filter("src_doc_id < _open").select("key", "src_doc_id")
    owners = Kept(owners, "run-owners", counted=True)
    of = Kept(perhaps_in(runs.df, owners.df, "key").join(owners.side(), "key"), "run-matches")
    runs.drop()
    longest = F.max_by(F.struct(F.col("pos").alias("src"), F.col("period").alias("src_period"), F.col("count").alias("src_count")), F.struct(F.col("period") * F.col("count"), -F.col("pos")))
    places = Kept(of.df.filter("doc_id = src_doc_id").groupBy("key").agg(longest.alias("_s")).select("key", "_s.*"), "run-places", counted=True)
    more = along(of.df.filter("open and doc_id != src_doc_id").join(places.side(), "key"))
    found = found.union(aligned(more, "run").df).distinct()
    if named is not None:
        real = named.side()
        found = found.withColumnsRenamed({"doc_id": "row_key", "src_doc_id": "src_row_key"}).join(real, "row_key", "left").withColumn("doc_id", F.coalesce("_id", "row_key")).drop("_id")
        found = found.join(real.withColumnRenamed("row_key", "src_row_key"), "src_row_key", "left").withColumn("src_doc_id", F.coalesce("_id", "src_row_key")).drop("_id").filter("doc_id != src_doc_id")
    else:
        found = found.withColumn("row_key", F.col("doc_id")).withColumn("src_row_key", F.col("src_doc_id"))

    by_start = Window.partitionBy("row_key").orderBy("start_word", "end_word", "src_row_key", "src_start")
    reach = F.max("end_word").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start_word") <= F.col("_reach") + JOIN_GAP, 0).otherwise(1)).over(by_start)
    whole = Window.partitionBy("row_key", "_island")
    marked = found.withColumn("_reach", reach).withColumn("_island", island).withColumn("passage_start", F.min("start_word").over(whole)).withColumn("passage_end", F.max("end_word").over(whole))
    return marked.filter(F.col("passage_end") - F.col("passage_start") >= min_words).drop("_reach", "_island")
