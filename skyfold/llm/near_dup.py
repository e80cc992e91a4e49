"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard on full shingle sets, connected components.

Two bijections of 32-bit values stand for the two permutations: the first scatters the shingles, the second, shifted
circularly by k, gives coordinate k of the signature (Li & Li, C-MinHash). ``bands`` groups of ``rows`` coordinates are
hashed; 48 bands of 6 miss a pair at Jaccard 0.8 with probability 5e-7.

1. One pass over the texts gives each its set size, a 128-bit digest of the set, and its band keys.
2. Documents with equal sets are one class, led by the smallest id. Copies go no further.
3. In every bucket of a band each class is compared on full sets with the bucket's pivot: the class that meets most
   others in all its buckets, as a text does that many copies were made of. Star rounds turn links into components.
4. Classes that fail are compared further, not dropped: all pairs of a bucket that are in different components, unless
   their sizes do not fit or the bits in which their sets' parity maps differ leave no room for the intersection (an
   exact bound). Pairs inside a component need no link. So a bucket of m copies costs m comparisons.
5. The links found then complete the components.

Sets are 64-bit shingle hashes of whole texts, made again only for classes that share a bucket.

Defined results: null, empty and blank texts have no shingles and stand alone; a text of fewer than k words is one
shingle; rows that repeat an id are one document in the graph; rows with a null id have no component and are kept; an
empty table gives no rows; further columns are ignored by ``components`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.llm import shingles
from skyfold.llm.common import Kept, small_batches
from skyfold.llm.components import roots

BANDS, ROWS = 48, 6
#: 64-bit words of a set's parity map.
MAP_WORDS = 16
_W = np.uint32


def _scatter(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of 32-bit values."""
    x = x ^ (x >> _W(16))
    x *= _W(a)
    x ^= x >> _W(15)
    x *= _W(b)
    x ^= x >> _W(16)
    return x


def signatures(values: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys of sets that are not empty: sets x bands."""
    first = _scatter((values >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    keys = np.empty((len(starts), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(starts), band + 1, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            least = np.minimum.reduceat(_scatter(first - _W(k), 0x2C1B3C6D, 0x297A2D39), starts)
            key = shingles.mix64(key * np.uint64(0x9E3779B97F4A7C15) + least)
        keys[:, band] = key
    return keys


def parity_maps(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """sets x MAP_WORDS: for each bit, whether an odd number of the set's values fall on it."""
    n, bits = len(firsts) - 1, 64 * MAP_WORDS
    cell = np.repeat(np.arange(n), np.diff(firsts)) * bits + (values & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=n * bits) & 1).astype(np.uint8)).view(np.int64).reshape(n, MAP_WORDS)


_SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, map array<long>"


def _digests(values: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, 0 for an empty one."""
    full = np.flatnonzero(np.diff(firsts))
    out = np.zeros((2, len(firsts) - 1), np.uint64)
    if len(full):
        out[0, full] = np.add.reduceat(shingles.mix64(values), firsts[full])
        out[1, full] = np.add.reduceat(shingles.mix64(values, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53), firsts[full])
    return out[0].view(np.int64), out[1].view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in shingles.groups(batch.column(1)):
            values, firsts = shingles.shingle_sets(data, offsets, k)
            sizes = np.diff(firsts)
            full = np.flatnonzero(sizes)
            d1, d2 = _digests(values, firsts)
            keys = signatures(values, firsts[full], bands, rows) if len(full) else np.zeros((0, bands), np.uint64)
            maps = parity_maps(values, firsts).ravel()
            rows_of = pa.array(np.arange(0, len(maps) + 1, MAP_WORDS, dtype=np.int32))
            ends = np.concatenate([[0], np.cumsum((sizes > 0) * bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(sizes)], pa.array(sizes.astype(np.int64)), pa.array(d1), pa.array(d2), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64))), pa.ListArray.from_arrays(rows_of, pa.array(maps))], ["doc_id", "n_shingles", "d1", "d2", "bands", "map"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in shingles.groups(batch.column(1)):
            values, firsts = shingles.shingle_sets(data, offsets, k)
            d1, d2 = _digests(values, firsts)
            yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(d1)], pa.array(d1), pa.array(d2), pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(values.view(np.int64)))], ["class", "d1", "d2", "shingles"])


def _confirmed(pairs: DataFrame, sets: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Pairs of classes with the size of their sets' intersection and union."""
    a, b = names
    one, two = sets.select(F.col("class").alias(a), F.col("shingles").alias("_sa")), sets.select(F.col("class").alias(b), F.col("shingles").alias("_sb"))
    both = F.size(F.array_intersect("_sa", "_sb")).cast("long")
    joined = pairs.join(one, a).join(two, b).select(a, b, both.alias("both"), (F.size("_sa") + F.size("_sb")).cast("long").alias("_n"))
    each = joined.select(a, b, "both", (F.col("_n") - F.col("both")).alias("either"))
    # An id with several texts has a row for each: the nearest counts.
    best = each.groupBy(a, b).agg(F.max(F.struct((F.col("both") / F.col("either")).alias("j"), "both", "either")).alias("_m"))
    return best.select(a, b, "_m.both", "_m.either")


def components(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id and kept.

    Documents are linked where 100 * intersection >= percent * union; the component is the smallest id reachable.
    """
    return _components(docs, k, percent, bands, rows, id_column, text_column)[0]


def _components(docs: DataFrame, k: int, percent: int, bands: int, rows: int, id_column: str, text_column: str) -> tuple[DataFrame, Kept]:
    """The result of ``components``, and the ids that several rows have."""
    texts = small_batches(docs).select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    sketches = Kept(texts.mapInArrow(lambda it: _sketch(it, k, bands, rows), _SKETCH), "near-sketch", hashes=True)
    full = sketches.df.filter("n_shingles > 0 and doc_id is not null")
    classes = Kept(full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("class"), F.any_value("bands").alias("bands"), F.any_value("map").alias("map")), "near-classes", hashes=True)
    repeats = Kept(sketches.df.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "near-repeats", counted=True)

    in_bands = classes.df.select("class", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    sizes = in_bands.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    shared = Kept(in_bands.join(sizes, "key"), "near-shared", hashes=True)
    # Copies of a text meet it in more buckets than each other, so the class with most company is a bucket's pivot.
    company = shared.df.groupBy("class").agg(F.sum("m").alias("met"))
    met = shared.df.join(company, "class").select("key", "class", "n", "met")
    pivots = met.groupBy("key").agg(F.max("met").alias("met"))
    pivots = met.join(pivots, ["key", "met"]).groupBy("key").agg(F.min("class").alias("pivot"))
    members = Kept(shared.df.join(pivots, "key").select("key", "class", "n", "pivot"), "near-members", hashes=True)
    shared.drop()

    known = members.df.filter("class != pivot")
    candidates = Kept(known.select("class").union(known.select(F.col("pivot").alias("class"))).distinct(), "near-candidates", counted=True)
    leaders = texts.join(candidates.side(), texts["doc_id"] == F.col("class"), "left_semi").mapInArrow(lambda it: _sets(it, k), "class long, d1 long, d2 long, shingles array<long>")
    sets = Kept(leaders.groupBy("class", "d1", "d2").agg(F.any_value("shingles").alias("shingles")), "near-sets", hashes=True)

    linked = F.col("both") * 100 >= F.lit(percent) * F.col("either")
    maps = classes.df.join(candidates.side(), "class", "left_semi").groupBy("class").agg(F.max("n_shingles").alias("n"), F.first("map").alias("map"), F.count("*").alias("texts"))  # one row, but for ids that repeat

    def mapped(a: str) -> DataFrame:
        return maps.select(F.col("class").alias(a), F.col("n").alias(f"n_{a}"), F.col("texts").alias(f"t_{a}"), *[F.col("map")[i].alias(f"{a}{i}") for i in range(MAP_WORDS)])

    def may_match(a: str, b: str) -> Column:
        """The sizes fit, and the bits that differ leave room for the intersection; ids with several texts pass."""
        total = F.col(f"n_{a}") + F.col(f"n_{b}")
        differ = sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(1, MAP_WORDS)), F.bit_count(F.col(f"{a}0").bitwiseXOR(F.col(f"{b}0"))))
        sizes = F.least(f"n_{a}", f"n_{b}") * 100 >= F.greatest(f"n_{a}", f"n_{b}") * percent
        # intersection <= (total - differ) / 2, and 100 * intersection >= percent * (total - intersection)
        return (sizes & ((total - differ) * (100 + percent) >= total * 2 * percent)) | (F.col(f"t_{a}") > 1) | (F.col(f"t_{b}") > 1)

    near = known.select("class", "pivot").distinct().join(mapped("class"), "class").join(mapped("pivot"), "pivot").filter(may_match("class", "pivot")).select("class", "pivot")
    stars = Kept(_confirmed(near, sets.df, ("class", "pivot")).withColumn("linked", linked), "near-stars", counted=True)
    tree = Kept(roots(stars.df.filter("linked").select(F.col("class").alias("u"), F.col("pivot").alias("v"))), "near-tree", counted=True)

    placed = members.df.join(stars.side().select("class", "pivot", "linked"), ["class", "pivot"], "left").join(tree.side(), F.col("class") == F.col("u"), "left")
    placed = Kept(placed.select("key", "class", "pivot", F.coalesce("linked", F.col("class") == F.col("pivot")).alias("linked"), F.coalesce("root", "class").alias("part")), "near-placed", hashes=True)
    members.drop()
    split = placed.df.groupBy("key").agg(F.min("part").alias("_lo"), F.max("part").alias("_hi")).filter("_lo < _hi").select("key")
    apart = placed.df.filter("class != pivot").join(split, "key", "left_semi").select("key", "class", "linked", "part")
    failed = apart.filter(~F.col("linked")).select("key", F.col("class").alias("a"), F.col("part").alias("pa")).join(mapped("a"), "a")
    other = apart.select("key", F.col("class").alias("b"), F.col("part").alias("pb"), F.col("linked").alias("lb")).join(mapped("b"), "b")
    rest = failed.join(other, "key").filter((F.col("pa") != F.col("pb")) & (F.col("lb") | (F.col("a") < F.col("b"))) & may_match("a", "b"))
    rest = Kept(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-rest")
    placed.drop()
    others = _confirmed(rest.df, sets.df, ("a", "b")).filter(linked).select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = tree.df.select("u", F.col("root").alias("v")).union(others)
    if repeats.rows:  # the texts of one id are one document
        own = full.join(repeats.side(), "doc_id", "left_semi").join(classes.df.select("d1", "d2", "n_shingles", "class"), ["d1", "d2", "n_shingles"])
        own = own.select("doc_id", "class").distinct()
        edges = edges.union(own.join(own.groupBy("doc_id").agg(F.min("class").alias("least")), "doc_id").filter("class != least").select("class", "least"))
    tree = Kept(roots(edges), "near-roots", counted=True)
    sets.drop()
    named = classes.df.select("d1", "d2", "n_shingles", "class").join(tree.side(), F.col("class") == F.col("u"), "left").select("d1", "d2", "n_shingles", F.coalesce("root", "class").alias("component_id"))
    each = sketches.df.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return each.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), repeats


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each component, with its own columns: the one with the smallest id.

    Of rows that repeat both id and text one stays; rows that repeat just the id are one document, and all stay if its
    component's smallest id is theirs. Rows with null ids stay.
    """
    found, repeats = _components(docs, k, percent, BANDS, ROWS, id_column, text_column)
    gone = Kept(found.filter(~F.col("kept")).select("doc_id").distinct(), "near-gone", counted=True)
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names that no column of docs can clash with
    at = docs.columns.index(id_column)
    own = F.col(f"c{at}").cast("long")
    left = rows.join(gone.side(), own == F.col("doc_id"), "left_anti")
    if repeats.rows:
        again = left.join(repeats.side(), own == F.col("doc_id"), "left_semi").dropDuplicates([f"c{at}", f"c{docs.columns.index(text_column)}"])
        left = left.join(repeats.side(), own == F.col("doc_id"), "left_anti").union(again)
    return left.toDF(*docs.columns)
