"""Line dedup: an exact set-similarity join of lines; a line goes if an earlier line has a similar set of words.

DataFrame operations only. A line's tokens are its words (A-Z lower-cased), as a set; two lines match where
100 * intersection >= percent * union. Lines stand in the order of (doc_id, xxhash64 of the text, line number).

1. Tokens get a global order by rarity: counts of all words in ``CELLS`` hashed cells, rarest cell first, then by hash.
   The table of cells has a fixed size whatever the input's, and any fixed order makes the filters below exact.
2. Lines with equal sets are one class, led by its first line; later lines of a class go at once.
3. A class posts its prefix as triples of neighbouring tokens. If a and b match, x tokens of a and y of b are not common.
   Three common tokens that follow each other in both lines make a triple of both; going along a, each of its x tokens
   spoils three triples at most and each of b's y tokens two, so one of the first 3x + 2y + 1 triples of a is also one
   of the first 3y + 2x + 1 of b. That is at most 3 n (100 - percent) / 100 + 1 of n tokens, rarest first (prefix
   filter). Short lines post pairs, by the same count; lines that may match both kinds post both.
4. Triples that a single class posts meet nothing and leave after one count; chance meetings are rare, unlike those of
   single tokens, so the work grows with the input and not with its square. Of classes that share a triple, candidates
   pass the length filter, the positional filter (what stands before and behind the shared triple must suffice), and a
   bound on the tokens that they share, by the differing bits of two parity maps. All are exact. Each class
   is first compared with the earliest class of the triple (its pivot); who matches goes and needs no other comparison.
   What is left is compared with every earlier class that met the same pivot and passes the length and map filters. So
   m copies of a line with a few words changed cost m comparisons, and none is dropped.
5. Jaccard is verified on the words themselves.

Earlier lines count as they were, whether they stay themselves or not; so the result depends on no processing order.

Defined results: lines without words stay; null texts stay null; rows that repeat doc_id and text are one document that
is stored twice, and fare alike; null ids come last; an empty table gives no rows; further columns are kept, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import SPACE, Kept, perhaps_in

CELLS = 1 << 16
#: Bits of a posted key. The zeros above them are not stored or sent; keys that fall together by chance cost a comparison.
KEY_BITS = 40
#: Below this similarity two matching lines need not have neighbouring tokens in common.
LEAST_PERCENT = 75


def _lower(line: Column) -> Column:
    """Lower-cases A-Z; lines that differ in more than that stay different.

    Other lines than plain ones are read byte by byte as Latin-1, and lower() then turns the bytes C0 to DE into E0 to FE as
    well. That loses nothing: the bytes 80 to BF that follow such a byte, one after C0 to DE and two or three after
    others, tell which it was. So a word stays equal to itself only, which is all that is asked of it.
    """
    plain = F.octet_length(line) == F.char_length(line)
    return F.lower(F.when(plain, line).otherwise(F.decode(line.cast("binary"), "ISO-8859-1")))


def _spaced(line: Column) -> Column:
    """The words with single blanks between them; most lines are written like that."""
    odd = F.contains(line, F.lit("  "))
    for c in "\t\n\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.trim(F.when(odd, F.regexp_replace(line, SPACE, " ")).otherwise(line))


def prepared_lines(lines: DataFrame) -> DataFrame:
    """``line`` lower-cased and spaced. Selects of their own, as Catalyst repeats no expression that they make."""
    own = [c for c in lines.columns if c != "line"]
    return lines.select(*own, _lower(F.col("line")).alias("line")).select(*own, _spaced(F.col("line")).alias("line"))


def tokens(prepared: Column) -> Column:
    """Words of a prepared line, as often as they occur."""
    return F.when(prepared == "", F.array().cast("array<string>")).otherwise(F.split(prepared, " "))


def _lines(texts: DataFrame, separator: str) -> DataFrame:
    # outer: a plain explode would first ask whether the split gives anything, and split twice
    return texts.select("doc_id", "text_key", F.posexplode_outer(F.split("text", _quoted(separator), -1)).alias("line_no", "line"))


def rarity(lines: DataFrame) -> Column:
    """An array literal: for each hashed cell, twice the binary logarithm of its words' count (63 at most), in the high bits."""
    words = lines.select(F.explode_outer(F.split(F.lower("line"), " ")).alias("w"))
    counted = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(CELLS - 1)).alias("cell")).agg(F.count("*").alias("n"))
    level = F.least(F.lit(63), F.floor(F.log2(F.col("n") + 1) * 2)).cast("int")
    found, levels = counted.select("cell", level.alias("level")).toArrow(), [0] * CELLS  # CELLS rows at most
    for cell, n in zip(found["cell"].to_pylist(), found["level"].to_pylist(), strict=True):
        levels[cell] = n << 57
    return F.split(F.lit(",".join(map(str, levels))), ",").cast("array<bigint>")


def keyed(words: Column, levels: Column) -> Column:
    """The distinct words as sorted integers, rarest first: level in the high bits, 57 bits of the hash below."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    level = lambda h: F.get(levels, h.bitwiseAND(F.lit(CELLS - 1)).cast("int"))
    # an array that can hold no null is sorted as plain longs, any other as objects
    return F.sort_array(F.array_distinct(F.transform(hashes, lambda h: F.coalesce(level(h) + F.shiftrightunsigned(h, 7), F.lit(0).cast("long")))))


def _long(percent: int) -> int:
    """Least size from which matching lines always have a triple in common: n - 2 >= 3 n (100 - percent) / 100 + 1."""
    return -(-300 // (3 * percent - 200))


def _posts(n: Column, percent: int, k: int) -> Column:
    """Keys of k tokens that a line of n tokens posts."""
    return F.least(n - k + 1, F.floor(n * (k * (100 - percent)) / 100) + 1).cast("int")


def _prefix(n: Column, percent: int) -> Column:
    """Tokens of a line of n that its keys are made of."""
    return F.when(n >= _long(percent), _posts(n, percent, 3) + 2).otherwise(F.greatest(F.lit(0), _posts(n, percent, 2)) + 1)


def _keys_of(classes: DataFrame, percent: int, carry: list[str]) -> DataFrame:
    """A row for each posted key, with the place of its first token."""
    least, most = _long(percent), (_long(percent) - 1) * 100 // percent  # a shorter line's partner has at most ``most``

    def kind(k: int, rows: DataFrame) -> DataFrame:
        each = rows.select(*carry, "prefix", F.posexplode("prefix").alias("p", "token")).filter(F.col("p") < _posts(F.col("n"), percent, k))
        key = F.xxhash64(F.lit(k), "token", *[F.get("prefix", F.col("p") + i) for i in range(1, k)])
        return each.select(F.shiftrightunsigned(key, 64 - KEY_BITS).alias("key"), *carry, "p")

    return kind(3, classes.filter(F.col("n") >= least)).union(kind(2, classes.filter(F.col("n") <= most)))


def _overlap(na: Column, nb: Column, percent: int) -> Column:
    """Common tokens that a match needs."""
    return F.ceil((na + nb) * percent / F.lit(100.0 + percent) - 1e-9)


def _maps(keys: Column) -> list[Column]:
    """128 bits: for each, whether an odd number of the line's tokens fall on it."""

    def folded(bit) -> Column:
        return F.aggregate(keys, F.lit(0).cast("long"), lambda m, k: m.bitwiseXOR(F.call_function("shiftleft", bit(k), k.bitwiseAND(F.lit(63)).cast("int"))))

    odd = lambda k: F.shiftright(k, 6).bitwiseAND(F.lit(1))
    return [folded(lambda k: F.lit(1) - odd(k)).alias("m0"), folded(odd).alias("m1")]


def _may_match(a: str, b: str, percent: int) -> Column:
    """Length and map filter: the bits in which the maps differ are no more than the tokens that are not common."""
    na, nb = F.col(a + "n"), F.col(b + "n")
    differ = F.bit_count(F.col(f"{a}m0").bitwiseXOR(F.col(f"{b}m0"))) + F.bit_count(F.col(f"{a}m1").bitwiseXOR(F.col(f"{b}m1")))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (na + nb - differ >= _overlap(na, nb, percent) * 2)


def _in_place(a: str, b: str, percent: int) -> Column:
    """Positional filter: what stands before the shared key in both, and from it on, must suffice."""
    na, nb, pa, pb = (F.col(x + c) for c in ("n", "p") for x in (a, b))
    return F.least(pa, pb) + F.least(na - pa, nb - pb) >= _overlap(na, nb, percent)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with their first places, and both and either: sizes of intersection and union of their words."""
    one, two = (sets.select(F.col("cid").alias(c), F.col("words").alias(f"_w{c}"), F.col("first").alias(f"_f{c}")) for c in ("a", "b"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "_fa", "_fb", F.size(F.array_intersect("_wa", "_wb")).alias("both"), (F.size("_wa") + F.size("_wb")).alias("_n"))
    return joined.select("a", "b", "_fa", "_fb", "both", (F.col("_n") - F.col("both")).alias("either"))


def removals(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text", separator: str = "\n") -> DataFrame:
    """Lines that go: doc_id, text_key and the sorted line numbers, a row for each document that loses any."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {LEAST_PERCENT} to 100")
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text")).filter("text is not null")
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    lines = _lines(texts, separator)
    levels = rarity(lines)

    keys = prepared_lines(lines).select("doc_id", "text_key", "line_no", keyed(tokens(F.col("line")), levels).alias("keys"))
    n = F.size("keys")
    # as floats tokens keep their level and the 18 or more leading bits of their hash; the cast is compiled, a lambda is not
    prefix = F.slice("keys", F.lit(1), _prefix(n, percent)).cast("array<float>")
    digests = [F.xxhash64("keys").alias("d1"), F.xxhash64(F.lit(1), "keys").alias("d2")]
    prepared = Kept(keys.select("doc_id", "text_key", "line_no", n.alias("n"), *digests, prefix.alias("prefix"), *_maps(F.col("keys"))), "line-keys", hashes=True)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "line_no")
    grouped = prepared.df.filter("n > 0").groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("copies"), *[F.any_value(c).alias(c) for c in ("n", "m0", "m1", "prefix")])
    classes = Kept(grouped.select(F.monotonically_increasing_id().alias("cid"), "*"), "line-classes", hashes=True)
    occurrences = Kept(prepared.df.filter("n > 0").select("doc_id", "text_key", "line_no", "d1", "d2"), "line-occurrences")
    prepared.drop()

    own = ["doc_id", "cid", "n", "m0", "m1"]
    posted = _keys_of(classes.df.select("cid", "first.doc_id", "n", "m0", "m1", "prefix"), percent, own)
    repeated = Kept(posted.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "line-repeated", counted=True)
    met = Kept(perhaps_in(posted, repeated.df, "key", bits=2).join(repeated.side(), "key"), "line-met", hashes=True)
    repeated.drop()
    pivot = F.min(F.struct(F.col("doc_id").isNull().alias("last"), *own, "p")).alias("pivot")
    pivots = Kept(met.df.groupBy("key").agg(pivot).select("key", *[F.col(f"pivot.{c}").alias(f"o_{c}") for c in ("cid", "n", "m0", "m1", "p")]), "line-pivots", counted=True, hashes=True)
    near = _may_match("", "o_", percent) & _in_place("", "o_", percent)
    pivoted = met.df.join(pivots.side(), "key").filter("cid != o_cid").select(*own, "o_cid", near.alias("near"), (F.col("m") > 2).alias("more"))
    pivoted = Kept(pivoted.filter("near or more"), "line-pivoted")  # what two classes post and fails the filters is done with
    met.drop()
    pivots.drop()
    first_pairs = Kept(pivoted.df.filter("near").select(F.col("cid").alias("a"), F.col("o_cid").alias("b")).distinct(), "line-near")

    def matched(pairs: DataFrame) -> Kept:
        """Of each pair of similar lines the later class."""
        words = _words(texts, classes.df, pairs.select("a").union(pairs.select("b")), separator)
        similar = _verified(pairs, words.df).filter(F.col("both") * 100 >= F.col("either") * percent)
        later = F.when(F.col("_fa") > F.col("_fb"), F.col("a")).otherwise(F.col("b"))
        out = Kept(similar.select(later.alias("cid")).distinct(), "line-matched", counted=True)
        words.drop()
        return out

    gone = matched(first_pairs.df)
    # Every class with its pivot has been looked at. Others only meet where three classes post a key, and share its pivot
    # then; so each pair is made once for each pivot, not for each key.
    family = Kept(pivoted.df.filter("more").select(F.col("o_cid").alias("family"), *own).distinct(), "line-families")
    x = family.df.join(gone.side(), "cid", "left_anti").select("family", *[F.col(c).alias(f"x_{c}") for c in own])
    y = family.df.select("family", *[F.col(c).alias(f"y_{c}") for c in own])
    # y comes first by document; inside a document the classes' lines decide, once verified
    order = lambda s: F.struct(F.col(f"{s}doc_id").isNull().alias("l"), F.col(f"{s}doc_id").alias("d"))
    rest = x.join(y, "family").filter((F.col("x_cid") != F.col("y_cid")) & (order("y_") <= order("x_")) & _may_match("x_", "y_", percent))
    others = Kept(rest.select(F.col("x_cid").alias("a"), F.col("y_cid").alias("b")).distinct().join(first_pairs.df, ["a", "b"], "left_anti"), "line-rest")
    family.drop()
    pivoted.drop()
    removed = gone.df.union(matched(others.df).df).distinct().withColumn("gone", F.lit(True))

    # Classes of one line that stay have nothing to say about their line.
    telling = classes.df.select("cid", "d1", "d2", "first", "copies").join(removed, "cid", "left").filter("copies > 1 or gone")
    telling = Kept(telling.select("d1", "d2", "first", F.coalesce("gone", F.lit(False)).alias("gone")), "line-telling", counted=True)
    marked = occurrences.df.join(telling.side(), ["d1", "d2"]).filter(F.col("gone") | (place != F.col("first")))
    return marked.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line_no")).alias("line_numbers"))


def _words(texts: DataFrame, classes: DataFrame, wanted: DataFrame, separator: str) -> Kept:
    """cid, first place and distinct words of the first line of each wanted class."""
    found = classes.select("cid", "first").join(wanted.toDF("cid").distinct(), "cid")
    lists = Kept(found.groupBy(F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key")).agg(F.collect_list(F.struct("cid", "first")).alias("own")), "line-places", counted=True)  # lines of one document
    own = texts["doc_id"].eqNullSafe(F.col("_id")) & (texts["text_key"] == F.col("_key"))
    lines = texts.join(lists.side(), own).select(F.split("text", _quoted(separator), -1).alias("parts"), "own").select("parts", F.explode("own").alias("o"))
    lines = lines.select("o.cid", "o.first", F.get("parts", F.col("o.first.line_no")).alias("line")).dropDuplicates(["cid"])
    return Kept(prepared_lines(lines).select("cid", "first", F.array_distinct(tokens(F.col("line"))).alias("words")), "line-words")


def _quoted(separator: str) -> str:
    return "\\Q" + separator + "\\E" if separator != "\n" else "\n"


def dedup_lines(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text", separator: str = "\n", count_columns: tuple[str, str] | None = None, drop_emptied: bool = False) -> DataFrame:
    """The documents without the lines that go. ``count_columns`` names two further columns: lines, and lines removed.

    Every row stays, even if no line of it does: its text is then empty; ``drop_emptied`` leaves out rows that
    lose all their lines.
    """
    if clash := set(count_columns or ()) & set(docs.columns):
        raise ValueError(f"columns that docs has: {', '.join(sorted(clash))}")
    gone = Kept(removals(docs, percent, id_column, text_column, separator), "line-removals", counted=True)
    # names that no column of docs can clash with
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at, of = docs.columns.index(text_column), docs.columns.index(id_column)
    text = F.col(f"c{at}").cast("string")
    side = gone.side().toDF("_id", "_key", "line_numbers")
    joined = rows.join(side, F.col(f"c{of}").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_key")), "left")
    # a column of its own: inside a lambda Spark would split the text again for each line
    joined = joined.withColumn("parts", F.when(F.col("line_numbers").isNotNull(), F.split(text, _quoted(separator), -1)))
    parts = F.col("parts")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("line_numbers"))
    clean = F.when(F.col("line_numbers").isNull(), F.col(f"c{at}")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), separator))
    out = [(clean if i == at else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)]
    without = F.replace(text, F.lit(separator), F.lit(""))
    n_lines = ((F.octet_length(text) - F.octet_length(without)) / len(separator.encode()) + 1).cast("long")
    if drop_emptied:
        joined = joined.filter(F.coalesce(F.cardinality("line_numbers") < n_lines, F.lit(True)))
    if count_columns:
        out += [F.coalesce(n_lines, F.lit(0)).alias(count_columns[0]), F.coalesce(F.size("line_numbers"), F.lit(0)).cast("long").alias(count_columns[1])]
    return joined.select(*out)
