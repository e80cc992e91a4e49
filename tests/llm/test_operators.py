"""Operators on small tables: brute force, nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import random
import textwrap
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest

from skyfold.llm import licenses, line_dedup, media, mixing, near_dup, neighbours, packing, quality, substring_dedup, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, size int, key string"
LONG = " ".join(f"w{i % 977}" for i in range(30000))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, 0.5, True, 1, "k") for i, t, s in rows], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, blank and long texts, ties, repeated rows, an id with two texts."""
    line = "the quick brown fox jumps over the lazy dog today and tomorrow"
    rows = [(1, line, "a"), (2, line, None), (2, line, None), (3, line + " again", "b"), (4, "", "b"), (5, None, None), (6, " \n\t ", "a"), (None, line, "a"), (None, None, None), (7, LONG, "c"), (8, "x\n" + LONG, "c"), (9, "one two", "d"), (10, "one two", "d"), (11, "first text of an id that has two of them", "d"), (11, "second text, of the same id, unlike it", "d")]
    return documents(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def union_find(links, items):
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def copies(rng, n):
    """Texts with near copies of copies: chains, hubs and unlinked neighbours."""
    base = [" ".join(f"t{rng.randrange(3000)}" for _ in range(rng.choice([30, 60, 120]))) for _ in range(6)]
    out = []
    for _ in range(n):
        words = rng.choice(base + out[-20:]).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"t{rng.randrange(3000)}"
        out.append(" ".join(words))
    return out


def test_near_duplicates_equal_brute_force(spark):
    texts = copies(random.Random(4), 160)
    docs = documents(spark, [(i * 3, t, "s") for i, t in enumerate(texts)])
    sets = [shingle_set(t, 5) for t in texts]
    links = [(3 * i, 3 * j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = union_find(links, [3 * i for i in range(len(texts))])
    got = {r.doc_id: r for r in near_dup.components(docs).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(sets[i // 3]) for i, r in got.items())
    assert {r.doc_id for r in near_dup.drop_near_duplicates(docs).collect()} == set(want.values())


def test_near_duplicates_of_odd_rows(odd, none):
    got = defaultdict(list)
    for r in near_dup.components(odd, k=4).collect():
        got[r.doc_id].append(r)
    assert len(got[2]) == 2 and {r.component_id for i in (1, 2, 3) for r in got[i]} == {1}
    assert got[9][0].component_id == got[10][0].component_id == 9 and got[9][0].n_shingles == 1
    assert all(got[i][0].component_id == i and got[i][0].n_shingles == 0 for i in (4, 5, 6))
    assert got[7][0].component_id == got[8][0].component_id == 7 and all(r.kept and r.component_id is None for r in got[None])
    left = near_dup.drop_near_duplicates(odd)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect() if r.doc_id) == [1, 4, 5, 6, 7, 9, 11, 11]
    assert near_dup.components(none).count() == 0 and near_dup.drop_near_duplicates(none).count() == 0


def plain_lines(rows, percent=80):
    seen, out = [], {}
    for i, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            w = set(line.lower().split())
            if not w or not any(100 * len(w & s) >= percent * len(w | s) for s in seen):
                kept.append(line)
            if w:
                seen.append(w)
        out[i] = "\n".join(kept)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    pool = copies(rng, 60) + ["a", "a b", "b a a", "", "  "] + [" ".join(f"q{rng.randrange(40)}" for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 8)))) for i in range(80)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == plain_lines(rows)


@pytest.mark.parametrize("percent", [75, 80])
def test_line_dedup_of_short_lines_and_hostile_edits(spark, percent):
    """Lines of 3 to 30 words that differ in as many places as they may, spread so that they cut runs of tokens."""
    rng = random.Random(percent)
    rows = []
    for i in range(150):
        base = [f"z{rng.randrange(60)}" for _ in range(rng.randrange(3, 31))]
        lines = [base]
        for _ in range(3):
            own = list(base)
            for at in rng.sample(range(len(own)), max(1, len(own) * (100 - percent) // rng.choice([100, 150, 190]))):
                own[at] = f"y{rng.randrange(10**6)}" if rng.random() < 0.5 else ""
            lines.append([w for w in own if w])
        rows.append((i, "\n".join(" ".join(x) for x in lines)))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, [(i, t, "s") for i, t in rows]), percent).collect()}
    assert got == plain_lines(rows, percent)


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "_gone", "_rid", "_id", "_key", "line_numbers", "c0", "row"]
    docs = spark.createDataFrame([(1, "a b c\nd", 1, 2, 3, 4, 5, 6, 7), (2, "c b a\ne", 7, 6, 5, 4, 3, 2, 1)], names)
    assert [tuple(r) for r in line_dedup.dedup_lines(docs).orderBy("doc_id").collect()] == [(1, "a b c\nd", 1, 2, 3, 4, 5, 6, 7), (2, "e", 7, 6, 5, 4, 3, 2, 1)]


def test_line_dedup_of_odd_rows(odd, none):
    clean = line_dedup.dedup_lines(odd, count_columns=("_n_lines", "_n_removed"))
    assert clean.columns == [*odd.columns, "_n_lines", "_n_removed"]
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(odd, count_columns=("size", "n"))
    rows = clean.collect()
    assert len(rows) == odd.count() and sorted(r.text for r in rows if r.doc_id == 1) == ["the quick brown fox jumps over the lazy dog today and tomorrow"]
    assert [r.text for r in rows if r.doc_id in (2, 3)] == [""] * 3 and [r.text for r in rows if r.doc_id == 5] == [None]
    assert [r.text for r in rows if r.doc_id == 8] == ["x"] and [r.text for r in rows if r.doc_id == 6] == [" \n\t "]
    assert sorted(str(r.text) for r in rows if r.doc_id is None) == ["", "None"]
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_lower_cases_a_to_z_alone(spark):
    """Bytes that lower() changes when read as Latin-1 meet bytes that look like them; each word stays its own."""
    same = [("\u00c9COLE", "\u00c9cole"), ("\u3249X", "\u3249x"), ("Q\U00010400", "q\U00010400")]
    other = ["\u00e9t\u00e9", "\u00c9T\u00c9", "\u03a9", "\u2126", "\u03c9", "\u00c3\u0089", "\u3249", "\u0409", "\u4409", "\U00010400", "\U00010428", "\u0130", "\u212a", "k"]
    rows = [(1, "\n".join([a for a, _ in same] + other)), (2, "\n".join([b for _, b in same] + other[:1])), (3, "K")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == {1: rows[0][1], 2: "", 3: ""}


def test_line_dedup_splits_a_long_text_once(spark):
    """A text of 40,000 lines that loses one; time that grows with the square of its lines would be minutes."""
    lines = [f"w{i}" for i in range(40_000)] + ["w0"]
    began = time.monotonic()
    got = line_dedup.dedup_lines(documents(spark, [(1, "\n".join(lines), "s")])).collect()
    assert got[0].text == "\n".join(lines[:-1]) and time.monotonic() - began < 40


def test_passages_find_shared_runs_and_leave_others(spark):
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(5000)}"
    shared = [word() for _ in range(70)]
    rows = []
    for i in range(40):
        body = [word() for _ in range(rng.randrange(40, 200))]
        if i % 4 == 0:
            own = list(shared)
            for p in range(i % 7 + 5, 70, 17):
                own[p] = word()
            at = rng.randrange(len(body))
            body[at:at] = own
        rows.append((i, " ".join(body), "s"))
    out = substring_dedup.passages(documents(spark, rows)).collect()
    assert {r.doc_id for r in out} | {r.src_doc_id for r in out} == {i for i in range(40) if i % 4 == 0}
    texts = {i: t.split() for i, t, _ in rows}
    for r in out:
        assert r.identity >= 0.75 and r.passage_end - r.passage_start >= 45 and set(texts[r.doc_id][r.start_word : r.end_word]) & set(shared)


def test_passages_whose_seeds_smaller_documents_hold_in_short_stretches(spark):
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(10**6)}"
    shared = [word() for _ in range(60)]
    # every 5-gram of the passage stands in an earlier document, in stretches of 9 words that are too short for a chain
    rows = [(i, " ".join([word() for _ in range(30)] + shared[at : at + 9] + [word() for _ in range(30)]), "s") for i, at in enumerate(range(0, 56, 5))]
    rows += [(i, " ".join([word() for _ in range(40)] + shared + [word() for _ in range(40)]), "s") for i in (100, 101)]
    # the source's own first places of the seeds are short stretches as well
    apart = [w for at in range(0, 56, 5) for w in [*(word() for _ in range(70)), *shared[at : at + 9]]]
    out = substring_dedup.passages(documents(spark, rows)).collect()
    assert {(r.doc_id, r.src_doc_id) for r in out} == {(101, 100)} and all(r.start_word <= 42 and r.end_word >= 98 for r in out)
    rows[-2] = (100, " ".join([*apart, *(word() for _ in range(70)), *shared]), "s")
    out = substring_dedup.passages(documents(spark, rows)).collect()
    assert {(r.doc_id, r.src_doc_id) for r in out} == {(101, 100)} and max(r.end_word - r.start_word for r in out) >= 56


def test_passages_cover_every_long_run_that_brute_force_finds(spark):
    """Runs of 50 words or more that stand in an earlier document, among short stretches that own their seeds."""
    rng = random.Random(12)
    word = lambda: f"v{rng.randrange(10**5)}"
    pool = [[word() for _ in range(rng.randrange(50, 130))] for _ in range(8)]
    texts = []
    for _ in range(90):
        body = [word() for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.randrange(0, 4)):
            p, n = rng.choice(pool), rng.choice([7, 10, 12, 14, 20, 60, 130])
            at = rng.randrange(max(1, len(p) - n + 1))
            body += p[at : at + n] + [word() for _ in range(rng.randrange(3, 30))]
        texts.append(body)
    rows = substring_dedup.passages(documents(spark, [(i, " ".join(t), "s") for i, t in enumerate(texts)])).collect()
    covered = defaultdict(set)
    for r in rows:
        assert texts[r.doc_id][r.start_word : r.end_word] and r.src_doc_id < r.doc_id and r.identity >= 0.75
        covered[r.doc_id].update(range(r.start_word, r.end_word))
    runs = 0
    for x, a in enumerate(texts):
        for b in texts[:x]:
            length = np.zeros(len(b) + 1, int)
            for i, w in enumerate(a):
                fresh = np.zeros(len(b) + 1, int)
                for j, v in enumerate(b):
                    if v == w:
                        fresh[j + 1] = length[j] + 1
                        ends = i + 1 == len(a) or j + 1 == len(b) or a[i + 1] != b[j + 1]
                        if ends and fresh[j + 1] >= 50:
                            runs += 1
                            # a source that owns the last seeds may itself end a few words before the run does
                            assert set(range(i + 1 - fresh[j + 1] + 14, i + 1 - 14)) <= covered[x], (x, i, fresh[j + 1])
                length = fresh
    assert runs > 50


def test_passages_that_repeat_themselves(spark):
    """A phrase or a word again and again, with more and with fewer repeats than the source and a source of its own length."""
    rng = random.Random(1)
    words = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], {}

    def pair(i, source, own):
        rows.extend([(i, " ".join(words(80) + source + words(60)), "s"), (i + 1, " ".join(words(33) + own + words(70)), "s")])
        want[i + 1] = (33, 33 + len(own))

    six, eight, thirty, fifty, word = words(6), words(8), words(30), words(55), words(1)
    pair(10, six * 40, six * 40)
    pair(20, eight * 12, eight * 12)
    pair(30, x := words(100), x)
    pair(40, thirty * 4, thirty * 4)
    pair(50, word * 60, word * 700)
    pair(60, fifty, fifty * 3)
    rows += [(2, " ".join(words(20) + word * 17 + words(30)), "s"), (3, " ".join(words(20) + eight * 3 + words(30)), "s")]  # shorter stretches in smaller documents
    out = substring_dedup.passages(documents(spark, rows)).collect()
    for i, (lo, hi) in want.items():
        own = [r for r in out if r.doc_id == i]
        assert own and {(r.passage_start, r.passage_end) for r in own} == {(lo, hi)} and set(range(lo, hi)) == {p for r in own for p in range(r.start_word, r.end_word)}, i
    assert {r.doc_id for r in out} == set(want) and len(out) < 60


def test_passages_of_each_text_of_a_repeated_id(spark):
    rng = random.Random(2)
    words = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    one, two, three = words(100), words(100), words(100)
    rows = [(50, " ".join(["a", *words(40), *one]), "s"), (50, " ".join(["z", *words(10), *three]), "s"), (51, " ".join(one + words(20)), "s"), (52, " ".join(words(9) + two), "s"), (53, " ".join(["a", *two]), "s"), (53, " ".join(["b", *three]), "s"), (53, " ".join(["b", *three]), "s"), (54, " ".join(["a", *words(30)]), "s"), (54, " ".join(["b", *words(3), *words(40)]), "s")]
    out = substring_dedup.passages(documents(spark, rows)).collect()
    pairs = {tuple(sorted((r.doc_id, r.src_doc_id))) for r in out}
    assert pairs == {(50, 51), (52, 53), (50, 53)} and all(r.end_word - r.start_word == 100 for r in out)


def test_passages_of_odd_rows(odd, none):
    rows = substring_dedup.passages(odd).collect()
    assert {(r.doc_id, r.src_doc_id) for r in rows} == {(8, 7)} and max(r.end_word for r in rows) == 30001
    assert substring_dedup.passages(none).count() == 0


def test_mixing_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randrange(1, 30)), rng.choice(["b", "a", None, "a", "a", "é"])) for i in range(300)]
    docs = documents(spark, rows)
    out = mixing.plan(docs).collect()
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
        assert r.taken <= 3 * r.size
    assert set(by) == {"a", "b", "é", None} and abs(sum(v[0].target for v in by.values()) - sum(r.size for r in out)) < 1e-6
    for rows_ in by.values():
        assert abs(sum(r.taken for r in rows_) - rows_[0].target) <= 0.5 + 1e-9 and rows_[0].target <= 3 * rows_[0].source_size
    order = mixing.schedule(docs).collect()
    places = [r._mix_position for r in order]
    assert places == sorted(places) and 0 <= min(places) and max(places) <= 1
    assert sum(r._mix_words for r in order) == sum(r.taken for r in out) and sorted(map(str, mixing.plan(docs).collect())) == sorted(map(str, out))


def test_mixing_odd_rows(odd, none):
    out = mixing.plan(odd).collect()
    assert len(out) == odd.count() and all(r.taken == 0 for r in out if r.size == 0)
    assert mixing.schedule(odd).columns == [*odd.columns, "_mix_position", "_mix_words"]
    assert mixing.plan(none).count() == 0 and mixing.schedule(none).count() == 0


def test_packing_round_trip_of_odd_rows(odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    pieces = packing.pack(odd, packing.tokenizer_path()).collect()
    ids = sorted([*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in odd.collect())
    parts = defaultdict(list)
    for p in sorted(pieces, key=lambda p: p.start):
        # rows that repeat an id cannot be told apart by it; a document in one piece stands alone
        parts[(p.sequence_id, p.offset) if p.length == p.doc_tokens else (p.doc_id, p.doc_tokens)].append(p)
    assert sorted(np.frombuffer(b"".join(p.ids for p in v), "<u4").tolist() for v in parts.values()) == ids
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == np.concatenate([[0], np.cumsum([p.length for p in s])])[:-1].tolist() and sum(p.length for p in s) <= 2048
    assert packing.digest(packing.pack(none, packing.tokenizer_path())).count() == 0


def test_media_of_odd_rows(odd, none):
    rows = media.digest(media.read_streams(media.write_streams(odd))).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect() if r.doc_id not in (11, None)}
    for r in rows:
        if r.doc_id in texts:
            t = texts[r.doc_id].ljust(r.payload_bytes, b" ")
            assert r.n_bytes == len(texts[r.doc_id]) and r.payload_bytes == max(192, -(-r.n_bytes // 192) * 192) and r.tail_crc32 == zlib.crc32(t[-16:])
    assert media.read_streams(media.write_streams(none)).count() == 0


def test_quality_of_odd_rows(spark, odd, none):
    good, bad = "the river runs past the old mill and the wide field", "BUY!! NOW!! CHEAP!! PILLS!! $$$ %%% &&&"
    docs = documents(spark, [(100 + i, (good if i % 2 else bad) * (1 + i % 5), "s") for i in range(120)])
    labels = spark.createDataFrame([(100 + i, i % 2, None) for i in range(120)] + [(999, 1, 0), (101, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    net = quality.train(docs, quality.learnable(labels))
    out = {r.doc_id: r for r in quality.score(docs, net).collect()}
    assert all((r.predicted == 1) == bool(i % 2) for i, r in out.items())
    assert quality.score(odd, net).count() == odd.count() and all(0 <= r.score <= 1 for r in quality.score(odd, net).collect())
    assert quality.accept(odd, net, 0.0).columns == odd.columns and quality.score(none, net).count() == 0 and quality.accept(none, net).count() == 0
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.filter("quality = 1"))).collect()} == {1.0}
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}


def test_licenses_of_wrapped_notices(spark):
    short = "see it,\nlicensed under the apache license,\nversion 2.0\nfor all."
    rows = [(0, short, "s"), (1, "licensed under the apache license,\nas is;\nversion 2.0", "s")]
    rows += [(i, "some words before\n\n" + "\n".join(" * " + x for x in textwrap.wrap(t, 32)) + "\nand some after", "s") for i, (_, t) in enumerate(licenses.TEMPLATES, 2)]
    out = {r.doc_id: r for r in licenses.digest(licenses.scan(documents(spark, rows))).collect()}
    assert out[0].labels == "apache-2.0" and out[0].score == 1 and out[1].labels == ""
    assert all(label in out[i].labels.split(",") and out[i].score == 1 for i, (label, _) in enumerate(licenses.TEMPLATES, 2))


def test_licenses_inside_and_scattered_over_a_long_line(spark):
    rng = random.Random(3)
    filler = lambda n: " ".join(f"x{rng.randrange(999)}" for _ in range(n))
    template = dict(licenses.TEMPLATES)["cc-by-nc"].split()
    rows = [(1, " ".join(f"{w} {filler(430)}" for w in template), "s"), (2, f"{filler(900)} {' '.join(template)} {filler(900)}", "s"), (3, f"{' '.join(template)}", "s"), (4, " ".join(f"{w} {filler(1)}" for w in template), "s")]
    out = {r.doc_id: r for r in licenses.digest(licenses.scan(documents(spark, rows))).collect()}
    assert [out[i].labels for i in (1, 2, 3, 4)] == ["", "cc-by,cc-by-nc", "cc-by,cc-by-nc", ""]
    assert out[1].score == 0 and licenses.scan(documents(spark, rows)).filter("doc_id = 2").first().blocks[0].first_word == 900


def test_license_windows_equal_brute_force():
    rng = random.Random(9)
    words = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})
    index = licenses.Index(licenses.TEMPLATES, {w: rng.randrange(9) for w in words}, 90)
    for _ in range(200):
        text = [w.encode() for _ in range(4) for w in [*rng.choices(words, k=rng.randrange(12)), *(w for w in rng.choice(licenses.TEMPLATES)[1].split() if rng.random() < 0.97)]]
        want = {}
        for label, t in licenses.TEMPLATES:
            whole, n = {w.encode() for w in t.split()}, len(t.split())
            best = max((len(whole & set(text[i : i + n])) for i in range(max(1, len(text) - n + 1))), default=0)
            if 100 * best >= 90 * len(whole):
                want[label] = max(want.get(label, 0), best / len(whole))
        got = {}
        for label, _, _, share in index.windows(text):
            got[label] = max(got.get(label, 0), share)
        assert got == want


def test_licenses_of_odd_rows(spark, odd, none):
    docs = documents(spark, [(1, "All  rights\nReserved. cc BY cc by", "s"), (2, "This work is licensed under the GNU General Public License, version 3.", "s"), (3, "plain", "s")])
    out = {r.doc_id: r for r in licenses.digest(licenses.scan(docs)).collect()}
    assert (out[1].n_words, out[1].n_base, out[1].first_word, out[1].last_word, out[1].labels) == (7, 3, 0, 5, "cc-by,reserved")
    many = licenses.digest(licenses.scan(documents(spark, [(9, "cc by " * 60000, "s")]))).first()
    assert (many.n_base, many.first_word, many.last_word) == (60000, 0, 119998)
    assert out[2].labels == "gpl,gpl-3" and out[2].base_labels == "gpl" and out[3].labels == "" and out[3].first_word is None and out[3].score == 0
    assert licenses.digest(licenses.scan(odd)).count() == odd.count() and licenses.scan(none).count() == 0


def test_warc_of_odd_pages(spark):
    body = "<html>" + "x" * 200
    rows = [(5, "http://a.b/1", body), (3, "http://a.b/2", body), (4, None, body), (None, "http://c.d", body), (6, "http://a.b/1", "short"), (7, "http://a.b/1", "short"), (8, "bad url \n", None), (9, "http://e.f/é?q=1", "ü" * 90), (9, "http://e.f/é?q=1", "ü" * 90), (2, "http://a.b/1", "")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, offset int")
    folder, captures = warc.write_archives(pages)
    shards = warc.build_index(captures, folder, block_lines=2)
    got = sorted((str(r.page_id), r.record_type, r.refers_to, bytes(r.payload)) for r in warc.read_captures(spark, folder, shards, warc.keys_of(pages)).collect())
    want = sorted((str(i), "revisit" if h == body and i != 3 else "response", 3 if h == body and i != 3 else None, (h or "").encode()) for i, _, h in rows)
    assert got == want
    one = spark.createDataFrame([(warc.capture_key("http://a.b/2", 3),), ("zz none",)], "key string")
    assert [r.page_id for r in warc.read_captures(spark, folder, shards, one).collect()] == [3]
    empty = pages.limit(0)
    folder, captures = warc.write_archives(empty)
    assert warc.read_captures(spark, folder, warc.build_index(captures, folder), warc.keys_of(empty)).count() == 0


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    x[700:1100] = x[40]
    vectors = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] + [1.0] * 15, 1), (2060, [1.0, 2.0], 1), (2080, [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score int").repartition(5)
    got = defaultdict(list)
    for r in neighbours.top_k(df, cell_rows=300).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20)) and all(len(v) == 20 for v in got.values())
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(1500), -np.round(s, 12))) if i != q][:20]
        hit += len({i for i, _ in found} & set(order))
        assert all(abs(s[i] - v) < 1e-9 for i, v in found) and [v for _, v in found] == sorted((v for _, v in found), reverse=True)
    assert hit >= 0.9 * 20 * len(got)
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [1.0, 1.0]), (1, [0.0, 0.0]), (20, [3.0, 0.0]), (20, [0.5, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.top_k(twice).orderBy("query_id", "rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5)]
    few = neighbours.top_k(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 1)] and neighbours.top_k(df.limit(0)).count() == 0
