"""Parts that need no session: encoders, containers, parsers, chains, nets."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyfold.llm import licenses, media, neighbours, packing, quality, shingles, substring_dedup, warc
from skyfold.llm.near_dup import BANDS, ROWS, parity_maps, signatures

TEXTS = st.text(st.one_of(st.sampled_from(" \n\t.,'!aA1éß漢½  "), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    t.encode_special_tokens = True
    return t, packing.Encoder(packing.tokenizer_path())


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_are_the_tokenizers(tokenizer, text):
    t, e = tokenizer
    assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|>b", "one two <|endoftext|> three  four", "<|endoftext|><|endoftext|>\n x", "<|endoftext", "no <|endoftext|>", "a  <|endoftext|>  b"])
def test_added_tokens_have_their_own_ids(tokenizer, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    assert np.frombuffer(tokenizer[1].encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_packer_keeps_every_id_and_fills_windows(seed):
    rng = random.Random(seed)
    docs = [bytes(4 * rng.choice([1, 5, 100, 255, 256, 257, 1000, 2047, 2048, 2049, 9000])) for _ in range(rng.choice([0, 1, 7, 200]))]
    windows = []
    p = packing.Packer(packing.TIERS, lambda t, w: windows.append((t, w)))
    for i, d in enumerate(docs):
        p.add(i, d)
        if i % 50 == 49:
            p.pack()
    p.finish()
    spans = {}
    for t, w in windows:
        assert sum(len(x[2]) // 4 for x in w) <= t
        for row, start, ids in w:
            spans.setdefault(row, []).append((start, len(ids) // 4))
    for i, d in enumerate(docs):
        at = 0
        for start, n in sorted(spans[i]):
            assert start == at and n > 0
            at += n
        assert at == len(d) // 4
    assert sum(sum(len(x[2]) // 4 for x in w) != t for t, w in windows) <= 1


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=7000))
def test_transport_stream_round_trip(data):
    payload = media.payload_of(data)
    stream = media.mux(payload)
    back = media.demux(stream)
    assert back["payload"] == payload and not back["continuity_errors"] and not back["table_errors"]
    assert len(payload) % 192 == 0 and len(stream) % 188 == 0 and back["random_access"][0]["pts"] == 0


def test_transport_stream_damage_is_counted():
    stream = media.mux(media.payload_of(b"x" * 5000))
    assert media.demux(stream[: 188 * 5] + stream[188 * 6 :])["continuity_errors"] == 1
    broken = bytearray(stream)
    broken[15] ^= 1
    assert media.demux(bytes(broken))["table_errors"] == 1 and media.demux(bytes(broken))["payload"] is None
    assert media.demux(b"")["payload"] is None
    assert media.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_keys_sort_by_reversed_host():
    assert warc.surt("https://www.Blog.example.com:443/en?a=1#top") == "com,example,blog)/en?a=1"
    assert warc.surt("http://a.b:81") == "b,a:81)/"
    assert warc.surt(None) == "-)" and " " not in warc.surt("not a url") and warc.surt("http://[bad/") == "-)http://[bad/"
    assert warc.capture_key("u", None) < warc.capture_key("u", -5) < warc.capture_key("u", 3)


def test_warc_records_round_trip():
    raw = warc.record(7, "http://a.b/ c", b"\r\n\r\nbody", "d", None, None)
    fields, payload = warc.parse(raw)
    assert payload == b"\r\n\r\nbody" and fields["warc-type"] == "response" and fields["warc-target-uri"] == "http://a.b/%20c"
    assert warc.parse(warc.record(8, "u", b"body", "d", 7, "v"))[0]["warc-refers-to"] == "<urn:page:7>"
    with pytest.raises(ValueError):
        warc.parse(raw[:-6])


def test_shingle_sets_equal_a_plain_version():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("a B c dd É  x".split(" ")) for _ in range(rng.choice([0, 1, 2, 3, 4, 30]))) for _ in range(60)] + ["", " \n\t ", "A b\x0bC  d\r\nE"]
    column = pa.array([*texts, None])
    plain = []
    for t in [*texts, ""]:
        w = t.encode().lower().split()
        plain.append({tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} if w else set())
    sets = []
    for _, data, offsets in shingles.groups(column, 64):
        values, firsts = shingles.shingle_sets(data, offsets, 4)
        sets += [set(values[a:b].tolist()) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    for i in range(0, len(sets), 5):
        for j in range(len(sets)):
            assert len(sets[i] & sets[j]) == len(plain[i] & plain[j])


def test_near_sets_share_a_band_and_maps_bound_the_difference():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
    other = np.unique(np.concatenate([base[20:], rng.integers(0, 1 << 63, 20, dtype=np.uint64)]))
    values = np.concatenate([base, other])
    firsts = np.array([0, len(base), len(values)])
    keys = signatures(values, firsts[:-1], BANDS, ROWS)
    assert (keys[0] == keys[1]).any()
    maps = parity_maps(values, firsts)
    assert sum(int(x).bit_count() for x in (maps[0] ^ maps[1]).view(np.uint64)) <= len(set(base.tolist()) ^ set(other.tolist()))


def test_minimizers_of_a_shared_run_agree():
    rng = random.Random(1)
    run = [f"w{rng.randrange(50)}" for _ in range(13)]
    texts = [" ".join([f"{c}{rng.randrange(99)}" for _ in range(40)] + run + [f"{c}{rng.randrange(99)}" for _ in range(25)]) for c in "xy"]
    (_, data, offsets), = shingles.groups(pa.array([*texts, "one two", ""]))
    value, row, _ = substring_dedup.minimizers(*shingles.words(data, offsets), 5, 9)
    assert set(value[row == 0].tolist()) & set(value[row == 1].tolist()) and not (row > 1).any()


def test_chains_equal_a_plain_dynamic_program():
    rng = np.random.default_rng(7)
    for _ in range(30):
        parts = np.stack([np.sort(rng.integers(0, 80, 12)), rng.integers(0, 80, 12), rng.integers(5, 9, 12)], 1)
        parts = parts[np.lexsort((parts[:, 1], parts[:, 0]))]
        best = [0.0] * 12
        for i, (s, t, n) in enumerate(parts):
            prior = [best[j] - 0.3 * (s - parts[j, 0] - parts[j, 2] + t - parts[j, 1] - parts[j, 2]) for j in range(12) if parts[j, 0] + parts[j, 2] <= s and parts[j, 1] + parts[j, 2] <= t]
            best[i] = n + max([0.0, *prior])
        found = substring_dedup.chains(parts, 0.3)
        assert abs(found[0][0] - max(best)) < 1e-9 and sorted(i for _, own in found for i in own) == list(range(12))


def test_alignment_bridges_changed_words():
    a = [f"w{i}" for i in range(60)]
    b = [*a[:20], "new", *a[21:40], *a[42:]]
    parts = [{"start": 2, "src": 2, "length": 18}, {"start": 21, "src": 21, "length": 19}, {"start": 42, "src": 40, "length": 16}]
    start, end, src, src_end, matches = substring_dedup.align(parts, a, b, 0, 0)
    assert (start, end, src, src_end) == (0, 60, 0, 58) and matches == 57


def test_chi_square_quantiles_and_search():
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 1e-3 and abs(neighbours.chi_square_quantile(0.99, 2) - 9.2103) < 1e-3
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16))
    image = neighbours.Image(16, float((x * x).sum(1).max()), 8, 1)
    hit = 0
    for j, own, dots in neighbours.search(x, x[:20], np.full(20, -np.inf), 10, image, neighbours.chi_square_quantile(0.97, 8), 64):
        hit += len(set(own[np.argsort(-dots)][:10]) & set(np.argsort(-(x @ x[j]))[:10]))
        assert np.allclose(dots, x[own] @ x[j])
    assert hit >= 190


def test_network_learns_and_covers_whole_texts():
    rng = random.Random(0)
    good = [" ".join(rng.choice(["the", "river", "runs", "past"]) for _ in range(200)).encode() for _ in range(60)]
    bad = [" ".join(rng.choice(["THE!!", "RIVER!!", "RUNS!!"]) for _ in range(200)).encode() for _ in range(60)]
    rows = [[quality.chunk(t, c) for c in range(quality.n_chunks(len(t)))] for t in good + bad]
    chunks = np.frombuffer(b"".join(c for r in rows for c in r), np.uint8).reshape(-1, quality.CHUNK)
    net = quality.fit(chunks, np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([1.0] * 60 + [0.0] * 60, np.float32))
    scores = net.score([*good, *bad, b"", good[0] * 30])
    assert (scores[:60] > 0.9).all() and (scores[60:120] < 0.1).all() and 0 <= scores[120] <= 1 and scores[121] > 0.9
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        text = bytes(rng.randrange(256) for _ in range(n))
        parts = [quality.chunk(text, c) for c in range(quality.n_chunks(n))]
        seen = {min(c * quality.HOP, max(n - quality.CHUNK, 0)) + i for c in range(len(parts)) for i in range(quality.CHUNK)}
        assert set(range(n)) <= seen and all(len(p) == quality.CHUNK for p in parts)


def test_license_index_finds_what_containment_says():
    rng = random.Random(2)
    words = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})
    index = licenses.Index(licenses.TEMPLATES, {w: rng.randrange(9) for w in words}, 80)
    for _ in range(300):
        block = [w.encode() for w in rng.sample(words, rng.randrange(1, 40))]
        if rng.random() < 0.6:
            block += [w.encode() for w in rng.choice(licenses.TEMPLATES)[1].split() if rng.random() < 0.9]
        want = sorted((label, len(set(t.split()) & {b.decode() for b in block}) / len(set(t.split()))) for label, t in licenses.TEMPLATES)
        assert sorted(index.matches(block)) == [(x, c) for x, c in want if c * 100 >= 80 - 1e-9]


def test_fold_is_the_contract():
    assert zlib.crc32(b"12") % 4 in range(4)
