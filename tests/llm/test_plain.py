"""Plain second versions: the network one position at a time, the transport stream one packet at a time; stages on odd rows."""

import random

import numpy as np
import pytest

import corpus_pipeline
from skyfold.llm import media, quality


def plain_score(net, text):
    """Each chunk, each position, each filter on its own."""
    total, n = 0.0, quality.n_chunks(len(text))
    for c in range(n):
        part = quality.chunk(text, c)
        best = [-np.inf] * quality.FILTERS
        for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
            window = [float(v) for b in part[at : at + quality.WIDTH] for v in net.table[b]]
            for f in range(quality.FILTERS):
                best[f] = max(best[f], sum(v * float(w) for v, w in zip(window, net.filters[:, f], strict=True)))
        total += sum(max(b + float(o), 0.0) * float(w) for b, o, w in zip(best, net.bias, net.weights, strict=True))
    return 1 / (1 + np.exp(-(total / n + net.offset)))


def test_network_equals_a_plain_convolution():
    rng = np.random.default_rng(3)
    net = quality.Network(rng.normal(0, 0.5, (256, quality.DIM)).astype(np.float32), rng.normal(0, 0.2, (quality.WIDTH * quality.DIM, quality.FILTERS)).astype(np.float32), rng.normal(0, 0.1, quality.FILTERS).astype(np.float32), rng.normal(0, 0.3, quality.FILTERS).astype(np.float32), 0.3)
    texts = [b"", b"a", bytes(range(256)) * 3, "für \u00e9 text ".encode() * 40, b"x" * 512, b"end of chunk " * 110]
    assert np.allclose(net.score(texts, block=2), [plain_score(net, t) for t in texts], atol=1e-5)


def plain_demux(stream):
    """Payload and times, packet by packet, by the standard's fields."""
    pids, last, units, times, entries = {0: "tables"}, {}, [], [], 0
    data = None
    for n in range(0, len(stream), 188):
        p = stream[n : n + 188]
        assert p[0] == 0x47 and len(p) == 188
        start, pid, control, counter = p[1] >> 6 & 1, (p[1] & 31) << 8 | p[2], p[3] >> 4 & 3, p[3] & 15
        at, entry = 4, False
        if control & 2:
            entry = p[4] > 0 and p[5] >> 6 & 1
            at = 5 + p[4]
        if not control & 1:
            continue
        assert pid not in last or counter == (last[pid] + 1) % 16
        last[pid] = counter
        body = p[at:]
        if pids.get(pid) in ("tables", "map"):
            section = body[1 + body[0] :]
            section = section[: 3 + ((section[1] & 15) << 8 | section[2])]
            inner = section[8:-4]
            if pids[pid] == "tables":
                pids[(inner[2] & 31) << 8 | inner[3]] = "map"
            else:
                data = (inner[5] & 31) << 8 | inner[6]
        elif pid == data:
            if start:
                s = body[9:14]
                times.append((s[0] >> 1 & 7) << 30 | s[1] << 22 | (s[2] >> 1) << 15 | s[3] << 7 | s[4] >> 1)
                entries += bool(entry)
                units.append(body[9 + body[8] :])
            else:
                units[-1] += body
    return b"".join(units), times, entries


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 3071, 3072, 3073, 40_000, 123_457])
def test_streams_equal_a_plain_demultiplexer(size):
    data = random.Random(size).randbytes(size)
    stream = media.mux(media.payload_of(data))
    payload, times, entries = plain_demux(stream)
    back = media.demux(stream)
    assert payload == media.payload_of(data) == back["payload"] and times == back["timestamps"] and entries == len(back["random_access"])
    assert back["continuity_errors"] == back["table_errors"] == 0


def test_stages_take_odd_rows(spark, sf):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and ids with two texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    line = "the quick brown fox jumps over the lazy dog today and tomorrow while others watch"
    text = lambda n, k=977: " ".join(f"w{i % k}" for i in range(n))
    rows = [(900001, line), (900002, line), (900002, line), (900003, line + "\n" + text(50)), (900004, ""), (900005, None), (900006, " \n\t "), (None, line), (None, None), (900007, text(200000, 99991)), (900008, "one\n" * 3000), (900009, text(80, 7)), (900009, text(90, 89))]
    odd = spark.createDataFrame([(i, t, None, "src0" if i and i % 2 else None, None) for i, t in rows], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.union(odd) if name == "quality" else odd, sf)  # it learns from labelled rows of its input
        got = [r for r in out.collect() if r.doc_id is None or r.doc_id > 900000]
        ids = [r.doc_id for r in got]
        assert name == "packing" or out.columns == docs.columns, name
        if name == "quality":
            scores = quality.train(docs, quality.learnable(spark.read.parquet(f"{sf}/labels.parquet"))).score([(t or "").encode() for _, t in rows])
            assert sorted(map(str, ids)) == sorted(str(i) for (i, _), s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD)
        elif name == "line_dedup":
            assert sum(r.text is not None and line in r.text.split("\n") for r in got) == 1 and 900007 in ids and {r.text for r in got if r.doc_id in (900004, 900005)} == {"", None}
        elif name == "near_dup":
            assert ids.count(900001) == 1 and 900002 not in ids and ids.count(900009) == 2 and {900003, 900004, 900005, 900006, 900007} <= set(ids)
        elif name == "mixing":
            assert {None, 900001} & set(ids) and not {900004, 900005, 900006} & set(ids) and 900007 in ids
        else:
            assert {i for i, _ in rows} == set(ids) and sum(r.doc_tokens for r in got if r.doc_id == 900004 and r.start == 0) == 1
