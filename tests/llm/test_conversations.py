"""Conversation repair against all edits of small conversations, over block edges, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from skyfold.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, audit string, block int, digest string"
EMPTY = hashlib.sha256(b"").hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "d") for r in rows], SCHEMA)


def damaged(rows):
    """What is left of (conv_id, turn, role, text), each conversation in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        role = "user" if kind == 4 else role
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())) for k, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        words = text.strip(c.BLANKS)
        out.append("b" if not words else "d" if (role, text) in seen else "t" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """By trying every edit of every row and up to two inserts before it: (cost, audit, repaired)."""
    found, best = faults(rows), [(3 * len(rows) + 9, "", "")]
    form = re.compile(r"(s?(ua)+)?\Z")

    def go(i, cost, audit, turns):
        if cost > best[0][0]:
            return
        if i == len(rows):
            for k in range(3):
                for more in itertools.product(("user", "assistant"), repeat=k):
                    whole = turns + [(r, "") for r in more]
                    if form.match("".join(r[:1] for r, _ in whole)):
                        way = (cost + 2 * k, audit + "I" * k, "\n".join(f"{r}:{t}" for r, t in whole))
                        best[0] = min(best[0], way)
            return
        _, role, text = rows[i]
        for k in range(3):
            for more in itertools.product(("user", "assistant"), repeat=k):
                before = turns + [(r, "") for r in more]
                if re.match(r"(s?(ua)*u?)?\Z", "".join(r[:1] for r, _ in before)):
                    go(i + 1, cost + 2 * k + 3, audit + "I" * k + "D", before)
                    if found[i] not in ("b", "d"):
                        for e, r, w in [("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)]:
                            if re.match(r"s?(ua)*u?\Z", "".join(x[:1] for x, _ in before) + (r[:1] or "-")):
                                go(i + 1, cost + 2 * k + w + (found[i] == "t"), audit + "I" * k + e, before + [(r, text)])

    go(0, 0, "", [])
    return best[0]


def plain(rows):
    out = {conv: (0, 0, 0, 0, 0, 0, "", EMPTY) for conv, *_ in rows}
    for conv, left in damaged(rows).items():
        if left:
            cost, audit, repaired = cheapest(left)
            turns, found = [t for t, _, _ in left if t is not None], faults(left)
            gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
            illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(left))
            out[conv] = (gaps, found.count("b"), found.count("d"), found.count("t"), illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest())
    return out


def texts(rng):
    return rng.choice(["Yes.", "No!", "Why?", "cut", "cut off", "", "  ", "Same.", "Same.", f"Long {rng.randrange(9)}.", None])


@pytest.mark.parametrize("parts", ["1", "7"])
def test_equals_all_edits(spark, parts):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    rows = [(conv if conv % 50 else None, rng.choice([t, t, t + 1, None]), rng.choice(roles), texts(rng)) for conv in range(120) for t in range(rng.randrange(1, 6))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.conv_id: tuple(r)[1:] for r in c.repair(frame(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = plain([r for r in rows if r[0] is not None])
    assert {k: v for k, v in got.items() if k is not None} == want and None in got


def test_blocks_of_one_conversation_add_up(spark):
    """One conversation with nearly all rows, over many tasks: as one task repairs it."""
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system", "tool"]), rng.choice(["A.", "b", f"{t}.", f"{t}", ""])) for t in range(3000)] + [(2, 1, "user", "Hi."), (0, 1, "user", "Hi.")]
    got = {}
    for parts in ("1", "16"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got[parts] = sorted(map(tuple, c.repair(frame(spark, rows)).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got["1"] == got["16"] and len(got["1"]) == 3
    one = c.Repair()
    left = damaged(rows)[1]
    codes = {"": c.SOUND, "b": c.BLANK, "d": c.DUPLICATE, "t": c.CUT}
    one.feed([c.Row(t, r, x, 1, codes[f]) for (t, r, x), f in zip(left, faults(left), strict=True)], c.END)
    assert got["1"][1] == (1, *one.result())


def test_odd_rows(spark):
    assert c.repair(frame(spark, [])).count() == 0
    gone = next(i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (None, None, None, None), (900, 1, "user", "Long " + "word " * 200000 + "end."), (900, 2, "assistant", "Yes.")] + [(901, 3, "user", "Same.")] * 400
    got = {r.conv_id: r for r in c.repair(frame(spark, rows)).collect()}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", EMPTY)
    assert (got[None].blank, got[None].audit) == (1, "D") and got[900].audit in ("KK", "KD", "DK", "DD")[:1] + ("KDKD",)
    assert got[901].duplicate == 399 and got[901].audit == "K" + "D" * 399 + "I" and got[901].cost == 399 * 3 + 2
