"""License scan: phrases that state a license, and text blocks that contain a license template.

Phrases are found wherever their words stand consecutively. Templates are found by an exact set-similarity join of
blocks and templates: a block matches where it holds at least ``percent`` of the template's distinct words. Blocks have
no more words than the template: lines, and runs of as many words as the template has, in longer lines and across line
ends. So a wrapped notice and one inside a long line are found, and words scattered over a long line are none.
Template words are ordered by their count over all documents, rarest first; a matching block must hold one of the first
n - ceil(percent * n / 100) + 1 of them (prefix filter), be long enough (length filter), and, its first such word
being number i, n - i words must suffice (positional filter). What passes is verified on whole sets.

The templates are a short fixed list, so their side is sent to every task; documents are read once for the counts and
once for the scan, without a shuffle but for the counts of template words.

Defined results: null and empty texts have no words and no labels; rows are independent of each other, so null and
repeated ids are rows of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import ascii_lower, small_batches, text_bytes

# The contract's phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Opening sentences of public licenses, and how pages commonly state them.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-program", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
PERCENT = 90
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MATCH = pa.struct([("label", pa.string()), ("line", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())])
_SCHEMA = "doc_id long, n_words long, phrases array<struct<label: string, word: long>>, blocks array<struct<label: string, line: long, first_word: long, n_words: long, containment: double>>"


def word_counts(docs: DataFrame, vocabulary: list[str], text_column: str = "text") -> dict[str, int]:
    """How often each word of a fixed vocabulary occurs in all documents."""
    own = F.filter(F.split(ascii_lower(F.col(text_column)), SEPARATORS), lambda w: w.isin(vocabulary))
    words = docs.select(F.explode(own).alias("w"))
    return {w: 0 for w in vocabulary} | {r.w: r["count"] for r in words.groupBy("w").count().collect()}


class Index:
    """Templates by the words of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[str, int], percent: int) -> None:
        self.sets: list[tuple[str, set[bytes], int]] = []
        self.prefixes: dict[bytes, list[tuple[int, int]]] = {}
        for t, (label, text) in enumerate(templates):
            words = sorted(set(text.split()), key=lambda w: (counts.get(w, 0), w))
            need = -(-percent * len(words) // 100)
            self.sets.append((label, {w.encode() for w in words}, need))
            for i, w in enumerate(words[: len(words) - need + 1]):
                self.prefixes.setdefault(w.encode(), []).append((t, i))
        self.rare = frozenset(self.prefixes)
        self.sizes = [len(text.split()) for _, text in templates]

    def matches(self, words: list[bytes], short: bool = False) -> Iterator[tuple[str, float]]:
        """Templates that a block matches; ``short``: only those with as many words as the block or more."""
        if self.rare.isdisjoint(words):
            return
        block = set(words)
        first: dict[int, int] = {}
        for w in block & self.rare:
            for t, i in self.prefixes[w]:
                first[t] = min(i, first.get(t, i))
        for t, i in sorted(first.items()):
            label, whole, need = self.sets[t]
            if short and len(words) > self.sizes[t]:
                continue
            if len(block) >= need and len(whole) - i >= need and (both := len(whole & block)) >= need:
                yield label, both / len(whole)

    def windows(self, words: list[bytes]) -> Iterator[tuple[str, int, int, float]]:
        """Templates in runs of as many words as they have, wherever the lines end: label, first word, words, containment.

        Runs that hold enough of a template and overlap are one match, the fullest (of equals, the first). Only runs with
        a word of the template's prefix are looked at.
        """
        if self.rare.isdisjoint(words):
            return
        places: dict[int, list[int]] = {}
        for at, w in enumerate(words):
            for t, _ in self.prefixes.get(w, ()):
                places.setdefault(t, []).append(at)
        for t, rare in sorted(places.items()):
            label, whole, need = self.sets[t]
            size = self.sizes[t]
            if len(words) < need:
                continue
            stretches: list[list[int]] = []
            for at in rare:  # stretches of words that some window with a rare word covers
                begin, end = max(0, at - size + 1), min(len(words), at + size)
                if stretches and begin <= stretches[-1][1]:
                    stretches[-1][1] = end
                else:
                    stretches.append([begin, end])
            for begin, end in stretches:
                width = min(size, end - begin)
                held: dict[bytes, int] = {}
                best: tuple[int, int] | None = None
                for i in range(begin, end):
                    if words[i] in whole:
                        held[words[i]] = held.get(words[i], 0) + 1
                    if (out := i - width) >= begin and words[out] in whole:
                        held[words[out]] -= 1
                        if not held[words[out]]:
                            del held[words[out]]
                    lo = i - width + 1
                    if lo < begin:
                        continue
                    if best and lo >= best[1] + width:
                        yield label, best[1], width, best[0] / len(whole)
                        best = None
                    if len(held) >= need and (best is None or len(held) > best[0]):
                        best = (len(held), lo)
                if best:
                    yield label, best[1], width, best[0] / len(whole)


def _scan(batches: Iterator[pa.RecordBatch], index: Index, phrases: dict[str, str]) -> Iterator[pa.RecordBatch]:
    wanted = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
    for batch in batches:
        counts, found, blocks = [], [], []
        for text in text_bytes(batch.column(1)):
            words: list[bytes] = []
            own = []
            starts = []
            for number, line in enumerate(text.split(b"\n")):
                part = line.translate(_FOLD).split()
                starts.append(len(words))
                for label, share in index.matches(part, short=True):
                    own.append({"label": label, "line": number, "first_word": len(words), "n_words": len(part), "containment": share})
                words += part
            starts.append(len(words))
            for label, first, n, share in index.windows(words):
                line = bisect_right(starts, first, 0, len(starts) - 1) - 1
                if starts[line + 1] < first + n or starts[line + 1] - starts[line] > n:  # else the line is the block
                    own.append({"label": label, "line": line, "first_word": first, "n_words": n, "containment": share})
            places = []
            joined = b" " + b" ".join(words) + b" "
            for pattern, label in wanted:
                at, counted, word = joined.find(pattern), 0, 0
                while at >= 0:
                    word += joined.count(b" ", counted, at)
                    counted = at
                    places.append({"label": label, "word": word})
                    at = joined.find(pattern, at + 1)
            counts.append(len(words))
            found.append(places)
            blocks.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))), pa.array(blocks, pa.list_(_MATCH))], ["doc_id", "n_words", "phrases", "blocks"])


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, phrases (label, word) and blocks (label, line, first_word, n_words, containment)."""
    templates = TEMPLATES if templates is None else templates
    index = Index(templates, word_counts(docs, sorted({w for _, t in templates for w in t.split()}), text_column), percent)
    rows = small_batches(docs).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(lambda it: _scan(it, index, PHRASES if phrases is None else phrases), _SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns. The score is the best containment of a template, or 1 with a phrase."""
    return found.selectExpr(
        "doc_id", "n_words", "cast(size(phrases) as bigint) n_base", "array_min(phrases.word) first_word", "array_max(phrases.word) last_word",
        "array_join(array_sort(array_distinct(phrases.label)), ',') base_labels", "array_join(array_sort(array_distinct(concat(phrases.label, blocks.label))), ',') labels",
        "case when size(phrases) > 0 then 1e0 else coalesce(array_max(blocks.containment), 0e0) end score",
    )
