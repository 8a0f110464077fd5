"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a window of consecutive words; windows overlap so far that every phrase lies
whole in the window that owns its first word.  Tokens are ordered by their frequency in the
whole corpus, rarest first.  A block meets a template when it holds the stated share of the
template's distinct tokens.  Prefix, length and positional filters name the candidates
without losing one; candidates are then counted exactly, and phrases that must stand
word for word are compared in place.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import slices, utf8

# Everything outside 0-9, a-z and non-ASCII separates words; A-Z becomes a-z.
TO_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

STRIDE = 32
# The templates are broadcast with the closure; this bounds them.
MAX_TEMPLATE_WORDS = 50_000


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    percent: int  # of the distinct tokens that a block must hold
    exact: bool = False  # the words must also stand one after the other


def template(label: str, text: str, percent: int = 80) -> Template:
    return Template(label, tuple(text.split()), percent)


# The base phrases and the notices of common licenses.
BASE = [
    Template("cc-by", ("cc", "by"), 100, True),
    Template("gpl", ("general", "public", "license"), 100, True),
    Template("reserved", ("all", "rights", "reserved"), 100, True),
]
NOTICES = [
    template("apache-2.0", "licensed under the apache license version 2 0", 85),
    template("mit", "released under the mit license", 100),
    template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    template("gpl-3.0", "this work is licensed under the gnu general public license version 3", 85),
    template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    template("cc-by-nc-4.0", "licensed under cc by nc 4 0", 100),
    template("cc-by-sa-4.0", "licensed under cc by sa 4 0", 100),
    template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    template("unlicense", "this is free and unencumbered software released into the public domain"),
]
PRODUCTION = BASE + NOTICES


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def needed(distinct: int, percent: int) -> int:
    return -(-percent * distinct // 100)


def token_counts(docs: DataFrame, vocabulary: set[bytes], text_col: str) -> dict[bytes, int]:
    """Places of every template token in all texts: a row for each token and task, summed by Spark."""

    def run(batches):
        counts: Counter[bytes] = Counter()
        for batch in slices(batches, "body"):
            for text in utf8(batch.column("body")):
                counts.update(w for w in words_of(text) if w in vocabulary)
        yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

    rows = docs.select(F.col(text_col).alias("body")).mapInArrow(run, "token binary, n long")
    summed = rows.groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r["token"]): r["n"] for r in summed.collect()}  # at most one row for each template token


class Index:
    """Templates under a global token order, with an inverted list for each prefix token."""

    def __init__(self, templates: list[Template], counts: dict[bytes, int], stride: int):
        tokens = {w.encode() for t in templates for w in t.words}
        order = {w: i for i, w in enumerate(sorted(tokens, key=lambda w: (counts.get(w, 0), w)))}
        self.order, self.stride = order, stride
        self.templates = [(t.label, [w.encode() for w in t.words], t.exact) for t in templates]
        self.sets = [sorted({order[w] for w in words}) for _, words, _ in self.templates]
        self.members = [frozenset(s) for s in self.sets]
        self.overlap = [needed(len(s), t.percent) for s, t in zip(self.sets, templates)]
        self.smallest = min(self.overlap)
        self.window = stride + max(len(t.words) for t in templates) - 1
        self.lists: dict[int, list[tuple[int, int]]] = {}
        for k, (tokens_k, least) in enumerate(zip(self.sets, self.overlap)):
            for place, token in enumerate(tokens_k[:len(tokens_k) - least + 1]):
                self.lists.setdefault(token, []).append((k, place))

    def blocks(self, words: list[bytes]):
        """(start, distinct template tokens in order) of the blocks that could meet a template."""
        hits: dict[int, set[int]] = {}
        order, stride, reach = self.order, self.stride, self.window
        for place, word in enumerate(words):
            token = order.get(word)
            if token is not None:
                for block in range(max(0, (place - reach) // stride + 1), place // stride + 1):
                    hits.setdefault(block, set()).add(token)
        for block, held in hits.items():
            if len(held) >= self.smallest:
                yield block * stride, sorted(held)

    def search(self, held: list[int]):
        """(template, tokens in common) for the templates that a block meets."""
        found = set()
        size, lists = len(held), self.lists
        for place, token in enumerate(held):
            for k, at in lists.get(token, ()):
                if k in found:
                    continue
                least = self.overlap[k]
                if size < least or place > size - least:  # length filter, the block's own prefix
                    continue
                if 1 + min(len(self.sets[k]) - at, size - place) - 1 < least:  # positional filter
                    continue
                found.add(k)
                common = len(self.members[k].intersection(held))
                if common >= least:
                    yield k, common

    def scan(self, text: bytes):
        words = words_of(text)
        base_places, base_labels, labels, score = set(), set(), set(), 0.0
        for start, held in self.blocks(words):
            for k, common in self.search(held):
                label, phrase, exact = self.templates[k]
                share = common / len(self.sets[k])
                if exact:
                    last = min(start + self.stride, len(words) - len(phrase) + 1)
                    places = [p for p in range(start, last) if words[p] == phrase[0] and words[p:p + len(phrase)] == phrase]
                    if not places:
                        continue
                    base_places.update((p, label) for p in places)
                    base_labels.add(label)
                labels.add(label)
                score = max(score, share)
        starts = [p for p, _ in base_places]
        return (len(words), len(base_places), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(base_labels)), ",".join(sorted(labels)), score)


RESULT = [("n_words", "long", pa.int64()), ("n_base", "long", pa.int64()), ("first_word", "long", pa.int64()), ("last_word", "long", pa.int64()),
          ("base_labels", "string", pa.string()), ("labels", "string", pa.string()), ("score", "double", pa.float64())]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] | None = None,
                  stride: int = STRIDE) -> DataFrame:
    """One row per input row: words, places of the word-for-word phrases, labels, best share.

    Null and empty texts have no words, no labels and score 0; repeated rows and ids are
    scanned each on its own; an id may be null; an empty table gives no rows; other columns
    are not looked at.  No text is shuffled: the token counts are the only exchange.
    """
    templates = PRODUCTION if templates is None else templates
    if sum(len(t.words) for t in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words are not broadcast")
    counts = token_counts(docs, {w.encode() for t in templates for w in t.words}, text_col)
    index = Index(templates, counts, stride)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "body"):
            columns = zip(*map(index.scan, utf8(batch.column("body"))))
            yield pa.record_batch([batch.column("id"), *(pa.array(c, t) for c, (_, _, t) in zip(columns, RESULT))],
                                  names=["id", *(n for n, _, _ in RESULT)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} {t}" for n, t, _ in RESULT)).withColumnRenamed("id", id_col)
