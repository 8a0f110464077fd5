"""Periodic runs of words: descending-LCP Kruskal over the suffixes of a text.

Suffixes are sorted by prefix doubling.  Neighbours in suffix order are edges, weighted by their
longest common prefix (LCP).  Edges are taken by decreasing LCP; union-find keeps, for each class of
suffixes, its positions in order.  Positions x < y that become neighbours in a class at level l
agree for exactly l words; at a distance of at most l they seed a run of period y - x, which starts
at x if the word before x does not continue it.  Every run is seeded by its first two periods: no
position of their class lies between them, since it would give the run a smaller period.

A run of at least ``min_words`` words and ``min_periods`` periods needs an LCP that follows from
both, so edges below that are left out, and so are texts in which no stretch of so many words
comes twice.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import slices, utf8

SLICE_BYTES = 2 << 20
BLOCK = 1024
RUN = "array<struct<start:long,length:long,period:long>>"


class Positions:
    """An ordered set of positions in blocks, so that a large one takes in a new member cheaply."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, position: int):
        self.blocks, self.firsts, self.size = [[position]], [position], 1

    def _block(self, position: int) -> int:
        return max(0, bisect_left(self.firsts, position + 1) - 1)

    def add(self, position: int) -> None:
        b = self._block(position)
        block = self.blocks[b]
        insort(block, position)
        self.firsts[b] = block[0]
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[b:b + 1] = [block[:BLOCK], block[BLOCK:]]
            self.firsts[b:b + 1] = [block[0], block[BLOCK]]

    def around(self, position: int) -> tuple[int, int]:
        """The members before and after one member (-1: none)."""
        b = self._block(position)
        block = self.blocks[b]
        k = bisect_left(block, position)
        before = block[k - 1] if k else self.blocks[b - 1][-1] if b else -1
        after = block[k + 1] if k + 1 < len(block) else self.firsts[b + 1] if b + 1 < len(self.blocks) else -1
        return before, after

    def __iter__(self):
        for block in self.blocks:
            yield from block


def least_prefix(min_words: int, min_periods: int) -> int:
    """The least LCP that the first two periods of a long enough run have."""
    return max(1, min(max(min_words - q, (min_periods - 1) * q) for q in range(1, max(2, min_words))))


def repeating(codes: np.ndarray, owner: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Texts (numbers of ``owner``) in which some ``least`` consecutive words may come twice."""
    hashes = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    hashes ^= hashes >> np.uint64(29)
    out, done, step, power = np.zeros(len(codes), np.uint64), 0, 1, 0xBF58476D1CE4E5B9
    while step <= least:  # powers of two of the length, put together
        if least & step:
            shifted = np.zeros_like(out)
            shifted[:max(0, len(out) - done)] = hashes[done:]
            out = out * np.uint64(power) + shifted
            done += step
        longer = np.zeros_like(hashes)
        longer[:max(0, len(hashes) - step)] = hashes[step:]
        hashes = hashes * np.uint64(power) + longer
        power, step = power * power & (1 << 64) - 1, step * 2
    places = np.flatnonzero(ends - np.arange(len(codes)) >= least)
    keys = out[places] ^ (owner[places].astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    return np.unique(owner[places[order[1:][same]]])


def suffix_edges(codes: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in suffix order within one text and their LCP, where that is ``least`` or more.

    ``codes`` may hold several texts; suffixes end with their text.
    """
    n = len(codes)
    levels: list[np.ndarray] = []
    first = np.unique(owner.astype(np.int64) * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
    order = np.argsort(first, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(first[order]) != 0])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))  # rank: number of smaller classes' suffixes
    step, members, kept = 1, np.arange(n), None
    while True:
        levels.append(rank.astype(np.int32 if n < 2 ** 31 else np.int64))
        order = members[np.argsort(rank[members], kind="stable")]
        ranks = rank[order]
        alone = np.r_[True, ranks[1:] != ranks[:-1]] & np.r_[ranks[1:] != ranks[:-1], True]
        members = order[~alone]
        if step * 2 > least and kept is None:
            kept = np.sort(members)
        if not len(members):
            break
        ahead = members + step
        inside = ahead < n
        inside[inside] = owner[ahead[inside]] == owner[members[inside]]
        second = np.zeros(len(members), np.int64)
        second[inside] = rank[ahead[inside]] + 1
        order = np.lexsort((second, rank[members]))
        members, second = members[order], second[order]
        old = rank[members]
        place = np.arange(len(members))
        new_class = np.r_[True, old[1:] != old[:-1]]
        new_group = new_class | np.r_[True, second[1:] != second[:-1]]
        class_start = np.maximum.accumulate(np.where(new_class, place, 0))
        group_start = np.maximum.accumulate(np.where(new_group, place, 0))
        rank = rank.copy()
        rank[members] = old + group_start - class_start
        step *= 2
    if kept is None or len(kept) < 2:
        return (np.zeros(0, np.int64),) * 3
    suffixes = kept[np.argsort(rank[kept], kind="stable")]
    left, right = suffixes[:-1], suffixes[1:]
    lcp = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + lcp, right + lcp
        within = (a < n) & (b < n)
        same = np.zeros(len(left), bool)
        same[within] = levels[k][a[within]] == levels[k][b[within]]
        lcp[same] += 1 << k
    good = lcp >= least
    return left[good], right[good], lcp[good]


def seeded_runs(codes: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray, lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of two periods or more that the edges seed."""
    order = np.argsort(-lcp, kind="stable")
    parent: dict[int, int] = {}
    members: dict[int, Positions] = {}

    def find(x: int) -> int:
        if x not in parent:
            parent[x], members[x] = x, Positions(x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: list[tuple[int, int, int]] = []
    level, met = -1, []

    def settle() -> None:  # neighbours when all edges of a level are in
        for x, y in met:
            if y - x <= level and members[find(x)].around(x)[1] == y:
                if x == 0 or owner[x - 1] != owner[x] or codes[x - 1] != codes[y - 1]:
                    out.append((x, y - x + level, y - x))

    for a, b, common in zip(left[order].tolist(), right[order].tolist(), lcp[order].tolist()):
        if common != level:
            settle()
            level, met = common, []
        a, b = find(a), find(b)
        if members[a].size < members[b].size:
            a, b = b, a
        large, small = members[a], list(members.pop(b))
        parent[b] = a
        for x in small:
            large.add(x)
        for k, x in enumerate(small):
            before, after = large.around(x)
            if before >= 0 and (k == 0 or before != small[k - 1]):
                met.append((before, x))
            if after >= 0 and (k + 1 == len(small) or after != small[k + 1]):
                met.append((x, after))
    settle()
    return out


def runs_of(words: list[list[bytes]], min_words: int, min_periods: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    sizes = np.array([len(w) for w in words], np.int64)
    if not sizes.sum():
        return out
    codes = pa.array([w for text in words for w in text], pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    least = least_prefix(min_words, min_periods)
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    wanted = repeating(codes, owner, (starts + sizes)[owner], least)
    if not len(wanted):
        return out
    chosen = np.zeros(len(words), bool)
    chosen[wanted] = True
    inside = chosen[owner]
    codes, owner = codes[inside].astype(np.int64), owner[inside]
    moved = np.cumsum(np.where(chosen, sizes, 0)) - np.where(chosen, sizes, 0)
    for start, length, period in seeded_runs(codes, owner, *suffix_edges(codes, owner, least)):
        if length >= min_words and length >= min_periods * period:
            text = int(owner[start])
            out[text].append((start - int(moved[text]), length, period))
    for runs in out:
        runs.sort(key=lambda run: (run[0], run[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those behind the first period of a run, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept, done = [], 0
    for start, end in sorted((s + period, s + length) for s, length, period in runs):
        if start > done:
            kept.extend(words[done:start])
        done = max(done, end)
    return b" ".join(kept + words[done:])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 24, min_periods: int = 3) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row, in one pass without a shuffle.

    Words are what ASCII white space leaves; a run is a maximal stretch of words with smallest period
    ``period``, of at least ``min_words`` words and ``min_periods`` (2 or more) periods; ``runs`` are by
    start, then period; ``collapsed`` keeps of each run its first period.  A null or empty text has no
    words, no runs and collapses to an empty text; repeated rows and ids are judged each on its own; an
    id may be null; an empty table gives no rows; other columns are not looked at.  Memory goes with the
    longest text (about 200 bytes a word where all of it repeats).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if min_periods < 2 or min_words < 1:
        raise ValueError("a run has two periods at least")

    def run(batches):
        for batch in slices(batches, "body", SLICE_BYTES):
            words = [text.split() for text in utf8(batch.column("body"))]
            runs = runs_of(words, min_words, min_periods)
            ends = pa.array(np.cumsum([0, *map(len, runs)]).astype(np.int32))
            flat = np.array([r for found in runs for r in found], np.int64).reshape(-1, 3)
            fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
            yield pa.record_batch([batch.column("id"), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(ends, fields),
                                   pa.array([collapse(w, r) for w, r in zip(words, runs)], pa.binary()).cast(pa.string())],
                                  names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, runs {RUN}, collapsed string").withColumnRenamed("id", id_col)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of which every tenth, by a hash of its id, repeats the words behind a place of its own.

    With h the crc32 of the decimal id and g = h div 10, a text of n > 0 words with h % 10 = 0 takes for
    each word i >= a = g % n the word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8).  Other texts and
    null ids stay as they are.
    """
    hashed = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    spread = """array_join(transform(sequence(0, n - 1), i -> words[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS INT)]), ' ')"""
    chosen = F.expr("h % 10 = 0 AND n > 0")
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), hashed.alias("h"),
                      F.when(hashed % 10 == 0, words).alias("words"), *([F.struct(*rest).alias("others")] if rest else []))
    out = out.withColumn("n", F.coalesce(F.size("words"), F.lit(0)).cast("long"))
    out = out.withColumn("a", F.when(chosen, F.expr("(h div 10) % n")))
    out = out.withColumn("p", F.when(chosen, F.expr("1 + (n - a) div (3 + (h div 10) % 8)")))
    return out.select(F.col("id").alias(id_col), F.when(chosen, F.expr(spread)).otherwise(F.col("body")).alias(text_col),
                      *([F.col(f"others.`{c}`") for c in rest]))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the run of most periods, and digests of all runs and of the collapsed text."""
    ahead = """array_sort(runs, (x, y) -> CASE WHEN x.length * y.period <> y.length * x.period
                                               THEN IF(x.length * y.period > y.length * x.period, -1, 1)
                                               WHEN x.start <> y.start THEN IF(x.start < y.start, -1, 1)
                                               ELSE CAST(x.period - y.period AS INT) END)"""
    best = F.when(F.size("runs") > 0, F.element_at(F.expr(ahead), 1))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        F.col(id_col), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
