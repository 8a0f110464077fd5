"""Mixing sources to target weights by subset sums.

The size of a document is its number of words.  A source's target is met by whole rounds of
the source plus a part of it.  For the part, documents are counted by exact size; every size
gives its proportional number, fractions rounded by the seed, and a bounded-knapsack dynamic
program over the documents left picks how many more of each size close the small gap.  Which
documents of a size are taken follows from a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import slices, staged, utf8

WEIGHTS = (3, 1, 2)
# The dynamic program covers gaps up to this many words; larger gaps are first narrowed by further proportional rounds.
DP_WORDS = 1 << 16
# Hash buckets a (source, size) is dealt into, so that one common size is not ranked in one task.
BUCKETS = 256
MAX_SOURCES = 100_000


def targets(sizes: dict, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict:
    """Words wanted from each source: ``share`` of all, by weight, at most ``most`` times its size.

    Sources in code point order, null last; what a full source cannot take is shared out
    again by weight among the others.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in set(full)]
    return out


def rounded_up(rest: list[int], total: int, rng: np.random.Generator) -> np.ndarray:
    """Which of the shares ``rest[i] / total`` become one: each with that probability, by ordered pivotal sampling.

    Two neighbours at a time settle one of them and hand the other on, so that the number chosen
    up to any place differs from the sum of the shares up to there by less than one.
    """
    up = np.zeros(len(rest), dtype=np.int64)
    open_, share = -1, 0
    for i, r in enumerate(rest):
        if not r:
            continue
        if not share:
            open_, share = i, r
            continue
        both = share + r
        if both <= total:  # one of them is out, the other goes on with both shares
            if rng.random() * both < r:
                open_ = i
            share = both
        else:  # one of them is in, the other goes on with what is left
            left = both - total
            if rng.random() * (2 * total - both) < total - r:
                up[open_], open_ = 1, i
            else:
                up[i] = 1
            share = left
        if share == total:
            up[open_], share = 1, 0
    if share and rng.random() * total < share:
        up[open_] = 1
    return up


def knapsack(sizes: np.ndarray, left: np.ndarray, gap: int, turn: np.ndarray) -> np.ndarray:
    """How many of each size, at most ``left``, for the largest sum up to ``gap``; sizes are tried in the order ``turn``.

    Reachable sums are the bits of one integer, a count is split into powers of two, and the sums
    before each piece tell the way back.
    """
    more = np.zeros_like(left)
    reach, steps, within = 1, [], (1 << (gap + 1)) - 1
    for i in turn:
        size, n, piece = int(sizes[i]), int(left[i]), 1
        if size <= 0 or size > gap:
            continue
        n = min(n, gap // size)
        while n > 0 and not reach >> gap & 1:
            k = min(piece, n)
            steps.append((i, k, reach))
            reach |= reach << (k * size) & within
            n, piece = n - k, piece * 2
    best = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> best & 1:
            more[i] += k
            best -= k * int(sizes[i])
    return more


def closest_subset(sizes: np.ndarray, counts: np.ndarray, goal: int, seed: int = 17) -> np.ndarray:
    """How many of each size to take, at most ``counts``, so that the sum comes closest to ``goal`` from below.

    Every size gets its proportional number; the fractions that are left are rounded by the seed,
    in order of size, so that all sizes have their share and the sum is off by about the two longest
    documents at most.  What is too much is given back, and while the gap is above DP_WORDS the same
    is done with the documents left.  The knapsack closes what remains; where it cannot, some
    documents are given back, so that it has more to choose from.
    """
    total = int((sizes * counts).sum())
    taken = np.zeros_like(counts)
    if total <= 0 or goal <= 0:
        return taken
    gap = goal = min(goal, total)
    rng = np.random.default_rng(seed)
    turn = rng.permutation(len(sizes))
    order = np.argsort(sizes, kind="stable")
    first = True
    while first or gap > DP_WORDS:
        first = False
        left = np.where((sizes > 0) & (sizes <= gap), counts - taken, 0)
        room = int((sizes * left).sum())
        if room <= gap:
            taken += left
            gap -= room
            break
        more = np.array([int(c) * gap // room for c in left], dtype=counts.dtype)
        more[order] += rounded_up([int(left[i]) * gap % room for i in order], room, rng)
        gap -= int((sizes * more).sum())
        for i in turn:
            if gap >= 0:
                break
            if more[i]:
                more[i] -= 1
                gap += int(sizes[i])
        taken += more
    taken += knapsack(sizes, counts - taken, gap, turn)
    gap = goal - int((sizes * taken).sum())
    step, least = 1, goal % int(np.gcd.reduce(sizes[counts > 0]))
    while gap > least and step <= len(sizes):  # a small gap may have no subset: widen it by documents given back
        wide = taken.copy()
        given = [i for i in turn if sizes[i] > 0 and wide[i]][:step]
        wide[given] -= 1
        room = goal - int((sizes * wide).sum())
        if not given or room > DP_WORDS:
            break
        wide += knapsack(sizes, counts - wide, room, turn)
        if goal - int((sizes * wide).sum()) < gap:
            taken, gap = wide, goal - int((sizes * wide).sum())
        step *= 2
    return taken


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(id, source, name, size, order, bucket) of each row: its words and its place in the seeded order.

    ``name`` is the source as a text that is never null, so that grouping, ranking and joining share one partitioning.
    """
    kinds = {name: docs.schema[name].dataType.simpleString() for name in (id_col, source_col)}

    def run(batches):
        for batch in slices(batches, "body"):
            sizes = pa.array([len(text.split()) for text in utf8(batch.column("body"))], pa.int64())
            yield pa.record_batch([batch.column("id"), batch.column("source"), sizes], names=["id", "source", "size"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("body"))
    rows = rows.mapInArrow(run, f"id {kinds[id_col]}, source {kinds[source_col]}, size long")
    order = F.xxhash64(F.lit(seed), F.col("id").cast("string"))
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return rows.withColumn("name", name).withColumn("order", order).withColumn("bucket", F.pmod(F.col("order"), F.lit(BUCKETS)).cast("int"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17,
          weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken (words, repeats counted).

    A null text has size 0; a null source is a source of its own, the last one; rows that are
    equal in id, source and size are taken one by one like any others; a null id takes part like
    any other; an empty table gives no rows; other columns are not looked at.
    """
    rows = staged(sized(docs, id_col, text_col, source_col, seed), "sizes")
    cells = staged(rows.groupBy("source", "name", "size", "bucket").count(), "cells")
    by_size = cells.groupBy("source", "name", "size").agg(F.sum("count").alias("count"))
    totals = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["source"]: int(r["n"]) for r in totals}
    wanted = targets(sizes, weights, share, most)
    kind = docs.schema[source_col].dataType.simpleString()
    spark = rows.sparkSession
    plan = spark.createDataFrame([(s, n, float(wanted[s])) for s, n in sizes.items()], f"source {kind}, source_size long, target double")

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size", kind="stable")
        whole, goal = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        rounds = int(goal // whole) if whole else 0
        part["rounds"] = rounds
        own = xxhash.xxh3_64_intdigest(part["name"].iloc[0].encode(), seed=seed & (1 << 64) - 1)
        part["more"] = closest_subset(part["size"].to_numpy(), part["count"].to_numpy(), int(round(goal - rounds * whole)), own)
        return part[["name", "size", "source_size", "target", "rounds", "more"]]

    # One row for each exact size of a source, whatever its number of documents.
    picks = (by_size.join(F.broadcast(plan), by_size["source"].eqNullSafe(plan["source"]))  # at most MAX_SOURCES rows
             .select(by_size["source"], "name", "size", "count", "source_size", "target")
             .groupBy("name").applyInPandas(fill, "name string, size long, source_size long, target double, rounds long, more long"))
    picks = staged(picks, "picks")
    before = Window.partitionBy("name", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # Both sides grow with the number of exact sizes: merged, never broadcast.
    dealt = (cells.join(picks.hint("merge"), ["name", "size"])
             .withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))  # at most BUCKETS rows in a partition
             .select("name", "size", "bucket", "source_size", "target", "rounds",
                     F.greatest(F.lit(0), F.least(F.col("count"), F.col("more") - F.col("before"))).alias("take")))
    place = F.row_number().over(Window.partitionBy("name", "size", "bucket").orderBy("order", F.col("id").cast("string")))
    out = rows.withColumn("place", place).join(dealt.hint("merge"), ["name", "size", "bucket"])
    taken = F.col("size") * (F.col("rounds") + (F.col("place") <= F.col("take")).cast("long"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17,
        weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixture itself: rows of ``docs`` as often as the plan takes them, columns unchanged.

    Documents without a word weigh nothing and stay once; rows that share an id are taken each on its
    own; rows equal in every column are interchangeable.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    id_name, body, source = (f"c{names.index(c)}" for c in (id_col, text_col, source_col))
    plain = plain.withColumn("hash", F.xxhash64(*plain.columns))
    plan = mixed(plain.withColumn("row", F.struct(F.col(id_name).alias("id"), "hash")), "row", body, source, seed, weights, share, most)
    times = F.when(F.col("size") == 0, 1).otherwise((F.col("taken") / F.col("size")).cast("int"))
    repeats = staged(plan.groupBy("row").agg(F.sum(times).alias("times"), F.count("*").alias("copies")).where("times > 0")
                     .select("row.id", F.col("row.hash").alias("row_hash"), "times", "copies"), "repeats")

    def taken(rows: DataFrame, part: DataFrame) -> DataFrame:
        joined = rows.join(part, (rows["hash"] == part["row_hash"]) & rows[id_name].eqNullSafe(part["id"]))
        return joined.select(*rows.columns, "times")

    out, equal = taken(plain, repeats.where("copies = 1")), repeats.where("copies > 1")
    if not equal.isEmpty():
        out = out.unionByName(taken(plain, equal).dropDuplicates())
    return out.select(*plain.columns, F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).drop("copy", "hash").toDF(*names)
