"""Embedding near-duplicates by a forest of random-projection trees.

The trees are fitted on a bounded sample and index every vector: a node projects on a random
direction and splits at the sample's median; what lies near the median goes both ways.  A vector
travels once to each small subtree that it reaches, and goes on to the leaves there.  Vectors
of one leaf are compared exactly, in pairs of blocks where a leaf is large, and the links of all
trees are joined to components.  Within a component every pair is compared once more, block by
block, so that a vector's number of links does not depend on the tree that found it.

Equal vectors are one class from the start, so copies are never compared with one another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import staged
from plinth.llm.components import components
from plinth.llm.ngram_join import EDGES, in_blocks

# Vectors the trees are fitted on; every vector is indexed whatever this is.
SAMPLE = 20_000
TREES, LEAF, SPILL = 16, 200, 0.06
MAX_DEPTH = 48
# Vectors of a subtree that go to one task together, as the sample tells.
SUBTREE = 8192
# Vectors of a leaf or component that meet in one task.
BLOCK = 1024


class Tree:
    """Directions, thresholds and children of the inner nodes, and whether a subtree is small; a negative child is a leaf."""

    def __init__(self, sample: np.ndarray, rows: int, rng: np.random.Generator, leaf: int, spill: float):
        self.directions, self.low, self.high, self.children, self.small, self.leaves = [], [], [], [], [], 0
        self._grow(sample, rows / max(1, len(sample)), rng, leaf, spill, 0)

    def _grow(self, part: np.ndarray, scale: float, rng, leaf: int, spill: float, depth: int) -> int:
        direction = rng.standard_normal(part.shape[1])
        projected = part @ direction
        if len(part) * scale <= leaf or len(part) < 4 or depth == MAX_DEPTH or projected.min() == projected.max():
            self.leaves += 1
            return -self.leaves
        low, high = np.quantile(projected, [0.5 - spill, 0.5 + spill])
        node = len(self.low)
        self.directions.append(direction), self.low.append(low), self.high.append(high), self.children.append((0, 0))
        self.small.append(len(part) * scale <= SUBTREE)
        left, right = projected <= high, projected >= low
        if left.all() and right.all():  # nothing but ties: spilling would not end
            left = right = projected <= low
            right = ~left
            self.low[node] = self.high[node] = low
            if left.all():
                self.directions.pop(), self.low.pop(), self.high.pop(), self.children.pop(), self.small.pop()
                self.leaves += 1
                return -self.leaves
        self.children[node] = (self._grow(part[left], scale, rng, leaf, spill, depth + 1), self._grow(part[right], scale, rng, leaf, spill, depth + 1))
        return node

    @classmethod
    def of(cls, parts: tuple) -> Tree:
        tree = object.__new__(cls)
        tree.directions, tree.low, tree.high, tree.children, tree.small = parts
        return tree

    def top(self) -> int:
        return 0 if self.low else -1

    def place(self, vectors: np.ndarray, start: int, whole: bool):
        """(rows, node) of all nodes below ``start`` that the vectors reach: leaves, or where not ``whole`` the first small subtrees too."""
        todo = [(start, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0 or not whole and self.small[node]:
                yield rows, node
                continue
            projected = vectors[rows] @ self.directions[node]
            left, right = self.children[node]
            todo.append((left, rows[projected <= self.high[node]]))
            todo.append((right, rows[projected >= self.low[node]]))


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)  # the largest component first: no overflow of squares
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def classes_of(rows: DataFrame) -> DataFrame:
    """(id, key, vec) of every row; key and vec are null where the vector links with nothing."""
    finite = F.forall("vec", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists("vec", lambda x: x != 0)
    vec = F.when(F.coalesce(finite, F.lit(False)), F.transform("vec", lambda x: x + F.lit(0).cast("float")))  # -0 is 0
    usable = rows.withColumn("vec", vec)
    key = F.concat(F.unhex(F.md5(F.array_join(F.col("vec").cast("array<string>"), ","))), F.unhex(F.lpad(F.hex(F.size("vec")), 8, "0")))
    return usable.withColumn("key", F.when(F.size("vec") > 0, key))


def leaf_edges(classes: DataFrame, trees: int, leaf: int, spill: float, least: float, seed: int) -> DataFrame:
    """Edges between vectors of one leaf that reach the cosine, as stars of who hangs together."""
    rows = classes.count()
    sample = classes.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vec").toArrow()
    if not sample.num_rows:
        return classes.sparkSession.createDataFrame([], EDGES)
    points = unit(matrix(sample.column("vec")))
    forest = [Tree(points, rows, np.random.default_rng([seed, t]), leaf, spill) for t in range(trees)]
    plain = [(t.directions, t.low, t.high, t.children, t.small) for t in forest]
    shared = classes.sparkSession.sparkContext.broadcast(plain)  # bounded by SAMPLE, TREES and MAX_DEPTH

    def place(batches):
        grown = [Tree.of(parts) for parts in shared.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = unit(matrix(batch.column("vec")))
            found = [(rows, number, node) for number, tree in enumerate(grown) for rows, node in tree.place(vectors, tree.top(), whole=False)]
            rows = np.concatenate([f[0] for f in found])
            order = np.argsort(rows, kind="stable")
            tree, node = (np.repeat(np.array([f[k] for f in found], dtype=np.int32), [len(f[0]) for f in found])[order] for k in (1, 2))
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(vectors)))]).astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(tree), pa.array(node)], names=["tree", "node"]))
            yield pa.record_batch([batch.column("key"), batch.column("vec"), cells], names=["key", "vec", "cells"])

    placed = staged(classes.select("key", "vec").mapInArrow(place, "key binary, vec array<float>, cells array<struct<tree: int, node: int>>"), "placed")
    reached = placed.select("key", "vec", F.inline("cells"))
    large = staged(reached.where("node < 0").groupBy("tree", "node").count().where(F.col("count") > BLOCK), "leaves")
    sized = reached.join(large, ["tree", "node"], "left").withColumn("count", F.coalesce("count", F.lit(1)))
    groups = in_blocks(sized, "count", BLOCK).select("tree", "node", "x", "y", "key", "vec").groupBy("tree", "node", "x", "y")

    def compare(group: tuple, table: pa.Table) -> pa.Table:
        number, start = group[0].as_py(), group[1].as_py()
        keys = table.column("key").to_pylist()
        vectors = unit(matrix(table.column("vec")))
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
        rank = np.empty(len(keys), dtype=np.int64)
        rank[order] = np.arange(len(keys))
        found = [np.zeros((0, 2), dtype=np.int64)]
        for rows, _ in Tree.of(shared.value[number]).place(vectors, start, whole=True):
            for part in block_pairs(rows):
                found.append(leaf_stars(vectors[part], rank[part], least))
        edges = np.unique(np.concatenate(found), axis=0)
        a, b = (pa.array([keys[i] for i in order[side]], pa.binary()) for side in edges.T)
        return pa.table({"a": a, "b": b})

    return groups.applyInArrow(compare, EDGES)


def block_pairs(rows: np.ndarray):
    """The rows of a leaf, or of every pair of its blocks where it has more than two."""
    if len(rows) <= 2 * BLOCK:
        yield rows
        return
    blocks = np.array_split(rows, -(-len(rows) // BLOCK))
    for i, block in enumerate(blocks):
        for other in blocks[:i]:
            yield np.concatenate([block, other])


def leaf_stars(vectors: np.ndarray, rank: np.ndarray, least: float) -> np.ndarray:
    """Pairs (rank, smallest rank that it hangs together with) of the vectors that reach the cosine with another."""
    near = vectors @ vectors.T >= least
    np.fill_diagonal(near, False)
    linked = np.flatnonzero(near.any(axis=1))
    near, rank = near[np.ix_(linked, linked)], rank[linked]
    label = rank
    while True:  # smallest label among the neighbours, until nothing moves
        new = np.minimum(np.where(near, label, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max), label)
        if (new == label).all():
            break
        label = new
    hang = label != rank
    return np.stack([rank[hang], label[hang]], axis=1)


def link_counts(members: DataFrame, least: float) -> DataFrame:
    """(key, links): per class the rows of other classes of its component that reach the cosine."""
    groups = in_blocks(members, "size", BLOCK).select("component", "x", "y", "mine", "key", "vec", "copies").groupBy("component", "x", "y")

    def count(table: pa.Table) -> pa.Table:
        vectors = unit(matrix(table.column("vec")))
        copies, mine = table.column("copies").to_numpy(), table.column("mine").to_numpy()
        near = vectors @ vectors.T >= least
        np.fill_diagonal(near, False)
        if table.column("x")[0].as_py() != table.column("y")[0].as_py():
            near &= mine[:, None] != mine[None, :]
        return pa.table({"key": table.column("key"), "links": pa.array(near @ copies, pa.int64())})

    return groups.applyInArrow(count, "key binary, links long").groupBy("key").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9,
                 trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = 11) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Null vectors, zero vectors and vectors with a null or non-finite component link with
    nothing: 0 links, their own component.  Vectors of one length have a forest of their own
    and link among themselves.  Equal vectors
    are linked whatever the trees do; rows that repeat an id are rows of their own; a null id
    belongs to its component and is not kept; an empty table gives no rows; other columns are
    not looked at.
    """
    rows = staged(classes_of(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))), "vectors")
    classes = staged(rows.where("key IS NOT NULL").groupBy("key").agg(F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("id").alias("smallest")), "classes")
    size = F.size("vec")
    lengths = [r["length"] for r in classes.groupBy(size.alias("length")).count().where("count > 1").orderBy("length").collect()]  # one row a length
    edges = classes.sparkSession.createDataFrame([], EDGES)
    for length in lengths:
        edges = edges.unionByName(leaf_edges(classes.where(size == length), trees, leaf, spill, least, seed))
    found = staged(components(edges).withColumnRenamed("node", "key"), "found")
    sizes = staged(found.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    members = found.join(sizes, "component").join(classes, "key").select("component", "size", "key", "vec", "copies")
    counts = link_counts(members, least)
    root = F.coalesce("component", "key")
    known = staged(classes.drop("vec").join(found, "key", "left").join(counts, "key", "left")
                   .select("key", root.alias("root"), "smallest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "known")
    names = known.groupBy("root").agg(F.min("smallest").alias("component_id"))
    named = staged(known.join(names, "root").select("key", "n_links", "component_id"), "named")
    out = rows.select("id", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
