"""N-gram Jaccard join by T-occurrence search.

A document is the set of its distinct n-word shingles.  Two documents link when their sets
share enough, so a document of n shingles must share at least T = ceil(percent * n / 100) with
any partner of its own size or less.  Shingles are ordered, the most frequent ones last; the
inverted lists of the first n - T + 1 are the short ones, and a partner stands in at least one.

1. One pass takes the class of every row (128-bit digest of its words) and the frequent shingles.
2. A second pass gives each class its short-list shingles and a parity bitmap, whose differing
   bits bound the symmetric difference of two sets from below.
3. Lists of two or more classes are walked, long ones in pairs of blocks; pairs that the bitmaps
   do not rule out make clusters.  No pair is lost and no pair leaves its task: a task returns
   only who hangs together with whom.
4. The sets of clustered classes go once to their cluster, and there a DivideSkip search finds
   the links: heap-merge of the short inverted lists, binary probes of the long ones.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import slices, staged, utf8
from plinth.llm.components import Forest, components

GRAM = 4
PERCENT = 85
# Shingles counted as frequent: at most so many, each at least so often.
FREQUENT, FREQUENT_FROM = 50_000, 32
# A shingle that a batch of texts holds less often than this is not reported as frequent.
BATCH_FROM = 4
# Word hashes a task remembers, and shingles it gathers before it counts the frequent ones.
WORDS, GATHERED = 200_000, 1_000_000
# Members of one inverted list, or sets of one cluster, that meet in one task.
LIST_BLOCK, SET_BLOCK = 512, 256
# Standard deviations by which unrelated sets must differ in more cells of their bitmaps than linked ones may.
CELL_MARGIN = 5
# Bits of the filter that spares most classes without a partner the way of their set.
FILTER_BITS = 1 << 24

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hash of each word of a task, computed once; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * M2
    x = (x ^ x >> np.uint64(27)) * M3
    return x ^ x >> np.uint64(31)


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingles."""

    def __init__(self, gram: int):
        self.gram, self.hashes = gram, WordHashes()

    def words(self, text: bytes) -> list[bytes]:
        return text.lower().split()  # bytes: A-Z only, and exactly the ASCII white space

    def shingles(self, words: list[bytes]) -> np.ndarray:
        n = len(words)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        known = self.hashes
        h = np.array([known[w] for w in words], dtype=np.uint64)
        width = min(n, self.gram)
        out = np.full(n - width + 1, width, dtype=np.uint64)
        for k in range(width):
            out = out * M1 + mixed(h[k:n - width + 1 + k] + np.uint64(k))
        return np.unique(mixed(out))


def class_key(words: list[bytes]) -> bytes | None:
    return hashlib.md5(b" ".join(words), usedforsecurity=False).digest() if words else None


def least_overlap(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def similar(common: int, n: int, m: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


def parity_cells(size: int, percent: int) -> int:
    """Cells of the bitmap of a set: the least power of two, 64 at least, that tells unrelated sets from linked ones.

    Taken for the largest partner of the set, with which it may differ in most.  Unrelated pairs that pass would
    tie clusters together, ever larger ones the more documents there are.
    """
    largest = size * 100 / percent
    linked, cells = largest - size, 64

    def unrelated(cells: int) -> float:
        return cells / 2 * (1 - math.exp(-2 * (size + largest) / cells))

    while cells < 2 * size and unrelated(cells) - CELL_MARGIN * math.sqrt(cells) / 2 < linked:
        cells *= 2
    return cells


def parity(tokens: np.ndarray, percent: int = PERCENT) -> bytes:
    """Parity of the shingles of each cell of the bitmap."""
    cells = parity_cells(len(tokens), percent)
    counts = np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def differing(a: int, a_bits: int, b: int, b_bits: int) -> int:
    """Cells whose parity differs, the larger bitmap folded to the smaller."""
    while a_bits > b_bits:
        a_bits >>= 1
        a = (a & (1 << a_bits) - 1) ^ a >> a_bits
    while b_bits > a_bits:
        b_bits >>= 1
        b = (b & (1 << b_bits) - 1) ^ b >> b_bits
    return (a ^ b).bit_count()


def rows_and_frequent(docs: DataFrame, id_col: str, text_col: str, gram: int) -> tuple[DataFrame, DataFrame]:
    """(id, key, n) of every row, and (token, n) of the shingles that batches hold often."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        shingler, held, kept, nulls = Shingler(gram), [], 0, None
        names = ["kind", "id", "key", "n", "token"]

        def frequent_of(held):
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= BATCH_FROM
            tokens, counts = tokens[often].view(np.int64), counts[often]
            n = len(tokens)
            return pa.record_batch([pa.array(np.ones(n, np.int32)), pa.nulls(n, nulls), pa.nulls(n, pa.binary()), pa.array(counts, pa.int64()),
                                    pa.array(tokens)], names=names)

        for batch in slices(batches, "body"):
            keys, sizes, nulls = [], [], batch.column("id").type
            for text in utf8(batch.column("body")):
                words = shingler.words(text)
                tokens = shingler.shingles(words)
                keys.append(class_key(words))
                sizes.append(len(tokens))
                held.append(tokens)
                kept += len(tokens)
            rows = batch.num_rows
            yield pa.record_batch([pa.array(np.zeros(rows, np.int32)), batch.column("id"), pa.array(keys, pa.binary()),
                                   pa.array(sizes, pa.int64()), pa.nulls(rows, pa.int64())], names=names)
            if kept >= GATHERED:
                yield frequent_of(held)
                held, kept = [], 0
        if kept:
            yield frequent_of(held)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    both = staged(rows.mapInArrow(run, f"kind int, id {kind}, key binary, n long, token long"), "classes", "kind")
    return both.where("kind = 0").select("id", "key", "n"), both.where("kind = 1").select("token", "n")


def short_lists(docs: DataFrame, text_col: str, gram: int, percent: int, frequent: dict[int, int]) -> DataFrame:
    """(key, n, parity, tokens): per class the shingles of its short lists, rarest kinds first."""
    common = np.array(sorted(frequent), dtype=np.int64).view(np.uint64)
    common = np.sort(common)
    weight = np.array([frequent[int(t)] for t in common.view(np.int64)], dtype=np.int64)

    def run(batches):
        shingler, seen = Shingler(gram), set()
        for batch in slices(batches, "body"):
            out = []
            for text in utf8(batch.column("body")):
                words = shingler.words(text)
                key = class_key(words)
                if key is None or key in seen:
                    continue
                seen.add(key)
                tokens = shingler.shingles(words)
                if len(common):
                    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
                    order = np.where(common[at] == tokens, weight[at], 0)
                    ranked = tokens[np.lexsort((tokens, order))] if order.any() else tokens
                else:
                    ranked = tokens
                first = ranked[:len(tokens) - least_overlap(len(tokens), percent) + 1]
                out.append((key, len(tokens), parity(tokens, percent), first.view(np.int64)))
            if out:
                ends = np.cumsum([0, *(len(o[3]) for o in out)]).astype(np.int32)
                yield pa.record_batch([
                    pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([o[3] for o in out])))], names=["key", "n", "parity", "tokens"])

    return staged(docs.select(F.col(text_col).alias("body")).mapInArrow(run, "key binary, n long, parity binary, tokens array<long>"), "short-lists")


def in_groups(batches, by: list[str]):
    """Rows of sorted Arrow batches, one list of tuples for each run of equal ``by`` columns."""
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(name).to_pylist() for name in batch.schema.names))

    for _, group in groupby(rows(), key=lambda row: row[:len(by)]):
        yield list(group)


def in_blocks(rows: DataFrame, size: str, block: int) -> DataFrame:
    """Deal the members of a group into blocks and send each to every pair of blocks it belongs to."""
    number = F.greatest(F.lit(1), F.ceil(F.col(size) / block)).cast("int")
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    return (rows.withColumn("blocks", number).withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other")))


def stars(keys: list[bytes], forest: Forest):
    """(key, key of its root) of the members that hang on another one."""
    return [(keys[i], keys[r]) for i in range(len(keys)) if (r := forest.find(i)) != i]


EDGES = "a binary, b binary"


def edge_batch(edges: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([e[0] for e in edges], pa.binary()), pa.array([e[1] for e in edges], pa.binary())], names=["a", "b"])


def candidate_edges(lists: DataFrame, percent: int) -> DataFrame:
    """Who hangs together by pairs of one inverted list that length and bitmaps allow."""
    postings = lists.select("key", F.explode("tokens").alias("token"))
    shared = staged(postings.groupBy("token").count().where("count > 1"), "shared")
    members = staged(postings.join(shared, "token").dropDuplicates(["token", "key"]), "members")
    facts = lists.select("key", "n", "parity").dropDuplicates(["key"])
    full = in_blocks(members.join(facts, "key"), "count", LIST_BLOCK).select("token", "x", "y", "key", "n", "parity")
    dealt = full.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y", "n")

    def run(batches):
        edges: set[tuple[bytes, bytes]] = set()
        for group in in_groups(batches, ["token", "x", "y"]):
            if len(group) < 2:
                continue
            keys = [row[3] for row in group]
            sizes = [row[4] for row in group]
            maps = [(int.from_bytes(row[5], "little"), 8 * len(row[5])) for row in group]
            forest, first = Forest(len(group)), 0
            for i in range(1, len(group)):
                n, (bits, width) = sizes[i], maps[i]
                while 100 * sizes[first] < percent * n:
                    first += 1
                for j in range(first, i):
                    if forest.find(i) != forest.find(j):
                        total = n + sizes[j]
                        most = total - 2 * (-(-percent * total // (100 + percent)))
                        if differing(bits, width, *maps[j]) <= most:
                            forest.union(i, j)
            edges.update(stars(keys, forest))
            if len(edges) >= 10_000:
                yield edge_batch(list(edges))
                edges = set()
        if edges:
            yield edge_batch(list(edges))

    return dealt.mapInArrow(run, EDGES)


def key_cell(key: bytes) -> int:
    return int.from_bytes(key[:4], "big") % FILTER_BITS


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bitmap of FILTER_BITS over the keys; its size does not depend on their number."""
    cell = F.pmod(F.conv(F.substr(F.hex("key"), F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(FILTER_BITS))
    cells = keys.select(cell.alias("cell"))
    words = (cells.select(F.floor(F.col("cell") / 32).cast("int").alias("word"), F.expr("shiftleft(1L, cast(cell % 32 AS int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")))
    out = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    for r in words.collect():  # at most FILTER_BITS / 32 rows
        out[r["word"]] = r["bits"]
    return out


def class_sets(docs: DataFrame, text_col: str, gram: int, clusters: DataFrame) -> DataFrame:
    """(key, tokens): the whole sets of the clustered classes, and of few others that the filter lets by."""
    wanted = key_filter(clusters)

    def run(batches):
        shingler, seen = Shingler(gram), set()
        for batch in slices(batches, "body"):
            out = []
            for text in utf8(batch.column("body")):
                words = shingler.words(text)
                key = class_key(words)
                if key is None or key in seen:
                    continue
                seen.add(key)
                cell = key_cell(key)
                if wanted[cell >> 5] >> (cell & 31) & 1:
                    out.append((key, shingler.shingles(words).tobytes()))
            if out:
                yield pa.record_batch([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], names=["key", "tokens"])

    sets = docs.select(F.col(text_col).alias("body")).mapInArrow(run, "key binary, tokens binary")
    return sets.dropDuplicates(["key"])  # copies of one class in several tasks


def divide_skip(keys: list[bytes], sets: list[np.ndarray], percent: int) -> Forest:
    """Links among the sets of one block pair, as disjoint sets.

    Sets come in ascending size, so a query's T holds for all that are indexed before it.  Its
    longest L inverted lists are left out of the merge; a candidate must stand in T - L of the
    others, and the long lists are then probed for it.  Candidates that already hang together
    with the query are not probed again.
    """
    forest = Forest(len(sets))
    index: dict[int, list[int]] = {}
    for q, tokens in enumerate(sets):
        size = len(tokens)
        need = least_overlap(size, percent)
        values = tokens.tolist()
        lists = sorted((index[t] for t in values if t in index), key=len)
        if len(lists) >= need:
            longest = len(lists[-1])
            long_n = min(need - 1, int(need / (0.0085 * max(1, longest).bit_length() + 1)))
            short, long_lists = lists[:len(lists) - long_n], lists[len(lists) - long_n:]
            for c, run in groupby(heapq.merge(*short)):
                common = sum(1 for _ in run)
                if common < need - long_n or forest.find(c) == forest.find(q) or 100 * len(sets[c]) < percent * size:
                    continue
                left = long_n
                for members in long_lists:
                    if common + left < need:
                        break
                    at = bisect_left(members, c)
                    common += at < len(members) and members[at] == c
                    left -= 1
                else:
                    if similar(common, size, len(sets[c]), percent):
                        forest.union(q, c)
        for t in values:
            index.setdefault(t, []).append(q)
    return forest


def exact_links(sets: DataFrame, percent: int) -> DataFrame:
    """Edges of the true links, from clusters dealt in blocks: (cluster, size, key, tokens) in."""
    dealt = (in_blocks(sets, "size", SET_BLOCK).select("cluster", "x", "y", "key", "tokens", F.length("tokens").alias("bytes"))
             .repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y", "bytes", "key"))

    def run(batches):
        for group in in_groups(batches, ["cluster", "x", "y"]):
            keys = [row[3] for row in group]
            forest = divide_skip(keys, [np.frombuffer(row[4], dtype=np.uint64) for row in group], percent)
            edges = stars(keys, forest)
            if edges:
                yield edge_batch(edges)

    return dealt.mapInArrow(run, EDGES)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links).

    Rows without a word have an empty set and stand alone: their component is their own id.
    Rows of equal words are one class and always linked; rows that repeat an id are rows of
    their own that may tie; a null id belongs to its component, which is named after the
    smallest id that is not null; an empty table gives no rows; other columns are not looked at.
    """
    rows, often = rows_and_frequent(docs, id_col, text_col, gram)
    summed = often.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    frequent = {r["token"]: r["n"] for r in summed.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()}
    lists = short_lists(docs, text_col, gram, percent, frequent)
    clusters = staged(components(candidate_edges(lists, percent)).withColumnsRenamed({"node": "key", "component": "cluster"}), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    sets = class_sets(docs, text_col, gram, clusters)
    placed = staged(clusters.join(sizes, "cluster"), "placed")
    links = components(exact_links(placed.join(sets, "key"), percent))
    named = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("smallest"))
    root = F.coalesce("component", "key")
    linked = staged(named.join(links, named["key"] == links["node"], "left").select("key", root.alias("root"), "smallest"), "named")
    names = linked.groupBy("root").agg(F.min("smallest").alias("component_id"))
    classes = staged(linked.join(names, "root").select("key", "component_id"), "components")
    out = rows.join(classes, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """One row of each group that hangs together, columns unchanged.

    That of the smallest id stays (null ids come last; of equal ids a hash of the whole row decides),
    and of rows that are equal in every column one.  Rows without a word all stay.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    id_name, body = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    row = F.struct(F.col(id_name).isNull().alias("missing"), F.col(id_name).alias("id"), F.xxhash64(*plain.columns).alias("hash"))
    plain = plain.withColumn("row", row)
    found = jaccard_components(plain, "row", body, gram, percent)
    same = F.col("row") == F.col("component_id")
    verdict = found.where("n_shingles > 0").groupBy("row").agg(F.bool_and(same).alias("first"), F.count("*").alias("copies"))
    verdict = staged(verdict.where("NOT first OR copies > 1").select("row.id", "row.hash", "first"), "one-of-each")
    ids = plain.withColumn("hash", F.col("row.hash")).drop("row")

    def of(side: DataFrame, how: str) -> DataFrame:
        return ids.join(side, (ids["hash"] == side["hash"]) & ids[id_name].eqNullSafe(side["id"]), how)

    out = of(verdict, "left_anti").drop("hash")
    again = verdict.where("first")
    if not again.isEmpty():
        out = out.unionByName(of(again, "left_semi").drop("hash").dropDuplicates())
    return out.toDF(*names)
