"""Byte-level BPE on padded numpy matrices.

Pieces of text (matches of the split pattern) that a task has not met yet are laid out, by
length bucket, as rows of a padded matrix of token ids, at first single bytes.  In each round
every row merges its leftmost pair of least rank: the pairs of all rows are looked up in one
hash table, the merged id replaces the pair and the row closes the gap.  Rows without a pair
leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import slices

NONE = np.int32(np.iinfo(np.int32).max)
# Pieces a task remembers; beyond it the memory is emptied, which costs time and changes nothing.
REMEMBERED = 200_000
# Texts split at once: the matches of a slice take some twelve times its bytes.
SLICE_BYTES = 2 << 20
# Rows longer than this merge by a queue of pairs, since a round of the matrix costs a whole row.
LONG_PIECE = 512


class Vocabulary:
    """Tokens by rank, and the table of all pairs of tokens whose bytes together are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        keys = np.array(left, dtype=np.uint64) << np.uint64(32) | np.array(right, dtype=np.uint64)
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int32)
        self._insert(keys, np.array(merged, dtype=np.int32))

    @staticmethod
    def of(parts: tuple) -> Vocabulary:
        """From ``parts``: plain values, which a broadcast carries without this package."""
        out = object.__new__(Vocabulary)
        out.tokens, out.single, out.bits, out.keys, out.ranks = parts
        return out

    def parts(self) -> tuple:
        return self.tokens, self.single, self.bits, self.keys, self.ranks

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        mask, empty = (1 << self.bits) - 1, np.iinfo(np.uint64).max
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == empty]
            first = free[np.unique(slot[free], return_index=True)[1]]  # one key for each free slot
            self.keys[slot[first]], self.ranks[slot[first]] = keys[first], values[first]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = slot[todo] + 1 & mask

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, NONE where the pair is no token; padding is negative."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        mask, empty = (1 << self.bits) - 1, np.iinfo(np.uint64).max
        out = np.full(keys.shape, NONE, dtype=np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys, slot = keys[todo], self._slot(keys[todo])
        while len(todo):
            held = self.keys[slot]
            hit = held == keys
            out[todo[hit]] = self.ranks[slot[hit]]
            go = ~hit & (held != empty)
            todo, keys, slot = todo[go], keys[go], slot[go] + 1 & mask
        return out

    def merge_matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of similar length, those of a piece as the bytes of 32-bit integers."""
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        place = np.arange(width)
        ids = np.full((len(pieces), width), -1, dtype=np.int32)
        ids[place < lengths[:, None]] = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        out: list[bytes] = [b""] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            ranks = self.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), -1)
            if ranks.shape[1] == 0:
                break
            at = ranks.argmin(axis=1)  # the leftmost of the least
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            for r, row in zip(rows[done].tolist(), ids[done]):
                out[r] = row[row >= 0].tobytes()
            rows, ids, at, best = rows[~done], ids[~done], at[~done], best[~done]
            if not len(rows):
                break
            ids[np.arange(len(rows)), at] = best
            after = np.concatenate([ids[:, 1:], np.full((len(rows), 1), -1, dtype=np.int32)], axis=1)
            ids = np.where(place[:ids.shape[1]] > at[:, None], after, ids)
            ids = ids[:, :max(2, int((ids >= 0).sum(axis=1).max()))]  # compaction
        for r, row in zip(rows.tolist(), ids):
            out[r] = row[row >= 0].tobytes()
        return out

    def merge_long(self, piece: bytes, pairs: dict[tuple[int, int], int]) -> bytes:
        """The same merges for one long piece, by a queue of (rank, place)."""
        ids = self.single[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        queue = [(pairs[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or pairs.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(ids) and (ids[a], ids[b]) in pairs:
                    heapq.heappush(queue, (pairs[ids[a], ids[b]], a))
        return np.array([x for x in ids if x >= 0], dtype=np.int32).tobytes()

    def pairs(self) -> dict[tuple[int, int], int]:
        used = np.flatnonzero(self.ranks != NONE)
        keys = self.keys[used]
        return dict(zip(zip((keys >> np.uint64(32)).tolist(), (keys & np.uint64(0xFFFFFFFF)).tolist()), self.ranks[used].tolist()))

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            buckets.setdefault(len(piece) if len(piece) <= 8 else 1 << (len(piece) - 1).bit_length(), []).append(i)
        pairs: dict | None = None
        for width, places in sorted(buckets.items()):
            if width > LONG_PIECE:
                pairs = pairs or self.pairs()
                for i in places:
                    out[i] = self.merge_long(pieces[i], pairs)
                continue
            rows = max(1, (1 << 20) // width)
            for start in range(0, len(places), rows):
                part = places[start:start + rows]
                for i, ids in zip(part, self.merge_matrix([pieces[i] for i in part])):
                    out[i] = ids
        return out


class Encoder:
    """Text to ids, piece by piece, remembering the pieces of one task."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.pattern.findall(text) for text in texts]
        wanted = set().union(*split)
        if len(self.known) + len(wanted) > REMEMBERED:
            self.known = {}
        new = [piece for piece in wanted if piece not in self.known]
        self.known.update(zip(new, self.vocabulary.encode_pieces([piece.encode() for piece in new])))
        ids = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids, pieces)), dtype=np.int32) for pieces in split]


def list_array(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           digest: bool = False) -> DataFrame:
    """(id, ids): the token ids of every row's whole text, in one pass without a shuffle.

    With ``digest`` the ids are decoded in the same pass: (id, ids, decoded_sha256).

    A null or empty text has no ids; repeated rows are encoded each on its own; an id may be
    null; an empty table gives no rows; other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.parts())  # a vocabulary file and its pairs

    def run(batches):
        encoder = Encoder(Vocabulary.of(shared.value), pattern)
        for batch in slices(batches, "body", SLICE_BYTES):
            texts = [text or "" for text in batch.column("body").to_pylist()]
            parts = encoder.encode(texts)
            columns = {"id": batch.column("id"), "ids": list_array(parts)}
            if digest:
                token = encoder.vocabulary.tokens.__getitem__
                columns["decoded_sha256"] = pa.array([hashlib.sha256(b"".join(map(token, ids.tolist()))).hexdigest() for ids in parts], pa.string())
            yield pa.record_batch(list(columns.values()), names=list(columns))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    schema = f"id {kind}, ids array<int>" + (", decoded_sha256 string" if digest else "")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decoder(spark: SparkSession, vocabulary: Vocabulary):
    """A column function: ids to the bytes they stand for (null ids: null)."""
    shared = spark.sparkContext.broadcast(vocabulary.tokens)

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        token = shared.value.__getitem__
        values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        out = [b"".join(map(token, values[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:])]
        return pa.array(out, pa.binary(), mask=ids.is_null().to_numpy(zero_copy_only=False))

    return decode


def digests(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id") -> DataFrame:
    """Token count, digest of the decimal ids and digest of the decoded bytes."""
    decode = decoder(encoded.sparkSession, vocabulary)
    text: Column = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(F.col(id_col), F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"),
                          F.sha2(decode("ids"), 256).alias("decoded_sha256"))
