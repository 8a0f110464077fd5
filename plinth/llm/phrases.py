"""Phrase collocations from FM-indexes over word ids, one per shard of texts.

A shard (a slice of a task's rows, one language) numbers its words, sorts its suffixes by their first
words and keeps the Burrows-Wheeler transform of the word sequence and of its reverse.  A phrase is an
interval in both; extending it by a word to the left (right) is one rank query in the forward (reverse)
transform, and all intervals of one length are extended at once.  Every shard gives the counts of its
phrases and extensions; Spark sums them.

A phrase is as rare as its rarest part, so only what is frequent in all texts of a language is extended.
Three passes sum hashes of words, of pairs and of triples over all shards: 40 bits instead of strings, most
of which are rare.  Frequent hashes travel as bit filters of fixed size.  A last pass counts what they let
through by the phrases themselves: what hashes let through in error is counted and dropped like any rare
phrase.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import slices, staged

BREAKS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
NO_LANG = "und"
SLICE_BYTES = 4 << 20
# Bits of a filter: 8 MB, whatever the data; the fuller it is, the less it spares.
FILTER_BITS = 1 << 26
# Bits of a hash that is summed; two phrases with one hash count together there, and apart in the end.
HASH_BITS = 40
KINDS = np.zeros(256, np.uint8)  # 1: between words, 2: between pieces
KINDS[[0x20, 0x09]] = 1
KINDS[list(BREAKS)] = 2
COUNTED = "lang string, n int, phrase string, f long"


def word_sequence(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of some texts, and all words in order as 1 + their place there; 0 parts pieces."""
    buffer = b"\n".join(text for text in texts.cast(pa.large_binary()).to_pylist() if text).translate(FOLD)
    data = np.frombuffer(buffer, np.uint8)
    kinds = KINDS[data]
    inside = np.r_[False, kinds == 0, False]
    starts, ends = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    if not len(starts):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int32)
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    letters = data[kinds == 0]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1
    piece = np.searchsorted(np.flatnonzero(kinds == 2), starts)
    parted = np.flatnonzero(np.diff(piece)) + 1
    return coded.dictionary, np.insert(codes, parted, 0)


def word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word of a language; 0 stands before them for the end of a piece."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.array([0, *(xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist())], np.uint64)


def joined_hashes(*words: np.ndarray) -> np.ndarray:
    """Hashes of words side by side."""
    out = words[0]
    for right in words[1:]:
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (right >> np.uint64(7)) ^ (right << np.uint64(57))
        out = (out ^ out >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return out


def lets(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter lets through."""
    slot = hashes >> np.uint64(64 - FILTER_BITS.bit_length() + 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


class Half:
    """One direction of the index: its transform, and the rank of a symbol before a row."""

    def __init__(self, sequence: np.ndarray, depth: int):
        n = len(sequence)
        rank, known = sequence.astype(np.int64), 1
        while known < depth:  # after it suffixes stand in order of their first ``known`` words
            ahead = np.zeros(n, np.int64)
            ahead[:n - known] = rank[known:] + 1
            rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)[1]
            known *= 2
        order = np.argsort(rank, kind="stable")
        self.transform = np.where(order > 0, sequence[order - 1], 0).astype(np.int64)
        self.n = n
        self.first = np.searchsorted(sequence[order], np.arange(int(sequence.max()) + 2))  # first row of each symbol
        self.keys = np.sort(self.transform * (n + 1) + np.arange(n))

    def before(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """First row of symbol + W, where W starts at ``row``."""
        base = np.searchsorted(self.keys, symbol * (self.n + 1))
        return self.first[symbol] + np.searchsorted(self.keys, symbol * (self.n + 1) + row) - base


class Intervals:
    """Phrases of one length: their words, and their rows in both directions."""

    def __init__(self, words: np.ndarray, rows: tuple[np.ndarray, np.ndarray], size: np.ndarray):
        self.words, self.rows, self.size = words, rows, size

    def at(self, keep: np.ndarray) -> Intervals:
        return Intervals(self.words[keep], (self.rows[0][keep], self.rows[1][keep]), self.size[keep])


class Index:
    """A bidirectional FM-index of a word sequence in which phrases of up to ``depth`` words are found."""

    def __init__(self, sequence: np.ndarray, depth: int):
        sequence = np.r_[0, sequence, 0]  # so that each word has a row behind it
        self.halves = (Half(sequence, depth), Half(sequence[::-1], depth))

    def words(self) -> Intervals:
        forward, reverse = self.halves
        size = np.diff(forward.first)
        words = np.flatnonzero(size)
        words = words[words > 0]
        return Intervals(words[:, None], (forward.first[words], reverse.first[words]), size[words])

    def extend(self, phrases: Intervals, side: int, allowed) -> Intervals:
        """All phrases with one word more, to the left (side 0) or right (1).

        ``allowed`` sees the two or three words at that end, from left to right.
        """
        half, rows = self.halves[side], phrases.rows[side]
        total = int(phrases.size.sum())
        owner = np.repeat(np.arange(len(rows)), phrases.size)
        place = np.arange(total) - np.repeat(np.cumsum(phrases.size) - phrases.size, phrases.size) + rows[owner]
        symbols = half.transform[place]
        width = int(symbols.max(initial=0)) + 1
        keys, size = np.unique(owner * width + symbols, return_counts=True)
        owner, symbols = keys // width, keys % width
        smaller = np.cumsum(size) - size  # rows of smaller symbols in the same interval
        first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
        smaller -= np.maximum.accumulate(np.where(first, smaller, 0))
        keep = symbols > 0
        owner, symbols, size, smaller = owner[keep], symbols[keep], size[keep], smaller[keep]
        old = phrases.words[owner]
        keep = allowed((symbols, *old[:, :2].T) if side == 0 else (*old[:, -2:].T, symbols), side)
        owner, symbols, size, old = owner[keep], symbols[keep], size[keep], old[keep]
        here = half.before(symbols, rows[owner])
        there = phrases.rows[1 - side][owner] + smaller[keep]
        words = np.concatenate([symbols[:, None], old] if side == 0 else [old, symbols[:, None]], axis=1)
        return Intervals(words, (here, there) if side == 0 else (there, here), size)


def phrase_batch(lang: str, words: pa.Array, found: Intervals) -> pa.RecordBatch:
    parts = [words.take(pa.array(found.words[:, k] - 1)) for k in range(found.words.shape[1])]
    phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if len(parts) > 1 else parts[0]
    n = len(found.size)
    return pa.record_batch([pa.array([lang] * n, pa.string()), pa.array(np.full(n, len(parts)), pa.int32()),
                            phrase.cast(pa.large_string()).cast(pa.string()), pa.array(found.size, pa.int64())], names=["lang", "n", "phrase", "f"])


def shards(batches):
    """(language, distinct words, sequence) of slices of rows."""
    for batch in slices(batches, "text", SLICE_BYTES):
        langs = batch.column("lang")
        for lang in pc.unique(langs).to_pylist():
            words, sequence = word_sequence(batch.column("text").filter(pc.equal(langs, lang)))
            if len(sequence):
                yield lang, words, sequence


def without_rare(sequence: np.ndarray, hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The sequence with rare words as ends of pieces."""
    good = lets(bits, hashes)
    good[0] = False
    sequence = np.where(good[sequence], sequence, 0)
    return sequence[(sequence > 0) | np.r_[True, sequence[:-1] > 0]]  # one mark where several meet


def admission(hashes: np.ndarray, filters: list):
    """For ``Index.extend``: whether the new pair or, with its filter at hand, the new triple may be frequent."""

    def allowed(words, side: int) -> np.ndarray:
        width = min(len(words), len(filters))
        if width < 2:
            return np.ones(len(words[0]), bool)
        return lets(filters[width - 1], joined_hashes(*(hashes[w] for w in (words[:width] if side == 0 else words[-width:]))))

    return allowed


def hash_sums(rows: DataFrame, n: int, shared: list) -> DataFrame:
    """(hash, f) summed over all shards: of phrases of ``n`` words (1 to 3) whose parts filters let through."""

    def run(batches):
        filters = [np.frombuffer(f.value, np.uint64) for f in shared]
        for lang, words, sequence in shards(batches):
            hashes = word_hashes(lang, words)
            if n == 1:
                size, found = np.bincount(sequence, minlength=len(words) + 1)[1:], hashes[1:]
            else:
                sequence = without_rare(sequence, hashes, filters[0])
                if not sequence.any():
                    continue
                index, side = Index(sequence, n), 1
                phrases = index.words()
                for _ in range(1, n):
                    phrases, side = index.extend(phrases, side, admission(hashes, filters)), 1 - side
                size, found = phrases.size, joined_hashes(*(hashes[w] for w in phrases.words.T))
            found = (found >> np.uint64(64 - HASH_BITS)).view(np.int64)
            yield pa.record_batch([pa.array(found), pa.array(size, pa.int64())], names=["hash", "f"])

    return rows.mapInArrow(run, "hash long, f long").groupBy("hash").agg(F.sum("f").alias("f"))


def bit_filter(hashes: DataFrame):
    """A broadcast of FILTER_BITS bits: those that a table of hashes sets."""
    slot = F.shiftright("hash", HASH_BITS - FILTER_BITS.bit_length() + 1)
    bits = hashes.select(F.shiftright(slot, 6).alias("place"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int")).alias("bit"))
    table = bits.groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[table.column("place").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(out.tobytes())


def counted(rows: DataFrame, longest: int, shared: list) -> DataFrame:
    """(lang, n, phrase, f) summed over all shards: of phrases of n words that filters let through; of all words (n 0)."""

    def run(batches):
        filters = [np.frombuffer(f.value, np.uint64) for f in shared]
        for lang, words, sequence in shards(batches):
            total = np.array([np.count_nonzero(sequence)])
            yield pa.record_batch([pa.array([lang], pa.string()), pa.array([0], pa.int32()), pa.array([""], pa.string()), pa.array(total)],
                                  names=["lang", "n", "phrase", "f"])
            hashes = word_hashes(lang, words)
            sequence = without_rare(sequence, hashes, filters[0])
            if not sequence.any():
                continue
            index, side = Index(sequence, longest), 1
            phrases = index.words()
            yield phrase_batch(lang, words, phrases)
            for _ in range(2, longest + 1):
                phrases, side = index.extend(phrases, side, admission(hashes, filters)), 1 - side
                if len(phrases.size):
                    yield phrase_batch(lang, words, phrases)

    return rows.mapInArrow(run, COUNTED).groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))


def parts_of(phrase: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to ``longest`` words that a language holds ``least`` times or more, and the
    number of all words of each language: (lang, n, phrase, f), (lang, n_words), both from one written table.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))
    frequent = F.col("f") >= least
    filters: list = []
    for n in range(1, min(longest, 3) + 1):
        filters.append(bit_filter(hash_sums(rows, n, filters.copy()).where(frequent)))
    found = staged(counted(rows, longest, filters).where(frequent | (F.col("n") == 0)), "phrases")
    return found.where(F.col("n") > 0), found.where(F.col("n") == 0).select("lang", F.col("f").alias("n_words"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30,
                 inside_percent: int = 80, most: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` phrases of each language that hang together best.

    A-Z are lower-cased; pieces end at . , ; : ! ? and line ends, words at space and tab; all phrases within
    pieces count.  Of phrases of 2 to ``longest`` words with a >= ``least`` occurrences every cut into two
    parts with l and r occurrences scores floor(2000000 a / (l + r)); the worst cut counts, of equal ones the
    first.  A phrase inside a longer one with at least ``inside_percent`` % of its occurrences goes.  A null
    language is ``und``; a null or empty text has no words; repeated rows count each; an empty table gives no
    rows; other columns are not looked at; ``most`` None keeps all.
    """
    return scored(*frequent_phrases(docs, text_col, lang_col, longest, least), inside_percent, most)


def scored(found: DataFrame, sums: DataFrame, inside_percent: int, most: int | None) -> DataFrame:
    """The collocations of counted phrases (lang, n, phrase, f); a phrase's parts are counted too."""
    candidates = found.where(F.col("n") > 1).withColumnRenamed("f", "a")
    cut = F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("cut")
    cuts = candidates.select("lang", "phrase", "n", "a", cut)
    cuts = cuts.withColumn("first", parts_of(F.col("phrase"), F.lit(1), F.col("cut"))) \
               .withColumn("rest", parts_of(F.col("phrase"), F.col("cut") + 1, F.col("n") - F.col("cut")))
    known = found.select("lang", "phrase", "f")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("worst"))

    spans = F.expr(f"""flatten(transform(sequence(2, n - 1), m -> transform(sequence(1, n - m + 1),
                                s -> array_join(slice(split(phrase, ' '), s, m), ' '))))""")
    inner = candidates.where(F.col("n") > 2).select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.expr(f"CAST(100 AS DECIMAL(3,0)) * CAST(longer AS DECIMAL(19,0)) >= CAST({int(inside_percent)} AS DECIMAL(3,0)) * CAST(a AS DECIMAL(19,0))")
    kept = worst.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~covered)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.select("lang", "phrase", "a", F.col("worst.l").alias("l"), F.col("worst.r").alias("r"), F.col("worst.score").alias("score"))
    ranked = ranked.withColumn("rank", place.cast("long"))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= most)
    return ranked.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")
