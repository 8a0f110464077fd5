"""SentencePiece merge-type encoding by backtracking.

A text's encoding is the one sequence of pieces in which every two neighbours, merged again from
their characters, give just these two.  So pieces are tried longest first (all matches of a text
come from one Aho-Corasick pass); a piece must be compatible with the one before it, else its next
shorter prefix is tried; a position from which none fits is marked as failed and never tried again.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import slices

SPACE = "▁"
# Chunks and pairs that a task remembers; beyond it the memory is emptied, which costs time and changes nothing.
REMEMBERED = 300_000
# Longer chunks are encoded each time they come.
LONG_CHUNK = 64
SLICE_BYTES = 2 << 20


class Model:
    """What the encoder needs of a .model file: plain values, which a broadcast carries."""

    def __init__(self, pieces: list[str], scores: list[float], byte_of: dict[int, int], silent: set[int], first: int, last: int):
        self.pieces, self.byte_of, self.silent, self.first, self.last = pieces, byte_of, silent, first, last
        self.ids = {p: i for i, p in enumerate(pieces) if i not in byte_of and i not in silent}
        self.order = {p: -scores[i] for p, i in self.ids.items()}
        self.tails: dict[int, tuple[str, ...]] = {}
        self.heads: dict[int, tuple[str, ...]] = {}
        split: dict[str, tuple[str, str]] = {}
        for piece in sorted(self.ids, key=len):
            if len(piece) > 1:
                last_merge: list[tuple[str, str]] = []
                if self.merge(list(piece), trace=last_merge) == [piece]:
                    split[piece] = last_merge[-1]
        self.reachable = {p: i for p, i in self.ids.items() if len(p) == 1 or p in split}
        for piece, i in self.reachable.items():
            tails, heads = [piece], [piece]
            while tails[-1] in split:
                tails.append(split[tails[-1]][1])
            while heads[-1] in split:
                heads.append(split[heads[-1]][0])
            self.tails[i], self.heads[i] = tuple(tails), tuple(heads)
        self.shorter = {i: next((self.reachable[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.reachable), -1)
                        for p, i in self.reachable.items()}

    @staticmethod
    def of(parts: tuple) -> Model:
        out = object.__new__(Model)
        (out.pieces, out.byte_of, out.silent, out.first, out.last, out.ids, out.order, out.tails, out.heads, out.reachable,
         out.shorter) = parts
        return out

    def parts(self) -> tuple:
        return (self.pieces, self.byte_of, self.silent, self.first, self.last, self.ids, self.order, self.tails, self.heads,
                self.reachable, self.shorter)

    @staticmethod
    def read(path: str) -> Model:
        """From a .model file.  Only what this encoder reproduces is accepted: merge-type pieces with
        bytes for unknown characters, no change of the text but white space marks and one in front.
        """
        from sentencepiece import sentencepiece_model_pb2 as schema

        file = schema.ModelProto()
        with open(path, "rb") as data:
            file.ParseFromString(data.read())
        kinds, norm, trainer = schema.ModelProto.SentencePiece, file.normalizer_spec, file.trainer_spec
        if (trainer.model_type != schema.TrainerSpec.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix
                or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces
                or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in file.pieces)):
            raise ValueError(f"{path}: only byte-fallback BPE models without normalisation or user-defined pieces are encoded")
        pieces = [p.piece for p in file.pieces]
        byte_of = {i: int(p.piece[1:-1], 16) for i, p in enumerate(file.pieces) if p.type == kinds.BYTE}
        silent = {i for i, p in enumerate(file.pieces) if p.type in (kinds.CONTROL, kinds.UNKNOWN)}
        out = Model(pieces, [p.score for p in file.pieces], byte_of, silent, trainer.bos_id, trainer.eos_id)
        single = {c for p in out.ids for c in p}
        if not single <= set(out.ids) or len(byte_of) != 256:
            raise ValueError(f"{path}: a character of its pieces is no piece, or a byte is missing")
        return out

    def merge(self, parts: list[str], seam: int = 0, trace: list[tuple[str, str]] | None = None) -> list[str]:
        """Merge from characters: the best score first, the leftmost of equal ones.

        With a ``seam`` (a number of parts) it stops at the first merge across it.
        """
        parts, get, never = list(parts), self.order.get, float("inf")
        turns = [get(a + b, never) for a, b in zip(parts, parts[1:])]
        while turns:
            first = min(turns)
            if first == never:
                break
            k = turns.index(first)
            if trace is not None:
                trace.append((parts[k], parts[k + 1]))
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del turns[k]
            if k:
                turns[k - 1] = get(parts[k - 1] + parts[k], never)
            if k < len(turns):
                turns[k] = get(parts[k] + parts[k + 1], never)
            if k == seam - 1:
                break
            if k < seam:
                seam -= 1
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the characters of two pieces, merged again, give these two pieces."""
        order = self.order
        if not any(a + b in order for a in self.tails[left] for b in self.heads[right]):
            return True  # nothing that ever stands at the seam is a piece
        a, b = self.pieces[left], self.pieces[right]
        return self.merge([*a, *b], len(a)) == [a, b]


class Encoder:
    """Text to ids, remembering chunks and pairs of pieces of one task."""

    def __init__(self, model: Model):
        self.model = model
        self.automaton = ahocorasick.Automaton()
        for piece, i in model.reachable.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.size = {i: len(p) for p, i in model.reachable.items()}
        self.byte_ids = {b: i for i, b in model.byte_of.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.chunks: dict[str, bytes] = {}
        # Where no piece has a mark behind another character, merges never cross that place;
        # where none holds a line feed, they never cross one.
        inner = any(SPACE in p.lstrip(SPACE) for p in model.ids)
        line = any("\n" in p for p in model.ids)
        self.pattern = None if inner else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if line else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

    def backtrack(self, text: str) -> list[int]:
        n = len(text)
        longest = [-1] * n
        for end, (i, length) in self.automaton.iter(text):
            longest[end - length + 1] = i
        size, shorter, pairs, fits = self.size, self.model.shorter, self.pairs, self.model.fits
        failed = bytearray(n + 1)
        out: list[int] = []
        place = start = 0  # before ``start`` everything is settled: it follows a character without a piece
        floor = 0
        piece = longest[0] if n else -1
        while place < n:
            if longest[place] < 0:
                out.extend(self.byte_ids[b] for b in text[place].encode())
                place = start = place + 1
                floor = len(out)
                piece = longest[place] if place < n else -1
                continue
            if piece < 0:
                if place == start:
                    raise ValueError("a text has no encoding")
                failed[place] = 1
                last = out.pop()
                place -= size[last]
                piece = shorter[last]
                continue
            end = place + size[piece]
            ok = not failed[end]
            if ok and len(out) > floor:
                pair = (out[-1], piece)
                ok = pairs.get(pair)
                if ok is None:
                    if len(pairs) >= REMEMBERED:
                        pairs.clear()
                    ok = pairs[pair] = fits(*pair)
            if ok:
                out.append(piece)
                place = end
                piece = longest[place] if place < n else -1
            else:
                piece = shorter[piece]
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, begin and end included, as 32-bit integers."""
        model, known = self.model, self.chunks
        marked = SPACE + text.replace(" ", SPACE) if text else ""
        parts = [array("I", [model.first]).tobytes()]
        for chunk in self.pattern.findall(marked) if self.pattern else [marked]:
            ids = known.get(chunk)
            if ids is None:
                ids = array("I", self.backtrack(chunk)).tobytes()
                if len(chunk) <= LONG_CHUNK:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[chunk] = ids
            parts.append(ids)
        parts.append(array("I", [model.last]).tobytes())
        return b"".join(parts)


def surfaces(model: Model) -> list[bytes]:
    """What each id stands for in a decoded text, white space marks still in it."""
    return [b"" if i in model.silent else bytes([model.byte_of[i]]) if i in model.byte_of else p.encode() for i, p in enumerate(model.pieces)]


def decoded(ids: list[int], surface: list[bytes]) -> str:
    """Ids to text: the mark that encoding puts in front goes, all others are spaces."""
    text = b"".join(map(surface.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of every row's whole text with begin and end id, in one pass without a shuffle.

    A null or empty text has the begin and end id only; repeated rows are encoded each on its
    own; an id may be null; an empty table gives no rows; other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())  # of a model file: its size is that of the vocabulary

    def run(batches):
        encoder = Encoder(Model.of(shared.value))
        for batch in slices(batches, "body", SLICE_BYTES):
            parts = [encoder.encode(text.as_py() or "") for text in batch.column("body")]
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.record_batch([batch.column("id"), ids], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decoder(spark: SparkSession, model: Model):
    """A column function: ids to their text (null ids: null)."""
    shared = spark.sparkContext.broadcast(surfaces(model))

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        surface = shared.value
        return pa.array([None if row is None else decoded(row, surface) for row in ids.to_pylist()], pa.string())

    return decode


def digests(encoded: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """Number of ids, digest of the ids as little-endian 32-bit integers and digest of the decoded text."""
    kind = encoded.schema[id_col].dataType.simpleString()
    shared = encoded.sparkSession.sparkContext.broadcast(surfaces(model))

    def run(batches):
        surface = shared.value
        for batch in batches:
            ids = batch.column("ids")
            values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            rows = [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
            first = [hashlib.sha256(row.astype("<u4").tobytes()).hexdigest() for row in rows]
            second = [hashlib.sha256(decoded(row.tolist(), surface).encode()).hexdigest() for row in rows]
            yield pa.record_batch([batch.column("id"), pa.array(np.diff(ends), pa.int64()), pa.array(first), pa.array(second)],
                                  names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = encoded.select(F.col(id_col).alias("id"), "ids")
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
