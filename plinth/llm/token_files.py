"""Token ids as flat unsigned integer files with 64-bit document offsets, read by memory mapping.

A part is two files: ``.bin`` holds the ids of its documents one after the other in the
unsigned integer type of the set, ``.idx`` a magic word, the number of documents, n + 1 64-bit
offsets in tokens, the n document ids and n flags for null ids.  Parts are ranges of ascending
document id; the base of a part is the sum of the parts before it.

The folder must be mounted on all executors (a file: path), as memory mapping needs; other
schemes are refused.  A task writes under a name of its own and only its returned row makes
the file part of the set, so a task that is run again does no harm.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import shared_folder, slices, staged, utf8

MAGIC = b"PLTOKIDX"
# Chunks a task remembers; beyond it the memory is emptied, which costs time and changes nothing.
REMEMBERED = 400_000
# The chain of the word vocabulary whose chunks are encoded on their own.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
# Beyond ASCII and Latin letters (which are composed, and lower-case one by one) the library does it all.
OTHER = re.compile("[^\x00-\x7f\u00c0-\u012f\u0131-\u017e]")
# Chunks of these characters alone fall into pieces by the same pattern without classes of all of Unicode.
SAFE = re.compile("[\x21-\x7e\u00df-\u00f6\u00f8-\u012f\u0131-\u017e]+$")
SAFE_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u017e]+|[0-9]|[^a-z0-9\u00df-\u017e]+"
# Bytes of text whose chunks are split and looked up at a time.
ENCODED_BYTES = 2 << 20
PART_SCHEMA = "part long, path string, documents long, tokens long"


def mounted(path: str) -> str:
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"token files are memory-mapped: {path} is not on a mounted file system")
    return url.path


def byte_letter(byte: int) -> str:
    """The letter that byte-level vocabularies write for a byte: itself where it is printable."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return chr(byte) if byte in printable else chr(256 + sum(b not in printable for b in range(byte)))


class WholeTexts:
    """Ids of a text through the tokenizers library, whatever the vocabulary."""

    def __init__(self, tokenizer_json: str, dtype: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.dtype = np.dtype(dtype)
        self.end = self.packed([end_id])

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)

    def raw(self, texts: list[str]) -> list[bytes]:
        return [self.packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text and the end id, as bytes of the file's integer type."""
        return [ids + self.end for ids in self.raw([text.decode() for text in texts])]


class ChunkEncoder(WholeTexts):
    """The same ids for vocabularies that lower-case, drop white space and split words as WORD_SPLIT does.

    What ASCII white space separates is encoded once and remembered.  Texts of ASCII and Latin letters
    are lower-cased first; their chunks fall into the pieces of the vocabulary's pattern, and only
    a piece not met before goes to its merges.  Other chunks, and all of a text in which a special
    token may hide, go through the library's whole chain.
    """

    def __init__(self, tokenizer_json: str, dtype: str, end_id: int):
        super().__init__(tokenizer_json, dtype, end_id)
        chain = json.loads(tokenizer_json)
        self.split, self.model = re.compile(SAFE_SPLIT), self.tokenizer.model
        self.shown = {b: byte_letter(b) for b in range(256)}
        self.special = [t["content"].lower().encode() for t in chain["added_tokens"]]
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @staticmethod
    def serves(tokenizer_json: str) -> bool:
        """Whether a tokenizer is of the one kind whose chunks may be encoded on their own."""
        chain = json.loads(tokenizer_json)
        split, letters = {"type": "Split", "pattern": {"Regex": WORD_SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel"}
        before = (chain.get("pre_tokenizer") or {}).get("pretokenizers") or [None, {}]
        plain = ("single_word", "lstrip", "rstrip", "normalized")
        return (chain.get("normalizer") == {"type": "Sequence", "normalizers": WORD_NORMAL} and chain["model"]["type"] == "BPE"
                and not chain["model"].get("dropout") and len(before) == 2 and before[0] == split
                and before[1].get("type") == letters["type"] and not before[1].get("add_prefix_space") and before[1].get("use_regex") is False
                and not chain.get("truncation") and not chain.get("padding")
                and not any(any(t[k] for k in plain) or t["content"] != "".join(t["content"].split()) for t in chain["added_tokens"]))

    def chunks(self, text: bytes) -> list[bytes]:
        lower = text.lower()  # bytes: A-Z only
        if any(token in lower for token in self.special):
            return text.split()
        if lower.isascii():
            return lower.split()
        body = text.decode()
        return text.split() if OTHER.search(body) else body.lower().encode().split()

    def piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else "".join(map(self.shown.__getitem__, piece.encode()))
        ids = self.pieces[piece] = self.packed([t.id for t in self.model.tokenize(letters)])
        return ids

    def learn(self, chunks: list[bytes]) -> None:
        if len(self.pieces) > REMEMBERED:
            self.pieces = {}
        pieces, other, safe, split = self.pieces, [], SAFE.match, self.split.findall
        for chunk in chunks:
            body = chunk.decode()
            if body.isalpha() and (body.isascii() or safe(body)) and body.islower():  # one piece
                ids = pieces.get(body)
                self.known[chunk] = self.piece(body) if ids is None else ids
                continue
            if not safe(body) or body != body.lower() or any(token in chunk for token in self.special):
                other.append(chunk)
                continue
            parts = []
            for piece in split(body):
                ids = pieces.get(piece)
                parts.append(self.piece(piece) if ids is None else ids)
            self.known[chunk] = b"".join(parts)
        self.known.update(zip(other, self.raw([chunk.decode() for chunk in other])))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [self.chunks(text) for text in texts]
        wanted = set().union(*split)
        new = [chunk for chunk in wanted if chunk not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(wanted)
        self.learn(new)
        known = self.known.__getitem__
        return [b"".join(map(known, chunks)) + self.end for chunks in split]


def text_encoder(tokenizer_json: str, dtype: str, end_id: int) -> WholeTexts:
    return (ChunkEncoder if ChunkEncoder.serves(tokenizer_json) else WholeTexts)(tokenizer_json, dtype, end_id)


def write_part(folder: str, part: int, batches, tokenizer_json: str, dtype: str, end_id: int):
    """Stream a range of documents into one part; returns its manifest row."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoder, width = text_encoder(tokenizer_json, dtype, end_id), np.dtype(dtype).itemsize
    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
    os.makedirs(folder, exist_ok=True)
    lengths, ids, missing = [], [], []
    with open(path + ".bin", "wb") as out:
        for batch in slices(batches, "body", ENCODED_BYTES):
            for encoded in encoder.encode(utf8(batch.column("body"))):
                out.write(encoded)
                lengths.append(len(encoded) // width)
            ids.append(batch.column("id").fill_null(0).to_numpy(zero_copy_only=False))
            missing.append(batch.column("id").is_null().to_numpy(zero_copy_only=False))
    ends = np.cumsum([0, *lengths], dtype=np.uint64)
    with open(path + ".idx", "wb") as out:
        out.write(MAGIC + struct.pack("<Q", len(lengths)) + ends.tobytes())
        out.write(np.concatenate(ids or [np.zeros(0, np.int64)]).astype("<i8").tobytes())
        out.write(np.concatenate(missing or [np.zeros(0, bool)]).astype(np.uint8).tobytes())
    return part, path, len(lengths), int(ends[-1])


class Part:
    """One part, memory-mapped."""

    def __init__(self, path: str, dtype: str):
        index = np.memmap(path + ".idx", dtype=np.uint8, mode="r")
        if bytes(index[:8]) != MAGIC:
            raise ValueError(f"{path}.idx is no index of token files")
        n = struct.unpack("<Q", bytes(index[8:16]))[0]
        self.ends = index[16:24 + 8 * n].view("<u8").astype(np.int64)
        self.ids = index[24 + 8 * n:24 + 16 * n].view("<i8")
        self.missing = index[24 + 16 * n:24 + 17 * n].view(bool)
        size = int(self.ends[-1])
        self.tokens = np.memmap(path + ".bin", dtype=dtype, mode="r", shape=(size,)) if size else np.zeros(0, dtype)

    def document(self, k: int) -> np.ndarray:
        return self.tokens[self.ends[k]:self.ends[k + 1]]


def write_tokens(docs: DataFrame, tokenizer_json: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                 dtype: str = "<u2", parts: int | None = None) -> DataFrame:
    """Write all documents in ascending id order; returns the manifest (part, path, documents, tokens, base).

    Null ids come first; rows that repeat an id follow one another; a null text is its end id
    alone; an empty table gives an empty manifest; other columns are not looked at.
    """
    spark = docs.sparkSession
    folder = mounted(shared_folder(spark, "tokens"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import pyspark

        first = next(batches, None)
        if first is None:
            return

        def rest():
            yield first
            yield from batches

        row = write_part(folder, pyspark.TaskContext.get().partitionId(), rest(), tokenizer_json, dtype, end_id)
        yield pa.record_batch([pa.array([v]) for v in row], names=["part", "path", "documents", "tokens"])

    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", F.col("body"))
    manifest = staged(ordered.mapInArrow(run, PART_SCHEMA), "manifest")
    base, listed = 0, []
    for r in manifest.orderBy("part").collect():  # one row for each file
        listed.append((r["part"], r["path"], r["documents"], r["tokens"], base))
        base += r["tokens"]
    return spark.createDataFrame(listed, PART_SCHEMA + ", base long")


def read_tokens(manifest: DataFrame, dtype: str = "<u2", id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the memory-mapped files.

    The checksum is that of the ids as little-endian unsigned 32-bit integers.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                part = Part(row["path"], dtype)
                for first in range(0, row["documents"], 4096):
                    ks = range(first, min(first + 4096, row["documents"]))
                    sums = [zlib.crc32(part.document(k).astype("<u4").tobytes()) for k in ks]
                    span = slice(ks.start, ks.stop)
                    yield pa.record_batch([
                        pa.array(np.array(part.ids[span]), pa.int64(), mask=np.array(part.missing[span])),
                        pa.array(part.ends[span] + row["base"], pa.int64()),
                        pa.array(np.diff(part.ends[ks.start:ks.stop + 1]), pa.int64()), pa.array(sums, pa.int64()),
                    ], names=["id", "start", "n_tokens", "ids_crc32"])

    files = manifest.repartition(max(1, manifest.count()), "part")
    return files.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
