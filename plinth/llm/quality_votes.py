"""Quality rules by weak supervision.

Every rule votes keep or reject on a document, or abstains.  Nobody says how reliable a
rule is: expectation-maximisation over the votes of all documents estimates for each rule
how often it votes which way on good and on bad documents, and the posterior probability
that a document is good replaces "all rules must pass".

Only the counts of vote patterns (at most 3 ** len(RULES) of them, whatever the input) reach
the driver; the votes of a document come from one pass over its whole text.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import slices, staged, utf8

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
SENTENCE_ENDS = (b".", b"!", b"?", b'"', b":", b";")
NOT_LETTERS = bytes(range(0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))

# (name, keep at or below, reject above): a share between the two bounds abstains.
RULES = [
    ("repeat_share", 0.20, 0.40),  # words in repeated 3-word windows / words
    ("symbol_share", 0.02, 0.10),  # symbols / words
    ("dup_line_share", 0.10, 0.30),  # repeated lines / lines with a word
    ("wordless_share", 0.15, 0.40),  # words without a letter / words
    ("top_word_share", 0.15, 0.30),  # most frequent word / words
    ("open_line_share", 0.50, 0.90),  # lines without a closing mark / lines with a word
    ("odd_word_length", 0.0, 0.5),  # 0: mean word of 3 to 12 code points, 1: under 2 or over 16, else 0.25
]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURE_SCHEMA = ", ".join(f"{name} long" for name in MEASURES) + ", votes int"

KEEP, REJECT, ABSTAIN = 0, 1, 2


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice, the first place included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered = bytearray(len(words))
    for place, window in enumerate(windows):
        if counts[window] > 1:
            covered[place:place + 3] = b"\x01\x01\x01"
    return covered.count(1)


def measure(text: bytes) -> tuple[int, ...]:
    """The five base measures of a text and its votes, one base-3 digit for each rule."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    word_chars = len(joined.translate(None, CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    lines = repeats = open_lines = 0
    for line in text.split(b"\n"):
        bare = line.strip()
        if bare:
            lines += 1
            open_lines += not bare.endswith(SENTENCE_ENDS)
            if line in seen:
                repeats += 1
            else:
                seen.add(line)
    windowed = repeated_words(words)
    if n:
        mean = word_chars / n
        counts = Counter(words)
        shares = (
            windowed / n, symbols / n, repeats / lines, sum(c for w, c in counts.items() if not w.translate(None, NOT_LETTERS)) / n,
            max(counts.values()) / n, open_lines / lines, 0.0 if 3 <= mean <= 12 else 1.0 if mean < 2 or mean > 16 else 0.25,
        )
        votes = 0
        for (_, good, bad), share in zip(RULES, shares):
            votes = votes * 3 + (KEEP if share <= good else REJECT if share > bad else ABSTAIN)
    else:
        votes = 3 ** len(RULES) - 1  # nothing to judge: all abstain
    return n, word_chars, symbols, repeats, windowed, votes


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, base measures, votes.  A null text is an empty one."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "body"):
            columns = list(zip(*map(measure, utf8(batch.column("body")))))
            yield pa.record_batch([batch.column("id"), *(pa.array(c, pa.int64()) for c in columns[:-1]),
                                   pa.array(columns[-1], pa.int32())], names=["id", *MEASURES, "votes"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(run, f"id {kind}, {MEASURE_SCHEMA}").withColumnRenamed("id", id_col)


def digits(pattern: int) -> list[int]:
    out = []
    for _ in RULES:
        out.append(pattern % 3)
        pattern //= 3
    return out[::-1]


def posteriors(counts: dict[int, int], prior: float = 0.8, rounds: int = 200, tolerance: float = 1e-9) -> dict[int, float]:
    """Probability of "good" for each vote pattern.

    Each rule has three rates (keep, reject, abstain) on good and on bad documents, started
    so that votes are more often right than wrong, and smoothed by one document of each
    start rate, so that a rule that never fires stays neutral.  Patterns are taken in order,
    so a rerun gives the same figures.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}
    votes = np.array([digits(p) for p in patterns])
    weight = np.array([counts[p] for p in patterns], dtype=float)
    start = np.array([[0.75, 0.05, 0.20], [0.35, 0.45, 0.20]])  # good, bad
    rates = np.repeat(start[:, None, :], len(RULES), axis=1)
    share, rule = prior, np.arange(len(RULES))
    good = np.full(len(patterns), share)
    for _ in range(rounds):
        log_good = np.log(share) + np.log(rates[0][rule, votes]).sum(axis=1)
        log_bad = np.log(1 - share) + np.log(rates[1][rule, votes]).sum(axis=1)
        new = 1 / (1 + np.exp(np.clip(log_bad - log_good, -700, 700)))
        moved, good = np.abs(new - good).max(), new
        if moved < tolerance:
            break
        for k, part in enumerate((good * weight, (1 - good) * weight)):
            for v in range(3):
                rates[k, :, v] = (part[:, None] * (votes == v)).sum(axis=0) + 10 * start[k, v]
            rates[k] /= rates[k].sum(axis=1, keepdims=True)
            # a keep vote must speak for good and a reject vote for bad: labels cannot switch
        swap = rates[1, :, KEEP] > rates[0, :, KEEP]
        rates[:, swap, KEEP] = rates[:, swap, KEEP].mean(axis=0)
        swap = rates[0, :, REJECT] > rates[1, :, REJECT]
        rates[:, swap, REJECT] = rates[:, swap, REJECT].mean(axis=0)
        rates /= rates.sum(axis=2, keepdims=True)
        share = float(np.clip((good * weight).sum() / weight.sum(), 0.01, 0.99))
    return dict(zip(patterns, good.tolist()))


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def fit(rows: DataFrame) -> dict[int, float]:
    """Posteriors from the votes of all documents that pass the base rules."""
    counts = rows.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).groupBy("votes").count()
    return posteriors({r["votes"]: r["count"] for r in counts.collect()})  # at most 3 ** len(RULES) rows


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Measures, base verdict, posterior and verdict of every row.

    Null or empty texts have no words and fail the base rules; rows that repeat an id are
    judged each on its own text; a null id stays null; an empty table gives no rows; other
    columns are not looked at.
    """
    rows = staged(measured(docs, id_col, text_col), "votes")
    good = fit(rows)
    table = rows.sparkSession.createDataFrame([(p, q) for p, q in good.items()], "votes int, quality double")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return (rows.join(F.broadcast(table), "votes", "left")  # at most 3 ** len(RULES) rows
            .withColumn("base_failed", failed)
            .withColumn("quality", F.when(failed, 0.0).otherwise(F.col("quality")))
            .withColumn("kept", ~failed & (F.col("quality") >= threshold))
            .select(id_col, *MEASURES, "base_failed", "quality", "kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns as they were.

    A first pass counts vote patterns, a second one drops rows where they lie: the texts are
    not shuffled.
    """
    good = fit(measured(docs, id_col, text_col))
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    body = f"c{names.index(text_col)}"

    def run(batches):
        for batch in slices(batches, body):
            mask = []
            for text in utf8(batch.column(body)):
                n, _, _, _, windowed, votes = measure(text)
                mask.append(not base_failed(n, windowed) and good[votes] >= threshold)
            yield batch.filter(pa.array(mask, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
