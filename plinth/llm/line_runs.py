"""Line de-duplication over levelled sorted runs, in DataFrame operations only.

The corpus is taken in batches of ascending ids.  A run is a sorted table of line keys, each
with the id that owns it.  A batch is reduced to one row per key, merge-anti-joined with all
runs so far, and what is new becomes a run of level 0; ``fan_in`` runs of one level are
compacted into one of the next.  Because batches ascend, the owner of a key is the smallest
id that holds it, whatever the sizes of the batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import WHITE, ascii_lower, staged

MIN_CODE_POINTS = 10


def split_lines(text: Column) -> Column:
    """Lines between \\n; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column, least: int) -> Column:
    """128-bit key of the stripped, A-Z lower-cased line; null below ``least`` code points."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.char_length(bare) >= least, F.unhex(F.md5(ascii_lower(bare))))


class LineRuns:
    """The sorted runs, by level; each key lies in exactly one run."""

    def __init__(self, fan_in: int = 2):
        self.fan_in = fan_in
        self.levels: list[list[DataFrame]] = []

    def all(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        if not runs:
            return None
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def add(self, lines: DataFrame) -> None:
        """Merge-anti-join the keys of a batch (key, id) with the runs and add the new ones."""
        fresh = lines.groupBy("key").agg(F.min("id").alias("owner"))  # a key of many lines is one row before the shuffle
        known = self.all()
        if known is not None:
            fresh = fresh.join(known.select("key"), "key", "left_anti")
        self._put(0, fresh)

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(staged(run.sortWithinPartitions("key"), f"run-{level}"))
        if len(self.levels[level]) == self.fan_in:
            first, *rest = self.levels[level]
            for other in rest:
                first = first.unionByName(other)
            self.levels[level] = []
            self._put(level + 1, first.repartition("key"))


def batches_of(lines: DataFrame, batches: int) -> Column:
    """Number of the id range of a row; the bounds only decide how even the batches are."""
    cuts = sorted(set(lines.approxQuantile("id", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.col("id") > F.lit(cut)).cast("int")
    return number


def lost_lines(docs: DataFrame, id_col: str, text_col: str, least: int, batches: int, fan_in: int) -> DataFrame:
    """(id, row, lost): the places of the lines that a text (``row``: its hash) loses because a smaller id holds them."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).where("id IS NOT NULL")
    keys = F.transform(split_lines(F.col("body")), lambda line: line_key(line, least))
    batch = batches_of(rows.select("id"), batches)
    lines = rows.select("id", F.xxhash64("body").alias("row"), batch.alias("batch"), F.posexplode(keys).alias("at", "key")).where("key IS NOT NULL")
    lines = staged(lines, "lines", "batch")
    runs = LineRuns(fan_in)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k).select("key", "id"))
    # Both sides come straight from storage: AQE splits the partition of a line that a third of all documents hold.
    return (lines.select("id", "row", "at", "key").join(runs.all(), "key").where("owner < id")
            .groupBy("id", "row").agg(F.collect_set("at").alias("lost")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CODE_POINTS,
                batches: int = 4, fan_in: int = 2, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with repeated lines taken out of its texts, and two columns: lines before, lines dropped.

    A line of at least ``least`` code points (stripped) stays only in the smallest id that
    holds it, there with all its places.  Ids are integers.  Rows that repeat an id count as
    one document; a row without an id owns nothing and loses nothing; a null text becomes an
    empty one; an empty table gives no rows; other columns pass through under their names.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    id_name, body = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    lost = lost_lines(plain, id_name, body, least, batches, fan_in)
    cut = plain.withColumns({"row": F.xxhash64(body), "lines": split_lines(F.col(body))}).drop(body)
    joined = cut.join(lost.withColumnRenamed("row", "its"), (cut[id_name] == lost["id"]) & (cut["row"] == F.col("its")), "left")
    # Places left over by a hash set, then lines by place: work in proportion to the lines, however many are lost.
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.col("lines")).otherwise(F.transform(places, lambda at: F.get(F.col("lines"), at)))
    others = [c for c in plain.columns if c != body]
    out = joined.select(*others, F.size("lines").cast("long").alias("n0"), kept.alias("kept"))
    return (out.withColumn("n1", F.col("n0") - F.size("kept"))
            .withColumn(body, F.array_join("kept", "\n"))
            .select(*plain.columns, "n0", "n1").toDF(*names, *counts))
