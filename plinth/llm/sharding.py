"""Sharding by extendible hashing.

A directory is indexed by prefixes of a document's hash.  A bucket whose bytes exceed the limit
splits on the next bit, the others stay; documents follow their bucket.  Sizes are counted once
for each prefix of LEVEL_BITS bits, and the splits within those bits follow from the counts;
only buckets that are still too large are counted again on the next bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import staged

# Bits a counting pass covers: at most 2 ** 12 cells for each bucket that still has to split.
LEVEL_BITS = 12
HASH_BITS = 60


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bits, size): a hash as a string of HASH_BITS binary digits, and the text's UTF-8 bytes."""
    code = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    bits = F.lpad(F.conv(F.substr(code, F.lit(1), F.lit(HASH_BITS // 4)), 16, 2), HASH_BITS, "0")
    return docs.select(F.col(id_col).alias("id"), bits.alias("bits"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("size"))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(prefix, depth, shard_bytes) of every bucket.

    A bucket is the shortest prefix within the limit below a prefix beyond it.  Where all
    HASH_BITS are used up (rows of one id) the bucket stays above the limit; ``shards`` deals
    its rows into overflow pages.
    """
    open_, done = None, []
    for start in range(0, HASH_BITS, LEVEL_BITS):
        part = rows if open_ is None else rows.join(open_, F.substring("bits", 1, start) == open_["prefix"], "left_semi")
        cells = part.groupBy(F.substring("bits", 1, start + LEVEL_BITS).alias("cell")).agg(F.sum("size").alias("size"))
        low = 0 if start == 0 else start + 1
        nodes = (cells.select("size", F.explode(F.transform(F.sequence(F.lit(low), F.lit(start + LEVEL_BITS)), lambda d: F.struct(
            d.alias("depth"), F.substr(F.col("cell"), F.lit(1), d).alias("prefix")))).alias("n"))
            .groupBy("n.depth", "n.prefix").agg(F.sum("size").alias("size")))
        nodes = staged(nodes, "nodes")
        parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("size").alias("up_size"))
        with_parent = nodes.join(parent, (nodes["depth"] == parent["depth"]) & (F.expr("substring(prefix, 1, length(prefix) - 1)") == parent["up"]), "left")
        # At the first depth of a later pass the parent is a bucket that was found too large.
        split = F.when(nodes["depth"] == low, F.lit(True)).otherwise(F.col("up_size") > limit)
        last = start + LEVEL_BITS >= HASH_BITS
        leaf = split & ((nodes["size"] <= limit) | (F.lit(last) & (nodes["depth"] == HASH_BITS)))
        done.append(with_parent.where(leaf).select("prefix", nodes["depth"].alias("depth"), nodes["size"].alias("shard_bytes")))
        if last:
            break
        open_ = staged(nodes.where((F.col("depth") == start + LEVEL_BITS) & (F.col("size") > limit)).select("prefix"), "open")
        if open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text_bytes, shard (the prefix, '*' for the root), depth, page, shard_bytes.

    A text longer than the limit has a shard of its own.  Rows of one id cannot be told apart by
    the hash: where they exceed the limit together, ``page`` numbers overflow pages that each
    keep within it; otherwise page is 0.  Null ids share one hash; a null text has 0 bytes; an
    empty table gives no rows; other columns are not looked at.
    """
    rows = staged(hashed(docs, id_col, text_col), "hashed")
    found = staged(directory(rows, limit), "directory")
    # A row meets its bucket at one depth: it looks only at the depths that occur (at most HASH_BITS + 1 values).
    depths = sorted(r["depth"] for r in found.select("depth").distinct().collect())
    tried = F.transform(F.array(*(F.lit(d) for d in depths)), lambda d: F.substr(F.col("bits"), F.lit(1), d))
    out = rows.withColumn("prefix", F.explode(tried)).join(found, "prefix")
    full = out.where((F.col("depth") == HASH_BITS) & (F.col("shard_bytes") > limit))
    rest = out.where((F.col("depth") < HASH_BITS) | (F.col("shard_bytes") <= limit))
    pages = overflow_pages(full, limit)
    columns = [F.col("id").alias(id_col), F.col("size").alias("text_bytes"), F.when(F.col("depth") == 0, "*").otherwise(F.col("prefix")).alias("shard"),
               "depth", "page", "shard_bytes"]
    return rest.withColumn("page", F.lit(0).cast("long")).select(*columns).unionByName(pages.select(*columns))


def overflow_pages(full: DataFrame, limit: int, salts: int = 256) -> DataFrame:
    """Pages for rows of equal hash: dealt over salts, then filled in order within a salt.

    A page is the running sum of bytes over half the limit, so that a page holds at most the
    limit; a row above half the limit starts its own.
    """
    salted = staged(full.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts))), "overflow")
    run = Window.partitionBy("prefix", "salt").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    half = max(1, limit // 2)
    large = F.col("size") > half
    number = F.when(large, F.row_number().over(Window.partitionBy("prefix", "salt").orderBy("size")) + F.lit(1 << 40)).otherwise(
        F.floor((F.sum("size").over(run) - 1) / half))
    return (salted.withColumn("page", (number * salts + F.col("salt")).cast("long"))
            .withColumn("shard_bytes", F.sum("size").over(Window.partitionBy("prefix", "page"))).drop("salt"))
