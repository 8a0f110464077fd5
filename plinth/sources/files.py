"""Delimited text, parquet, folders, database connections, policy and indicator files."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce
from typing import NamedTuple
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators.clean import cleaned

# Separators tried, suffixes read, hidden path parts.
SEPARATORS = [",", ";", "\t", "|"]
SUFFIXES = ["csv", "tsv", "txt", "json", "jsonl", "parquet"]
HIDDEN = r"/(\.|~\$)[^/]*"


class Layout(NamedTuple):
    """How a delimited file is written: its separator, its first filled line, whether quoted values span lines."""

    sep: str
    header: str
    many_lines: bool


def layouts(spark: SparkSession, path: str | list[str]) -> dict[str, Layout]:
    """The layout of each file of delimited text, from all its lines; files without a filled line have none.

    The separator is the one that occurs most evenly.  A line with an odd number of quotes opens or closes a value
    that spans lines: only such files are read as one split.
    """
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("at"))
    counts = lines.select("path", "value", "at", (F.regexp_count("value", F.lit('"')) % 2 == 1).alias("odd"),
                          *[F.regexp_count("value", F.lit(re.escape(sep))).alias(f"c{i}") for i, sep in enumerate(SEPARATORS)])
    parts = [f(f"c{i}").alias(f"{name}{i}") for i in range(len(SEPARATORS)) for f, name in ((F.min, "low"), (F.max, "high"))]
    first = [F.min_by("value", "at").alias("header"), *[F.min_by(f"c{i}", "at").alias(f"first{i}") for i in range(len(SEPARATORS))]]
    rows = counts.groupBy("path").agg(F.bool_or("odd").alias("many_lines"), *first, *parts).collect()  # one row for each file
    even = lambda r, i: (r[f"low{i}"] > 0, r[f"low{i}"] == r[f"high{i}"], r[f"low{i}"])
    rank = lambda r, i: (r[f"first{i}"],) if r["many_lines"] else even(r, i)  # noqa: E731  lines are no rows there: the header decides
    return {unquote(r["path"]): Layout(SEPARATORS[max(range(len(SEPARATORS)), key=lambda i: rank(r, i))], r["header"], r["many_lines"])
            for r in rows}


def read_layout(spark: SparkSession, paths: list[str], layout: Layout, source: str | None = None) -> DataFrame:
    """Files of one layout as text columns, with their own path under the name ``source``."""
    df = spark.read.option("header", True).option("multiLine", layout.many_lines).option("escape", '"').option("sep", layout.sep).csv(sorted(paths))
    return df.withColumn(source, F.col("_metadata.file_path")) if source else df


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, clean: bool = True) -> DataFrame:
    """CSV, TSV and the like as text columns; types are decided by the cleaning, on whole columns.

    Files of one layout are read together; files of different layouts are joined by column name.
    """
    groups: dict[Layout, list[str]] = {}
    for file, own in layouts(spark, path).items():
        groups.setdefault(own._replace(sep=sep or own.sep), []).append(file)
    parts = [read_layout(spark, found, own) for own, found in sorted(groups.items())]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else spark.read.option("header", True).csv(path)
    return cleaned(df) if clean else df


def _below(spark: SparkSession, folder: str):
    """(path, bytes) of every file below a folder, those that Spark's readers pass over included."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    found = root.getFileSystem(conf).listFiles(root, True)
    while found.hasNext():
        file = found.next()
        yield file.getPath().toString(), file.getLen()


def discover(spark: SparkSession, folder: str, suffixes=tuple(SUFFIXES)) -> DataFrame:
    """(path, bytes, suffix) of every readable file below a folder; hidden and lock files are skipped."""
    files = spark.createDataFrame(list(_below(spark, folder)), "path string, bytes long")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    below = F.replace(F.col("path"), F.lit(folder.rstrip("/")), F.lit(""))
    return files.select("path", "bytes", suffix.alias("suffix")).where(F.col("suffix").isin(*suffixes) & ~below.rlike(HIDDEN))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file with this text, in whatever file system the path names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def footer(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """(rows, schema) that the footer of a Parquet file names, None where it has no readable footer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    try:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
            jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf))
    except Py4JJavaError:
        return None
    try:
        return reader.getRecordCount(), reader.getFileMetaData().getSchema().toString()
    finally:
        reader.close()


def read_parquet_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their file, manifest): a damaged file is listed with the rows that could be read, not fatal.

    ``failed``: the footer cannot be read, or names another number of rows than were read.
    """
    footers = [(r, footer(spark, r["path"])) for r in discover(spark, folder, ("parquet",)).collect()]
    found = [(r["path"], r["bytes"], r["suffix"], named and named[0]) for r, named in footers]
    reader = spark.read.option("ignoreCorruptFiles", True)
    good = [path for path, _, _, rows in found if rows is not None]
    plain = [path for path in good if not path.rsplit("/", 1)[1].startswith("_")]  # Spark reads no file of such a name
    rows = (reader.parquet(*plain) if plain else spark.createDataFrame([], "value string")).withColumn(
        "source_file", F.col("_metadata.file_path") if plain else F.lit(""))
    at = lambda c: F.regexp_replace(c, "^file:/+", "/")
    # A bare count is taken from the footers: every column is read, so that damage inside a file shows.
    hashed = F.xxhash64(*[F.to_json(F.struct(f"`{c}`")) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in rows.dtypes])
    counts = rows.groupBy(F.url_decode(F.replace(at("source_file"), F.lit("+"), F.lit("%2B"))).alias("path")) \
        .agg(F.count("*").alias("rows"), F.bit_xor(hashed).alias("read")).where("read IS NOT NULL").drop("read")
    files = spark.createDataFrame(found, "path string, bytes long, suffix string, named long").withColumn("path", at("path"))
    manifest = files.join(counts, "path", "left").withColumn("rows", F.coalesce("rows", F.lit(0))) \
        .withColumn("failed", ~F.col("rows").eqNullSafe(F.col("named"))).drop("named")
    return rows, manifest


def redacted(url: str) -> str:
    """A connection URL without its credentials."""
    url = re.sub(r"//[^/@]+@", "//***@", url)
    return re.sub(r"(?i)(password|user)=[^&;]*", r"\1=***", url)


def read_connection(spark: SparkSession, url: str, table: str | None = None, query: str | None = None,
                    partition: Mapping[str, object] | None = None, properties: Mapping[str, str] | None = None) -> DataFrame:
    """A table (optionally read in parallel over a numeric column) or the result of one query."""
    reader = spark.read.format("jdbc").option("url", url).options(**dict(properties or {}))
    if query:
        return reader.option("query", query).load()
    for name, value in (partition or {}).items():
        reader = reader.option(name, value)
    return reader.option("dbtable", table).load()


def policy_events(raw: DataFrame) -> DataFrame:
    """Dated events only; entries marked as examples are skipped."""
    example = F.coalesce(F.col("example"), F.lit(False)) if "example" in raw.columns else F.lit(False)
    date = F.coalesce(F.try_to_timestamp("date", F.lit("yyyy-MM-dd")), F.try_to_timestamp("date", F.lit("yyyy-MM"))).cast("date")
    return raw.withColumn("date", date).where(F.col("date").isNotNull() & ~example)


def indicator_pointers(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(filled, missing) official indicators."""
    return obs.where("value IS NOT NULL"), obs.where("value IS NULL").select("name")
