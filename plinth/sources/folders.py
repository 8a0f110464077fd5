"""A folder of mixed files as named tables, with a manifest of what was read and what failed."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, NumericType, StructType

from plinth.operators.clean import cleaned, safe_columns, safe_name
from plinth.operators.sets import jaccard
from plinth.session import cut_lineage
from plinth.sources import files, json_walk

FILE = "__file"
TEXT, JSON, PARQUET = ("csv", "tsv", "txt"), ("json", "jsonl"), ("parquet",)
SAME_SHAPE = json_walk.SAME_SHAPE
FOOTERS_AT_ONCE = 16


def local_form(path: Column) -> Column:
    """A file's path in one form, whether a listing or ``_metadata`` names it."""
    return F.regexp_replace(path, "^file:/+", "/")


def file_of(column: str = "_metadata.file_path") -> Column:
    return local_form(F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B"))))


def table_name(path: str) -> str:
    """The name of a file's table: its stem, that of its folder for the part files of a written table."""
    parts = path.rstrip("/").split("/")
    name = parts[-2] if parts[-1].startswith("part-") and len(parts) > 1 else parts[-1]
    return safe_name(name.rsplit(".", 1)[0] if "." in name[1:] else name)


def _text_tables(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, str, DataFrame]]:
    """(first file, name, rows) for each name and layout of delimited files; files without a filled line give none."""
    groups: dict[tuple, list[str]] = {}
    for path, layout in files.layouts(spark, list(paths)).items():
        groups.setdefault((table_name(path), layout), []).append(path)
    return [(min(found), name, files.read_layout(spark, found, layout, source=FILE)) for (name, layout), found in sorted(groups.items(), key=str)]


def _parquet_tables(spark: SparkSession, paths: Sequence[str]) -> tuple[list[tuple[str, str, DataFrame]], dict[str, int]]:
    """The same for Parquet files of one schema each, and the rows that each readable footer names."""
    with ThreadPoolExecutor(FOOTERS_AT_ONCE) as pool:
        footers = dict(zip(paths, pool.map(lambda p: files.footer(spark, p), paths), strict=True))
    groups: dict[tuple[str, str], list[str]] = {}
    for path, found in footers.items():
        if found is not None and not path.rsplit("/", 1)[1].startswith("_"):  # Spark reads no file of such a name
            groups.setdefault((table_name(path), found[1]), []).append(path)
    reader = spark.read.option("ignoreCorruptFiles", True)
    tables = [(min(found), name, reader.parquet(*found).withColumn(FILE, F.col("_metadata.file_path"))) for (name, _), found in sorted(groups.items())]
    return tables, {path: found[0] for path, found in footers.items() if found is not None}


def _json_tables(spark: SparkSession, paths: Sequence[str]) -> tuple[list[tuple[str, str, DataFrame]], DataFrame]:
    tables, manifest = json_walk.read_json_tables(spark, list(paths))
    out = []
    for name, df in tables.items():
        df = df.toDF(*df.columns[:-1], FILE)
        out.append((min(paths), name.split("__")[0], df))
    return out, manifest


def _nested(kind) -> bool:
    return isinstance(kind, (ArrayType, MapType, StructType))


def stacked(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables by column name; a column whose types have no common kind is text, a nested one JSON text."""
    kinds = {f.name: f.dataType for f in b.schema.fields}
    differ = {f.name for f in a.schema.fields if f.name in kinds and f.dataType != kinds[f.name]
              and not (isinstance(f.dataType, NumericType) and isinstance(kinds[f.name], NumericType))}
    as_text = lambda df: df.select(*[
        (F.to_json(f"`{f.name}`") if _nested(f.dataType) else F.col(f"`{f.name}`").cast("string")).alias(f.name)
        if f.name in differ else F.col(f"`{f.name}`") for f in df.schema.fields])
    return as_text(a).unionByName(as_text(b), allowMissingColumns=True)


def merged(tables: Sequence[tuple[str, str, DataFrame]]) -> dict[str, DataFrame]:
    """Tables of one name and 60 % common columns are stacked; another shape of a name gets a number appended."""
    out: dict[str, tuple[str, DataFrame]] = {}
    for _, name, df in sorted(tables, key=lambda t: t[:2]):
        df = _with_safe_names(df)
        columns = [c for c in df.columns if c != FILE]
        same = next((k for k, (base, other) in out.items() if base == name and jaccard([c for c in other.columns if c != FILE], columns) >= SAME_SHAPE), None)
        if same is None:
            same, n = name, 2
            while same in out:
                same, n = f"{name}__{n}", n + 1
            out[same] = (name, df)
        else:
            out[same] = (name, stacked(out[same][1], df))
    return {k: df for k, (_, df) in out.items()}


def _with_safe_names(df: DataFrame) -> DataFrame:
    rest = [F.col(f"`{c}`") for c in df.columns if c != FILE]
    return df.select(*rest, FILE).toDF(*safe_columns(df.select(*rest)).columns, FILE)


def _rows_of(df: DataFrame) -> DataFrame:
    """(path, rows) of a table's files; every column is read, so that damage inside a file shows."""
    hashed = F.xxhash64(*[F.to_json(F.struct(f"`{c}`")) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in df.dtypes])
    return df.groupBy(file_of(FILE).alias("path")).agg(F.count("*").alias("rows"), F.bit_xor(hashed).alias("read")) \
        .where("read IS NOT NULL").drop("read")


def read_folder(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(cleaned tables by name, manifest: path, bytes, suffix, rows, damaged, failed) of a folder of any readable files.

    Delimited text, JSON, JSON lines and Parquet are read side by side; hidden and lock files are skipped.  Tables of
    one name are stacked where 60 % of their columns agree.  No bad file ends the run: ``failed`` marks a file that
    gave no row (empty, no JSON, no footer) or a Parquet file of which other rows were read than its footer names;
    ``damaged`` counts left out lines of JSON.  A folder without readable files gives no table and an empty manifest.
    The driver holds one line for each file (as Spark's own listing does) and reads Parquet footers sixteen at a time.
    """
    found = cut_lineage(files.discover(spark, folder))
    listed: dict[str, list[str]] = {}
    for r in found.select("path", "suffix").collect():
        listed.setdefault(r["suffix"], []).append(r["path"])
    of = lambda kinds: sorted(p for k in kinds for p in listed.get(k, []))
    text = _text_tables(spark, of(TEXT)) if of(TEXT) else []
    parquet, footers = _parquet_tables(spark, of(PARQUET)) if of(PARQUET) else ([], {})
    json, lines = _json_tables(spark, of(JSON)) if of(JSON) else ([], spark.createDataFrame([], "file string, damaged long"))
    counts = [_rows_of(df) for _, _, df in [*text, *parquet, *json]]
    none = spark.createDataFrame([], "path string, rows long")
    rows = reduce(DataFrame.unionByName, counts, none).groupBy("path").agg(F.sum("rows").alias("rows"))
    named = spark.createDataFrame(list(footers.items()), "path string, named long").withColumn("path", local_form(F.col("path")))
    damaged = lines.select(file_of("file").alias("path"), "damaged")
    manifest = found.withColumn("path", local_form(F.col("path"))).join(rows, "path", "left").join(named, "path", "left").join(damaged, "path", "left") \
        .withColumns({"rows": F.coalesce("rows", F.lit(0)), "damaged": F.coalesce("damaged", F.lit(0))}) \
        .withColumn("failed", F.when(F.col("suffix").isin(*PARQUET), ~F.col("rows").eqNullSafe(F.col("named"))).otherwise(F.col("rows") == 0)) \
        .select("path", "bytes", "suffix", "rows", "damaged", "failed")
    return {name: cleaned(df.drop(FILE)) for name, df in merged([*text, *parquet, *json]).items()}, cut_lineage(manifest)
