"""JSON of any of the usual shapes to named flat tables, decided from the inferred schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from plinth.operators.clean import safe_columns

# Keys of an envelope in order of preference, nesting depth.
ENVELOPE = ["data", "records", "rows", "items", "result", "results", "values", "table"]
MAX_DEPTH = 3


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects to dotted columns, then safe names."""
    def leaves(schema: StructType, path: str = "", label: str = ""):
        for f in schema.fields:
            here = f"{path}.`{f.name}`" if path else f"`{f.name}`"
            name = f"{label}.{f.name}" if label else f.name
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, here, name)
            else:
                yield F.col(here).alias(name)
    return safe_columns(df.select(*leaves(df.schema)))


def _record_list(field) -> bool:
    return isinstance(field.dataType, ArrayType) and isinstance(field.dataType.elementType, StructType)


def _plain_list(field) -> bool:
    return isinstance(field.dataType, ArrayType) and not isinstance(field.dataType.elementType, (StructType, ArrayType))


def tables_of(df: DataFrame, name: str = "data", depth: int = 0) -> dict[str, DataFrame]:
    """Tables inside a parsed JSON document: envelope, several lists, columns, index or plain records."""
    fields = df.schema.fields
    lists = [f for f in fields if _record_list(f)]
    wrapped = next((f for key in ENVELOPE for f in lists if f.name == key), None)
    if wrapped is not None:
        return {name: flatten(df.select(F.inline(F.col(f"`{wrapped.name}`"))))}
    if lists and depth < MAX_DEPTH and len(lists) + sum(isinstance(f.dataType, StructType) for f in fields) == len(fields):
        return {f.name: flatten(df.select(F.inline(F.col(f"`{f.name}`")))) for f in lists}
    if len(fields) > 1 and all(_plain_list(f) for f in fields):
        return {name: safe_columns(df.select(F.inline(F.arrays_zip(*[F.col(f"`{f.name}`") for f in fields]))))}
    structs = [f for f in fields if isinstance(f.dataType, StructType)]
    if structs and len(structs) == len(fields) and len(fields) > 1:
        shapes = {tuple(sorted(f.dataType.names)) for f in structs}
        if len(shapes) == 1:
            names = structs[0].dataType.names
            rows = F.array(*[F.struct(F.lit(f.name).alias("key"), *[F.col(f"`{f.name}`.`{n}`").alias(n) for n in names])
                             for f in structs])
            return {name: flatten(df.select(F.inline(rows)))}
        if depth < MAX_DEPTH:
            out: dict[str, DataFrame] = {}
            for f in structs:
                out.update(tables_of(df.select(F.col(f"`{f.name}`.*")), f.name, depth + 1))
            return out
    return {name: flatten(df)}


def envelope_note(df: DataFrame) -> DataFrame:
    """Scalar siblings of an envelope's list as one metadata row (JSON text)."""
    scalars = [f.name for f in df.schema.fields if not isinstance(f.dataType, (ArrayType, StructType))]
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in scalars])).alias("note"))


def json_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(files of one document each, files of JSON lines).

    A file whose first filled line parses on its own is read by lines.  Any other is tried as
    one document, and read by lines, damage counted, where it is none.
    """
    ok = F.try_parse_json("value").isNotNull()
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.input_file_name().alias("file"), ok.alias("ok"), F.monotonically_increasing_id().alias("at"))
    firsts = lines.groupBy("file").agg(F.min_by("ok", "at").alias("ok")).collect()  # one row per file
    by_line, open_ = [r["file"] for r in firsts if r["ok"]], [r["file"] for r in firsts if not r["ok"]]
    whole: list[str] = []
    if open_:
        tried = spark.read.text(open_, wholetext=True).select(F.input_file_name().alias("file"), ok.alias("ok")).collect()
        whole, by_line = [r["file"] for r in tried if r["ok"]], by_line + [r["file"] for r in tried if not r["ok"]]
    return sorted(whole), sorted(by_line)


def read_json(spark: SparkSession, path: str, name: str = "data") -> dict[str, DataFrame]:
    """Tables of the JSON files below a path; ``damaged_lines`` tells what reading by lines left out."""
    whole, by_line = json_files(spark, path)
    out = tables_of(spark.read.option("multiLine", True).json(whole), name) if whole else {}
    if by_line:
        for key, rows in tables_of(read_json_lines(spark, by_line)[0], name).items():
            out[key] = out[key].unionByName(rows, allowMissingColumns=True) if key in out else rows
    return out


def damaged_lines(spark: SparkSession, path: str) -> DataFrame:
    """(damaged, lines) over the files that are read by lines."""
    by_line = json_files(spark, path)[1]
    return read_json_lines(spark, by_line)[1] if by_line else spark.createDataFrame([(0, 0)], "damaged long, lines long")


def read_json_lines(spark: SparkSession, path: str | list[str], schema: StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """(records of the sound lines, one row counting damaged and all lines).

    Damaged lines are skipped and counted, never fatal.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    if schema is None:
        inferred = spark.read.option("columnNameOfCorruptRecord", "_broken").json(path).schema
        schema = StructType([f for f in inferred.fields if f.name != "_broken"])
    parsed = lines.withColumn("ok", F.try_parse_json("value").isNotNull()) \
        .withColumn("r", F.from_json("value", schema))
    return parsed.where("ok").select("r.*"), parsed.agg(
        F.count_if(~F.col("ok")).alias("damaged"), F.count("*").alias("lines"))
