"""JSON documents of any shape to flat tables, walked as VARIANT values.

No key of a document becomes a field of a schema before its table is known: an index of a
hundred thousand keys gives as many rows.  The walk is one chain of explodes over the
documents, decided within each row; only the shapes of the tables found reach the driver.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from plinth.operators.clean import safe_columns
from plinth.session import cut_lineage

# Keys of an envelope in order of preference, nesting depth, share of columns that makes one table.
ENVELOPE = ["data", "records", "rows", "items", "result", "results", "values", "table"]
MAX_DEPTH = 3
SAME_SHAPE = 0.6
# A document is one row, which the JVM bounds at 2 GB: a larger file can only be lines.
MAX_DOCUMENT = 1 << 30
MAX_SHAPES = 10_000

LIST, OBJECT = "array<variant>", "map<string, variant>"
FOUND = "array<struct<table: string, key: string, record: variant, open: boolean>>"


def _as(kind: str, value: str = "v") -> str:
    """A cast: outside compiled code a path would be parsed for each value."""
    return f"try_cast({value} AS {kind})"


def _filled(value: str) -> str:
    return f"(size({_as(LIST, value)}) > 0 OR size({_as(OBJECT, value)}) > 0)"


def _safe(name: str) -> str:
    plain = rf"regexp_replace(trim({name}), '(?U)[\\W_]+', '_')"
    return f"lower(coalesce(nullif(trim(BOTH '_' FROM {plain}), ''), 'column'))"


def _found(table: str, record: str, key: str = "CAST(NULL AS string)", open_: bool = False) -> str:
    return f"named_struct('table', {table}, 'key', {key}, 'record', {record}, 'open', {str(open_).lower()})"


def _level(nodes: DataFrame, depth: int) -> DataFrame:
    """One level of the walk: every open node becomes its tables' records or the nodes below it."""
    below = depth < MAX_DEPTH
    keys = ", ".join(f"'{key}'" for key in ENVELOPE)
    payloads = f"filter(transform(array({keys}), k -> try_element_at(object, k)), w -> {_filled('w')})"
    facts = nodes.withColumn("v", F.expr("if(open, record, NULL)")) \
        .withColumns({"items": F.expr(_as(LIST)), "object": F.expr(_as(OBJECT))}) \
        .withColumn("fields", F.expr("map_entries(object)")) \
        .withColumns({
            "wrapped": F.expr(f"CASE WHEN size(fields) > 0 THEN try_element_at({payloads}, 1) END" if below else "CAST(NULL AS variant)"),
            "lists": F.expr(f"filter(transform(fields, e -> named_struct('key', e.key, 'items', {_as(LIST, 'e.value')})), e -> size(e.items) > 0)"),
            "indexed": F.expr(f"size(fields) > 0 AND forall(fields, e -> {_as(OBJECT, 'e.value')} IS NOT NULL)")})
    same_length = "size(array_distinct(transform(lists, l -> size(l.items)))) = 1"
    # One fold over the lists, each entry touched once.
    turned = ("aggregate(lists, CAST(array_repeat(array(), coalesce(size(get(lists, 0).items), 0)) AS array<array<struct<key: string, value: variant>>>), "
              "(rows, l) -> zip_with(rows, l.items, (row, x) -> concat(row, array(named_struct('key', l.key, 'value', x)))))")
    is_object = f"{_as(OBJECT, 'x')} IS NOT NULL"
    deeper = f"filter(fields, e -> {_filled('e.value')})" if below else "filter(fields, e -> false)"
    found = f"""CAST(CASE
        WHEN NOT open THEN array(named_struct('table', table, 'key', key, 'record', record, 'open', false))
        WHEN items IS NOT NULL AND forall(items, x -> {is_object}) THEN transform(items, x -> {_found('table', 'x')})
        WHEN items IS NOT NULL THEN transform(items, x -> {_found('table', 'to_variant_object(map(table, x))')})
        WHEN wrapped IS NOT NULL THEN array({_found('table', 'wrapped', open_=True)})
        WHEN size(lists) > 0 AND forall(lists, l -> forall(l.items, x -> {is_object}))
            THEN flatten(transform(lists, l -> transform(l.items, x -> {_found(_safe('l.key'), 'x')})))
        WHEN size(lists) > 0 AND {same_length} THEN transform({turned}, row -> {_found('table', 'to_variant_object(map_from_entries(row))')})
        WHEN indexed THEN transform(fields, e -> {_found('table', 'e.value', key='e.key')})
        WHEN size({deeper}) > 0 THEN transform({deeper}, e -> {_found(_safe('e.key'), 'e.value', open_=True)})
        WHEN size(fields) > 0 THEN array({_found('table', 'v')})
        END AS {FOUND})"""
    return facts.select("file", F.explode(F.expr(found)).alias("f")).select("file", "f.*")


def walk(docs: DataFrame) -> DataFrame:
    """(file, table, key, record) of documents (file, name, document VARIANT), one row per record.

    In this order an object is: an envelope (its first filled payload, list or object, is walked on); lists of
    objects (a table for each, named by its key; scalars beside them are left out); lists of one length (a row for
    each position); an index of objects (``key`` names the row); else its filled lists and objects are walked on
    under their own keys, and where it has none it is one record.  Lists of other values give one column named
    like the table.  Null, scalar and empty documents give nothing; walking ends below ``MAX_DEPTH`` levels, where
    an object is taken as one record.
    """
    rows = docs.select("file", F.col("name").alias("table"), F.lit(None).cast("string").alias("key"),
                       F.col("document").alias("record"), F.lit(True).alias("open"))
    for depth in range(MAX_DEPTH + 1):
        rows = _level(rows, depth)
    return rows.drop("open")


def record_schema(described: str) -> StructType:
    """The columns of records from what ``schema_of_variant_agg`` says of them.

    Decimals are read as doubles; values of mixed kinds, nulls only and empty objects as text.
    """
    def plain(m: re.Match) -> str:
        if m[1]:
            return f"{m[1] if m[1].startswith('`') else f'`{m[1]}`'}: "
        return {"OBJECT<": "STRUCT<", "DECIMAL": "DOUBLE"}.get(re.sub(r"\(.*", "", m[0]), "STRING")
    tokens = r"(`(?:[^`]|``)*`|\w+): |OBJECT<>|OBJECT<|VOID|VARIANT|DECIMAL\(\d+, ?\d+\)"
    parsed = DataType.fromDDL(re.sub(tokens, plain, described))
    return parsed if isinstance(parsed, StructType) else StructType()


def _value(record: Column, path: tuple[str, ...], kind: str) -> Column:
    """A value of a record by its path, whatever the names hold."""
    for name in path[:-1]:
        record = _value(record, (name,), "variant")
    name = path[-1]
    quote = next((q for q in "'\"" if q not in name), None)
    if quote is None:  # no path can write it
        record, at = F.try_element_at(F.try_variant_get(record, "$", OBJECT), F.lit(name)), "$"
    else:
        at = f"$[{quote}{name}{quote}]"
    if kind == "json":
        return F.to_json(F.try_variant_get(record, at, "variant"))
    return F.try_variant_get(record, at, kind)


def _leaves(schema: StructType, path: tuple[str, ...] = ()):
    """(path, type) of the columns; objects give a column for each of their own, lists with objects are JSON text."""
    for f in schema.fields:
        here, kind = (*path, f.name), f.dataType
        if isinstance(kind, StructType) and kind.fields:
            yield from _leaves(kind, here)
        elif isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
            yield here, "json"
        else:
            yield here, kind.simpleString()


def as_columns(rows: DataFrame, described: str, keyed: bool) -> DataFrame:
    """Records as columns of dotted, then safe and unique names, the index key first and the file last."""
    leaves = list(_leaves(record_schema(described)))
    columns = [_value(F.col("record"), path, kind) for path, kind in leaves]
    names = [".".join(path) for path, _ in leaves]
    if keyed:
        columns, names = [F.col("key"), *columns], ["key", *names]
    flat = rows.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)], F.col("file"))
    return safe_columns(flat.toDF(*names, "source_file"))


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of walked records.

    Records of one name are one table where the columns of their files overlap by 60 %; a name taken by another shape
    gets a number appended.  Shapes, not files, are compared on the driver; above ``MAX_SHAPES`` of them it refuses.
    """
    rows = cut_lineage(rows)
    keys = F.map_keys(F.try_variant_get("record", "$", OBJECT))
    shaped = cut_lineage(rows.select("table", "file", F.explode_outer(keys).alias("k")).groupBy("table", "file")
                         .agg(F.array_sort(F.collect_set("k")).alias("shape")))  # the columns of a file's table
    # Keys of an index are no columns: they are in ``key``, so shapes stay as few as the kinds of records.
    shapes = shaped.groupBy("table", "shape").agg(F.min("file").alias("first")).orderBy("first", "table", "shape").limit(MAX_SHAPES + 1).collect()
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"more than {MAX_SHAPES} shapes of tables: these documents are no tables")
    groups: dict[str, tuple[str, set[str]]] = {}
    placed = []
    for r in shapes:
        own = set(r["shape"])
        same = next((k for k, (base, cols) in groups.items() if base == r["table"] and len(own & cols) >= SAME_SHAPE * len(own | cols)), None)
        if same is None:
            same, n = r["table"], 2
            while same in groups:
                same, n = f"{r['table']}__{n}", n + 1
            groups[same] = (r["table"], own)
        placed.append((r["table"], r["shape"], same))
    if not placed:
        return {}
    spark = rows.sparkSession
    target = spark.createDataFrame(placed, "table string, shape array<string>, target string")
    places = cut_lineage(shaped.join(F.broadcast(target), ["table", "shape"]).select("table", "file", "target"))  # at most MAX_SHAPES rows of target
    sorted_out = cut_lineage(rows.join(places, ["table", "file"]))
    described = sorted_out.groupBy("target").agg(F.schema_of_variant_agg("record").alias("s"), F.count("key").alias("keyed")).collect()
    return {r["target"]: as_columns(sorted_out.where(F.col("target") == r["target"]), r["s"], r["keyed"] > 0) for r in described}


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The filled lines (file, bytes, at, document); the generator is a fence, so that no line is parsed again for a filter."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.monotonically_increasing_id().alias("at"),
                        F.inline(F.array(F.struct(F.try_parse_json("value").alias("document")))))


def documents(spark: SparkSession, path: str | list[str], by_lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents: file, name, document; manifest: file, lines, damaged, whole) of JSON files.

    A file is lines when its first filled line parses on its own, or more than half of its lines do: in one document
    of several lines every line that parses alone follows one that cannot, so that no file is taken for the wrong
    kind, and a large feed with a damaged first line is never read as one row.  Any other file is tried as one
    document, and counted as lines where it is none.  Damaged lines are left out and counted.  A file of one line is
    one document; several lines are the records of one table, as if they stood in a list; ``by_lines`` walks each line
    as a document of its own.
    """
    lines = _lines(spark, path)
    ok = F.col("document").isNotNull()
    facts = cut_lineage(lines.groupBy("file").agg(
        F.count("*").alias("lines"), F.count_if(ok).alias("sound"), F.min_by(ok, "at").alias("first"), F.max("bytes").alias("bytes"))
        .withColumn("open", ~F.col("first") & (F.col("sound") * 2 <= F.col("lines")) & (F.col("bytes") <= MAX_DOCUMENT)))
    tried = [r["file"] for r in facts.where("open").select("file").collect()]  # as many names as one-document files, as Spark's own listing
    empty = spark.createDataFrame([], "file string, document variant")
    whole = spark.read.text([unquote(f) for f in tried], wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("document")).where("document IS NOT NULL") if tried else empty
    whole = cut_lineage(whole)
    are_whole = whole.select("file").distinct().withColumn("whole", F.lit(True))
    manifest = facts.join(are_whole, "file", "left").select(
        "file", "lines", F.when(F.col("whole"), 0).otherwise(F.col("lines") - F.col("sound")).alias("damaged"), F.coalesce("whole", F.lit(False)).alias("whole"))
    listed = F.to_variant_object(F.array("document"))
    record = F.col("document") if by_lines else F.when(F.col("lines") == 1, F.col("document")).otherwise(listed)
    stem = F.regexp_extract(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), r"([^/]+?)(\.[^./]*)?(/part-[^/]*)?$", 1)  # the folder's of a written table
    named = manifest.where("NOT whole").withColumn("stem", stem).select("file", "lines", F.expr(_safe("stem")).alias("name"))  # once for each file
    single = lines.where(ok).join(named, "file").select("file", "name", record.alias("document"))
    docs = whole.withColumn("stem", stem).select("file", F.expr(_safe("stem")).alias("name"), "document").unionByName(single)
    return docs, manifest


def read_json_tables(spark: SparkSession, path: str | list[str], by_lines: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, manifest) of the JSON files below a path."""
    docs, manifest = documents(spark, path, by_lines)
    return tables(walk(docs)), manifest
