"""Exact quantiles, ranks and row numbers that never gather a group in one task.

Spark's ``percentile`` keeps one hash map of distinct values per group, so a group
holding a third of the rows ends up in one task's memory.  The operators here walk a
monotone *cell* of the value instead: counts per (group, cell) are pre-aggregated
map-side and bounded in number, the cells that hold the wanted ranks are found with a
running sum over those counts, and only the rows inside the hit cells are looked at
again.  Results are exact, and the source is read twice however many columns,
quantiles, aggregates and groupings are wanted.  Ranks and row numbers come from rows
cut into ordered ranges, as many as the rows need.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.numbers import finite
from plinth.session import measured

CELLS_PER_E = 256           # coarse cells, about 0.4 % of the value wide
FINE_PER_E = 1 << 20        # 4096 fine cells inside one coarse cell
SUB_CELLS = 1 << 16         # parts of one fine cell, between its least and its greatest value
CELL_ORIGIN = 1 << 30       # > 745 * FINE_PER_E: keeps magnitudes positive
PART_ROWS = 1 << 20         # rows of one range when rows are ranked or numbered


def value_cell(x: Column, cells_per_e: int = CELLS_PER_E) -> Column:
    """A non-decreasing integer cell of a double: logarithmic, signed, zero apart."""
    size = F.floor(F.ln(F.abs(x)) * F.lit(float(cells_per_e))) + F.lit(CELL_ORIGIN)
    return F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("bigint")


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join on ``keys`` treating NULL keys as equal (as ``groupBy`` does)."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = F.lit(True)
    for key in keys:
        cond = cond & F.col(key).eqNullSafe(F.col(f"__r_{key}"))
    out = left.join(renamed, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])


class RankDirectory:
    """Counts of every cell of some columns per finest group, from one pass over the rows.

    Coarser groups are sums of its rows, so any number of groupings share the pass.  A second
    pass over the rows, the same for all groupings and columns, looks only at the cells in
    which a wanted rank lies.  ``aggs`` (named columns) are computed per finest group in the
    first pass, over a row of its own beside those of the columns.
    """

    def __init__(self, df: DataFrame, finest: Sequence[str], columns: Sequence[str], aggs: Sequence[Column] = ()):
        self.df, self.finest, self.columns = df, list(finest), list(columns)
        kinds = {f.name: f.dataType for f in df.schema.fields}
        self.kinds = {k: kinds[k] for k in self.finest}
        values = F.array(F.lit(None).cast("double"), *[F.col(c).cast("double") for c in self.columns])
        long = df.select("*", F.posexplode(values).alias("__m", "__v"))
        long = long.where((F.col("__m") == 0) | (F.abs("__v") < float("inf")))  # neither null nor NaN nor infinite
        cell = F.when(F.col("__m") > 0, F.expr(_cell_sql("__v", CELLS_PER_E)))
        self.counts = measured(long.groupBy(*self.finest, "__m", cell.alias("__cell")).agg(F.count("*").alias("__n"), *aggs))
        self.names = [c for c in self.counts.columns if c not in (*self.finest, "__m", "__cell", "__n")]

    def groups(self, where: Column | None = None) -> DataFrame:
        """The finest groups with their aggregates and ``__n`` rows each."""
        out = self.counts.where("__m = 0").select(*self.finest, "__n", *self.names)
        return out if where is None else out.where(where)

    def ranks(self, groupings: Sequence[tuple[Sequence[str], Column | None]], wanted: Mapping[str, Mapping[str, float]]) -> list[DataFrame]:
        """Exact quantiles (keys..., names...) of each grouping (keys among the finest, condition on them)."""
        cells, ways = None, []
        for number, (keys, where) in enumerate(groupings):
            shown = [(F.col(k) if k in keys else F.lit(None).cast(self.kinds[k])).alias(k) for k in self.finest]
            part = self.counts.where("__m > 0") if where is None else self.counts.where("__m > 0").where(where)
            part = part.select(F.lit(number).alias("__g"), *shown, (F.col("__m") - 1).alias("m"), F.col("__cell").alias("cell"), "__n")
            cells = part if cells is None else cells.unionByName(part)
            way = F.struct(F.lit(number).alias("__g"), *shown)
            ways.append(way if where is None else F.when(where, way))
        keys = ["__g", *self.finest]
        cells = cells.groupBy(*keys, "m", "cell").agg(F.sum("__n").alias("n"))
        rows = self.df.select(*self.finest, *[F.col(c).cast("double").alias(f"__c{i}") for i, c in enumerate(self.columns)])
        if len(groupings) > 1 or groupings[0][1] is not None or len(groupings[0][0]) < len(self.finest):
            ways = F.filter(F.array(*ways), lambda w: w.isNotNull())
            rows = rows.select(F.inline(ways), *[f"__c{i}" for i in range(len(self.columns))])
        else:
            rows = rows.withColumn("__g", F.lit(0))
        long = rows.select(*keys, F.posexplode(F.array(*[f"__c{i}" for i in range(len(self.columns))])).alias("m", "v"))
        long = long.where(F.abs("v") < float("inf")).withColumn("cell", F.expr(_cell_sql("v", CELLS_PER_E)))
        found = _values_at_ranks(cells, long, keys, self.columns, wanted)
        if len(groupings) > 1:
            found = measured(found)
        names = [name for probs in wanted.values() for name in probs]
        return [found.where(F.col("__g") == number).select(*keys, *names) for number, (keys, _) in enumerate(groupings)]


def quantiles(df: DataFrame, keys: Sequence[str],
              wanted: Mapping[str, Mapping[str, float]], bounded: bool = False) -> DataFrame:
    """Exact linear-interpolation quantiles per group.

    ``wanted`` maps a numeric column to ``{output name: probability}``.  ``bounded``
    is the caller's statement that every group is small by construction (a series of
    periods, say); only then is the built-in grouped ``percentile`` used.
    Groups without a single value are absent from the result.
    """
    if bounded:
        aggs = [F.percentile(finite(col), p).alias(name)
                for col, probs in wanted.items() for name, p in probs.items()]
        return df.groupBy(*keys).agg(*aggs)
    return RankDirectory(df, keys, list(wanted)).ranks([(list(keys), None)], wanted)[0]


def _values_at_ranks(cells: DataFrame, long: DataFrame, keys: Sequence[str], columns: Sequence[str],
                     wanted: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Quantiles per key from cell counts (keys, m, cell, n) and values (keys, m, v, cell)."""
    names = [name for probs in wanted.values() for name in probs]
    spark = long.sparkSession
    ks = "".join(f"`{k}`, " for k in keys)
    part = f"PARTITION BY {ks}m"

    def same(left: str, right: str, *cells: str) -> str:
        return " AND ".join([f"{left}.`{k}` <=> {right}.`{k}`" for k in keys]
                            + [f"{left}.{c} = {right}.{c}" for c in ("m", *cells)])

    asked = ", ".join("array(" + ", ".join(f"struct('{n}' AS name, double({p}) AS p)" for n, p in wanted.get(c, {}).items()) + ")"
                      for c in columns)
    hits = measured(spark.sql(f"""
        WITH cells AS (
          SELECT *, sum(n) OVER ({part} ORDER BY cell) AS upto, sum(n) OVER ({part}) AS total FROM {{counts}}),
        asked AS (
          SELECT *, t.p * (total - 1) AS pos FROM cells
          LATERAL VIEW explode(get(array({asked}), m)) AS t),
        ranks AS (
          SELECT * FROM asked LATERAL VIEW explode(array(floor(pos), floor(pos) + 1)) AS k
          WHERE k >= upto - n AND k < upto)
        SELECT {ks}m, cell, collect_set(struct(
          t.name AS name, k - upto + n AS k, k > floor(pos) AS upper, pos - floor(pos) AS frac)) AS targets
        FROM ranks GROUP BY {ks}m, cell""", counts=cells))
    outs = ", ".join(
        f"""max(CASE WHEN t.name = '{n}' AND NOT t.upper THEN v END) AS `lo_{n}`,
        max(CASE WHEN t.name = '{n}' AND t.upper THEN v END) AS `hi_{n}`,
        max(CASE WHEN t.name = '{n}' THEN t.frac END) AS `f_{n}`""" for n in names)
    final = ", ".join(
        f"CASE WHEN `f_{n}` > 0 THEN `lo_{n}` + (`hi_{n}` - `lo_{n}`) * `f_{n}` ELSE `lo_{n}` END AS `{n}`" for n in names)
    lcols = "".join(f"l.`{k}`, " for k in keys) + "l.m, l.cell, l.v"
    vcols = "".join(f"x.`{k}`, " for k in keys) + "x.v, x.n, x.targets"
    counted = measured(spark.sql(f"""
          SELECT g.*, h.targets FROM (
            SELECT {lcols}, count(*) AS n, any_value({_cell_sql('l.v', FINE_PER_E)}) AS fine
            FROM {{long}} l JOIN {{hits}} h ON {same('l', 'h', 'cell')} GROUP BY {lcols}) g
          JOIN {{hits}} h ON {same('g', 'h', 'cell')}""", long=long, hits=hits))
    return spark.sql(f"""
        WITH counted AS (SELECT * FROM {{counted}}),
        fines AS (
          SELECT *, sum(fn) OVER ({part}, cell ORDER BY fine) - fn AS before
          FROM (SELECT {ks}m, cell, fine, sum(n) AS fn, min(v) AS lo, max(v) AS hi, any_value(targets) AS ft
                FROM counted GROUP BY {ks}m, cell, fine)),
        kept AS (SELECT * FROM fines WHERE exists(ft, t -> t.k >= before AND t.k < before + fn)),
        cut AS (
          SELECT {vcols}, x.m, x.cell, x.fine, y.before, y.ft,
            coalesce(floor(try_divide(x.v - y.lo, y.hi - y.lo) * {SUB_CELLS}D), 0) AS sub
          FROM counted x JOIN kept y ON {same('x', 'y', 'cell', 'fine')}),
        subs AS (
          SELECT *, before + sum(sn) OVER ({part}, cell, fine ORDER BY sub) - sn AS start
          FROM (SELECT {ks}m, cell, fine, sub, sum(n) AS sn, any_value(before) AS before, any_value(ft) AS ft
                FROM cut GROUP BY {ks}m, cell, fine, sub)),
        hit AS (SELECT * FROM subs WHERE exists(ft, t -> t.k >= start AND t.k < start + sn)),
        placed AS (
          SELECT {vcols}, y.start + sum(x.n) OVER (
            PARTITION BY {"".join(f"x.`{k}`, " for k in keys)}x.m, x.cell, x.fine, x.sub ORDER BY x.v) AS upto
          FROM cut x JOIN hit y ON {same('x', 'y', 'cell', 'fine', 'sub')}),
        found AS (
          SELECT {ks}v, t FROM placed
          LATERAL VIEW explode(filter(targets, t -> t.k < upto AND t.k >= upto - n)) AS t)
        SELECT {ks}{final} FROM (SELECT {ks}{outs} FROM found GROUP BY {ks[:-2]})""", counted=counted)


def _cell_sql(x: str, cells_per_e: int) -> str:
    """SQL text of :func:`value_cell`."""
    size = f"(floor(ln(abs({x})) * {float(cells_per_e)}D) + {CELL_ORIGIN})"
    return f"CASE WHEN {x} = 0 THEN 0L WHEN {x} > 0 THEN {size} ELSE -{size} END"


def summarise(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column],
              wanted: Mapping[str, Mapping[str, float]], bounded: bool = False) -> DataFrame:
    """Ordinary aggregates and exact quantiles of the same groups, side by side."""
    keys = list(keys)
    if bounded:
        extra = [F.percentile(finite(col), p).alias(name)
                 for col, probs in wanted.items() for name, p in probs.items()]
        return df.groupBy(*keys).agg(*aggs, *extra)
    directory = RankDirectory(df, keys, list(wanted), aggs)
    ranked = directory.ranks([(keys, None)], wanted)[0]
    base = directory.groups().drop("__n")
    if keys:
        return join_on(base, ranked, keys, "left")
    one = F.lit(1)
    if base.isEmpty():  # the one group of a table without rows
        base = df.agg(*aggs)
    return base.withColumn("__one", one).join(ranked.withColumn("__one", one), "__one", "left").drop("__one")


def in_ranges(df: DataFrame, order: Sequence[str], part_rows: int | None = None) -> DataFrame:
    """The rows written in ``order`` (NULL first), cut into ranges ``__part`` of about ``part_rows`` rows.

    Ranges are cut by ``order``, then by a hash of the row, then by a seeded number, so neither
    close values nor one value nor equal rows can fill a range: the number of ranges grows with the
    rows, their size does not.  Each range is one file, whose rows lie in order.
    """
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = df.withColumns({"__hash": F.xxhash64(*hashed), "__salt": F.rand(17)})
    ranges = max(1, -(-df.count() // (part_rows or PART_ROWS)))
    by = [F.col(c).asc_nulls_first() for c in [*order, "__hash", "__salt"]]
    cut = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).drop("__hash", "__salt")
    return measured(cut.withColumn("__part", F.spark_partition_id()))


def _ranked(counts: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Distinct (keys, value, n) with the tie-averaged rank: a running sum over ranges, then one inside each."""
    running = (Window.unboundedPreceding, Window.currentRow)
    rows = in_ranges(counts, [*keys, value])
    parts = rows.groupBy(*keys, "__part").agg(F.sum("n").alias("__pn"))
    upto = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(*running)
    before = parts.select(*keys, "__part", (F.sum("__pn").over(upto) - F.col("__pn")).alias("__before"))
    inside = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(*running)
    summed = rows.withColumn("__in", F.sum("n").over(inside) - F.col("n"))
    return join_on(summed, before, [*keys, "__part"], "inner").select(
        *keys, value, "n", (F.col("__before") + F.col("__in") + (F.col("n") + 1) / 2.0).alias(out))


def average_ranks(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "avg_rank") -> DataFrame:
    """One row per distinct (keys, value) with its tie-averaged rank and its count ``n``.

    Copies of a value collapse to a count; distinct values are ranked in ranges of bounded size.
    """
    keys = list(keys)
    return _ranked(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")), keys, value, out)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (rho, pairs): Pearson correlation of the tie-averaged ranks.

    Equal (x, y) pairs collapse to a count first, so copies never travel; the counts
    re-enter as weights of the closed-form correlation.
    """
    pairs = measured(df.select(finite(x).alias("__x"), finite(y).alias("__y"))
                     .where("__x IS NOT NULL AND __y IS NOT NULL")
                     .groupBy("__x", "__y").agg(F.count("*").alias("w")))

    def ranks(col: str, out: str) -> DataFrame:
        return _ranked(pairs.groupBy(col).agg(F.sum("w").alias("n")), [], col, out).select(col, out)

    ranked = pairs.join(ranks("__x", "rx"), "__x").join(ranks("__y", "ry"), "__y")
    return weighted_corr(ranked, "rx", "ry", "w")


def weighted_corr(df: DataFrame, x: str, y: str, w: str) -> DataFrame:
    """Pearson correlation with integer weights, centred on the mean rank."""
    x, y, w = F.col(x), F.col(y), F.col(w)
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    sxy, sxx, syy = F.sum(w * x * y), F.sum(w * x * x), F.sum(w * y * y)
    sums = df.agg(n.alias("pairs"), sx.alias("sx"), sy.alias("sy"),
                  sxy.alias("sxy"), sxx.alias("sxx"), syy.alias("syy"))
    num = F.col("pairs") * F.col("sxy") - F.col("sx") * F.col("sy")
    den = F.sqrt(F.col("pairs") * F.col("sxx") - F.col("sx") * F.col("sx")) * \
        F.sqrt(F.col("pairs") * F.col("syy") - F.col("sy") * F.col("sy"))
    return sums.select(F.try_divide(num, den).alias("rho"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by ``order`` (then by every other column).

    An aggregate, not a window: copies of one key collapse map-side.
    """
    rest = [c for c in df.columns if c not in order]
    row = F.struct(*[F.col(c) for c in [*order, *rest]])
    return df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min(row).alias("__row")) \
        .select(*[F.col(f"__row.{c}").alias(c) for c in df.columns])


def numbered(df: DataFrame, order: str, tie: Sequence[str] = (), out: str = "row_no", keys: Sequence[str] = ()) -> DataFrame:
    """A 1-based row number by ``order`` then ``tie``, over all rows or within ``keys``, computed in parallel.

    The rows are written in ranges of bounded size (:func:`in_ranges`); a row's number is the
    rows of the ranges before its own and its place in its file, so no window holds rows.
    Orders and ties may be of any sortable type and are compared as they are.  Rows without a
    value come first; rows equal in ``order`` and ``tie`` follow a hash of the row, so reruns
    agree up to rows that are equal in every column.
    """
    keys = list(keys)
    rows = in_ranges(df, [*keys, order, *tie]).select(*[F.col(f"`{c}`") for c in df.columns], "__part", F.col("_metadata.row_index").alias("__at"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("__part").agg(F.count("*").alias("__pn"))  # one row per range
    parts = measured(parts.select("__part", F.coalesce(F.sum("__pn").over(before), F.lit(0)).alias("__before")))
    placed = rows.join(parts, "__part").withColumn(out, F.col("__before") + F.col("__at") + 1)
    if keys:
        first = measured(placed.groupBy(*keys).agg((F.min(out) - 1).alias("__first")))
        placed = join_on(placed, first, keys, "inner").withColumn(out, F.col(out) - F.col("__first"))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], out)
