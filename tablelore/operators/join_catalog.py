"""Which columns of a whole catalog hold the keys of which others.

One scan a table makes a theta sketch of every key column: the values with the smallest
hashes. Two sketches cut at the same hash are the same sample of two sets, so the share of
the source's sample that the target has is its containment, with a known error. The pairs
whose answer the error leaves open are counted exactly, many at once: every value is
grouped once with a mask of the columns that hold it, and the masks answer all pairs.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from math import log, sqrt

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.types import is_text, is_temporal, ref
from ..store import SMALL_TABLE_ROWS, small_or_whole, temporary_folder, written
from .joins import key_evidence

#: Tables or pairs in one plan; further ones get plans of their own.
BATCH = 40
#: Columns that the bits of one number tell apart.
MASK_COLUMNS = 63


def _kind(dt: T.DataType) -> str | None:
    """Columns of one kind can hold each other's values; none for those that are no keys."""
    if isinstance(dt, T.IntegralType):
        return "number"
    if is_text(dt):
        return "text"
    return dt.simpleString() if is_temporal(dt) else None


def _value(name: str, kind: str) -> Column:
    c = ref(name)
    return c.cast("bigint") if kind == "number" else c


def _hashed(name: str, kind: str) -> Column:
    return F.xxhash64(_value(name, kind))


def _appended(frames: list[DataFrame], name: str) -> DataFrame:
    """All frames in one written table, so many a plan and each computed once."""
    spark = frames[0].sparkSession
    path = f"{temporary_folder(spark, name)}/rows"
    for i in range(0, len(frames), BATCH):
        reduce(DataFrame.unionByName, frames[i:i + BATCH]).write.mode("append").parquet(path)
    return spark.read.schema(frames[0].schema).parquet(path)


def key_sketches(tables: Mapping[str, DataFrame], log_size: int = 12) -> DataFrame:
    """One row per column that can be a key: its counts and a sketch of its values.

    Whole numbers, texts, dates and times count; a column of nulls alone has an empty
    sketch. Each table is read once and shuffles one row a task; the sketches, at most
    16 bytes times two to the power of ``log_size`` each, are written.
    """
    frames = []
    for table, df in tables.items():
        kinds = {f.name: k for f in df.schema.fields if (k := _kind(f.dataType))}
        if not kinds:
            continue
        # Names may hold any character, so the aggregates go by number.
        sums = df.agg(*[a for i, (c, k) in enumerate(kinds.items()) for a in (
            F.count(ref(c)).alias(f"n{i}"),
            F.theta_sketch_agg(F.when(ref(c).isNotNull(), _hashed(c, k)),
                               F.lit(log_size)).alias(f"s{i}"))])
        frames.append(sums.select(F.lit(table).alias("table_name"), F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("kind"),
                     F.col(f"n{i}").alias("non_null_rows"),
                     F.theta_sketch_estimate(f"s{i}").alias("distinct_near"),
                     F.col(f"s{i}").alias("sketch"))
            for i, (c, k) in enumerate(kinds.items())]))))
    return _appended(frames, "key-sketches")


def key_pairs(sketches: DataFrame, unique: float = 0.9) -> DataFrame:
    """Pairs of columns of one kind in two tables whose target is nearly a key.

    A target is nearly a key if its distinct values are at least ``unique`` of its rows,
    as far as its sketch says; the default leaves room for four standard errors. Rows of
    names: as many as columns times near keys of one kind, whatever the size of the tables.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("kind", F.col("table_name").alias(f"{name}_table"),
                         F.col("column_name").alias(f"{name}_col"))

    keys = sketches.where((F.col("non_null_rows") > 0)
                          & (F.col("distinct_near") >= unique * F.col("non_null_rows")))
    return side(sketches.where("non_null_rows > 0"), "source").join(
        side(keys, "target"), "kind").where("source_table <> target_table").drop("kind")


def containment_bounds(sketches: DataFrame, pairs: DataFrame, log_size: int = 12,
                       chance: float = 1e-9) -> DataFrame:
    """``pairs`` with ``near``, ``low`` and ``high`` for the containment of their source.

    Source and target sketches that hold all their values answer exactly (but for equal
    64-bit hashes). Else the source's values below the lower of the two cuts are a sample
    without replacement; by Hoeffding's inequality a share taken from m of them is off by
    more than ``sqrt(ln(2 / chance) / 2m)`` with a probability below ``chance``. Where the
    target is larger than the source, m shrinks in proportion. A source without values
    has null bounds.
    """
    size = float(2 ** log_size)

    def side(name: str) -> DataFrame:
        return sketches.select(
            F.col("table_name").alias(f"{name}_table"), F.col("column_name").alias(f"{name}_col"),
            F.col("distinct_near").cast("double").alias(f"{name}_n"),
            F.col("sketch").alias(f"{name}_sketch"))

    both = (pairs.join(side("source"), ["source_table", "source_col"])
            .join(side("target"), ["target_table", "target_col"]))
    # Both are cut at the same hash, so their ratio is that of the sample.
    shared = F.theta_sketch_estimate(F.theta_intersection("source_sketch", "target_sketch"))
    alone = F.theta_sketch_estimate(F.theta_difference("source_sketch", "target_sketch"))
    both = both.withColumn("shared", shared.cast("double")).withColumn(
        "alone", alone.cast("double"))
    near = F.try_divide("shared", F.col("shared") + F.col("alone"))
    larger = F.greatest("source_n", "target_n")
    # A merged sketch keeps at least its nominal size; a tenth is left for the estimate.
    sample = F.try_divide(0.9 * size * F.col("source_n"), larger)
    error = F.when(larger < 0.9 * size, 0.0).otherwise(F.coalesce(
        F.sqrt(F.try_divide(F.lit(log(2 / chance) / 2), sample)), F.lit(1.0)))
    return both.select(
        "source_table", "source_col", "target_table", "target_col",
        F.when(F.col("source_n") > 0, F.coalesce(near, F.lit(0.0))).alias("near"),
        error.alias("error")).select(
        "source_table", "source_col", "target_table", "target_col", "near",
        *[F.when(F.col("near").isNotNull(), c).alias(name) for name, c in (
            ("low", F.greatest(F.lit(0.0), F.col("near") - F.col("error"))),
            ("high", F.least(F.lit(1.0), F.col("near") + F.col("error"))))])


def widest_error(log_size: int = 12, chance: float = 1e-9) -> float:
    """The error of a pair whose target is no larger than its source."""
    return sqrt(log(2 / chance) / 2 / (0.9 * 2 ** log_size))


def _portions(pairs: list[tuple], sizes: Mapping[tuple, float], kinds: Mapping[tuple, str],
              rows: int) -> list[tuple[list[tuple], bool]]:
    """Pairs of columns in portions of one kind and at most ``MASK_COLUMNS`` columns.

    True for portions whose sources have at most ``rows`` distinct values together, by
    their sketches; pairs with larger sources come apart.
    """
    out: list[tuple[list[tuple], bool]] = []
    last = None
    for source, target in sorted(pairs, key=lambda p: (kinds[p[0]], sizes[p[0]], *p)):
        few = sizes[source] <= rows
        if out and last == (kinds[source], few):
            columns = {c for p in out[-1][0] for c in p} | {source, target}
            values = sum(sizes[c] for c in {p[0] for p in out[-1][0]} | {source})
            if len(columns) <= MASK_COLUMNS and (values <= rows or not few):
                out[-1][0].append((source, target))
                continue
        out.append(([(source, target)], few))
        last = kinds[source], few
    return out


def _values_of(tables: Mapping[str, DataFrame], columns: list[tuple], kind: str) -> DataFrame:
    """``(value, mask)`` of all columns, each table read once; bit i stands for column i."""
    own: dict[str, list[tuple[int, str]]] = {}
    for i, (table, column) in enumerate(columns):
        own.setdefault(table, []).append((i, column))
    return reduce(DataFrame.unionByName, [
        tables[table].select(F.inline(F.array(*[
            F.struct(_value(c, kind).alias("value"), F.lit(1 << i).cast("bigint").alias("mask"))
            for i, c in named]))).where("value is not null")
        for table, named in own.items()])


def _matched(tables: Mapping[str, DataFrame], pairs: list[tuple], kinds: Mapping[tuple, str],
             sizes: Mapping[tuple, float], rows: int = SMALL_TABLE_ROWS) -> DataFrame:
    """The pairs of names with ``source_distinct`` and ``matched_distinct``, exactly.

    Values are grouped once, with a mask of the columns that hold them, so that a value is
    shuffled once from every task whatever the number of pairs. Where the sources have few
    values, others are left out before. A row per mask that occurs is left.
    """
    spark = next(iter(tables.values())).sparkSession
    counted, asked = [], []
    for n, (portion, few) in enumerate(_portions(pairs, sizes, kinds, rows)):
        sources = sorted({p[0] for p in portion})
        columns = sources + sorted({p[1] for p in portion} - set(sources))
        kind = kinds[sources[0]]
        values = _values_of(tables, columns, kind)
        if few:
            sought = written(_values_of(tables, sources, kind).select(
                F.xxhash64("value").alias("hash")).distinct(), "sought")
            values = values.withColumn("hash", F.xxhash64("value")).join(
                small_or_whole(sought, rows), "hash", "left_semi")
        masks = values.groupBy("value").agg(F.bit_or("mask").alias("mask")).groupBy(
            "mask").agg(F.count(F.lit(1)).alias("n"))
        counted.append(masks.select(F.lit(n).alias("portion"), "mask", "n"))
        asked += [(n, *s, *t, columns.index(s), columns.index(t)) for s, t in portion]
    masks = _appended(counted, "masks")
    asked = spark.createDataFrame(asked, "portion int, source_table string, source_col string, "
                                  "target_table string, target_col string, s int, t int")
    in_source, in_target = (F.expr(f"bit_get(mask, {bit}) = 1") for bit in "st")
    return asked.join(masks, "portion").where(in_source).groupBy(
        "source_table", "source_col", "target_table", "target_col").agg(
        F.sum("n").alias("source_distinct"),
        F.sum(F.when(in_target, F.col("n")).otherwise(0)).alias("matched_distinct"))


def catalog_evidence(tables: Mapping[str, DataFrame], pairs: DataFrame | None = None,
                     least: float = 0.9, log_size: int = 12, chance: float = 1e-9,
                     sketches: DataFrame | None = None) -> DataFrame:
    """Which pairs of columns hold as keys: one row per pair, ``holds`` if at least
    ``least`` of the source's distinct values are in the target.

    ``pairs`` has ``source_table``, ``source_col``, ``target_table``, ``target_col`` and
    defaults to ``key_pairs``; a pair whose source has no values does not hold. ``low`` and
    ``high`` bound the containment, ``settled_by`` says whether the sketches sufficed or
    the pair was joined; joined ones have their exact containment in both. Every table is
    read once for the sketches, unless ``key_sketches`` of ``log_size`` are given, and a few
    times for all pairs that stay open. The names of those and of the columns come to the
    driver, which plans what is read.
    """
    if sketches is None:
        sketches = key_sketches(tables, log_size)
    bounds = written(containment_bounds(
        sketches, key_pairs(sketches) if pairs is None else pairs, log_size, chance), "bounds")
    names = ["source_table", "source_col", "target_table", "target_col"]
    is_open = (F.col("low") < least) & (F.col("high") >= least) & (F.col("low") < F.col("high"))
    settled = bounds.where(~F.coalesce(is_open, F.lit(False))).select(
        *names, "low", "high", F.coalesce(F.col("low") >= least, F.lit(False)).alias("holds"),
        F.lit("sketch").alias("settled_by"))
    left = [((p.source_table, p.source_col), (p.target_table, p.target_col))
            for p in bounds.where(is_open).select(*names).orderBy(*names).collect()]
    if not left:
        return settled
    columns = sketches.select("table_name", "column_name", "kind", "distinct_near").collect()
    kinds = {(c.table_name, c.column_name): c.kind for c in columns}
    sizes = {(c.table_name, c.column_name): float(c.distinct_near) for c in columns}
    alike = [p for p in left if kinds[p[0]] == kinds[p[1]]]
    parts = [_matched(tables, list(dict.fromkeys(alike)), kinds, sizes)] if alike else []
    # Pairs that were asked for although their types differ compare as Spark compares them.
    mixed = [key_evidence(tables[s[0]], s[1], tables[t[0]], t[1]).select(
        F.lit(s[0]).alias("source_table"), "source_col", F.lit(t[0]).alias("target_table"),
        "target_col", "source_distinct", "matched_distinct")
        for s, t in left if kinds[s] != kinds[t]]
    if mixed:
        parts.append(_appended(mixed, "joined-pairs"))
    exact = F.try_divide("matched_distinct", "source_distinct")
    joined = reduce(DataFrame.unionByName, parts).select(
        *names, exact.alias("low"), exact.alias("high"), (exact >= least).alias("holds"),
        F.lit("join").alias("settled_by"))
    return settled.unionByName(joined)
