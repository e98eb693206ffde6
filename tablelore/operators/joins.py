"""Which columns join two tables, and how well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.names import singular_stems
from ..functions.types import ref, type_family
from ..sources.rows import pick_column


def _links(catalog: DataFrame, side: str) -> DataFrame:
    """Names under which a column can be found: its own, and for ``id`` also
    ``{singular}_id`` for every singular of its table name."""
    own = F.lower("column_name")
    foreign = F.transform(
        singular_stems(F.col("table_name")),
        lambda stem: F.struct(F.concat(stem, F.lit("_id")).alias("link"),
                              F.lit(True).alias("foreign")))
    itself = F.array(F.struct(own.alias("link"), F.lit(False).alias("foreign")))
    return catalog.select(
        F.col("table_name").alias(f"{side}_table"),
        F.col("column_name").alias(f"{side}_col"),
        type_family(F.col("data_type")).alias(f"{side}_family"),
        F.inline(F.when(own == "id", F.concat(itself, foreign)).otherwise(itself)),
    ).withColumnRenamed("foreign", f"{side}_foreign")


def join_candidates(catalog: DataFrame, table: str, target: str | None = None) -> DataFrame:
    """Likely join columns between ``table`` and every other table of a column catalog.

    Columns match by equal name, or by convention: ``{singular}_id`` of one side with
    ``id`` of the other.  One row per target table and column pair; best tables first.
    All rules meet in one equi-join whose left side is the columns of a single table.
    """
    name = F.lower("table_name")
    others = catalog.where(name != table.lower())
    if target is not None:
        others = others.where(name == target.lower())
    pairs = _links(catalog.where(name == table.lower()), "source").join(
        _links(others, "target"), "link"
    ).where(~(F.col("source_foreign") & F.col("target_foreign")))

    # The rules in order of preference, the first one wins for a pair of columns.
    order = (F.when(F.col("target_foreign"), 2).when(F.col("source_foreign"), 3)
             .otherwise(1))
    exact = order == 1
    same = F.col("source_family") == F.col("target_family")

    def graded(confidence: tuple[float, float]) -> Column:
        return F.when(same, confidence[0]).otherwise(confidence[1])

    match = F.struct(
        order.alias("order"),
        F.when(exact, "exact_name").otherwise("convention").alias("match_type"),
        F.when(exact, graded(fixed.EXACT_NAME_CONFIDENCE))
        .otherwise(graded(fixed.CONVENTION_CONFIDENCE)).alias("confidence"))
    one_table = Window.partitionBy("target_table")  # at most the pairs of two tables
    return (
        pairs.groupBy("source_table", "target_table", "source_col", "target_col")
        .agg(F.min(match).alias("match"))
        .select("source_table", "target_table", "source_col", "target_col",
                "match.match_type", "match.confidence",
                F.max("match.confidence").over(one_table).alias("table_confidence"))
        .orderBy(F.desc("table_confidence"), "target_table", F.desc("confidence"),
                 "source_col", "target_col")
    )


def key_evidence(source: DataFrame, source_col: str, target: DataFrame,
                 target_col: str) -> DataFrame:
    """How far a candidate key holds, as one row.

    ``containment`` is the share of distinct source keys present in the target,
    ``orphan_rows`` the source rows without a partner.  Both sides are counted per key
    first; the join reuses that partitioning and a frequent key is a single row.
    """
    def per_key(df: DataFrame, column: str, n: str) -> DataFrame:
        c = ref(pick_column(df, column))
        return df.groupBy(c.alias("k")).agg(F.count(F.lit(1)).alias(n))

    left = per_key(source, source_col, "source_n")
    right = per_key(target, target_col, "target_n").where(F.col("k").isNotNull())
    both = left.join(right, "k", "full")
    s, t = F.col("source_n"), F.col("target_n")
    has_key = F.col("k").isNotNull()

    def total(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))

    def wide(c: Column) -> Column:
        # The join size of two frequent keys can pass the range of a bigint.
        return c.cast("decimal(19,0)")

    sums = both.agg(
        total(s.isNotNull(), s).alias("source_rows"),
        total(~has_key, s).alias("source_nulls"),
        F.count_if(has_key & s.isNotNull()).alias("source_distinct"),
        F.count_if(s.isNotNull() & t.isNotNull()).alias("matched_distinct"),
        total(has_key & t.isNull(), s).alias("orphan_rows"),
        F.count_if(t.isNotNull()).alias("target_distinct"),
        F.coalesce(F.max(F.when(has_key, s)), F.lit(0)).alias("source_max"),
        F.coalesce(F.max(t), F.lit(0)).alias("target_max"),
        total(s.isNotNull() & t.isNotNull(), wide(s) * wide(t)).alias("joined_rows"),
    )
    one_source, one_target = F.col("source_max") <= 1, F.col("target_max") <= 1
    return sums.select(
        F.lit(source_col).alias("source_col"), F.lit(target_col).alias("target_col"),
        "source_rows", "source_nulls", "source_distinct", "matched_distinct",
        F.round(F.col("matched_distinct")
                / F.nullif(F.col("source_distinct"), F.lit(0)), 4).alias("containment"),
        "orphan_rows", "target_distinct", one_target.alias("target_unique"),
        F.concat(F.when(one_source, "one").otherwise("many"), F.lit("_to_"),
                 F.when(one_target, "one").otherwise("many")).alias("cardinality"),
        "joined_rows",
    )
