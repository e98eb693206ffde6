"""Group-by summaries and measures by dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, names
from ..functions.types import ref
from ..sources.rows import pick_column, pick_columns

_AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def pivot(
    df: DataFrame,
    rows: Sequence[str],
    values: Sequence[str],
    agg: str,
    where: str | Column | None = None,
    order_by: Sequence[str | Column] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Group by ``rows`` and apply one aggregate to every value column.

    Results are named ``{agg}_{column}``; ``count`` of ``*`` is ``count_star`` and also
    counts rows whose values are null.
    """
    kind = agg.lower()
    if kind not in _AGGREGATES:
        raise ValueError(
            f"invalid aggregation {agg!r}; use one of {', '.join(sorted(_AGGREGATES))}")
    if "*" in values and kind != "count":
        raise ValueError("'*' only goes with count")
    if where is not None:
        df = df.where(where)
    keys = [pick_column(df, r) for r in rows]
    measures = [
        F.count(F.lit(1)).alias("count_star") if v == "*"
        else _AGGREGATES[kind](ref(pick_column(df, v))).alias(f"{kind}_{v}")
        for v in values
    ]
    out = df.groupBy(*[ref(k) for k in keys]).agg(*measures)
    out = out.orderBy(*(order_by or [ref(k) for k in keys]))
    return out.limit(limit) if limit and limit > 0 else out


def model_metrics(df: DataFrame, dimension: str,
                  measures: Sequence[str] | None = None) -> DataFrame:
    """Every measure column by one dimension: averaged when its name reads like a
    rate, summed otherwise."""
    by = pick_column(df, dimension)
    chosen = pick_columns(df, measures) if measures else [
        f.name for f in df.schema.fields
        if names.role(f.name, f.dataType) == "measure" and f.name != by
    ]
    aggregates = []
    for name in chosen:
        averaged = any(w in name.lower() for w in fixed.AVERAGE_WORDS)
        kind = "avg" if averaged else "sum"
        aggregates.append(_AGGREGATES[kind](ref(name)).alias(f"{kind}_{name.lower()}"))
    return df.groupBy(ref(by)).agg(F.count(F.lit(1)).alias("row_count"), *aggregates)
