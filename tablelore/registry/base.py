"""Registration of queries and the tables they read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, dict[str, str]] = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int",
                 "c_acctbal": "double", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int",
                 "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string",
             "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
               "o_totalprice": "double", "o_orderdate": "timestamp_ntz",
               "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint",
                 "l_linenumber": "int", "l_quantity": "double",
                 "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
                 "l_returnflag": "string", "l_linestatus": "string",
                 "l_shipdate": "timestamp_ntz"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint",
               "event_type": "string", "value": "double", "props": "string"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string",
                  "source": "string", "n_chars": "bigint"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string",
                      "text": "string"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
}


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


_QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register the decorated function; ``covers`` lists operator ids of the survey."""
    def add(run: Callable[[SparkSession, str], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        _QUERIES[name] = Query(name, run, sql, tuple(covers.split()))
        return run
    return add


def all_queries() -> dict[str, Query]:
    from . import facts, knowledge, questions, scans, shapes  # noqa: F401  (they register)

    return dict(_QUERIES)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def read_all(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {name: read(spark, sf, name) for name in TABLES}


# --- SQL for statistics: one SELECT per column ------------------------------------

NUMERIC = ("int", "bigint", "double")


def _literal(value: str | None) -> str:
    return "cast(null as varchar)" if value is None else f"'{value}'"


def profile_sql(source: str, columns: dict[str, str], quick: bool = False) -> str:
    parts = []
    for name, kind in columns.items():
        fields = [
            f"'{name}' as column_name", f"'{kind}' as column_type",
            "count(*) as total_rows", f"count(*) - count({name}) as null_count",
            f"cast(round(100.0 * (count(*) - count({name})) / nullif(count(*), 0), 2) "
            "as double) as null_pct",
            f"count(distinct {name}) as distinct_count",
        ]
        if not quick:
            number, exact = kind in NUMERIC, kind in ("int", "bigint")
            none = "cast(null as double)"
            text = f"cast({name} as varchar)"
            fields += [
                f"{f'cast(min({name}) as double)' if number else none} as min_val",
                f"{f'cast(max({name}) as double)' if number else none} as max_val",
                f"{f'cast(min({name}) as varchar)' if exact else _literal(None)} as min_text",
                f"{f'cast(max({name}) as varchar)' if exact else _literal(None)} as max_text",
                f"{f'round(avg({name}), 4)' if number else none} as mean_val",
                f"{f'round(median(cast({name} as double)), 4)' if number else none} "
                "as median_val",
                f"{f'round(stddev({name}), 4)' if number else none} as stddev_val",
                f"{'cast(null as bigint)' if number else f'min(length({text}))'} "
                "as min_length",
                f"{'cast(null as bigint)' if number else f'max(length({text}))'} "
                "as max_length",
            ]
        parts.append(f"select {', '.join(fields)} from {source}")
    return "\nunion all\n".join(parts)


def quality_sql(source: str, columns: dict[str, str],
                allowed: dict[str, list[str]] | None = None) -> str:
    parts = []
    for name, kind in columns.items():
        number, text = kind in NUMERIC, kind != "double"
        values = (allowed or {}).get(name)
        listed = ", ".join(f"'{v}'" for v in values or [])
        invalid = (f"count(*) filter (where {name} is not null and {name} not in ({listed}))"
                   if values else "cast(null as bigint)")
        edge = {
            f"{f}_{s}": (f"cast({f}({name}) as {t})" if ok else f"cast(null as {t})")
            for s, t, ok in (("val", "double", number), ("text", "varchar", text))
            for f in ("min", "max")
        }
        parts.append(
            f"select '{name}' as column_name, '{kind}' as column_type, "
            f"count(*) as row_count, count(*) - count({name}) as null_count, "
            f"count(distinct {name}) as distinct_count, "
            + ", ".join(f"{e} as {a}" for a, e in edge.items())
            + f", {invalid} as invalid_count, {len(values or [])} as allowed_count "
            f"from {source}")
    stats = "\nunion all\n".join(parts)
    return f"""
with stats as ({stats}),
rated as (select *,
  cast(printf('%.2f', cast(100.0 * null_count / row_count as double)) as double) as null_pct,
  cast(printf('%.2f', cast(100.0 * distinct_count / row_count as double)) as double)
    as uniqueness_pct,
  cast(100.0 * distinct_count / row_count as double) as u from stats)
select column_name, column_type, row_count, null_count, null_pct, distinct_count,
  uniqueness_pct, min_val, max_val, min_text, max_text,
  case when invalid_count > 0 then 'fail' else 'ok' end as status,
  concat_ws('; ',
    case when null_pct > 20 then cast(null_pct as varchar) || '% null' end,
    case when distinct_count = 0 then '0 distinct values (all null)' end,
    case when distinct_count > 0 and u < 1 then printf('%.1f', u) || '% unique' end
  ) as signals,
  case when invalid_count > 0 then cast(invalid_count as varchar)
    || ' value(s) not in valid_values (' || allowed_count || ' allowed)' else '' end
    as issues,
  invalid_count
from rated"""
