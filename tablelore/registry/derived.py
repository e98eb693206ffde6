"""Fact logs, catalogs and snapshots that grow with the test tables.

``events`` is read as a log of written facts: every user is a table, every event one
write.  ``documents`` is read as a data dictionary: every source is a table, every
document a described column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .base import read

MIDDLE = "2024-01-16 00:00:00"
AS_OF = "2024-02-15 00:00:00"

# --- events as a log of facts -------------------------------------------------------

LOG_SQL = """
select 'user_' || user_id as table_name,
  case when event_type = 'signup' then null else event_type end as column_name,
  case when event_type = 'signup'
    then ['table_description', 'data_owner', 'notes', 'row_count'][k % 4 + 1]
    else ['description', 'pii', 'valid_values', 'sample_values'][k % 4 + 1] end as field,
  case when event_type <> 'signup' and k % 4 = 1
    then case when value > 20 then 'true' else 'false' end
    when event_type <> 'signup' and k % 4 = 2 then null
    when value < 2 then '<todo>' else props end as value,
  case when event_type <> 'signup' and k % 4 = 2 then [event_type, props] end as "values",
  case when k % 5 = 0 then null else 'scan' end as source,
  case when k % 5 = 0 then null else least(value / 50, 1.0) end as confidence,
  ts as written_at, 'user ' || user_id as author, cast(null as varchar) as session,
  event_id as write_id
from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as integer) as k from events)
"""


def fact_log(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events").withColumn(
        "k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    of_table = F.col("event_type") == "signup"
    kind = F.col("k") % 4

    def pick(*names: str):
        return F.element_at(F.array(*[F.lit(n) for n in names]), kind + 1)

    by_hand = F.col("k") % 5 == 0
    return events.select(
        F.concat(F.lit("user_"), "user_id").alias("table_name"),
        F.when(~of_table, F.col("event_type")).alias("column_name"),
        F.when(of_table, pick("table_description", "data_owner", "notes", "row_count"))
        .otherwise(pick("description", "pii", "valid_values", "sample_values")).alias("field"),
        F.when(~of_table & (kind == 1), (F.col("value") > 20).cast("string"))
        .when(~of_table & (kind == 2), F.lit(None))
        .when(F.col("value") < 2, "<todo>").otherwise(F.col("props")).alias("value"),
        F.when(~of_table & (kind == 2), F.array("event_type", "props")).alias("values"),
        F.when(~by_hand, "scan").alias("source"),
        F.when(~by_hand, F.least(F.col("value") / 50, F.lit(1.0))).alias("confidence"),
        F.col("ts").alias("written_at"),
        F.concat(F.lit("user "), "user_id").alias("author"),
        F.lit(None).cast("string").alias("session"),
        F.col("event_id").alias("write_id"),
    )


def latest_sql(source: str) -> str:
    """The last fact per table, column and field of a log."""
    return f"""(select * exclude (rn) from (select *, row_number() over (
      partition by table_name, column_name, field order by write_id desc) as rn
      from ({source})) where rn = 1)"""


BEFORE_SQL = f"select * from ({LOG_SQL}) where written_at < timestamp '{MIDDLE}'"
AFTER_SQL = f"select * from ({LOG_SQL}) where written_at >= timestamp '{MIDDLE}'"


def middle():
    return F.lit(MIDDLE).cast("timestamp_ntz")


# A fact's state in SQL.  Three operators read it, so it is written once.
FILLED_SQL = """(coalesce(len({p}"values") > 0, false)
  or coalesce(trim({p}value) <> '' and trim({p}value) not like '<%', false))"""


def confidence_sql(prefix: str = "") -> str:
    filled = FILLED_SQL.format(p=prefix)
    return (f"(case when {prefix}source is not null and {prefix}confidence is not null "
            f"then {prefix}confidence when {filled} then 1.0 else 0.0 end)")


# --- events as observed schemas -----------------------------------------------------

_TYPE_SQL = """case when max(value) < 10 then 'float' when max(value) < 40
  then 'decimal(4,2)' else 'double' end"""


def observed_sql(where: str = "true") -> str:
    """Columns seen per user: the narrowest type that fits, nullable when a payload
    was empty."""
    return f"""
select 'user_' || user_id as table_name, event_type as column_name,
  {_TYPE_SQL} as data_type, bool_or(props = '{{"k": 0}}') as nullable
from events where {where} group by user_id, event_type"""


def _observed(events: DataFrame, *more) -> DataFrame:
    top = F.max("value")
    return events.groupBy("user_id", "event_type", *more).agg(
        F.when(top < 10, "float").when(top < 40, "decimal(4,2)").otherwise("double").alias(
            "data_type"),
        F.bool_or(F.col("props") == '{"k": 0}').alias("nullable"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("table_name", F.concat(F.lit("user_"), "user_id")).withColumnRenamed(
        "event_type", "column_name")


def observed_catalog(spark: SparkSession, sf: str, where=None) -> DataFrame:
    events = read(spark, sf, "events")
    if where is not None:
        events = events.where(where)
    return _observed(events).select("table_name", "column_name", "data_type", "nullable")


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """One snapshot per user and day; row_count is the day's events of the user."""
    from pyspark.sql import Window

    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("taken_at")
    per_day = Window.partitionBy("table_name", "taken_at")
    return _observed(read(spark, sf, "events"), day).withColumn(
        "row_count", F.sum("n").over(per_day)
    ).select("taken_at", "table_name", "row_count", "column_name", "data_type", "nullable")


SNAPSHOTS_SQL = f"""
select date_trunc('day', ts) as taken_at, 'user_' || user_id as table_name,
  cast(sum(count(*)) over (partition by user_id, date_trunc('day', ts)) as bigint)
    as row_count,
  event_type as column_name, {_TYPE_SQL} as data_type,
  bool_or(props = '{{"k": 0}}') as nullable
from events group by user_id, event_type, date_trunc('day', ts)"""


# --- documents as a data dictionary -------------------------------------------------

_WRITTEN_SQL = "timestamp '2023-11-01 00:00:00' + to_days(cast(doc_id % 100 as integer))"

DICTIONARY_SQL = f"""
with d as (select d.*, l.quality, l.toxic from documents d left join labels l
  on d.doc_id = l.doc_id),
f as (
  select source as table_name, 'doc_' || doc_id as column_name, 'description' as field,
    case when quality is null then '<description>' else text end as value,
    cast(null as varchar[]) as "values", doc_id, quality from d
  union all select source, 'doc_' || doc_id, 'type', 'string', null, doc_id, quality from d
  union all select source, 'doc_' || doc_id, 'distinct_count',
    cast(length(lang) * (1 + doc_id % 15) as varchar), null, doc_id, quality from d
  union all select source, 'doc_' || doc_id, 'pii',
    case when toxic = 1 then 'true' else 'false' end, null, doc_id, quality from d
  union all select source, 'doc_' || doc_id, 'valid_values', null,
    case when lang = 'en' then [lang, source] else [] end, doc_id, quality from d
  union all select source, 'doc_' || doc_id, 'sample_values', lang, null, doc_id, quality
    from d)
select table_name, column_name, field, value, "values",
  case when quality = 0 then 'scan' end as source,
  case when quality = 0 then 0.8 end as confidence,
  {_WRITTEN_SQL} as written_at from f"""


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Six facts per document; descriptions are missing where no label exists."""
    docs = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")

    def fact(field: str, value=None, values=None):
        return F.struct(
            F.lit(field).alias("field"),
            (F.lit(None) if value is None else value).cast("string").alias("value"),
            (F.lit(None).cast("array<string>") if values is None else values).alias("values"))

    facts = F.array(
        fact("description", F.when(F.col("quality").isNull(), "<description>")
             .otherwise(F.col("text"))),
        fact("type", F.lit("string")),
        fact("distinct_count", F.length("lang") * (1 + F.col("doc_id") % 15)),
        fact("pii", F.when(F.col("toxic") == 1, "true").otherwise("false")),
        fact("valid_values", values=F.when(F.col("lang") == "en", F.array("lang", "source"))
             .otherwise(F.array().cast("array<string>"))),
        fact("sample_values", F.col("lang")),
    )
    written = (F.lit("2023-11-01").cast("timestamp_ntz")
               + F.make_dt_interval(days=(F.col("doc_id") % 100).cast("int")))
    by_scan = F.col("quality") == 0
    return docs.select(
        F.col("source").alias("table_name"),
        F.concat(F.lit("doc_"), "doc_id").alias("column_name"),
        F.when(by_scan, "scan").alias("fact_source"),
        F.when(by_scan, F.lit(0.8)).alias("confidence"),
        written.alias("written_at"), F.inline(facts),
    ).withColumnRenamed("fact_source", "source").select(
        "table_name", "column_name", "field", "value", "values", "source", "confidence",
        "written_at")
