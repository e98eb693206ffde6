"""Queries on column categories, derived facts, context and documentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knowledge as k
from ..operators.columns import column_categories, columns_by_category
from ..operators.counts import text_counts
from ..operators.profile import approx_top_values, profile
from ..operators.values import top_values
from ..sources.tables import catalog, enrich_catalog
from ..store import written
from .base import TABLES, profile_sql, quality_sql, query, read, read_all
from .scans import LABELLED_COLUMNS, LABELLED_SQL, _catalog_sql, _near, labelled

# --- categories -------------------------------------------------------------------

# The rule for roles and categories; names are lower case in the test tables.
_ROLE_SQL = """case
  when column_type like '%date%' or column_type like '%time%' or column_name like '%date%'
    or column_name like '%time%' then 'time_dimension'
  when column_type in ('int', 'bigint', 'double') and not contains(column_name, '_id')
    then 'measure'
  else 'dimension' end"""


def _categories_sql(source: str, columns: dict[str, str]) -> str:
    return f"""
with p as ({profile_sql(source, columns, quick=True)}),
r as (select *, {_ROLE_SQL} as role from p)
select column_name, column_type, distinct_count, null_pct, role,
  case when distinct_count = 1 then 'constant' when null_pct > 90 then 'sparse'
    when distinct_count / total_rows > 0.95 then 'high_cardinality'
    when role = 'time_dimension' then 'time' when role = 'measure' then 'measure'
    when distinct_count < 50 then 'low_cardinality' else 'other' end as category
from r"""


_CATEGORY = ("column_name", "column_type", "distinct_count", "null_pct", "role", "category")

for _table in ("lineitem", "orders", "events", "part"):
    @query(f"column_categories_{_table}", "K1 K2 K13",
           _categories_sql(_table, TABLES[_table]))
    def _(spark, sf, _t=_table):
        return column_categories(profile(read(spark, sf, _t), quick=True, exact=True)
                                 ).select(*_CATEGORY)


for _table in ("lineitem", "orders", "customer"):
    @query(f"column_categories_default_{_table}", "K1 K2", f"""
select column_name, column_type, role, category
from ({_categories_sql(_table, TABLES[_table])})""")
    def _(spark, sf, _t=_table):
        return column_categories(profile(read(spark, sf, _t), quick=True)).select(
            "column_name", "column_type", "role", "category")


@query("column_categories_labelled", "K1 K2",
       _categories_sql(LABELLED_SQL, LABELLED_COLUMNS))
def _(spark, sf):
    return column_categories(profile(labelled(spark, sf), quick=True, exact=True)
                             ).select(*_CATEGORY)


@query("columns_by_category_lineitem", "K2 K13", f"""
select category, string_agg(column_name, ',' order by pos) as columns,
  count(*) as column_count
from ({_categories_sql('lineitem', TABLES['lineitem'])})
join (values {', '.join(f"('{c}', {i})" for i, c in enumerate(TABLES['lineitem']))})
  o(column_name, pos) using (column_name)
group by category""")
def _(spark, sf):
    stats = profile(read(spark, sf, "lineitem"), quick=True, exact=True)
    return columns_by_category(column_categories(stats)).withColumn(
        "columns", F.concat_ws(",", "columns"))


# --- derived facts ----------------------------------------------------------------

# events with a column that is almost always null and a time that says so by name
_EVENTS_SQL = """(select event_id, user_id, event_type, props, ts as occurred_at,
  case when props = '{"k": 0}' then value end as rare_value from events)"""


def _events(spark, sf):
    return read(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "props", F.col("ts").alias("occurred_at"),
        F.when(F.col("props") == '{"k": 0}', F.col("value")).alias("rare_value"))


def _flat(facts):
    return facts.withColumn("values", F.when(
        F.col("values").isNotNull(), F.concat_ws(";", "values")))


def _valid_values_sql(source: str, column: str, table: str, by: str = "values",
                      least: int = 1) -> str:
    return f"""
select '{table}' as table_name, '{column}' as column_name, 'valid_values' as field,
  cast(null as varchar) as value, string_agg(v, ';' order by v) as "values",
  cast(0.8 as double) as confidence, '{by}' as source
from (select distinct {column} as v from {source} where {column} is not null)
having count(*) between {least} and 19"""


def _sparse_sql(source: str, column: str, table: str, by: str = "quality") -> str:
    return f"""
select '{table}', '{column}', 'likely_sparse', 'true', null, cast(0.9 as double), '{by}'
from {source} having round(100.0 * (count(*) - count({column})) / count(*), 2) > 95"""


def _temporal_sql(column: str, table: str, by: str = "profile") -> str:
    return f"""
select '{table}', '{column}', 'temporal', 'true', null, cast(0.9 as double), '{by}'"""


_DERIVED_SQL = "\nunion all\n".join([
    _valid_values_sql(_EVENTS_SQL, "event_type", "events"),
    _valid_values_sql(_EVENTS_SQL, "props", "events"),
    _sparse_sql(_EVENTS_SQL, "rare_value", "events"),
    _temporal_sql("occurred_at", "events")])


@query("facts_derived_events", "K3 K4 K5", _DERIVED_SQL)
def _(spark, sf):
    return _flat(k.derived_facts(_events(spark, sf), "events"))


@query("facts_derived_orders", "K3 K4 K5", "\nunion all\n".join([
    _valid_values_sql("orders", "o_orderstatus", "orders"),
    _valid_values_sql("orders", "o_orderpriority", "orders")]))
def _(spark, sf):
    orders = read(spark, sf, "orders").withColumnRenamed("o_orderdate", "o_ordered")
    return _flat(k.derived_facts(orders, "orders"))


@query("small_value_sets_lineitem", "K5", """
select 'l_returnflag' as column_name, count(distinct l_returnflag) as distinct_count,
  string_agg(distinct l_returnflag, ';' order by l_returnflag) as "values" from lineitem
union all select 'l_linestatus', count(distinct l_linestatus),
  string_agg(distinct l_linestatus, ';' order by l_linestatus) from lineitem""")
def _(spark, sf):
    return _flat(k.small_value_sets(read(spark, sf, "lineitem")))


# Stored knowledge about orders: the allowed priorities are the ones below the greatest,
# so the greatest one violates them.
def stored_facts(spark, sf):
    orders = read(spark, sf, "orders")
    top = orders.agg(F.max("o_orderpriority")).scalar()
    none_s, none_a = F.lit(None).cast("string"), F.lit(None).cast("array<string>")

    def fact(column, field, value, source=None, confidence=None):
        return F.struct(
            F.lit("orders").alias("table_name"), F.lit(column).cast("string").alias(
                "column_name"),
            F.lit(field).alias("field"), F.lit(value).alias("value"),
            none_a.alias("values"), F.lit(source).cast("string").alias("source"),
            F.lit(confidence).cast("double").alias("confidence"))

    written = spark.range(1).select(F.inline(F.array(
        fact("o_orderpriority", "description", " How urgent the order is "),
        fact("o_orderstatus", "description", "<description>"),
        fact("o_custkey", "pii", "true"),
        fact("o_orderdate", "temporal", "true", "profile", 0.9),
        fact(None, "table_description", "One row per order"),
    )))
    listed = orders.where(F.col("o_orderpriority") < top).agg(
        F.array_sort(F.collect_set("o_orderpriority")).alias("v")).select(
        F.lit("orders").alias("table_name"), F.lit("o_orderpriority").alias("column_name"),
        F.lit("valid_values").alias("field"), none_s.alias("value"), F.col("v").alias(
            "values"), F.lit("values").alias("source"), F.lit(0.8).alias("confidence"))
    statuses = orders.agg(F.array_sort(F.collect_set("o_orderstatus")).alias("v")).select(
        F.lit("orders").alias("table_name"), F.lit("o_orderstatus").alias("column_name"),
        F.lit("valid_values").alias("field"), none_s.alias("value"), F.col("v").alias(
            "values"), F.lit("values").alias("source"), F.lit(0.8).alias("confidence"))
    return written.unionByName(listed).unionByName(statuses)


_ALLOWED_SQL = """(select string_agg(distinct o_orderpriority, ';' order by o_orderpriority)
  from orders where o_orderpriority < (select max(o_orderpriority) from orders))"""
_STATUSES_SQL = """(select string_agg(distinct o_orderstatus, ';' order by o_orderstatus)
  from orders)"""

STORED_SQL = f"""
select * from (values
  ('o_orderkey', null, null, null, null), ('o_totalprice', null, null, null, null),
  ('o_custkey', null, null, 'true', null),
  ('o_orderstatus', null, {_STATUSES_SQL}, null, null),
  ('o_orderdate', null, null, null, 'true'),
  ('o_orderpriority', 'How urgent the order is', {_ALLOWED_SQL}, null, null)
) v(column_name, description, valid_values, pii, temporal)"""


@query("suggestions_orders", "K7", "\nunion all\n".join([
    _valid_values_sql("orders", "o_orderpriority", "orders", least=2),
    _temporal_sql("order_date", "orders")]))
def _(spark, sf):
    # o_orderstatus is stored with the same list already, o_orderpriority with another.
    orders = read(spark, sf, "orders").withColumnRenamed("o_orderdate", "order_date")
    stored = stored_facts(spark, sf)
    known = stored.where("field = 'description'").limit(1).withColumns({
        "column_name": F.lit("Order_Date"), "value": F.lit("<description>")})
    return _flat(k.suggestions(orders, "orders", stored.unionByName(known)))


@query("catalog_enriched", "S9", f"""
with c as ({_catalog_sql()})
select c.table_name, c.column_name, c.row_count,
  case when c.table_name = 'orders' then 'One row per order' end as table_description,
  s.description, s.pii, s.valid_values
from c left join ({STORED_SQL}) s on c.table_name = 'orders' and s.column_name = c.column_name
""")
def _(spark, sf):
    rows = enrich_catalog(catalog(read_all(spark, sf)), stored_facts(spark, sf))
    return rows.select(
        "table_name", "column_name", "row_count", "table_description", "description", "pii",
        F.when(F.col("valid_values").isNotNull(), F.concat_ws(";", "valid_values")).alias(
            "valid_values"))


@query("profile_with_facts_orders", "K10 A1", f"""
with p as ({profile_sql('orders', TABLES['orders'], quick=True)})
select p.*, description, valid_values, pii, temporal, cast(null as varchar) as likely_sparse
from p join ({STORED_SQL}) using (column_name)""")
def _(spark, sf):
    stats = profile(read(spark, sf, "orders"), quick=True, exact=True).drop(
        "pos", "row_count", "sampled")
    rows = k.with_facts(stats, stored_facts(spark, sf), "orders")
    return rows.withColumn("valid_values", F.when(
        F.col("valid_values").isNotNull(), F.concat_ws(";", "valid_values")))


_CHECKED_SQL = f"""
with q as ({quality_sql('orders', TABLES['orders'])}),
bad as (select 'o_orderpriority' as column_name, count(*) filter (where o_orderpriority =
    (select max(o_orderpriority) from orders)) as invalid_count from orders
  union all select 'o_orderstatus', 0),
s as ({STORED_SQL})
select q.column_name, q.row_count, q.distinct_count, q.signals,
  case when bad.invalid_count > 0 then 'fail' else 'ok' end as status,
  case when bad.invalid_count > 0 then bad.invalid_count || ' value(s) not in valid_values ('
    || (select count(distinct o_orderpriority) - 1 from orders) || ' allowed)' else '' end
    as issues,
  bad.invalid_count, s.description, s.valid_values
from q left join bad using (column_name) left join s using (column_name)"""


@query("quality_with_facts_orders", "Q3 K10", _CHECKED_SQL)
def _(spark, sf):
    rows = k.quality_with_facts(read(spark, sf, "orders"), stored_facts(spark, sf),
                                "orders", exact=True)
    return rows.select(
        "column_name", "row_count", "distinct_count",
        F.concat_ws("; ", "signals").alias("signals"), "status",
        F.concat_ws("; ", "issues").alias("issues"), "invalid_count", "description",
        F.when(F.col("valid_values").isNotNull(), F.concat_ws(";", "valid_values")).alias(
            "valid_values"))


# --- context and documentation ----------------------------------------------------

def _frequent_sql(table: str, column: str, n: int) -> str:
    return f"""(select string_agg(v, ';' order by c desc, v) from (
  select cast({column} as varchar) as v, count(*) as c from {table}
  where {column} is not null group by 1 order by c desc, v limit {n}))"""


def context_sql(table: str, columns: dict[str, str], n: int = 5) -> str:
    listed = ", ".join(
        f"('{c}', " + (_frequent_sql(table, c, n) if t not in ("int", "bigint", "double")
                       else "null") + ")" for c, t in columns.items())
    return f"""
with p as ({profile_sql(table, columns)}),
s(column_name, sample_values) as (values {listed})
select p.*, true as nullable, s.sample_values from p join s using (column_name)"""


_CONTEXT = ("column_name", "column_type", "total_rows", "null_count", "null_pct",
            "distinct_count", "min_val", "max_val", "min_text", "max_text", "mean_val",
            "median_val", "stddev_val", "min_length", "max_length", "nullable",
            "sample_values")


def _flat_context(rows):
    return rows.withColumn("median_val", F.round("median_val", 4)).withColumn(
        "sample_values", F.when(F.col("sample_values").isNotNull(),
                                F.concat_ws(";", "sample_values")))


@query("context_events", "K9", context_sql("events", TABLES["events"]))
def _(spark, sf):
    return _flat_context(k.context(read(spark, sf, "events"), "events", exact=True)
                         ).select(*_CONTEXT)


@query("context_orders_with_facts", "K9 K10", f"""
select c.*, s.description, s.pii, s.temporal
from ({context_sql('orders', TABLES['orders'])}) c join ({STORED_SQL}) s using (column_name)
""")
def _(spark, sf):
    rows = k.context(read(spark, sf, "orders"), "orders", stored_facts(spark, sf), exact=True)
    return _flat_context(rows).select(*_CONTEXT, "description", "pii", "temporal")


@query("context_sketched_orders", "K9 A6 A9", f"""
select c.column_name, c.column_type, c.total_rows, c.null_count, s.description, s.pii,
  true as distinct_count_near, true as median_val_near
from ({context_sql('orders', TABLES['orders'])}) c join ({STORED_SQL}) s using (column_name)
""")
def _(spark, sf):
    orders = read(spark, sf, "orders")
    rows = k.context(orders, "orders", stored_facts(spark, sf))
    near = _near(rows, profile(orders, exact=True), ("distinct_count", "median_val"))
    return rows.select("column_name", "column_type", "total_rows", "null_count",
                       "description", "pii").join(near, "column_name")


@query("facts_from_context_events", "K6", "\nunion all\n".join([
    _valid_values_sql(_EVENTS_SQL, "event_type", "events", "context"),
    _sparse_sql(_EVENTS_SQL, "rare_value", "events", "context"),
    _temporal_sql("occurred_at", "events", "context")]))
def _(spark, sf):
    rows = k.context(_events(spark, sf), "events", sample_values=10)
    return _flat(k.facts_from_context(rows, "events"))


@query("documentation_orders", "K8", f"""
with p as ({profile_sql('orders', TABLES['orders'])}),
f as (select * from orders order by o_orderkey limit 3),
s(column_name, sample_values) as (values {', '.join(
    f"('{c}', (select string_agg(cast({c} as varchar), ', ' order by o_orderkey) from f))"
    for c in TABLES['orders'])})
select 'orders' as table_name, column_name, column_type, total_rows as row_count,
  distinct_count, null_count, null_pct, min_val, max_val, min_length, max_length,
  sample_values
from p join s using (column_name)""")
def _(spark, sf):
    return k.documentation(read(spark, sf, "orders"), "orders", order_by=["o_orderkey"],
                           exact=True).drop("ordinal", "nullable", "comment")


_PLACES_SQL = """select cast(null as varchar) as column_name, field, value from (values
  ('table_comment', ''), ('table_description', '<description>'), ('notes', ''),
  ('data_owner', '<data_owner>'), ('update_frequency', '<update_frequency>')) v(field, value)"""


@query("machine_facts_orders", "K8 F3", f"""
with p as ({profile_sql('orders', TABLES['orders'])}),
f as (select * from orders order by o_orderkey limit 3),
s(column_name, sample_values) as (values {', '.join(
    f"('{c}', (select string_agg(cast({c} as varchar), ', ' order by o_orderkey) from f))"
    for c in TABLES['orders'])}),
all_facts as (
select column_name, 'distinct_count' as field, cast(distinct_count as varchar) as value
  from p
union all select column_name, 'null_count', cast(null_count as varchar) from p
union all select column_name, 'null_pct', cast(null_pct as varchar) from p
union all select column_name, 'type', column_type from p
union all select column_name, 'nullable', 'true' from p
union all select column_name, 'primary_key',
  cast(column_name = 'o_orderkey' as varchar) from p
union all select column_name, 'description', '<description>' from p
union all select column_name, 'max_length', cast(max_length as varchar) from p
union all select column_name, 'min_length', cast(min_length as varchar) from p
union all select column_name, 'sample_values', sample_values from s
union all select null, 'row_count', cast(count(*) as varchar) from orders
union all {_PLACES_SQL})
select column_name, field, value, cast(null as double) as number from all_facts
union all select column_name, 'min_val', null, min_val from p
union all select column_name, 'max_val', null, max_val from p""")
def _(spark, sf):
    rows = k.documentation(read(spark, sf, "orders"), "orders", order_by=["o_orderkey"],
                           exact=True)
    number = F.col("field").isin("min_val", "max_val")
    return k.machine_facts(rows, primary_key=["O_OrderKey"]).select(
        "column_name", "field", F.when(~number, F.col("value")).alias("value"),
        F.when(number, F.col("value").cast("double")).alias("number"))


@query("machine_facts_refreshed", "F3 K8", f"""
select field, value from ({_PLACES_SQL}) where field <> 'table_description'
union all select 'row_count', cast(count(*) as varchar) from orders
union all select 'table_description', 'One row per order'""")
def _(spark, sf):
    from ..operators import facts as f

    orders = read(spark, sf, "orders").select("o_orderkey")
    stored = stored_facts(spark, sf)
    fresh = k.machine_facts(k.documentation(orders, "orders", exact=True))
    return f.refresh(stored, fresh).where(F.col("column_name").isNull()).select(
        "field", "value")


@query("values_with_facts_orders", "A10 K10", f"""
select o_orderpriority as value, count(*) as count, 'How urgent the order is' as description,
  {_ALLOWED_SQL} as valid_values, cast(null as varchar) as pii,
  (select count(*) from orders) as total_rows
from orders group by o_orderpriority""")
def _(spark, sf):
    rows = k.values_with_facts(read(spark, sf, "orders"), "O_OrderPriority",
                               stored_facts(spark, sf), "Orders")
    return rows.select("value", "count", "description",
                       F.concat_ws(";", "valid_values").alias("valid_values"), "pii",
                       "total_rows")


@query("quality_typed_facts_orders", "K10 Q3", """
with m as (select min(o_totalprice) as lo from orders)
select 'o_custkey' as column_name, count(*) filter (where o_custkey not in (1, 2, 3)) as invalid_count,
  case when count(*) filter (where o_custkey not in (1, 2, 3)) > 0 then 'fail' else 'ok' end as status
from orders
union all select 'o_orderdate', count(*) filter (where o_orderdate <>
    (select min(o_orderdate) from orders)), 'fail' from orders
union all select 'o_totalprice', count(*) filter (where o_totalprice <> lo),
  case when count(*) filter (where o_totalprice <> lo) > 0 then 'fail' else 'ok' end
from orders, m""")
def _(spark, sf):
    orders = read(spark, sf, "orders")
    # Lists as a person writes them: other spelling of names and of numbers.
    lists = orders.agg(
        F.array(F.lit("1.0"), F.lit("2"), F.lit("03")).alias("O_CUSTKEY"),
        F.array(F.min("o_totalprice").cast("decimal(20,6)").cast("string")).alias("o_TotalPrice"),
        F.array(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd HH:mm:ss")).alias("o_orderdate"))
    stored = lists.select(F.inline(F.array(*[
        F.struct(F.lit("ORDERS").alias("table_name"), F.lit(c).alias("column_name"),
                 F.lit("valid_values").alias("field"), F.lit(None).cast("string").alias("value"),
                 F.col(c).alias("values"), F.lit(None).cast("string").alias("source"),
                 F.lit(None).cast("double").alias("confidence"))
        for c in lists.columns])))
    return k.quality_with_facts(orders, stored, "orders", exact=True).where(
        F.col("column_name").isin("o_custkey", "o_totalprice", "o_orderdate")).select(
        "column_name", "invalid_count", "status")


def _one_more_sql(n: int) -> str:
    """A column with ``n`` values: listed up to the sample of ten, left out beyond."""
    return f"""select 'n{n}' as column_name,
  string_agg(distinct 'v' || lpad(cast(l_orderkey % {n} as varchar), 2, '0'), ';'
    order by 'v' || lpad(cast(l_orderkey % {n} as varchar), 2, '0')) as valid_values
from lineitem having {n} <= 10"""


@query("facts_from_context_complete_sets", "K6", "\nunion all\n".join(
    _one_more_sql(n) for n in range(8, 13)))
def _(spark, sf):
    lineitem = read(spark, sf, "lineitem").select(*[
        F.concat(F.lit("v"), F.lpad((F.col("l_orderkey") % n).cast("string"), 2, "0")).alias(
            f"n{n}") for n in range(8, 13)])
    rows = k.facts_from_context(k.context(lineitem, "t", sample_values=10), "t")
    return rows.where("field = 'valid_values'").select(
        "column_name", F.concat_ws(";", "values").alias("valid_values"))


# Neighbouring words have a long tail, places in the text are a key.
_TAILS_SQL = """
tails as (select w[i] || ' ' || w[i + 1] as pair, doc_id || ':' || i as place,
    lang, cast(doc_id % 3 as varchar) as third
  from (select doc_id, lang, w, unnest(range(1, len(w))) as i
    from (select *, string_split(text, ' ') as w from documents)))"""


def _tails(spark, sf):
    words = F.split("text", " ")
    # Unfolded as pairs: every row of an unfolded index would carry the whole text.
    pairs = F.zip_with(words, F.slice(words, 2, 1_000_000_000), lambda a, b: F.concat_ws(
        " ", a, F.when(b.isNotNull(), b)))
    return read(spark, sf, "documents").select(
        "doc_id", "lang", F.posexplode(F.slice(pairs, F.lit(1), F.size(words) - 1)).alias(
            "at", "pair")).select(
        "pair", F.concat_ws(":", F.col("doc_id"), F.col("at") + 1).alias("place"), "lang",
        (F.col("doc_id") % 3).cast("string").alias("third"))


@query("context_long_tails", "K9 K6", f"""
with {_TAILS_SQL}
{" union all ".join(f"""
select '{c}' as column_name, count(distinct {c}) <= 5 as all_values,
  least(count(distinct {c}), 5) as shown,
  case when count(distinct {c}) <= 5 then string_agg(distinct {c}, ';' order by {c}) end
    as valid_values
from tails""" for c in ("pair", "place", "lang", "third"))}""")
def _(spark, sf):
    rows = k.context(_tails(spark, sf), "t")
    stored = k.facts_from_context(rows, "t").where("field = 'valid_values'").select(
        "column_name", F.concat_ws(";", "values").alias("valid_values"))
    return rows.select("column_name", "all_values", F.size("sample_values").cast(
        "bigint").alias("shown")).join(stored, "column_name", "left")


# Words: a few are frequent and settle the column; pairs of words need grouping.
@query("top_values_long_tails", "A8 W1", f"""
with {_TAILS_SQL},
words as (select pair, split_part(pair, ' ', 1) as word, lang from tails)
{" union all ".join(f"""
select * from (select '{c}' as column_name, {c} as value, count(*) as count,
  cast(row_number() over (order by count(*) desc, {c}) as integer) as rank
  from words where {c} is not null group by {c}) where rank <= 10"""
                    for c in ("pair", "word", "lang"))}""")
def _(spark, sf):
    words = _tails(spark, sf).select(
        "pair", F.split_part("pair", F.lit(" "), F.lit(1)).alias("word"), "lang")
    return top_values(words, top=10).select("column_name", "value", "count", "rank")


@query("approx_top_long_tails", "A9", f"""
with {_TAILS_SQL}
{" union all ".join(f"""
select '{c}' as column_name, (select count(*) from tails) as total_rows,
  least(count(*), 5) as shown, true as within_error, count(*) <= 5 as all_values
from (select {c}, count(*) as n from tails where {c} is not null group by {c})"""
                    for c in ("pair", "place", "lang", "third"))}""")
def _(spark, sf):
    tails = _tails(spark, sf)
    found = written(approx_top_values(tails, top=5), "found")  # at most five rows a column
    exact = text_counts(tails, tails.columns, only=found).select(
        "column_name", "value", F.col("n"))
    return found.join(exact, ["column_name", "value"]).groupBy(
        "column_name", "total_rows").agg(
        F.count(F.lit(1)).alias("shown"),
        # A filled-up value is only known to occur; the sketch's counts are near.
        F.min((F.abs(F.col("count") - F.col("n")) <= F.col("max_error"))
              | ((F.col("count") == 1) & (F.col("n") >= 1))).alias("within_error"),
        F.min("all_values").alias("all_values"))
