"""Queries on quality, freshness, assertions, joins and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import singular_stems
from ..operators.assertions import assert_sql, assertion_suite
from ..operators.columns import column_roles
from ..operators.diff import (
    bundle_diff, count_drift, diff_counts, diff_since, fingerprint_status, fingerprints,
    latest_snapshot, null_regression, schema_diff,
)
from ..operators.freshness import freshness, freshness_candidates
from ..operators.join_catalog import catalog_evidence, key_pairs, key_sketches
from ..operators.joins import join_candidates, key_evidence
from ..operators.quality import invalid_values, quality
from ..sources.tables import catalog, open_tables
from . import derived as d
from .base import TABLES, quality_sql, query, read, read_all
from .scans import LABELLED_COLUMNS, LABELLED_SQL, _catalog_sql, _near, labelled

# --- quality ----------------------------------------------------------------------



def _flat(rows):
    return rows.select(
        "column_name", "column_type", "row_count", "null_count", "null_pct",
        "distinct_count", "uniqueness_pct", "min_val", "max_val", "min_text", "max_text",
        "status", F.concat_ws("; ", "signals").alias("signals"),
        F.concat_ws("; ", "issues").alias("issues"), "invalid_count")


@query("quality_lineitem", "Q1 Q2", quality_sql("lineitem", TABLES["lineitem"]))
def _(spark, sf):
    return _flat(quality(read(spark, sf, "lineitem"), exact=True))


@query("quality_nulls", "Q1 Q2", quality_sql(LABELLED_SQL, LABELLED_COLUMNS))
def _(spark, sf):
    return _flat(quality(labelled(spark, sf), exact=True))


_PRIORITIES = {"o_orderpriority": ["1-URGENT", "2-HIGH", "5-LOW"],
               "o_orderstatus": ["O", "F", "P"]}


@query("quality_allowed_orders", "Q3 P4",
       quality_sql("orders", TABLES["orders"], _PRIORITIES))
def _(spark, sf):
    return _flat(quality(read(spark, sf, "orders"), exact=True, allowed=_PRIORITIES))


@query("quality_approx_lineitem", "Q1 A4", f"""
select column_name, row_count, null_count, status, true as distinct_count_near
from ({quality_sql("lineitem", TABLES["lineitem"])})""")
def _(spark, sf):
    lineitem = read(spark, sf, "lineitem")
    rows = quality(lineitem)
    near = _near(rows, quality(lineitem, exact=True), ("distinct_count",))
    return rows.select("column_name", "row_count", "null_count", "status").join(
        near, "column_name")


# More allowed values than a scan carries as literals, two thirds of all keys.
_MANY_KEYS = [n for n in range(6000) if n % 3]


@query("quality_many_allowed_orders", "Q3", """
select 'o_custkey' as column_name, count(*) as row_count,
  count(*) filter (where o_custkey % 3 = 0 or o_custkey >= 6000) as invalid_count,
  case when count(*) filter (where o_custkey % 3 = 0 or o_custkey >= 6000) > 0
    then 'fail' else 'ok' end as status
from orders""")
def _(spark, sf):
    rows = quality(read(spark, sf, "orders"), "o_custkey", exact=True,
                   allowed={"O_CustKey": _MANY_KEYS})
    return rows.select("column_name", "row_count", "invalid_count", "status")


_ALLOWED_SQL = """
with toxic as (select d.* from documents d join labels l on d.doc_id = l.doc_id
  where l.toxic = 1),
allowed as (select distinct 'lang' as column_name, lang as value from toxic
  union all select distinct 'source', source from toxic),
checked as (select 'lang' as column_name, lang as value from documents
  union all select 'source', source from documents)
select c.column_name, count(*) as row_count,
  count(*) filter (where c.value is not null and a.value is null) as invalid_count,
  (select count(*) from allowed x where x.column_name = c.column_name) as allowed_count,
  case when count(*) filter (where c.value is not null and a.value is null) > 0
    then 'fail' else 'ok' end as status
from checked c left join allowed a on a.column_name = c.column_name and a.value = c.value
group by c.column_name"""


@query("invalid_by_table", "Q3 P4", _ALLOWED_SQL)
def _(spark, sf):
    documents = read(spark, sf, "documents")
    toxic = documents.join(read(spark, sf, "labels").where("toxic = 1"), "doc_id",
                           "left_semi")
    allowed = toxic.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"))
        for c in ("lang", "source")])))
    return invalid_values(documents, allowed, ["lang", "source"]).select(
        "column_name", "row_count", "invalid_count", "allowed_count", "status")


# --- freshness --------------------------------------------------------------------

_CLOCK = "timestamp '2024-02-03 12:00:00'"


def _clock():
    return F.lit("2024-02-03 12:00:00").cast("timestamp")


def _span_sql(table: str, column: str, kind: str, score: int) -> str:
    return f"""
select '{column}' as column_name, '{kind}' as column_type, {score} as score,
  count(*) as row_count, count({column}) as non_null_count,
  count(*) - count({column}) as null_count,
  cast(round(100.0 * (count(*) - count({column})) / count(*), 2) as double) as null_pct,
  {'strftime(min(%s), %r)' % (column, '%Y-%m-%dT%H:%M:%S+00:00') if kind.startswith('time')
   else f'cast(min({column}) as varchar)'} as earliest_value,
  {'strftime(max(%s), %r)' % (column, '%Y-%m-%dT%H:%M:%S+00:00') if kind.startswith('time')
   else f'cast(max({column}) as varchar)'} as latest_value,
  {f"round(date_diff('microsecond', max({column}), {_CLOCK}) / 86400000000.0, 2)"
   if kind.startswith('time') else 'cast(null as double)'} as latest_age_days
from {table}"""


@query("freshness_candidates_events", "Q5", "\nunion all\n".join([
    _span_sql("events", "ts", "timestamp_ntz", 4),
    _span_sql("events", "event_id", "bigint", 2),
    _span_sql("events", "event_type", "string", 2)]))
def _(spark, sf):
    return freshness_candidates(read(spark, sf, "events"), as_of=_clock()).drop("reasons")


@query("freshness_events", "Q5", f"""
select count(*) as row_count, cast(7 as double) as stale_after_days,
  case when round(date_diff('microsecond', max(ts), {_CLOCK}) / 86400000000.0, 2) <= 7
    then 'fresh' else 'stale' end as status,
  'ts' as selected_column, 3 as candidate_count,
  strftime(min(ts), '%Y-%m-%dT%H:%M:%S+00:00') as earliest_value,
  strftime(max(ts), '%Y-%m-%dT%H:%M:%S+00:00') as latest_value,
  round(date_diff('microsecond', max(ts), {_CLOCK}) / 86400000000.0, 2) as latest_age_days
from events""")
def _(spark, sf):
    return freshness(read(spark, sf, "events"), as_of=_clock()).drop("reason").withColumn(
        "candidate_count", F.col("candidate_count").cast("int"))


@query("freshness_orders_text", "Q5", f"""
select count(*) as row_count, 'stale' as status, 'order_date' as selected_column,
  strftime(min(o_orderdate), '%Y-%m-%d') as earliest_value,
  strftime(max(o_orderdate), '%Y-%m-%d') as latest_value,
  round(date_diff('microsecond', max(o_orderdate), {_CLOCK}) / 86400000000.0, 2)
    as latest_age_days
from orders""")
def _(spark, sf):
    texts = read(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"))
    return freshness(texts, as_of=_clock()).select(
        "row_count", "status", "selected_column", "earliest_value", "latest_value",
        "latest_age_days")


@query("freshness_customer_unknown", "Q5", """
select count(*) as row_count, 'unknown' as status,
  'No temporal columns were detected from schema names or types.' as reason from customer""")
def _(spark, sf):
    return freshness(read(spark, sf, "customer"), as_of=_clock()).select(
        "row_count", "status", "reason")


# --- assertions -------------------------------------------------------------------

_ASSERTIONS = [
    ("orders exist", "select count(*) from orders", "gt", 0),
    ("no orphan lines", "select count(*) from lineitem l left join orders o "
     "on l.l_orderkey = o.o_orderkey where o.o_orderkey is null", "eq", 0),
    ("discount at most 10 %", "select max(l_discount) from lineitem", "lte", 0.1),
    ("mean value", "select round(avg(value), 4) from events", "lt", 5),
    ("labels complete", "select count(*) * 100.0 / (select count(*) from documents) "
     "from labels", "gte", 95),
    ("nothing to compare", "select max(toxic) from labels where toxic > 1", "eq", 0),
]
_SIGNS = {"eq": "=", "gt": ">", "lt": "<", "gte": ">=", "lte": "<="}


def _assert_sql(name: str, sql: str, op: str, expected: float) -> str:
    return f"""
select '{name}' as name, a as actual, '{op}' as operator,
  cast({expected} as double) as expected,
  coalesce(a {_SIGNS[op]} {expected}, false) as passed
from (select cast(({sql}) as double) as a)"""


@query("assertion_orders", "Q6", _assert_sql(*_ASSERTIONS[0]))
def _(spark, sf):
    open_tables(spark, {"orders": f"{sf}/orders.parquet"})
    name, sql, op, expected = _ASSERTIONS[0]
    return assert_sql(spark, sql, op, expected, name)


@query("assertion_suite", "Q7", "\nunion all\n".join(_assert_sql(*a) for a in _ASSERTIONS))
def _(spark, sf):
    open_tables(spark, {t: f"{sf}/{t}.parquet" for t in TABLES})
    return assertion_suite(spark, [
        {"name": n, "sql": s, "operator": o, "expected": e} for n, s, o, e in _ASSERTIONS])


# --- joins ------------------------------------------------------------------------

_OBSERVED_SQL = d.observed_sql()


@query("join_candidates_observed", "J1", f"""
with c as ({_OBSERVED_SQL}),
typed as (select *, case when split_part(data_type, '(', 1) in ('float', 'double', 'decimal')
  then 'numeric' else data_type end as family from c),
best as (select s.table_name as source_table, t.table_name as target_table,
  s.column_name as source_col, t.column_name as target_col, 'exact_name' as match_type,
  cast(case when s.family = t.family then 0.9 else 0.5 end as double) as confidence
  from typed s join typed t on s.column_name = t.column_name
  where s.table_name = 'user_1' and t.table_name <> 'user_1')
select *, max(confidence) over (partition by target_table) as table_confidence from best""")
def _(spark, sf):
    return join_candidates(d.observed_catalog(spark, sf), "USER_1")


def _shop(spark, sf):
    """Three tables under names that follow the id convention."""
    customers = read(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    orders = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"))
    lines = read(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("id"), F.col("l_orderkey").cast("string").alias(
            "order_id"))
    return {"customers": customers, "orders": orders, "order_lines": lines}


@query("join_candidates_shop", "J1 J2 S7", """
with sizes as (select 'customers' as target_table, count(*) as target_rows from customer
  union all select 'order_lines', count(*) from lineitem)
select source_table, target_table, source_col, target_col, match_type,
  cast(confidence as double) as confidence,
  cast(table_confidence as double) as table_confidence, target_rows from (values
  ('orders', 'customers', 'customer_id', 'id', 'convention', 0.8, 0.9),
  ('orders', 'customers', 'id', 'id', 'exact_name', 0.9, 0.9),
  ('orders', 'order_lines', 'id', 'id', 'exact_name', 0.9, 0.9),
  ('orders', 'order_lines', 'id', 'order_id', 'convention', 0.4, 0.9)
) v(source_table, target_table, source_col, target_col, match_type, confidence,
    table_confidence) join sizes using (target_table)""")
def _(spark, sf):
    tables = _shop(spark, sf)
    counted = catalog(tables)
    sizes = counted.groupBy(F.col("table_name").alias("target_table")).agg(
        F.max("row_count").alias("target_rows"))
    return join_candidates(counted, "orders").join(sizes, "target_table")


@query("singular_stems_words", "J2", """
with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as t
  from documents)
select t, t as stem from w
union select t, left(t, length(t) - 3) || 'y' from w where t like '%ies'
union select t, left(t, length(t) - 1) from w where t like '%s' and t not like '%ss'""")
def _(spark, sf):
    words = read(spark, sf, "documents").select(F.explode(F.regexp_extract_all(
        F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("t")).distinct()
    return words.select("t", F.explode(singular_stems(F.col("t"))).alias("stem"))


def _evidence_sql(source: str, source_col: str, target: str, target_col: str) -> str:
    return f"""
with s as (select {source_col} as k, count(*) as n from {source} group by 1),
t as (select {target_col} as k, count(*) as n from {target}
  where {target_col} is not null group by 1),
b as (select s.k, s.n, t.n as tn from s left join t on s.k = t.k)
select '{source_col}' as source_col, '{target_col}' as target_col,
  cast(sum(n) as bigint) as source_rows,
  cast(coalesce(sum(n) filter (where k is null), 0) as bigint) as source_nulls,
  count(k) as source_distinct, count(tn) as matched_distinct,
  round(count(tn) / count(k), 4) as containment,
  cast(coalesce(sum(n) filter (where k is not null and tn is null), 0) as bigint)
    as orphan_rows,
  (select count(*) from t) as target_distinct, (select max(n) <= 1 from t) as target_unique,
  case when max(n) filter (where k is not null) <= 1 then 'one' else 'many' end || '_to_' ||
    case when (select max(n) from t) <= 1 then 'one' else 'many' end as cardinality,
  cast(coalesce(sum(n * tn), 0) as bigint) as joined_rows
from b"""


for _name, _args in {
    "join_evidence_orders_customer": ("orders", "o_custkey", "customer", "c_custkey"),
    "join_evidence_documents_labels": ("documents", "doc_id", "labels", "doc_id"),
    "join_evidence_lineitem_part": ("lineitem", "l_partkey", "part", "p_partkey"),
    "join_evidence_text": ("documents", "text", "benchmark", "text"),
}.items():
    @query(_name, "J3", _evidence_sql(*_args))
    def _(spark, sf, _a=_args):
        return key_evidence(
            read(spark, sf, _a[0]), _a[1], read(spark, sf, _a[2]), _a[3]
        ).withColumn("joined_rows", F.col("joined_rows").cast("bigint"))


_KEY_COLUMNS = [(t, c, "text" if k == "string" else k.replace("bigint", "int"))
                for t, cols in TABLES.items() for c, k in cols.items()
                if k in ("int", "bigint", "string", "timestamp_ntz")]


def _contained_sql(least: float) -> str:
    values = "\nunion all\n".join(
        f"select distinct '{t}' as t, '{c}' as c, '{k}' as kind, cast({c} as varchar) as v "
        f"from {t} where {c} is not null" for t, c, k in _KEY_COLUMNS)
    return f"""
with v as materialized ({values}),
sizes as (select t, c, count(*) as d from v group by t, c),
hits as (select s.t as t, s.c as c, x.t as target_table, x.c as target_col, count(*) as m
  from v s join v x on s.kind = x.kind and s.v = x.v and s.t <> x.t group by all)
select t as source_table, c as source_col, target_table, target_col
from hits join sizes using (t, c) where m >= {least} * d"""


@query("contained_columns", "J3", _contained_sql(0.9))
def _(spark, sf):
    """Pairs of columns of all tables, near keys or not, whose source is in the target."""
    tables = read_all(spark, sf)
    sketches = key_sketches(tables)
    pairs = key_pairs(sketches, unique=0.0)
    return catalog_evidence(tables, pairs, least=0.9, sketches=sketches).where("holds").select(
        "source_table", "source_col", "target_table", "target_col")


@query("nation_top_suppliers", "J4", """
select n_name, count(*) as suppliers from nation join supplier on n_nationkey = s_nationkey
group by n_name order by suppliers desc, n_name limit 10""")
def _(spark, sf):
    return (
        read(spark, sf, "nation").join(
            read(spark, sf, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"))
        .groupBy("n_name").agg(F.count(F.lit(1)).alias("suppliers"))
        .orderBy(F.desc("suppliers"), "n_name").limit(10))


@query("segment_orders_ratio", "J5", """
select c_mktsegment, count(distinct c_custkey) as customers, count(o_orderkey) as orders,
  round(count(o_orderkey) * 1.0 / count(distinct c_custkey), 1) as per_customer
from customer left join orders on c_custkey = o_custkey and year(o_orderdate) < 1998
group by c_mktsegment""")
def _(spark, sf):
    # Counting per customer first keeps the join and the distinct count small.
    old = read(spark, sf, "orders").where(F.year("o_orderdate") < 1998)
    per_customer = old.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    joined = read(spark, sf, "customer").join(
        per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_mktsegment").agg(
        F.count_distinct("c_custkey").alias("customers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("orders"),
    ).withColumn("per_customer", F.round(F.col("orders") / F.col("customers"), 1))


# --- differences ------------------------------------------------------------------

_LEFT_SQL = d.observed_sql(f"ts < timestamp '{d.MIDDLE}'")
_RIGHT_SQL = d.observed_sql(f"ts >= timestamp '{d.MIDDLE}'")
_DIFF_SQL = """
select coalesce(l.table_name, r.table_name) as table_name,
  coalesce(l.column_name, r.column_name) as column_name,
  case when l.column_name is null then 'added' when r.column_name is null then 'removed'
    when l.data_type <> r.data_type or l.nullable <> r.nullable then 'changed'
    else 'unchanged' end as change,
  l.data_type as left_type, r.data_type as right_type,
  l.nullable as left_nullable, r.nullable as right_nullable
from ({left}) l full join ({right}) r
  on l.table_name = r.table_name and l.column_name = r.column_name"""
_OBSERVED_DIFF_SQL = _DIFF_SQL.format(left=_LEFT_SQL, right=_RIGHT_SQL)


def _halves(spark, sf):
    return (d.observed_catalog(spark, sf, F.col("ts") < d.middle()),
            d.observed_catalog(spark, sf, F.col("ts") >= d.middle()))


@query("schema_diff_observed", "D1 U3", _OBSERVED_DIFF_SQL)
def _(spark, sf):
    return schema_diff(*_halves(spark, sf))


@query("schema_diff_counts", "D1", f"""
select table_name, count(*) filter (where change = 'added') as added,
  count(*) filter (where change = 'removed') as removed,
  count(*) filter (where change = 'changed') as changed,
  count(*) filter (where change = 'unchanged') as unchanged
from ({_OBSERVED_DIFF_SQL}) group by table_name""")
def _(spark, sf):
    return diff_counts(schema_diff(*_halves(spark, sf)))


_NEWEST_SQL = f"""
select * from ({d.SNAPSHOTS_SQL}) where taken_at < timestamp '{d.MIDDLE}'
qualify taken_at = max(taken_at) over (partition by table_name)"""


@query("latest_snapshot", "D2", _NEWEST_SQL)
def _(spark, sf):
    return latest_snapshot(d.snapshots(spark, sf), d.middle())


@query("diff_since_snapshot", "D2", f"""
with p as ({_NEWEST_SQL}),
c as ({d.observed_sql()}),
n as (select 'user_' || user_id as table_name, count(*) as n from events group by 1),
s as (select table_name, max(taken_at) as since, max(row_count) as prev from p group by 1),
diff as ({_DIFF_SQL.format(left="select * from p", right="select * from c")})
select diff.*, s.since, s.prev as previous_row_count, n.n as current_row_count,
  n.n - s.prev as row_count_delta
from diff join s using (table_name) left join n using (table_name)""")
def _(spark, sf):
    current = d.observed_catalog(spark, sf)
    sizes = read(spark, sf, "events").groupBy(
        F.concat(F.lit("user_"), "user_id").alias("table_name")
    ).agg(F.count(F.lit(1)).alias("row_count"))
    return diff_since(d.snapshots(spark, sf), current, sizes, d.middle())


def _fingerprint_sql(catalog_sql: str) -> str:
    return f"""
select table_name, left(sha256(string_agg(lower(column_name) || ':' ||
    upper(split_part(data_type, '(', 1)), '|' order by lower(column_name),
    upper(split_part(data_type, '(', 1)))), 16) as fingerprint, count(*) as column_count
from ({catalog_sql}) group by table_name"""


@query("fingerprints_observed", "D3", _fingerprint_sql(_OBSERVED_SQL))
def _(spark, sf):
    return fingerprints(d.observed_catalog(spark, sf))


@query("fingerprint_status_observed", "F5", f"""
select i.table_name, i.fingerprint as incoming_fingerprint,
  l.fingerprint as local_fingerprint,
  case when l.fingerprint is null then 'no_local_table'
    when l.fingerprint = i.fingerprint then 'match' else 'drift' end as status
from ({_fingerprint_sql(_OBSERVED_SQL)}) i
left join ({_fingerprint_sql(_LEFT_SQL)}) l using (table_name)""")
def _(spark, sf):
    left, _right = _halves(spark, sf)
    return fingerprint_status(fingerprints(d.observed_catalog(spark, sf)),
                              fingerprints(left))


@query("bundle_diff_observed", "F8 U3", f"""
select coalesce(a.table_name, b.table_name) as table_name,
  a.fingerprint as fingerprint_a, b.fingerprint as fingerprint_b,
  case when b.fingerprint is null then 'only_in_a' when a.fingerprint is null
    then 'only_in_b' else 'shared' end as presence,
  coalesce(a.fingerprint <> b.fingerprint, false) as drift
from ({_fingerprint_sql(_LEFT_SQL)}) a
full join ({_fingerprint_sql(_RIGHT_SQL)}) b on a.table_name = b.table_name""")
def _(spark, sf):
    left, right = _halves(spark, sf)
    return bundle_diff(fingerprints(left), fingerprints(right))


@query("count_drift_orders", "D4", """
select (select count(*) from orders where o_orderdate < timestamp '2000-01-01')
    as before_rows, (select count(*) from orders) as after_rows,
  abs((select count(*) from orders) - (select count(*) from orders
    where o_orderdate < timestamp '2000-01-01')) * cast(100 as double)
  / (select count(*) from orders where o_orderdate < timestamp '2000-01-01') as drift_pct""")
def _(spark, sf):
    orders = read(spark, sf, "orders")
    return count_drift(orders.where(
        F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")), orders)


@query("null_regression_labels", "D5", f"""
select 'quality' as column_name, (select count(*) - count(quality) from labels)
    as before_nulls, (select count(*) - count(quality) from {LABELLED_SQL}) as after_nulls
union all select 'toxic', (select count(*) - count(toxic) from labels),
  (select count(*) - count(toxic) from {LABELLED_SQL})""")
def _(spark, sf):
    return null_regression(read(spark, sf, "labels"), labelled(spark, sf))


@query("column_roles_catalog", "K1", f"""
select *, case
  when data_type like '%date%' or data_type like '%time%' or column_name like '%date%'
    or column_name like '%time%' or column_name like '%created%'
    or column_name like '%updated%' or column_name like '%modified%' then 'time_dimension'
  when data_type in ('int', 'bigint', 'double') and not (contains(column_name, '_id')
    or contains(column_name, '_key') or contains(column_name, '_pk')
    or contains(column_name, '_fk') or contains(column_name, '_code')
    or contains(column_name, '_num')) then 'measure'
  else 'dimension' end as role
from ({_catalog_sql()})""")
def _(spark, sf):
    return column_roles(catalog(read_all(spark, sf)).select(
        "table_name", "ordinal", "column_name", "data_type", "row_count"))
