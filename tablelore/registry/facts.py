"""Queries on the table of facts and on search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as f
from ..operators.diff import fingerprint_status, fingerprints
from ..operators.fact_snapshots import facts_now, facts_undone, store_snapshot
from ..operators.search import rank_documents, search_facts
from ..operators.search_index import build_index, search_index
from ..store import temporary_folder, written
from . import derived as d
from .base import query, read

_CURRENT_SQL = d.latest_sql(d.LOG_SQL)
_LOCAL_SQL = d.latest_sql(d.BEFORE_SQL)
_INCOMING_SQL = d.latest_sql(d.AFTER_SQL)
_CONF = d.confidence_sql()
_VALUES = "array_to_string(\"values\", ';') as \"values\""


def _flat(facts):
    return facts.withColumn("values", F.when(
        F.col("values").isNotNull(), F.concat_ws(";", "values")))


def _log(spark, sf):
    return d.fact_log(spark, sf)


def _local(spark, sf):
    return f.current_facts(_log(spark, sf).where(F.col("written_at") < d.middle()))


def _incoming(spark, sf):
    return f.current_facts(_log(spark, sf).where(F.col("written_at") >= d.middle()))


_BODY = "table_name, column_name, field, value, " + _VALUES + \
        ", source, confidence, written_at, author, write_id"
_BODY_COLUMNS = ("table_name", "column_name", "field", "value", "values", "source",
                 "confidence", "written_at", "author", "write_id")


@query("facts_current", "F1 F6", f"select {_BODY} from {_CURRENT_SQL}")
def _(spark, sf):
    return _flat(f.current_facts(_log(spark, sf))).select(*_BODY_COLUMNS)


# Updates: the later half of the log, applied to the state of the first half.  Columns
# count as known when the first half wrote about them.
_DECIDE_SQL = f"""
with cur as {_LOCAL_SQL}, upd as {_INCOMING_SQL},
known as (select distinct table_name, column_name from cur where column_name is not null)
select u.table_name, u.column_name, u.field, u.value, u."values", u.confidence, u.source,
  case when u.column_name is not null and k.column_name is null then 'column_not_found'
    when cur.field is not null and {d.confidence_sql('cur.')} >= 1.0
    then 'human_authored' end as reason
from upd u
left join cur on u.table_name = cur.table_name and u.field = cur.field
  and u.column_name is not distinct from cur.column_name
left join known k on k.table_name = u.table_name and k.column_name = u.column_name"""


def _known(local):
    return local.where(F.col("column_name").isNotNull()).select("table_name", "column_name")


@query("facts_preview", "F2", f"""
select table_name, column_name, field, value, {_VALUES}, confidence, source,
  case when reason is null then 'written' else 'skipped' end as action, reason
from ({_DECIDE_SQL})""")
def _(spark, sf):
    local = _local(spark, sf)
    return _flat(f.decide_writes(local, _incoming(spark, sf), _known(local)))


@query("facts_apply", "F1", f"""
select table_name, column_name, field, value, {_VALUES}, confidence, source,
  timestamp '{d.AS_OF}' as written_at, 'reviewer' as author,
  cast(1000000000 as bigint) as write_id
from ({_DECIDE_SQL}) where reason is null""")
def _(spark, sf):
    local = _local(spark, sf)
    written = f.apply_updates(
        local, _incoming(spark, sf), _known(local), 1_000_000_000,
        F.lit(d.AS_OF), author="reviewer")
    return _flat(written).drop("connection", "session").withColumn(
        "written_at", F.col("written_at").cast("timestamp_ntz"))


_REFRESH_SQL = f"""
with old as (select *, true as is_old from {_LOCAL_SQL}),
new as (select *, true as is_new from {_INCOMING_SQL}),
live as (select distinct table_name, column_name from new),
j as (select coalesce(o.table_name, n.table_name) as table_name,
    coalesce(o.column_name, n.column_name) as column_name,
    coalesce(o.field, n.field) as field, o.is_old, n.is_new,
    o.value as ov, o."values" as ovs, o.write_id as ow,
    n.value as nv, n."values" as nvs, n.write_id as nw
  from old o full join new n on o.table_name = n.table_name and o.field = n.field
    and o.column_name is not distinct from n.column_name),
c as (select j.*, case
    when j.column_name is null and field in ('row_count', 'table_comment')
      then case when is_new then 'n' else 'o' end
    when j.column_name is null then case when is_old then 'o'
      when field in ('table_description', 'data_owner', 'update_frequency', 'notes')
      then 'n' end
    when l.table_name is null then null
    when field in ('description', 'pii', 'valid_values')
      then case when is_old then 'o' else 'n' end
    when is_new then 'n' end as side
  from j left join live l on l.table_name = j.table_name
    and l.column_name is not distinct from j.column_name)
select table_name, column_name, field, case side when 'o' then ov else nv end as value,
  array_to_string(case side when 'o' then ovs else nvs end, ';') as "values",
  case side when 'o' then ow else nw end as write_id
from c where side is not null"""


@query("facts_refresh", "F3", _REFRESH_SQL)
def _(spark, sf):
    return _flat(f.refresh(_local(spark, sf), _incoming(spark, sf))).select(
        "table_name", "column_name", "field", "value", "values", "write_id")


def _merge_sql(strategy: str, drift: bool) -> str:
    wins = {"theirs": "true", "mine": "false",
            "keep_higher": "(ic > lc or (ic = lc and i_written > l_written))"}[strategy]
    skipped = ("'local_wins'" if strategy == "mine" else
               "case when lc > ic then 'local_higher_confidence' else 'local_newer' end")
    return f"""
with loc as {_LOCAL_SQL}, inc as {_INCOMING_SQL},
fa as ({d_fingerprints(d.observed_sql())}), fb as ({d_fingerprints(_LEFT)}),
status as (select fa.table_name, fb.fingerprint is not null
  and fa.fingerprint <> fb.fingerprint as drift from fa left join fb using (table_name)),
kc as (select distinct table_name, column_name from loc where column_name is not null),
j as (select i.table_name, i.column_name, i.field, i.value, i."values", i.write_id,
    i.written_at as i_written, l.written_at as l_written,
    (i.value is not null or i."values" is not null) as i_stored,
    coalesce(l.value is not null or l."values" is not null, false) as l_stored,
    {d.confidence_sql('i.')} as ic,
    case when l.field is null then 0.0 else {d.confidence_sql('l.')} end as lc,
    i.column_name is not null and kc.column_name is null as new_column,
    {'coalesce(s.drift, false)' if drift else 'false'} as drift
  from inc i
  left join loc l on i.table_name = l.table_name and i.field = l.field
    and i.column_name is not distinct from l.column_name
  left join kc on kc.table_name = i.table_name and kc.column_name = i.column_name
  left join status s on s.table_name = i.table_name
  where case when i.column_name is null then i.field not in ('row_count', 'table_comment')
    else i.field not in ('sample_values', 'min_val', 'max_val') end),
v as (select *, case when new_column and drift then 'schema_drift'
    when new_column then 'new_column' when not i_stored then null
    when not l_stored or lc = 0.0 or {wins} then '{strategy}'
    else {skipped} end as reason from j)
select table_name, column_name, field,
  case when reason in ('new_column', '{strategy}') then 'write' else 'skip' end as action,
  reason, value, {_VALUES}, write_id, lc as local_confidence, ic as incoming_confidence
from v"""


def d_fingerprints(catalog_sql: str) -> str:
    from .shapes import _fingerprint_sql

    return _fingerprint_sql(catalog_sql)


_LEFT = d.observed_sql(f"ts < timestamp '{d.MIDDLE}'")
_DECISION = ("table_name", "column_name", "field", "action", "reason", "value", "values",
             "write_id", "local_confidence", "incoming_confidence")


def _status(spark, sf):
    left = d.observed_catalog(spark, sf, F.col("ts") < d.middle())
    return fingerprint_status(fingerprints(d.observed_catalog(spark, sf)), fingerprints(left))


@query("facts_merge_keep_higher", "F4 F5", _merge_sql("keep_higher", True))
def _(spark, sf):
    return _flat(f.merge_decisions(_local(spark, sf), _incoming(spark, sf), "keep_higher",
                                   _status(spark, sf))).select(*_DECISION)


@query("facts_merge_mine", "F4", _merge_sql("mine", False))
def _(spark, sf):
    return _flat(f.merge_decisions(
        _local(spark, sf), _incoming(spark, sf), "mine")).select(*_DECISION)


@query("facts_merge_theirs", "F4", _merge_sql("theirs", False))
def _(spark, sf):
    return _flat(f.merge_decisions(
        _local(spark, sf), _incoming(spark, sf), "theirs")).select(*_DECISION)


@query("facts_merged", "F4", f"""
with t as (select * from ({_merge_sql('keep_higher', False)}) where action = 'write'),
loc as {_LOCAL_SQL}
select coalesce(t.table_name, l.table_name) as table_name,
  coalesce(t.column_name, l.column_name) as column_name,
  coalesce(t.field, l.field) as field, coalesce(t.write_id, l.write_id) as write_id
from loc l full join t on t.table_name = l.table_name and t.field = l.field
  and t.column_name is not distinct from l.column_name""")
def _(spark, sf):
    return f.merge(_local(spark, sf), _incoming(spark, sf)).select(
        "table_name", "column_name", "field", "write_id")


@query("facts_best_of_bundles", "F4", f"""
select table_name, column_name, field, value, {_VALUES}, confidence, write_id, bundle
from (select *, row_number() over (partition by table_name, column_name, field
    order by {_CONF} desc, written_at desc, bundle desc) as rn
  from (select *, strftime(written_at, '%Y-%m-%d') as bundle from ({d.LOG_SQL}))
  where value is not null or "values" is not null)
where rn = 1""")
def _(spark, sf):
    bundles = _log(spark, sf).withColumn("bundle", F.date_format("written_at", "yyyy-MM-dd"))
    return _flat(f.best_of_bundles(bundles)).select(
        "table_name", "column_name", "field", "value", "values", "confidence", "write_id",
        "bundle")


@query("facts_undo", "F6", f"""
with log as ({d.LOG_SQL}),
ids as (select table_name, write_id, dense_rank() over (partition by table_name
  order by write_id desc) as rk from log),
kept as (select log.* from log join ids using (table_name, write_id) where rk > 3)
select {_BODY} from {d.latest_sql('select * from kept')}""")
def _(spark, sf):
    return _flat(f.current_facts(f.undo(_log(spark, sf), 3))).select(*_BODY_COLUMNS)


def _snapshot_of_half(spark, sf):
    """The log, and a folder with snapshots of its first quarter and half."""
    log = written(_log(spark, sf), "fact-log")
    folder = temporary_folder(spark, "fact-snapshots")
    last = log.agg(F.max("write_id")).collect()[0][0] or 0
    for share in (4, 2):
        store_snapshot(log.where(F.col("write_id") <= last // share), folder)
    return log, folder


@query("facts_from_snapshot", "F1", f"""
select table_name, field, count(*) as facts, max(write_id) as last_write,
  count(value) as with_value from {_CURRENT_SQL} group by table_name, field""")
def _(spark, sf):
    return facts_now(*_snapshot_of_half(spark, sf)).groupBy("table_name", "field").agg(
        F.count(F.lit(1)).alias("facts"), F.max("write_id").alias("last_write"),
        F.count("value").alias("with_value"))


@query("facts_undone_from_snapshot", "F6", f"""
with log as ({d.LOG_SQL}),
ids as (select table_name, write_id, dense_rank() over (partition by table_name
  order by write_id desc) as rk from log),
kept as (select log.* from log join ids using (table_name, write_id) where rk > 7)
select {_BODY} from {d.latest_sql('select * from kept')}""")
def _(spark, sf):
    return _flat(facts_undone(*_snapshot_of_half(spark, sf), 7)).select(*_BODY_COLUMNS)


@query("facts_redact", "F7", f"""
with dic as ({d.DICTIONARY_SQL}),
pii as (select distinct table_name, column_name from dic
  where field = 'pii' and value = 'true')
select table_name, column_name, field, value, {_VALUES} from dic
where not (field in ('sample_values', 'min_val', 'max_val', 'valid_values')
  and exists (select 1 from pii p where p.table_name = dic.table_name
    and p.column_name = dic.column_name))""")
def _(spark, sf):
    return _flat(f.redact(d.dictionary(spark, sf))).select(
        "table_name", "column_name", "field", "value", "values")


@query("facts_rename", "F11", f"""
select case table_name when 'src0' then 'archive' when 'src1' then 'live'
    else table_name end as table_name, column_name, field, value
from ({d.DICTIONARY_SQL})""")
def _(spark, sf):
    return f.rename_tables(d.dictionary(spark, sf), {"src0": "archive", "src1": "live"}
                           ).select("table_name", "column_name", "field", "value")


@query("facts_rename_by_table", "F11", f"""
select coalesce(r.lang || '_' || dic.table_name, dic.table_name) as table_name,
  column_name, field, value
from ({d.DICTIONARY_SQL}) dic left join (select source, max(lang) as lang from documents
  group by source having count(*) > 50) r on r.source = dic.table_name""")
def _(spark, sf):
    names = (
        read(spark, sf, "documents").groupBy("source")
        .agg(F.max("lang").alias("lang"), F.count(F.lit(1)).alias("n")).where("n > 50")
        .select("source", F.concat_ws("_", "lang", "source").alias("target")))
    return f.rename_tables(d.dictionary(spark, sf), names).select(
        "table_name", "column_name", "field", "value")


_SCORE_SQL = f"""
with dic as ({d.DICTIONARY_SQL}),
c as (select table_name, column_name,
    max(case when field = 'description' and {_CONF} >= 1.0 then 1 else 0 end) as described,
    max(case when field = 'distinct_count' then cast(value as double) end) as dist,
    max(case when field = 'valid_values' and {d.FILLED_SQL.format(p='')} then 1 else 0 end)
      as listed,
    max(written_at) as written_at
  from dic group by table_name, column_name),
t as (select table_name, count(*) as column_count,
    coalesce(string_agg(column_name, ';' order by column_name)
      filter (where described = 0), '') as missing_descriptions,
    coalesce(string_agg(column_name, ';' order by column_name)
      filter (where dist > 1 and dist <= 20 and listed = 0), '') as missing_valid_values, sum(described) as described,
    count(*) filter (where dist > 1 and dist <= 20) as targets,
    count(*) filter (where dist > 1 and dist <= 20 and listed = 1) as listed,
    greatest(0.0, date_diff('microsecond', max(written_at), timestamp '{d.AS_OF}')
      / 86400000000.0) as days
  from c group by table_name),
p as (select *, case when column_count > 0 then 100.0 * described / column_count
    else 100.0 end as dp,
  case when targets > 0 then 100.0 * listed / targets else 100.0 end as vp,
  cast(case when days <= 7 then 1.0 when days >= 90 then 0.0
    else 1.0 - (days - 7.0) / 83.0 end as double) as fresh from t)
select table_name,
  cast(printf('%.2f', cast(0.5 as double) * (dp / 100) + cast(0.3 as double) * (vp / 100)
    + cast(0.2 as double) * fresh) as double) as score,
  column_count, cast(printf('%.1f', cast(dp as double)) as double) as column_description_pct,
  cast(printf('%.1f', cast(vp as double)) as double) as valid_values_coverage_pct,
  targets as valid_values_targets,
  cast(printf('%.1f', cast(days as double)) as double) as freshness_days,
  missing_descriptions, missing_valid_values
from p"""


@query("facts_score", "F9", _SCORE_SQL)
def _(spark, sf):
    rows = f.completeness(d.dictionary(spark, sf), F.lit(d.AS_OF))
    return rows.withColumns({c: F.concat_ws(";", c) for c in (
        "missing_descriptions", "missing_valid_values")})


@query("facts_score_average", "F9", f"""
select cast(printf('%.2f', avg(score)) as double) as average_score,
  count(*) as table_count from ({_SCORE_SQL})""")
def _(spark, sf):
    return f.average_score(f.completeness(d.dictionary(spark, sf), F.lit(d.AS_OF)))


# --- search -----------------------------------------------------------------------

_WORDS = "the reation thering"


def _tokens_sql(text: str) -> str:
    """Terms of a text; hyphenated and underscored terms also yield their parts."""
    return (f"flatten(list_transform(regexp_extract_all(lower(coalesce({text}, '')), "
            "'[a-z0-9]+(?:[-_][a-z0-9]+)?'), lambda t: case when regexp_matches(t, '[-_]') "
            "then list_concat([t], regexp_split_to_array(t, '[-_]')) else [t] end))")


def _search_sql(words: str, limit: int) -> str:
    asked = ", ".join(f"('{w}')" for w in words.split())
    return f"""
with q(term) as (values {asked}),
d as (select doc_id, lang, source, text, {_tokens_sql('text')} as toks from documents),
l as (select *, len(toks) as dl from d),
s as (select count(*) as n, sum(dl) as total from l),
tf as (select doc_id, term, dl, len(list_filter(toks, lambda t: t = term)) as tf from l, q),
df as (select term, count(*) filter (where tf > 0) as df from tf group by term),
parts as (select doc_id, sum(case when tf > 0 then
    ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5
      / (tf + 1.5 * (0.25 + 0.75 * dl / (total / n)))) else 0 end) as bm
  from tf join df using (term), s group by doc_id)
select doc_id, lang, source, round(bm + case when contains(lower(text), '{words}')
  then 2.0 else 0.0 end, 3) as score
from parts join documents using (doc_id) where bm > 0
order by score desc, doc_id limit {limit}"""


@query("search_documents", "F10", _search_sql(_WORDS, 20))
def _(spark, sf):
    return rank_documents(
        read(spark, sf, "documents"), _WORDS, {"text": 1}, excerpt="text",
        order=("doc_id",), limit=20,
    ).select("doc_id", "lang", "source", "score")


def _indexed(spark, sf, words, limit):
    documents = read(spark, sf, "documents")
    folder = temporary_folder(spark, "index")
    build_index(documents, {"text": 1}, ["doc_id", "lang", "source"], folder)
    return search_index(spark, folder, words, limit, ["doc_id"], documents, "text").select(
        "doc_id", "lang", "source", "score")


# The same question to a stored index: three words, a rare one, and one that all have.
for _name, _asked, _limit in (("search_index_three", "the reation thering", 40),
                              ("search_index_rare", "thering", 7),
                              ("search_index_mail", "example mail7 com", 25)):
    @query(_name, "F10", _search_sql(_asked, _limit))
    def _(spark, sf, _w=_asked, _n=_limit):
        return _indexed(spark, sf, _w, _n)


@query("search_conversations", "F10", f"""
with q(term, qf) as (values ('data-set', 1), ('data', 1), ('set', 1), ('ouen', 2)),
d as (select conv_id, turn, {_tokens_sql('text')} as toks from conversations),
l as (select *, len(toks) as dl from d),
s as (select count(*) as n, sum(dl) as total from l),
tf as (select conv_id, turn, term, qf, dl,
  len(list_filter(toks, lambda t: t = term)) as tf from l, q),
df as (select term, count(*) filter (where tf > 0) as df from tf group by term)
select conv_id, turn, round(sum(case when tf > 0 then
    qf * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5
      / (tf + 1.5 * (0.25 + 0.75 * dl / (total / n)))) else 0 end), 3) as score
from tf join df using (term), s group by conv_id, turn having score > 0
order by score desc, conv_id, turn limit 10""")
def _(spark, sf):
    return rank_documents(
        read(spark, sf, "conversations"), "data-set ouen OUEN", {"text": 1},
        order=("conv_id", "turn"), limit=10,
    ).select("conv_id", "turn", "score")


# Facts as documents: a column document weighs its name 6, its table 3, the description
# 5, listed values 4, type 2 and the personal-data flag 4.
@query("search_facts_dictionary", "F10", f"""
with dic as ({d.DICTIONARY_SQL}),
doc as (select table_name, column_name,
    max(case when field = 'description' and trim(value) not like '<%' then trim(value) end)
      as description,
    max(case when field = 'valid_values' and len("values") > 0
      then array_to_string("values", ', ') end) as vv,
    max(case when field = 'type' then value end) as kind,
    max(case when field = 'pii' then 'pii sensitive ' || value end) as pii
  from dic group by table_name, column_name),
tok as (select *, {_tokens_sql('column_name')} as t1, {_tokens_sql('table_name')} as t2,
    {_tokens_sql('description')} as t3, {_tokens_sql('vv')} as t4,
    {_tokens_sql('kind')} as t5, {_tokens_sql('pii')} as t6,
    column_name || ' (' || kind || ')' || coalesce(' | ' || description, '')
      || coalesce(' | Valid values: ' || vv, '') || ' | PII: ' || pii as excerpt from doc),
l as (select *, 6 * len(t1) + 3 * len(t2) + 5 * len(t3) + 4 * len(t4) + 2 * len(t5)
    + 4 * len(t6) as dl from tok),
s as (select count(*) as n, sum(dl) as total from l),
q(term) as (values ('pii'), ('true'), ('src3')),
tf as (select table_name, column_name, excerpt, dl, term,
    6 * len(list_filter(t1, lambda t: t = term)) + 3 * len(list_filter(t2, lambda t: t = term))
    + 5 * len(list_filter(t3, lambda t: t = term)) + 4 * len(list_filter(t4, lambda t: t = term))
    + 2 * len(list_filter(t5, lambda t: t = term))
    + 4 * len(list_filter(t6, lambda t: t = term)) as tf,
    list_contains(t1, term) as in1, list_contains(t2, term) as in2 from l, q),
df as (select term, count(*) filter (where tf > 0) as df from tf group by term),
sc as (select table_name, column_name, any_value(excerpt) as excerpt,
    sum(case when tf > 0 then ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5
      / (tf + 1.5 * (0.25 + 0.75 * dl / (total / n)))) else 0 end)
    + 0.8 * (count(*) filter (where in1) + count(*) filter (where in2))
    + case when contains(lower(any_value(excerpt)), 'pii true src3') then 2 else 0 end
      as score
  from tf join df using (term), s group by table_name, column_name)
select 'column' as kind, table_name, column_name, round(score, 3) as score from sc
where score > 0 order by score desc, table_name, column_name limit 15""")
def _(spark, sf):
    return search_facts(d.dictionary(spark, sf), "PII true src3", 15).select(
        "kind", "table_name", "column_name", "score")


@query("search_facts_explained", "F10")
def _(spark, sf):
    return search_facts(f.current_facts(_log(spark, sf)), "todo purchase user_12", 10)
