"""Freshness, joins and differences."""

import datetime

import pytest
from conftest import by
from pyspark.sql import functions as F

from tablelore.functions.names import singular_stems, temporal_score
from tablelore.operators.diff import (
    bundle_diff, count_drift, diff_counts, diff_since, fingerprint_status, fingerprints,
    latest_snapshot, null_regression, schema_diff,
)
from tablelore.operators.freshness import freshness, freshness_candidates
from tablelore.operators.joins import join_candidates, key_evidence
from tablelore.plans.recipes import migration_check, schema_compare
from tablelore.sources.tables import column_catalog

NOW = datetime.datetime(2024, 6, 30, 12)


def clock():
    return F.lit("2024-06-30 12:00:00").cast("timestamp")


def ago(days):
    return (NOW - datetime.timedelta(days=days)).isoformat(sep=" ")


@pytest.fixture
def events(frame):
    return frame("id int, created_at string, updated_at string, note string",
                 [(1, ago(10), ago(1), "x"), (2, ago(20), ago(3), "y"), (3, ago(30), None, "z")])


def test_the_youngest_column_decides(events):
    row = freshness(events, as_of=clock()).collect()[0]
    assert (row.status, row.selected_column, row.latest_age_days) == ("fresh", "updated_at", 1.0)
    assert row.latest_value == "2024-06-29T12:00:00+00:00"
    assert row.reason == "Newest value in 'updated_at' is 1.0 day(s) old (threshold: 7d)."


def test_chosen_column_and_threshold(events):
    assert freshness(events, "CREATED_AT", as_of=clock()).collect()[0].status == "stale"
    assert freshness(events, stale_after_days=0, as_of=clock()).collect()[0].status == "stale"


def test_no_candidates(frame):
    row = freshness(frame("id int, name string", [(1, "a")]), as_of=clock()).collect()[0]
    assert (row.status, row.candidate_count, row.row_count, row.selected_column) == (
        "unknown", 0, 1, None)


def test_empty_and_unreadable_columns(frame):
    row = freshness(frame("created_at string", [(None,)]), as_of=clock()).collect()[0]
    assert row.status == "unknown" and "non-null" in row.reason
    row = freshness(frame("created_at string", [("yesterday",)]), as_of=clock()).collect()[0]
    assert row.status == "unknown" and "could not be parsed" in row.reason
    assert row.latest_value == "yesterday"


def test_future_is_fresh_and_formats(frame):
    row = freshness(frame("updated_at string", [("2030-01-01",)]), as_of=clock()).collect()[0]
    assert row.status == "fresh" and row.latest_value == "2030-01-01"
    for text in ("2024-06-29T12:00:00Z", "20240629", "2024-06-29 12:00:00.5"):
        row = freshness(frame("updated_at string", [(text,)]), as_of=clock()).collect()[0]
        assert row.status == "fresh", text


def test_candidates_are_scored(frame):
    df = frame("loaded_at timestamp, event_id bigint, plain int",
               [(datetime.datetime(2024, 6, 1), 1, 1)])
    rows = by(freshness_candidates(df, as_of=clock()), "column_name")
    assert set(rows) == {"loaded_at", "event_id"}
    assert rows["loaded_at"]["score"] == 10 and len(rows["loaded_at"]["reasons"]) == 4
    assert rows["event_id"]["score"] == 2 and rows["event_id"]["latest_age_days"] is None


def test_temporal_score_of_plain_name(frame):
    field = frame("x int", [(1,)]).schema["x"]
    assert temporal_score(field.name, field.dataType) == (0, [])


# --- joins ------------------------------------------------------------------------

@pytest.fixture
def shop(frame):
    return {
        "customers": frame("id int, name string, email string", [(1, "a", "b")]),
        "orders": frame("id int, customer_id int, order_date date, total double",
                        [(1, 1, None, 1.0)]),
        "products": frame("id int, name string, price double", [(1, "p", 1.0)]),
        "order_items": frame("id int, order_id string, product_id int, quantity int",
                             [(1, "1", 1, 1)]),
    }


def _pairs(df):
    return {(r.target_table, r.source_col, r.target_col): (r.match_type, r.confidence)
            for r in df.collect()}


def test_join_candidates(shop):
    found = _pairs(join_candidates(column_catalog(shop), "Orders"))
    assert found["customers", "customer_id", "id"] == ("convention", 0.8)
    assert found["customers", "id", "id"] == ("exact_name", 0.9)
    assert found["order_items", "id", "order_id"] == ("convention", 0.4)
    assert found["products", "id", "id"] == ("exact_name", 0.9)
    assert not any(table == "orders" for table, _, _ in found)
    only = _pairs(join_candidates(column_catalog(shop), "orders", "CUSTOMERS"))
    assert {t for t, _, _ in only} == {"customers"}


def test_best_tables_come_first(frame):
    tables = {"a": frame("id int, x int, b_id string", []), "b": frame("id int", []),
              "c": frame("x string", [])}
    rows = join_candidates(column_catalog(tables), "a").collect()
    assert [(r.target_table, r.confidence) for r in rows] == [
        ("b", 0.9), ("b", 0.4), ("c", 0.5)]


def test_type_mismatch_halves_trust(frame):
    tables = {"left": frame("code string", []), "right": frame("CODE int", [])}
    assert _pairs(join_candidates(column_catalog(tables), "left")) == {
        ("right", "code", "CODE"): ("exact_name", 0.5)}


@pytest.mark.parametrize("table,stems", [
    ("categories", {"categories", "categorie", "category"}),
    ("movies", {"movies", "movie", "movy"}), ("address", {"address"}),
    ("status", {"status", "statu"}), ("Orders", {"orders", "order"}), ("data", {"data"}),
])
def test_stems(spark, table, stems):
    got = spark.range(1).select(singular_stems(F.lit(table)).alias("s")).collect()[0].s
    assert set(got) == stems and len(got) == len(stems)


@pytest.mark.parametrize("table,fk", [
    ("categories", "category_id"), ("movies", "movie_id"), ("address", "address_id"),
    ("status", "status_id"), ("boxes", "boxe_id"),
])
def test_plural_tables_are_found(frame, table, fk):
    tables = {table: frame("id int", []), "facts": frame(f"{fk} int", [])}
    assert _pairs(join_candidates(column_catalog(tables), "facts")) == {
        (table, fk, "id"): ("convention", 0.8)}


def test_key_evidence(frame):
    orders = frame("customer_id int", [(1,), (1,), (2,), (9,), (9,), (None,)])
    customers = frame("id int", [(1,), (2,), (3,)])
    row = key_evidence(orders, "customer_id", customers, "id").collect()[0]
    assert (row.source_rows, row.source_nulls, row.source_distinct, row.matched_distinct,
            row.orphan_rows, row.target_distinct, row.target_unique, row.joined_rows) == (
        6, 1, 3, 2, 2, 3, True, 3)
    assert row.containment == 0.6667 and row.cardinality == "many_to_one"
    back = key_evidence(customers, "ID", orders, "customer_id").collect()[0]
    assert back.cardinality == "one_to_many" and back.orphan_rows == 1


# --- differences ------------------------------------------------------------------

CATALOG = "table_name string, column_name string, data_type string, nullable boolean"


def test_schema_diff(frame):
    v1 = frame(CATALOG, [("v1", "id", "int", True), ("v1", "name", "string", False),
                         ("v1", "age", "int", True), ("v1", "gone", "int", True)])
    v2 = frame(CATALOG, [("v2", "ID", "INT", True), ("v2", "name", "string", True),
                         ("v2", "age", "double", True), ("v2", "email", "string", True)])
    rows = by(schema_diff(v1, v2, by_table=False), "column_name")
    assert {n: r["change"] for n, r in rows.items()} == {
        "id": "unchanged", "name": "changed", "age": "changed", "gone": "removed",
        "email": "added"}
    assert (rows["age"]["left_type"], rows["age"]["right_type"]) == ("int", "double")
    counts = diff_counts(schema_diff(v1, v1)).collect()[0]
    assert (counts.unchanged, counts.added, counts.removed, counts.changed) == (4, 0, 0, 0)


SNAPSHOT = "taken_at string, row_count bigint, " + CATALOG


def test_diff_since_the_latest_snapshot(frame):
    snapshots = frame(SNAPSHOT, [
        ("2024-01-01", 5, "T", "id", "int", True), ("2024-01-01", 5, "T", "old", "int", True),
        ("2024-02-01", 9, "t", "id", "int", True), ("2024-02-01", 9, "t", "x", "int", True),
        ("2024-03-01", 99, "t", "id", "string", True)])
    assert {r.column_name for r in latest_snapshot(snapshots).collect()} == {"id"}
    current = frame(CATALOG, [("t", "id", "int", True), ("t", "y", "int", True),
                              ("unknown", "id", "int", True)])
    counts = frame("table_name string, row_count bigint", [("t", 12), ("unknown", 1)])
    rows = by(diff_since(snapshots, current, counts, F.lit("2024-03-01")), "column_name")
    assert {n: r["change"] for n, r in rows.items()} == {
        "id": "unchanged", "x": "removed", "y": "added"}
    assert {(r["previous_row_count"], r["row_count_delta"], r["since"])
            for r in rows.values()} == {(9, 3, "2024-02-01")}


def test_fingerprints(frame):
    def print_of(rows):
        return fingerprints(frame(CATALOG, rows)).collect()[0].fingerprint

    one = print_of([("t", "id", "int", True), ("t", "n", "varchar(255)", True)])
    assert one == print_of([("t", "N", "VARCHAR", False), ("t", "ID", "INT", True)])
    assert one != print_of([("t", "id", "bigint", True), ("t", "n", "varchar", True)])
    assert len(one) == 16
    import hashlib
    assert one == hashlib.sha256(b"id:INT|n:VARCHAR").hexdigest()[:16]


def test_fingerprint_status_and_bundle_diff(frame):
    schema = "table_name string, fingerprint string"
    incoming = frame(schema, [("same", "a"), ("drifted", "a"), ("new", "a"), ("none", None)])
    local = frame(schema, [("same", "a"), ("drifted", "b"), ("mine", "c")])
    assert {r.table_name: r.status for r in fingerprint_status(incoming, local).collect()} == {
        "same": "match", "drifted": "drift", "new": "no_local_table", "none": "unknown"}
    rows = by(bundle_diff(incoming.where("fingerprint is not null"), local), "table_name")
    assert {t: (r["presence"], r["drift"]) for t, r in rows.items()} == {
        "same": ("shared", False), "drifted": ("shared", True), "new": ("only_in_a", False),
        "mine": ("only_in_b", False)}


def test_drift_and_null_regression(spark, frame):
    before = frame("id int, a string, b string", [(1, "x", None), (2, "y", "z")])
    after = frame("id int, A string, b string, c string",
                  [(1, None, None, "p"), (2, "y", None, "p"), (3, None, "q", "p")])
    assert count_drift(before, after).collect()[0].drift_pct == 50.0
    assert count_drift(before.limit(0), after).collect()[0].drift_pct is None
    rows = null_regression(before, after).collect()
    assert [(r.column_name.lower(), r.before_nulls, r.after_nulls) for r in rows] == [("a", 0, 2)]
    parts = migration_check(before, after, 60.0)
    assert parts["drift"].collect()[0].passed
    assert parts["nulls"].count() == 1


def test_schema_compare_finds_joins_only_for_differences(shop, frame):
    parts = schema_compare(shop, "orders", "customers")
    assert parts["joins"].count() == 2
    same = schema_compare({"a": shop["orders"], "b": shop["orders"]}, "a", "b")
    assert same["joins"].count() == 0
    assert {r.change for r in same["diff"].collect()} == {"unchanged"}
