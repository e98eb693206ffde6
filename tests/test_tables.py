import csv
import glob
import json

import pytest
from conftest import by
from pyspark.sql import functions as F

from tablelore.sources.rows import (
    capped_query, capped_query_summary, check_name, export, export_query, preview, scratch,
    select_rows, sort_rows,
)
from tablelore.sources.tables import (
    catalog, column_catalog, enrich_catalog, inspect, list_tables, open_parquet, row_counts,
    search_catalog,
)


@pytest.fixture
def shop(frame):
    return {
        "customers": frame("id int, name string, email string", [(1, "a", "e")]),
        "orders": frame("id int, customer_id int, total double", [(1, 1, 2.0), (2, 1, 3.0)]),
    }


def test_parquet_becomes_a_view_named_by_its_stem(spark, frame, tmp_path):
    sales = frame("id int, product string, price double, seller string",
                  [(1, "w", 9.5, "x"), (2, "g", 1.0, "y"), (3, "w", 2.0, "x")])
    sales.write.parquet(str(tmp_path / "sales.parquet"))
    open_parquet(spark, str(tmp_path / "sales.parquet"))
    assert spark.sql("select sum(price) from sales").collect()[0][0] == 12.5
    names = [r.table_name for r in list_tables(spark).collect()]
    assert "sales" in names and names == sorted(names)


def test_catalog_and_counts(shop):
    rows = catalog(shop).collect()
    assert len(rows) == 6
    assert {(r.table_name, r.row_count) for r in rows} == {("customers", 1), ("orders", 2)}
    short = catalog(shop, tables_only=True).collect()
    assert len(short) == 2 and short[0].column_name is None and short[0].row_count is None
    assert {r.row_count for r in row_counts(shop).collect()} == {1, 2}


def test_inspect_shows_comments_and_nullability(spark):
    spark.sql("create or replace temp view v as select id from range(4)")
    df = spark.table("v").select(F.col("id").alias("id", metadata={"comment": "key"}))
    row = inspect(df, "v").collect()[0]
    assert (row.column_name, row.nullable, row.comment, row.row_count) == (
        "id", False, "key", 4)


def test_search_keeps_whole_tables(shop):
    rows = search_catalog(catalog(shop), "MAIL").collect()
    assert {r.table_name for r in rows} == {"customers"} and len(rows) == 3
    assert len(search_catalog(catalog(shop), "order").collect()) == 3
    assert search_catalog(catalog(shop), "%").collect() == []


def test_enrich_leaves_placeholders_out(shop, frame):
    facts = frame(
        "table_name string, column_name string, field string, value string, "
        "values array<string>",
        [("orders", None, "data_owner", "Ann", None),
         ("orders", None, "notes", "<notes>", None),
         ("orders", "TOTAL", "description", "Sum of lines", None),
         ("orders", "id", "description", "<description>", None),
         ("orders", "total", "valid_values", None, ["1", "2"])])
    rows = {(r.table_name, r.column_name): r
            for r in enrich_catalog(column_catalog(shop), facts).collect()}
    assert len(rows) == 6
    total = rows["orders", "total"]
    assert (total.data_owner, total.notes, total.description, total.valid_values) == (
        "Ann", None, "Sum of lines", ["1", "2"])
    assert rows["orders", "id"].description is None
    assert rows["customers", "id"].data_owner is None


def test_preview_sort_and_select(spark):
    df = spark.range(50).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("even"))
    assert preview(df).count() == 20
    assert [r.id for r in preview(df, 2, [F.desc("id")]).collect()] == [49, 48]
    assert sort_rows(df, "EVEN").collect()[-1].even is None
    assert sort_rows(df, "even", descending=True).collect()[0].even is None
    rows = select_rows(df, ["ID"], "id > 40", ["id"], 3).collect()
    assert [r.id for r in rows] == [41, 42, 43]


def test_capped_query(spark):
    assert capped_query(spark, "select * from range(2000);").count() == 2000
    assert capped_query(spark, "select * from range(2000)", 1000).count() == 1000
    got = [capped_query_summary(spark, "select * from range(10)", n).collect()[0]
           for n in (5, 10, 20, 0)]
    assert [(r.row_count, r.limited) for r in got] == [
        (5, True), (10, True), (10, False), (10, False)]


def test_scratch_view(spark):
    scratch(spark.range(100), "numbers", 3, ["id"])
    assert [r.id for r in spark.sql("select id from tmp_numbers order by id").collect()
            ] == [0, 1, 2]


@pytest.mark.parametrize("name", ["a;drop", "a b", "", "1a", "a..b", "x'--"])
def test_bad_names(name):
    with pytest.raises(ValueError):
        check_name(name)


def _files(folder):
    return [open(f, newline="").read() for f in sorted(glob.glob(f"{folder}/part-*"))]


def test_export(spark, frame, tmp_path):
    df = frame("id int, name string, tags array<string>",
               [(1, 'say "hi", you', ["a"]), (2, None, None), (3, "", ["b", "c"])]).coalesce(1)
    export(df, f"{tmp_path}/c", "csv", where="id < 3")
    rows = list(csv.reader(_files(f"{tmp_path}/c")[0].splitlines()))
    assert rows == [["id", "name", "tags"], ["1", 'say "hi", you', '["a"]'], ["2", "", ""]]
    export(df, f"{tmp_path}/t", "tsv", columns=["NAME", "id"], limit=1)
    assert _files(f"{tmp_path}/t")[0].splitlines()[0] == "id\tname"
    for fmt in ("json", "jsonl"):
        export(df, f"{tmp_path}/{fmt}", fmt)
        lines = [json.loads(x) for x in _files(f"{tmp_path}/{fmt}")[0].splitlines()]
        assert lines[1] == {"id": 2, "name": None, "tags": None} and len(lines) == 3
    export_query(spark, "select id from range(5) where id > 2", f"{tmp_path}/q")
    assert sum(len(t.splitlines()) - 1 for t in _files(f"{tmp_path}/q") if t) == 2
    with pytest.raises(ValueError, match="unsupported"):
        export(df, f"{tmp_path}/x", "xml")
    assert by(df, "id")[1]["tags"] == ["a"]
