"""Facts from snapshots equal facts from the whole log."""

import pytest
from pyspark.sql import functions as F

from tablelore.operators import fact_snapshots
from tablelore.operators.fact_snapshots import (
    facts_now, facts_undone, snapshots, store_snapshot,
)
from tablelore.operators.facts import LOG_SCHEMA, current_facts, undo


@pytest.fixture
def log(frame, tmp_path, spark):
    rows = []
    for i in range(1, 41):
        table = "often" if i % 4 else "seldom"
        for c in (None, "A" if i % 2 else "a", f"c{i % 5}"):
            rows.append((None, table, c, "notes", None if i % 7 == 0 else f"{i}",
                         [str(i)] if i % 6 == 0 else None, None, None, None, "x", None, i))
    frame(LOG_SCHEMA, rows).repartition(5, "write_id").write.parquet(f"{tmp_path}/log")
    return spark.read.parquet(f"{tmp_path}/log")


def facts(df):
    return sorted(map(str, (r.asDict() for r in df.select(sorted(df.columns)).collect())))


@pytest.mark.parametrize("taken", [[], [1], [10, 25], [25, 40], [40]])
def test_same_as_the_whole_log(log, tmp_path, taken):
    folder = f"{tmp_path}/snaps"
    for upto in taken:
        assert store_snapshot(log.where(F.col("write_id") <= upto), folder) == upto
    assert snapshots(log.sparkSession, folder) == taken
    assert facts(facts_now(log, folder)) == facts(current_facts(log))
    for writes in (0, 1, 3, 9, 15, 100):
        assert facts(facts_undone(log, folder, writes)) == facts(current_facts(undo(log, writes)))


def test_undoing_more_than_is_kept(log, tmp_path, monkeypatch):
    monkeypatch.setattr(fact_snapshots, "KEPT_WRITES", 2)
    store_snapshot(log, f"{tmp_path}/s")
    for writes in (2, 5):
        assert facts(facts_undone(log, f"{tmp_path}/s", writes)) == facts(
            current_facts(undo(log, writes)))


def test_only_the_end_of_the_log_is_read(log, tmp_path):
    folder = f"{tmp_path}/snaps"
    store_snapshot(log.where("write_id <= 30"), folder)
    plan = facts_now(log, folder)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(write_id,30)" in plan
    plan = facts_undone(log, folder, 2)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "Scan parquet" in line and "/log" in line]
    assert len(scans) == 1 and "GreaterThan(write_id,30)" in scans[0]


def test_nothing_new_and_empty_logs(log, tmp_path, frame):
    folder = f"{tmp_path}/snaps"
    empty = frame(LOG_SCHEMA, [])
    assert store_snapshot(empty, folder) is None and facts_now(empty, folder).count() == 0
    assert store_snapshot(log, folder) == 40 == store_snapshot(log, folder)
    assert snapshots(log.sparkSession, folder) == [40]
