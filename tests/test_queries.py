"""Every named query against its SQL, on the smallest test tables."""

import os
import re

import pytest
from compare import compare, duck

import __spark_entry__ as driver
from tablelore.registry import all_queries

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@needs_data
@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, con, name):
    ok, message = compare(spark, con, SF, name)
    assert ok, message


@needs_data
def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert len(rows) == 11 and rows[0].total_rows > 0


def test_entry_points_agree():
    names = set(driver.queries())
    assert set(driver.oracle_sql()) <= names and len(names) >= 120


def test_every_operator_has_a_query():
    wanted = set()
    for letter, count in {"S": 16, "P": 6, "J": 5, "A": 16, "W": 2, "L": 4, "U": 3, "Q": 7,
                          "D": 5, "K": 16, "F": 11}.items():
        wanted |= {f"{letter}{i}" for i in range(1, count + 1)}
    covered = {c for q in all_queries().values() for c in q.covers}
    assert wanted - covered == set()


def test_no_two_queries_say_the_same():
    seen = {}
    for q in all_queries().values():
        if q.sql:
            key = re.sub(r"\s+", " ", q.sql).strip()
            seen.setdefault(key, []).append(q.name)
    assert [names for names in seen.values() if len(names) > 1] == []
