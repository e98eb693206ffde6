import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablelore.functions.text import terms
from tablelore.operators import search_index as search_index_module
from tablelore.operators.search import query_terms, rank_documents, search_facts
from tablelore.operators.search_index import _postings, build_index, search_index
from tablelore.store import temporary_folder, written


def test_terms(spark):
    got = spark.range(1).select(terms(F.lit("Order-Items and net_sum, x1 -- _a")).alias("t")
                                ).collect()[0].t
    assert got == ["order-items", "and", "net_sum", "x1", "a", "order", "items", "net", "sum"]
    assert sorted(query_terms("Order-Items and net_sum, x1 -- _a")) == sorted(got)
    hard = "a-b-c-d e_f_g -x- y--z 1-2_3 ab-cd-"
    got = spark.range(1).select(terms(F.lit(hard)).alias("t")).collect()[0].t
    assert sorted(got) == sorted(query_terms(hard))
    assert spark.range(1).select(terms(F.lit(None).cast("string")).alias("t")
                                 ).collect()[0].t == []


def brute_force(texts, query, limit):
    """Ranking by the textbook formula."""
    bags = [Counter(query_terms(t)) for t in texts]
    lengths = [sum(b.values()) for b in bags]
    average = sum(lengths) / len(texts)
    scores = []
    for i, bag in enumerate(bags):
        score = 0.0
        for term, wanted in Counter(query_terms(query)).items():
            tf = bag[term]
            if tf:
                df = sum(term in b for b in bags)
                idf = math.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
                score += wanted * idf * tf * 2.5 / (
                    tf + 1.5 * (0.25 + 0.75 * lengths[i] / average))
        if re.search(re.escape(query.lower().strip()), texts[i].lower()):
            score += 2.0
        if score > 0:
            scores.append((-round(score, 3), i))
    return [(i, -s) for s, i in sorted(scores)[:limit]]


@pytest.mark.parametrize("query", ["red fox", "fox fox dog-house", "missing", "the"])
def test_ranking_against_brute_force(spark, query):
    rng = random.Random(5)
    words = ["red", "fox", "dog", "house", "dog-house", "the", "a", "lazy"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = rank_documents(docs, query, {"text": 1}, excerpt="text", order=("id",), limit=15)
    assert [(r.id, r.score) for r in rows.collect()] == brute_force(texts, query, 15)


def test_empty_query_and_empty_corpus(spark):
    docs = spark.createDataFrame([(1, "a")], "id int, text string")
    assert rank_documents(docs, " ,, ", {"text": 1}).collect() == []
    assert rank_documents(docs.limit(0), "a", {"text": 1}).collect() == []


@pytest.fixture
def facts(frame):
    return frame(
        "table_name string, column_name string, field string, value string, "
        "values array<string>",
        [("orders", None, "table_description", "Every sale of the shop", None),
         ("orders", None, "data_owner", "Sales team", None),
         ("orders", "status", "description", "State of the order", None),
         ("orders", "status", "valid_values", None, ["open", "done"]),
         ("orders", "status", "type", "string", None),
         ("customers", "email", "pii", "true", None),
         ("customers", "email", "description", "<description>", None),
         ("customers", None, "notes", "One row per person", None)])


def test_fact_search(facts):
    first = search_facts(facts, "status").collect()[0]
    assert (first.kind, first.table_name, first.column_name) == ("column", "orders", "status")
    assert first.excerpt == "status (string) | State of the order | Valid values: open, done"
    assert first.rationale == "column name: status"
    private = search_facts(facts, "sensitive pii").collect()
    assert [r.column_name for r in private] == ["email"]
    assert private[0].rationale == "PII flag: pii, sensitive"
    assert private[0].matched_terms == ["sensitive", "pii"]
    orders = search_facts(facts, "orders", limit=2).collect()
    assert [r.kind for r in orders] == ["table", "column"]
    assert orders[0].excerpt == "Every sale of the shop | Owner: Sales team"
    assert search_facts(facts, "zebra").collect() == []


def test_name_bonus(facts):
    # Same name 8, name contains 3, excerpt contains 2, one query term in the names 0.8.
    with_bonus = {r.column_name: r.score for r in search_facts(facts, "email").collect()}
    assert 13.8 < with_bonus["email"] < 13.8 + 6


# --- the stored index ---------------------------------------------------------------

@pytest.fixture(scope="module")
def library(spark):
    """Thousands of short documents of a few common and many rare words."""
    rng = random.Random(4)
    common = ["the", "of", "data", "set", "data-set", "a_b", "long"]
    rows = [(i, " ".join(rng.choice(common) if rng.random() < 0.7 else f"w{rng.randrange(3000)}"
                         for _ in range(rng.randrange(1, 25))), f"t{i % 7} data")
            for i in range(9_000)]
    rows += [(9_001, None, None), (9_002, "", "w1"), (9_003, "Data-Set of THE", None)]
    rows += [(9_100 + i, "the perfect match of words", "title") for i in range(3)]
    return written(spark.createDataFrame(rows, "id long, body string, title string")
                   .repartition(3), "library")


@pytest.fixture(scope="module")
def index(spark, library):
    folder = f"{temporary_folder(spark, 'index')}/own"
    build_index(library, {"body": 2, "title": 3}, ["id"], folder)
    return folder


@pytest.mark.parametrize("query", [
    "the", "data-set", "w17 w18", "the of data set", "perfect match of words", "t3 data w5",
    "w99999", "a_b A_B the", "w1 w2 w3 w4 w5 w6 w7 w8", "", "!?"])
@pytest.mark.parametrize("limit", [1, 10, 60])
def test_index_ranks_like_reading_all(spark, library, index, query, limit):
    want = rank_documents(library, query, {"body": 2, "title": 3}, excerpt="body",
                          order=("id",), limit=limit).collect()
    got = search_index(spark, index, query, limit, ["id"], library, "body").collect()
    assert [(r.id, r.score, r.matched_terms) for r in got] == [
        (r.id, r.score, r.matched_terms) for r in want]


def test_only_asked_terms_are_read(spark, index):
    rows = _postings(spark, index, ["w17"])
    assert {r.term for r in rows.collect()} == {"w17"}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    folders, pushed = (plan.split(f"{part}Filters: [")[1] for part in ("Partition", "Pushed"))
    assert "folder" in folders and "w17" in pushed
    assert rows.count() < spark.read.parquet(f"{index}/terms").count() / 100


def test_blocks_that_cannot_win_are_skipped(spark, tmp_path, monkeypatch):
    """The one block with the word often decides; the word's other blocks stay unread."""
    docs = spark.range(0, 60_000, numPartitions=1).select("id", F.when(
        F.col("id").between(20_000, 20_050), F.lit("rare rare rare")).when(
        F.col("id") % 100 == 0, F.concat(F.lit("rare "), F.repeat(F.lit("x "), F.lit(40))))
        .otherwise("x").alias("body"))
    folder = str(tmp_path / "index")
    build_index(docs, {"body": 1}, ["id"], folder)
    seen = []
    real = search_index_module.written

    def spied(df, name):
        table = real(df, name)
        seen.append((name, table))
        return table

    monkeypatch.setattr(search_index_module, "written", spied)
    got = search_index(spark, folder, "rare", 10, ["id"])
    assert [r.id for r in got.collect()] == list(range(20_000, 20_010))
    bounds = sorted(r.bound for _, t in seen for r in t.collect())
    assert len(bounds) == 15 and bounds[-1] > 2 * bounds[-3]


def test_index_of_nothing(spark, tmp_path):
    folder = str(tmp_path / "index")
    build_index(spark.createDataFrame([], "id long, body string"), {"body": 1}, ["id"], folder)
    assert search_index(spark, folder, "word", 3).collect() == []


def test_words_are_counted_in_their_row(spark, tmp_path, monkeypatch):
    """What is written before the shuffles is a row a document: its terms once, no texts."""
    docs = spark.createDataFrame(
        [(1, "b a b c-d", "b"), (2, None, ""), (3, "a", None), (1, "b a b c-d", "b")],
        "id long, body string, title string")
    seen = []
    real = search_index_module.written

    def spied(df, name):
        seen.append(real(df, name))
        return seen[-1]

    monkeypatch.setattr(search_index_module, "written", spied)
    folder = str(tmp_path / "index")
    build_index(docs, {"body": 1, "title": 2}, ["id"], folder)
    (rows,) = [t.drop("_doc").collect() for t in seen]
    both = (["a", "b", "c", "c-d", "d"], [1, 4, 1, 1, 1])
    got = sorted((r.id, r._len, r._runs and (r._runs.terms, r._runs.counts)) for r in rows)
    assert got == [(1, 8, both), (1, 8, both), (2, 0, None), (3, 1, (["a"], [1]))]
    terms = spark.read.parquet(f"{folder}/terms")
    assert sorted((r.term, sorted(r.counts)) for r in terms.selectExpr(
        "term", "explode(counts) as n").groupBy("term").agg(
        F.collect_list("n").alias("counts")).collect()) == [
        ("a", [1, 1, 1]), ("b", [4, 4]), ("c", [1, 1]), ("c-d", [1, 1]), ("d", [1, 1])]
