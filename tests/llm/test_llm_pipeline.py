"""The pipeline's stages against their operators by brute force, and the registered queries."""

import os

import pytest
from compare import duck

import __spark_entry__ as driver
import corpus_pipeline
from tablelore.llm import decontaminate, jaccard
from tablelore.llm.frames import fresh

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
OWN = [f"op{n}_" for n in range(1, 11)]


def test_every_operator_is_registered():
    names = list(driver.queries())
    assert all(sum(n.startswith(o) for n in names) == 1 for o in OWN) and "pipeline" in names
    assert [s[0] for s in corpus_pipeline.STAGES] == [
        "language", "quality_rules", "near_duplicates", "decontamination", "packing"]


@needs_data
def test_urls_against_sql(spark):
    name = "op1_url_filters"
    con = duck(SF)
    want = con.sql(driver.oracle_sql()[name])
    columns = ["page_id", "host", "path", "rule", "verdict"]
    got = driver.queries()[name](spark, SF)
    assert got.columns == columns == list(want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


@needs_data
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnsRenamed(
        {"source": "counts"})  # a name that a stage uses inside
    columns = docs.columns
    bench = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{number}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").collect()} == set(before)
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and docs.count() == len(after)
        if name == "language":
            assert len(after) >= 0.99 * len(before)
        if name == "quality_rules":
            assert all(len(t.split()) >= 10 for t in after.values())
        if name == "near_duplicates":
            assert set(after) == {min(g) for g in groups(before)}
        if name == "decontamination":
            gone = {d for d, t in before.items() if any(b in decontaminate.normal(t) for b in bench)}
            assert gone <= set(before) - set(after)
        before = after


def groups(texts):
    sets = {}
    for d, t in texts.items():
        w = jaccard.words_of(t)
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    out = {d: {d} for d in texts}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if out[a] is not out[b] and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                merged = out[a] | out[b]
                for d in merged:
                    out[d] = merged
    return list({id(g): g for g in out.values()}.values())


def test_near_duplicates_of_awkward_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "b"), (None, text, "c"), (7, None, "d"),
            (8, "", "e"), (9, " ", "f"), (9, " ", "f"), (1, "quite another text than this one", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text_hash string")
    got = corpus_pipeline.unlike(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted(
        (str(d), str(t)) for d, t, _ in [rows[1], *rows[3:]])


def test_near_duplicates_are_rows(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    rows = [(3, a), (5, a + " more"), (5, b), (9, b + " more"), (5, "a text that nothing else is like"),
            (7, c), (7, c + " more"), (None, d), (None, d), (None, d + " more"), (None, "no other like it")]
    got = corpus_pipeline.unlike(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted((str(r.doc_id), r.text.removesuffix(" more")) for r in got) == sorted(
        [("3", a), ("5", b), ("5", rows[4][1]), ("7", c), ("None", d), ("None", rows[10][1])])


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "Counts int, _counts int")
    assert fresh(df, "counts") == "__counts"
