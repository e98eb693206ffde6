"""Url rules and shards against brute force, and on awkward rows."""

import re
from collections import Counter

import pytest

from tablelore.llm import shards, url_filter

URLS = [
    "https://Example.ORG/es/1?x=/en/1", "http://a.b.example.org/en/12#t", "http://example.org",
    "http://notexample.org/en/1", "x://com/de/", "http://m.com/fr", "http://m.com/fr/?q",
    "ftp://a.com:80/de/x", "no scheme /de/", "", None, "http://", "http:///es/", "a://b://c.org/x",
    "http://example.org./es/", "http://é.example.org/es/ü", "http://m.com/de/" + "x" * 5000,
]
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.fullmatch(r"(?s)([^/?#]*)([^?#]*).*", url.split("://", 1)[1]).groups()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def expected(url, rules, default):
    host, path = parts(url)
    fits = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


def judged(spark, urls, rules, **options):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)],
                               "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame(rules, "host string, path string, action string")
    rows = url_filter.judge_urls(df, rules, **options).collect()
    assert len(rows) == len(urls)
    return {r.page_id: tuple(r)[1:] for r in rows}


def test_verdicts(spark):
    got = judged(spark, URLS + URLS, RULES)
    assert got == {i: expected(u, RULES, "allow") for i, u in enumerate(URLS + URLS)}


def test_ties_nulls_and_repeated_rules(spark):
    rules = [("a.org", "/x", "allow"), ("a.org", "/x", "block"), ("a.org", "/x", "block"),
             (None, "/", "block"), ("a.org", None, "block"), ("a.org", "/", None), ("org", "", "allow")]
    got = judged(spark, ["http://a.org/x", "http://b.org", "http://q.net"], rules, default="block")
    assert [got[i][2:] for i in range(3)] == [("a.org/x", "block"), ("org", "allow"), (None, "block")]


def test_short_prefixes_are_confirmed(spark):
    urls = [f"http://h{i}.org/p{i}" for i in range(300)]
    rules = [(f"h{i}.org", f"/p{i}", "block") for i in range(0, 300, 2)]
    got = judged(spark, urls, rules, prefix_digits=1)
    assert all(got[i][3] == ("block" if i % 2 == 0 else "allow") for i in range(300))


def test_empty_tables(spark):
    assert judged(spark, [], RULES) == {}
    assert judged(spark, ["http://a.org"], [])[0][2:] == (None, "allow")


def test_a_hot_url_is_split(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        ids = spark.range(0, 60_000, numPartitions=16)
        urls = ids.selectExpr("xxhash64(id) as page_id", "case when id % 3 > 0 then "
                              "concat('http://h', id % 5000, '.org/en/', id) end as url")
        rules = spark.createDataFrame(RULES, "host string, path string, action string")
        judged = url_filter.judge_urls(urls, rules)
        assert len(judged.collect()) == 60_000
        assert "skew=true" in judged._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("rows", [0, 1, 5, 16, 1000, 1003])
def test_plan_balances_and_keeps_all(rows):
    ring = shards.Ring(16, cells=64)
    counts = Counter((i * 7919) % 9 for i in range(rows))
    where = shards.plan(ring, counts)
    loads, slots, seen = Counter(), {}, Counter()
    for cell, low, high, shard, slot in zip(*where.values(), strict=True):
        loads[shard] += high - low
        slots.setdefault(shard, []).extend(range(slot, slot + high - low))
        seen[cell] += high - low
    assert seen == +counts
    full = [loads[s] for s in range(16)]
    assert max(full) - min(full) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_overflow_goes_clockwise_and_little_moves():
    counts = {c: 1 for c in range(0, 4096, 2)}

    def owner(shard_count):
        ring = shards.Ring(shard_count, cells=4096, slack=0.25)
        where = shards.plan(ring, counts)
        return dict(zip(where["cell"].tolist(), where["shard"].tolist(), strict=True))

    before, after = owner(16), owner(17)
    assert sum(before[c] != after[c] for c in counts) < 0.2 * len(counts)
    ring = shards.Ring(2, nodes_per_shard=2, cells=100)
    nodes = ring.nodes()
    where = shards.plan(ring, {nodes[0][0]: 10})
    assert where["shard"].tolist() == [nodes[0][1], 1 - nodes[0][1]]
    assert (where["high"] - where["low"]).tolist() == [5, 5]


def test_shards_of_documents(spark):
    import zlib

    rows = [(i, t, 9) for i, t in enumerate(["a", "é" * 3000, "", None, "same", "same"] * 20)]
    rows += [(7, "same", 9)] * 60 + [(None, "n", 9)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = shards.assign_shards(df, shards.Ring(4)).collect()
    key = lambda d, t: (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        key(d, t) for d, t, _ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(v) for v in slots.values()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    again = shards.assign_shards(df.repartition(7), shards.Ring(4)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert shards.assign_shards(df.limit(0), shards.Ring(4)).count() == 0


def test_hot_keys_and_copies(spark, monkeypatch):
    monkeypatch.setattr(shards, "_STEP", 7)
    ids = spark.range(9_000)
    df = ids.selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 5 else id end as doc_id",
                        "case when id < 4000 then 'same' else concat('t', id) end as text")
    ring = shards.Ring(8)
    groups = shards._counted(df, ring, "doc_id", "text").groupBy("at", "part").count()
    assert max(r["count"] for r in groups.collect()) < 9_000 // 60
    got = shards.assign_shards(df, ring).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in df.collect())
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert [len(slots[s]) for s in range(8)] == [1125] * 8


def test_very_long_texts(spark):
    df = spark.createDataFrame([(1, "é" * 2_000_000), (2, "a")], "doc_id long, text string")
    got = {r.doc_id: r["size"] for r in shards.assign_shards(df, shards.Ring(2)).collect()}
    assert got == {1: 4_000_001, 2: 2}


def test_the_ring_walked_row_by_row(spark):
    """Every arc offers its rows to its node's shard, then all go on one node at a time."""
    ring = shards.Ring(3, nodes_per_shard=4, cells=97)
    df = spark.createDataFrame([(i % 40, f"t{i}") for i in range(200)], "doc_id long, text string")
    rows = sorted((r.at, r.part, r.hash, r.key, r["size"], r.text_crc32) for r in shards._counted(
        df, ring, "doc_id", "text").selectExpr("*", "xxhash64(key) as hash").collect())
    nodes = ring.nodes()
    room = dict(enumerate(ring.capacities(200)))
    arc = [next((i for i, (cell, _) in enumerate(nodes) if cell >= r[0]), 0) for r in rows]
    placed, step = {}, 0
    while len(placed) < 200:
        for a in range(len(nodes)):
            shard = nodes[(a + step) % len(nodes)][1]
            for i, r in enumerate(rows):
                if arc[i] == a and i not in placed and room[shard]:
                    placed[i] = shard
                    room[shard] -= 1
        step += 1
    got = {(r.doc_id, r.text_crc32): r.shard for r in shards.assign_shards(df, ring).collect()}
    assert got == {(rows[i][3], rows[i][5]): s for i, s in placed.items()}
