"""Decontamination and similarity links against brute force, and on awkward rows."""

import random
import time

import numpy as np
import pytest

from tablelore.llm import decontaminate, jaccard
from tablelore.llm.components import components


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_bit_parallel_distance():
    rnd = random.Random(1)
    for _ in range(150):
        p = "".join(rnd.choices("ab", k=rnd.randint(1, 9)))
        t = "".join(rnd.choices("abc", k=rnd.randint(0, 12)))
        masks = decontaminate.edit_masks(p)
        best = min(distance(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        assert decontaminate.nearest(masks, len(p), t)[0] == best
        assert decontaminate.nearest(masks, len(p), t, True)[0] == min(
            distance(p, t[:j]) for j in range(len(t) + 1))


def words(rnd, n):
    return " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(n))


def edited(rnd, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rnd.randrange(len(chars))
        kind = rnd.random()
        if kind < 0.4:
            chars[at] = rnd.choice("xyz")
        elif kind < 0.7:
            chars.insert(at, rnd.choice("xyz"))
        else:
            del chars[at]
    return "".join(chars)


def test_items_within_the_budget_are_found(spark):
    rnd = random.Random(8)
    items = [(i, words(rnd, rnd.randint(8, 40))) for i in range(12)]
    settings = decontaminate.Settings(items_per_block=5)
    rows, want = [], set()
    for doc in range(120):
        item, text = items[doc % 12]
        size = len(decontaminate.normal(text))
        edits = rnd.choice([0, 1, settings.budget(size), 3 * settings.budget(size) + 4])
        inside = edited(rnd, text, edits)
        rows.append((doc, f"{words(rnd, 30)}, {inside.upper()}!\n{words(rnd, 30)}", 0))
    rows += [(900, None, 0), (901, "", 0), (None, items[0][1], 0), (902, items[1][1], 0),
             (902, items[1][1], 0), (903, words(rnd, 40_000) + " " + items[2][1], 0)]
    for doc, text, _ in rows:
        plain = decontaminate.normal(text or "")
        for item, pattern in items:
            pattern = decontaminate.normal(pattern)
            masks = decontaminate.edit_masks(pattern)
            d, _ = decontaminate.nearest(masks, len(pattern), plain)
            if plain and d <= settings.budget(len(pattern)):
                want.add((doc, item, d))
    docs = spark.createDataFrame(rows, "doc_id long, text string, distance int")
    bench = spark.createDataFrame([*items, items[0], (77, None), (None, "x" * 90), (78, "too short")],
                                  "item_id long, text string")
    got = decontaminate.find_items(docs, bench, settings).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want
    assert len(got) == len(want) + 1 and len(want) > 60
    texts = {d: t for d, t, _ in rows}
    for r in got:
        if r.distance == 0:
            assert decontaminate.normal(texts[r.doc_id][r.begin:r.end]) == decontaminate.normal(
                dict(items)[r.item_id])
    clean = decontaminate.drop_contaminated(docs, bench, settings)
    assert clean.columns == docs.columns
    leaked = {d for d, _, _ in want}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _, _ in rows if d not in leaked)
    assert decontaminate.find_items(docs.limit(0), bench).count() == 0
    assert decontaminate.find_items(docs, bench.limit(0)).columns == [
        "doc_id", "item_id", "distance", "budget", "begin", "end"]
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(rows)


def brute_components(rows, settings):
    def shingles(text):
        w = jaccard.words_of(text)
        n = settings.words
        if len(w) < n:
            return {tuple(w)} if w else set()
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}

    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            shared = len(x & sets[j])
            if x and sets[j] and 100 * shared >= settings.share * (len(x) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    out = {}
    for i, (doc, _, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out[i] = (doc, len(sets[i]), doc if not sets[i] else min(same, default=None))
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("settings", [jaccard.Settings(words=3, share=90), jaccard.Settings(),
                                      jaccard.Settings(words=2, share=60)])
def test_links_against_all_pairs(spark, settings):
    rnd = random.Random(settings.share)
    rows, doc = [], 1000
    passage = words(rnd, 30)
    for size in (1, 2, 4, 8, 12, 20, 35, 60, 120, 300):
        base = words(rnd, size).split()
        for copy in range(9):
            now = list(base)
            for _ in range(rnd.randint(0, max(1, size // 15)) if copy else 0):
                now[rnd.randrange(len(now))] = words(rnd, 1)
            if copy == 8:
                now = now[:-max(1, size // 12)]
            rows.append((doc, " ".join(now).title() if copy == 3 else " ".join(now), 5))
            doc -= 1
        rows.append((doc, passage + " " + words(rnd, 12), 5))
        doc -= 1
    chain = words(rnd, 150).split()
    for step in range(12):  # each like the next, the ends unlike
        chain = list(chain)
        chain[step * 12] = words(rnd, 1)
        rows.append((doc, " ".join(chain), 5))
        doc -= 1
    rows += [(2, None, 5), (3, "", 5), (4, " \n", 5), (None, rows[0][1], 5), (None, "only null", 5),
             (rows[5][0], rows[5][1], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int").repartition(5)
    got = jaccard.link_components(df, settings).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, settings)


def test_links_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.link_components(df).collect() == []


def test_bands_never_lose_a_partner():
    for settings in (jaccard.Settings(), jaccard.Settings(words=3, share=90)):
        for a in (*range(1, 130), 500, 1999):
            for b in (a, a * 100 // settings.share):
                shared = set(jaccard.bands_of(a, settings)) & set(jaccard.bands_of(b, settings))
                most = settings.differences(a, b)
                assert any(x.deletions and 2 * x.segments > most or not x.deletions
                           and x.segments > most and x.differences >= most for x in shared)


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(260)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    df = spark.createDataFrame([*edges, (None, 3), (7, None)], "a long, b long")
    rows = components(df).collect()
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)
    assert components(df.limit(0)).count() == 0


def test_short_items_are_whole_words_without_edits():
    finder = decontaminate.ItemFinder(
        [(1, "What is 17 times 23?"), (2, "cat"), (3, "?!"), (4, "")], decontaminate.Settings())

    def found(text):
        return [(m.item, m.distance) for m in finder.matches(text)]

    assert found("So: what is 17 times 23? A bobcat.") == [(1, 0)]
    assert found("The cat") == found("CAT") == found("cats, cat!") == [(2, 0)]
    assert found("what is 17 times 234") == found("what is 17 times 2 3") == found("") == []


def test_items_that_begin_alike():
    """Hits of a shared beginning cost little, and items are told apart behind it."""
    rng = random.Random(2)
    stem = "Which of the following statements about "
    items = [(i, stem + " ".join("".join(rng.choice("abcdefgh") for _ in range(6))
                                 for _ in range(10))) for i in range(2_000)]
    finder = decontaminate.ItemFinder(items, decontaminate.Settings())
    clean = " ".join(stem + "x" * 60 for _ in range(5))
    begun = time.process_time()
    assert finder.matches(clean) == []
    assert time.process_time() - begun < 1
    changed = items[17][1].replace("b", "z", 3)
    assert [(m.item, m.distance) for m in finder.matches(f"{clean} {changed} {clean}")] == [(17, 3)]


@pytest.mark.parametrize("differ", [0, 30, 400, 3_000])
def test_wide_bits_bound_the_difference(differ):
    rng = np.random.default_rng(differ)
    one = np.unique(rng.integers(0, 2**64, 4_000, dtype=np.uint64))
    two = np.unique(np.concatenate(
        [one[differ:], rng.integers(0, 2**64, differ + 200, dtype=np.uint64)]))

    def bits(hashes, size):
        return np.unpackbits(jaccard.parity_bits(hashes, size).view(np.uint8))

    true = len(set(one.tolist()) ^ set(two.tolist()))
    wide = [jaccard.wide_bits(x) for x in (one, two)]
    assert len(wide[0]) == 4_096 // 64 and jaccard.wide_bits(one[:1_024]) is None
    for size in (1_024, 4_096, 8_192):
        assert (bits(one, size) != bits(two, size)).sum() <= true
    # half as many bits are the halves, one xor the other
    whole = jaccard.parity_bits(one, 8_192)
    assert (whole[:64] ^ whole[64:] == jaccard.parity_bits(one, 4_096)).all()
    apart = (bits(one, 4_096) != bits(two, 4_096)).sum()
    bound = jaccard.Settings().differences(len(one), len(two))
    assert (apart > bound) == (differ >= 3_000)


def test_large_sets_of_unlike_sizes(spark):
    """Pairs on both sides of a power of two, with the bits of one folded."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2_300)]
    rows = [(1, " ".join(words[:2_000])), (2, " ".join(words[:2_200])),
            (3, " ".join(words[:1_000] + words[1_300:])), (4, " ".join(words[1_200:])),
            (5, " ".join(words[:1_010])), (6, " ".join(words[:1_100]))]
    got = {r.doc_id: r.component_id for r in jaccard.link_components(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
