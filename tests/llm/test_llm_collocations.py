"""Collocations against counting every run of words."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablelore.llm import collocations
from tablelore.llm.collocations import Settings

SCHEMA = "lang string, text string"


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def runs_of(rows, most):
    counts = {}
    for lang, text in rows:
        f = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            for size in range(1, most + 1):
                f.update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    return counts


def by_hand(rows, least, top=2000):
    out = []
    for lang, f in runs_of(rows, 4).items():
        n = sum(c for run, c in f.items() if len(run) == 1)
        candidates = [run for run, c in f.items() if len(run) > 1 and c >= least]
        inside = Counter()
        for run in candidates:
            for size in range(2, len(run)):
                for i in range(len(run) - size + 1):
                    part = run[i:i + size]
                    inside[part] = max(inside[part], f[run])
        found = []
        for run in candidates:
            if 100 * inside[run] >= 80 * f[run]:
                continue
            score, _, left, right = min(
                (2_000_000 * f[run] // (f[run[:k]] + f[run[k:]]), k, f[run[:k]], f[run[k:]])
                for k in range(1, len(run)))
            found.append((-score, -f[run], " ".join(run).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def found(spark, rows, settings):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("words", F.lit(1)).repartition(3)
    got = collocations.collocations(docs, settings)
    return sorted(tuple(r) for r in got.select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_against_counting(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b", "B", "cc", "É", "é", "x-y", " ", "d"]
    marks = [" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]
    rows = [(rng.choice(["en", None, "und", "de"]),
             "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(60))))
            for _ in range(120)]
    rows += [("en", "the quick brown fox jumps over the lazy dog again and again")] * 20
    rows += [(None, None), ("en", ""), ("en", " \t"), ("fr", "...")]
    assert found(spark, rows, Settings(least=6)) == by_hand(rows, 6)


def test_a_filter_that_keeps_everything_changes_nothing(spark):
    rng = random.Random(3)
    rows = [("en", " ".join(rng.choice("abcdefgh") for _ in range(40))) for _ in range(60)]
    want = by_hand(rows, 5)
    assert found(spark, rows, Settings(least=5)) == want
    assert found(spark, rows, Settings(least=5, filter_bits=6)) == want


def test_chains_become_paths(spark):
    """A passage is one path where nothing branches, and breaks where one of its words does."""
    rows = [("en", "one two three four five six seven eight")] * 5 + [
        ("en", "zero two three four five nine")] * 5
    docs = spark.createDataFrame(rows, SCHEMA)
    paths = {(r.words, r.f) for r in collocations.graph(docs, Settings(least=2)).paths.collect()}
    assert paths == {("one two three four", 5), ("zero two three four", 5),
                     ("two three four five", 10), ("three four five six seven eight", 5),
                     ("three four five nine", 5)}


def test_long_chains_and_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = spark.createDataFrame([("en", long)] * 3, SCHEMA)
    paths = [r.words.split() for r in
             collocations.graph(docs, Settings(least=3)).paths.collect()]
    assert sum(len(p) - 3 for p in paths) == 30_000 - 3
    assert len(paths) == 30 and max(map(len, paths)) == 1003


def test_counts_beyond_64_bits(spark):
    got = found(spark, [("en", "x y. " * 50)], Settings(least=30, scale=10 ** 18))
    assert got == [("en", 1, "x y", 50, 50, 50, 100, 10 ** 18 // 2)]


def test_nothing(spark):
    assert found(spark, [], Settings()) == []
    assert found(spark, [("en", None)], Settings()) == []


def test_ranks_are_cut(spark):
    rng = random.Random(5)
    rows = [("en", " ".join(rng.choice("abcdefghij") for _ in range(50))) for _ in range(80)]
    assert found(spark, rows, Settings(least=3, top=7)) == by_hand(rows, 3, 7)
