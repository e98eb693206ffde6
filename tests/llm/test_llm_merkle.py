"""Merkle manifests against a tree built leaf by leaf."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tablelore.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    if value is None:
        return "-"
    return f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row
    return sha("".join(map(field, (doc_id, source, lang, n_chars, text))))


def climb(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([sha("".join(level[i:i + 8])) for i in range(0, len(level), 8)])
    return levels


def fold(levels, place, node):
    """The siblings on the way up, and the top that another node leads to."""
    proof = ""
    for level in levels[:-1]:
        begin = place - place % 8
        run = level[begin:begin + 8]
        proof += "".join(run[:place - begin] + run[place - begin + 1:])
        run[place - begin] = node
        node, place = sha("".join(run)), place // 8
    return proof, node


def lower(text):
    return text if text is None else "".join(c.lower() if c.isascii() else c for c in text)


def by_hand(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {}
    for name in names:
        ordered = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0,
                                                      leaf_of(r, r[1])))
        trees[name] = ordered, climb([leaf_of(r, r[1]) for r in ordered])
    upper = climb([trees[n][1][-1][0] for n in names])
    root, out = upper[-1][0], []
    for n, name in enumerate(names):
        ordered, levels = trees[name]
        for i, row in enumerate(ordered):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            new = leaf_of(row, lower(row[1])) if changed else levels[0][i]
            proof, sub = fold(levels, i, new)
            more, top = fold(upper, n, sub)
            out.append((row[0], levels[0][i], levels[-1][0], root, sha(proof + more), top,
                        top == root))
    return sorted(out, key=repr)


def run(spark, rows, extra=""):
    docs = spark.createDataFrame(rows, SCHEMA)
    if extra:
        docs = docs.withColumn(extra, F.lit(1))
    found = merkle.manifest(
        docs, changed=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0,
        tampered={"text": merkle.ascii_lower(F.col("text"))})
    return found


def rows_of(found):
    return sorted(((None if r["key"] is None else int(r["key"]), r.leaf, r.subroot, r.root,
                    r.proof_sha256, r.folded_root, r.verified) for r in found.collect()),
                  key=repr)


@pytest.mark.parametrize("counts", [
    {"en": 1}, {"en": 8, None: 9}, {"a": 513, "b": 65, "ä": 1, "": 2},
    {f"l{i}": 1 + i % 3 for i in range(19)}])
def test_tree_by_hand(spark, counts):
    rows, n = [], 0
    for lang, count in counts.items():
        for _ in range(count):
            rows.append((n * 7 % 4099, f"Über TEXT {n}" if n % 5 else None, lang,
                         f"s{n % 3}" if n % 4 else None, n))
            n += 1
    assert rows_of(run(spark, rows)) == by_hand(rows)


def test_two_levels_of_blocks(spark):
    rows = [(i, f"Text {i}", "en", "s", 1) for i in range(512 * 9 + 3)] + [(-1, "x", "de", "s", 1)]
    assert rows_of(run(spark, rows)) == by_hand(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "", "en", "", None),
            (None, "B", "en", "", None), (3, "A" * 300_000, "en", "s", 5)]
    rows += [(3, "same", "en", "s", 5)] * 20
    assert rows_of(run(spark, rows, extra="key")) == by_hand(rows)
    assert run(spark, []).collect() == []


def test_repeated_null_keys_are_spread(spark, monkeypatch):
    """A third of all rows alike: places are gapless, and each range numbers its own."""
    docs = spark.range(3_000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("t").alias("text"),
        F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    placed = merkle._numbered(docs.select(
        F.col("lang").alias("group"), F.col("doc_id").alias("sort")), "group", ["sort"])
    assert [r.pos for r in placed.orderBy("pos").collect()] == list(range(3_000))
    assert placed.where("sort is null").agg(F.max("pos")).first()[0] == 999


def test_versions_share_all_but_their_path(spark):
    rows = [(i, f"Text {i}", "en" if i % 2 else "de", "s", 1) for i in range(1_400)]
    found = run(spark, rows).collect()
    for r in found:
        if r.copies is not None:
            assert r.copies[-1] == r.folded_root and not r.verified
            assert len(r.copies) == 1 + 4 + 1  # a leaf, four levels of 700, one of two groups
        else:
            assert r.folded_root == r.root and r.verified
