"""Personal data: base spans against plain patterns, and what the method adds."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelore.llm import personal

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def by_hand(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {"email": True, "ip": kind == "ip" and all(
                        int(p) <= 255 for p in m.group().split(".")),
                    "card": 13 <= len(digits) <= 19 and luhn(digits),
                    "phone": 9 <= len(digits) <= 15}[kind]
            if fits:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


CARDS = ["4539578763621486", "4716 2210 5188 5662", "4024-0071-0902-2143"]
PEOPLE = [(1, "Call +1 (826) 555-4081 190.137.223.204 now."),
          (2, f"a {CARDS[0]} 4485275742308327 b"),
          (3, "numbers 9807915762804490 9807915762804491 here"),
          (4, "write to jane.doe [at] example [dot] org please"),
          (5, "Dear Mr. Halloran, Maria Keller and Thstorti Anin agreed."),
          (6, "ssn: 123-45-6789, phone (212) 555-0187."),
          (7, "nothing of the kind, 12 of 30, version 1.2.3 of 2024-01-02")]


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(1)
    common = [f"mail x{i}@mail{i}.example.com, call +1 ({i:03}) 555-{i:04}, from 10.0.{i}.7, "
              f"card {CARDS[i % 3]}" for i in range(60)]
    common += ["order " + "".join(rng.choice("0123456789") for _ in range(16))
               for _ in range(60)]
    rows = PEOPLE + [(100 + i, t) for i, t in enumerate(common)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def model(documents):
    return personal.learn(documents)


def added(found, rows):
    texts = dict(rows)
    out = {}
    for r in found.collect():
        base = by_hand(texts[r.doc_id])
        for span in filter(None, r.spans.split(",")):
            if span not in base:
                kind, start, end = span.split(":")
                out.setdefault(r.doc_id, []).append((kind, texts[r.doc_id][int(start):int(end)]))
        assert set(base) <= set(r.spans.split(","))
    return out


def test_what_the_method_adds(documents, model):
    got = added(personal.report(documents.where("doc_id < 100"), model), PEOPLE)
    assert got == {
        1: [("phone", "+1 (826) 555-4081")],
        2: [("card", CARDS[0]), ("card", "4485275742308327")],
        4: [("email", "jane.doe [at] example [dot] org")],
        5: [("name", "Mr. Halloran"), ("name", "Maria Keller")],
        6: [("phone", "(212) 555-0187"), ("id", "123-45-6789")],
    }


def test_check_digits_are_found_reliable(model):
    assert model.reliability["check"] > 0.9 > 0.6 > model.reliability["edges"]
    assert model.weights["check", 1] > 0.5 > -0.5 > model.weights["check", -1]


def test_estimation_finds_the_reliable_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    right = [0.95, 0.9, 0.55, 0.6, 0.85, 0.7, 0.5]
    ballots = np.stack([np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1
                        for p in right], axis=1)
    chance, table = personal.estimate(ballots, np.zeros(4000, int), np.ones(4000))
    assert ((chance > 0.5) == truth).mean() > 0.95
    assert np.abs(table[1, :, 2] - right).max() < 0.06


@pytest.mark.parametrize("seed", range(3))
def test_base_spans_by_hand(spark, model, seed):
    rng = random.Random(seed)
    parts = ["a@b.c", "@", ".", "_x", "1.2.3.4", "256.1.1.1", "0001.2.03.4", ".9", "+1", "+", " ",
             " (", ") ", "-", "555", "0187", "4539578763621486", "4716 2210 5188 5662", "é", "😀",
             "x", "--", "co.uk", "%", "1", "22", "  ", "\n", "a.b@c-d.e.f.g", "+12 345 678 901 2"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))))
            for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "a@b.c"), (5, "a@b.c"), (5, "a@b.c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)
                  for r in personal.report(docs, model).collect()), key=repr)
    want = []
    for key, text in rows:
        base = by_hand(text)
        want.append((key, *(sum(s.startswith(k) for s in base) for k in PLAIN),
                     hashlib.sha256(",".join(base).encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_very_long_texts(spark, model):
    texts = ["a" * 400_000, "1" * 200_000, "1 " * 200_000, "1." * 200_000, "a@b" + ".c" * 200_000,
             "+1" + " " * 200_000, "x@y.z 1.2.3.4 " * 20_000, "(" * 100_000 + "at)" * 50_000,
             "Mr. " * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_email, r.n_ip) for r in personal.report(docs, model).collect()}
    assert got[4] == (1, 0) and got[6] == (20_000, 20_000) and got[3][1] == 50_000


def test_other_columns_and_empty_tables(spark, model):
    docs = spark.createDataFrame([("a@b.c", 1, "k", 2)], "text string, base int, row string, "
                                 "email int")
    found = personal.find_spans(docs, model)
    assert found.columns == ["text", "row", "email", "base", "spans"]
    assert [s.match for s in found.first().spans] == ["a@b.c"]
    assert personal.find_spans(docs.limit(0), model).collect() == []
    nothing = personal.learn(docs.limit(0))
    assert personal.report(docs.withColumn("doc_id", F.lit(1)), nothing).first().n_email == 1


def test_no_python_in_the_plan(documents, model):
    plan = personal.report(documents, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
