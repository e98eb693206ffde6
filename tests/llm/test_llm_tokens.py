"""Token counts and packing against the tokenizer itself and a plain greedy search."""

import ctypes
import gc
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tablelore.llm import packing, token_counts, tokens
from tablelore.llm.queries import tokenizer_file

TEXTS = [None, "", " \n", "a", "Hello, world. It's 12 o'clock...", "H̱ello ẖ é é ΣΑΣ", "x" * 9000,
         "<|endoftext|> a<|startoftext|>b", "«. a» . , A. B, c.d", "ÿŸ×÷ a×b 你好。", "a b\x1cc\x85d",
         "one two three. " * 3000, "İstanbul ß ẞ µ", "!!! ... ,,a.,b"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY_WORDS", 5)
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as file:
        words = tokens.WordIds(file.read())
    for text in TEXTS * 2:
        assert words.of(text or "") == np.array(ids_of(tokenizer, text), dtype="<u4").tobytes()


def resident_mb():
    gc.collect()
    ctypes.CDLL(None).malloc_trim(0)
    with open("/proc/self/statm", encoding="ascii") as file:
        return int(file.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2 ** 20


def test_tasks_leave_no_tokenizer_behind_in_their_worker():
    rnd = random.Random(3)
    text = " ".join("".join(rnd.choices("aeinorst", k=rnd.randint(8, 14))) for _ in range(20_000))
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as file:
        tokenizer_json = file.read()

    def task():
        return tokens.WordIds(tokenizer_json).of(text)

    first, begin = task(), resident_mb()
    for _ in range(12):
        assert task() == first
    assert resident_mb() - begin < 15


def greedy(word, vocabulary):
    longest, count = max(map(len, vocabulary)), 0
    while word:
        size = next((k for k in range(min(longest, len(word)), 0, -1) if word[:k] in vocabulary), 0)
        if not size:
            return 0
        word, count = word[size:], count + 1
    return count


def test_pieces_against_greedy_search():
    rnd = random.Random(2)
    for _ in range(60):
        vocabulary = {bytes(rnd.choices(b"abc", k=rnd.randint(1, 5))) for _ in range(rnd.randint(1, 14))}
        pieces = tokens.WordPieces(vocabulary)
        for _ in range(60):
            word = bytes(rnd.choices(b"abcd"[:rnd.randint(3, 4)], k=rnd.randint(0, 12)))
            assert pieces.count(word) == greedy(word, vocabulary), (vocabulary, word)


def test_counts_of_documents(spark):
    vocabulary = set(token_counts.read_vocabulary(tokenizer_file("byte_bpe_50k.tiktoken")))
    df = spark.createDataFrame([(i % 9, t, 1) for i, t in enumerate(TEXTS)],
                               "doc_id long, text string, n_words int")
    got = token_counts.count_tokens(df, tokenizer_file("byte_bpe_50k.tiktoken")).collect()
    for row, text in zip(got, TEXTS, strict=True):
        counts = [greedy(b" " + w, vocabulary) for w in (text or "").encode().split()]
        assert tuple(row)[1:] == (len(counts), sum(counts), 0, max(counts, default=0))
    assert token_counts.count_tokens(df.limit(0), tokenizer_file("byte_bpe_50k.tiktoken")).count() == 0


def fill(rows):
    """Pieces of each sequence of a plan, and the places they take."""
    out = {}
    for length, low, high, first, each, offset in rows:
        for rank in range(low, high):
            nth = rank - low
            out.setdefault(first + nth // each, []).append((offset + nth % each * length, length))
    return out


@pytest.mark.parametrize("capacity", [
    packing.Capacity(64), packing.Capacity(64, documents=3),
    packing.Capacity(64, attention=1800, documents=5, weights=(1, 1, 1)),
    packing.Capacity(64, choose="product", weights=(1, 0.5, 0.5), attention=4096)])
def test_plans_keep_every_capacity(capacity):
    rnd = random.Random(4)
    lengths = [min(42, 1 + int(rnd.expovariate(0.1))) for _ in range(500)]
    sequences = fill(packing.plan(Counter(lengths), capacity))
    assert Counter(n for s in sequences.values() for _, n in s) == Counter(lengths)
    whole = capacity.vector()
    for places in sequences.values():
        need = sum(capacity.needs(n) for _, n in places)
        assert (need <= whole).all()
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n


def test_best_fit_is_near_the_bound():
    rnd = random.Random(5)
    lengths = [rnd.randint(1, 3000) for _ in range(2000)]
    used = len(fill(packing.plan(Counter(lengths), packing.Capacity())))
    assert used <= -(-sum(lengths) // 4096) * 1.02 + 1
    assert packing.plan({}, packing.Capacity()) == []
    with pytest.raises(ValueError):
        packing.plan({10: 1}, packing.Capacity(100, attention=50))


def test_packed_documents_give_back_all_ids(spark, tokenizer):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, "a", 1)] * 40 + [(None, "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    path = tokenizer_file("word_bpe_49k.json")
    got = packing.pack(df, path).collect()
    want = Counter()
    for doc, text, _ in rows:
        ids = np.array([*ids_of(tokenizer, text), 1], dtype="<u4")
        for n, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start:start + 4096]
            want[doc, n, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    ends = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096 and len(ends) == -(-sum(ends.values()) // 4096)
    assert packing.pack(df.limit(0), path).count() == 0
