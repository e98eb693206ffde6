"""Language, quality score and quality rules: brute force, accuracy and awkward rows."""

import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from tablelore.llm import compress_quality, language, quality_rules

SYLLABLES = {"en": "th er on an re he in ed nd ha at".split(),
             "fr": "eau que ère ou le tre ment ê oi".split(),
             "de": "sch ung ein ä ge cht ver pf ß".split()}


def prose(lang, words, rnd):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 4)))
                    for _ in range(words))


def phrase_ends(text, model, block):
    """Ends of phrases within blocks, by looking for each stretch in the labelled text."""
    total = 0
    for start in range(0, len(text), block):
        phrase = b""
        for i in range(start, min(start + block, len(text))):
            byte = text[i:i + 1]
            if phrase + byte in model:
                phrase += byte
            else:
                total += 1
                phrase = byte if byte in model else b""
    return total


def test_phrases_against_substring_search():
    rnd = random.Random(3)
    texts = tuple((lang, language.plain(prose(lang, 60, rnd))) for lang in sorted(SYLLABLES))
    parser = language.CrossParser(texts, 64)
    samples = [language.plain(prose(lang, n, rnd)) for lang in SYLLABLES for n in (1, 7, 90)]
    samples += [b"zzz", b"", "日本".encode(), texts[0][1]]
    got = parser.phrases(samples)
    for row, sample in zip(got, samples, strict=True):
        for count, (_, model) in zip(row, texts, strict=True):
            assert count == phrase_ends(sample, model, 64) + 1


def corpus(spark, n=240):
    rnd = random.Random(5)
    langs = sorted(SYLLABLES)
    return spark.createDataFrame([(i, prose(langs[i % 3], rnd.randint(4, 80), rnd), langs[i % 3], "s")
                                  for i in range(n)], "doc_id long, text string, lang string, score string")


def test_language_of_held_out_documents(spark):
    df = corpus(spark)
    model = language.learn(df.where("doc_id % 2 = 0"))
    got = language.identify(df.where("doc_id % 2 = 1"), model).collect()
    assert len(got) == 120 and sum(r.lang == r.lang_pred for r in got) >= 118
    assert all(0.5 <= r.score <= 1 for r in got) and got[0].__fields__.count("score") == 1


def test_language_of_awkward_rows(spark):
    rows = [(1, None, "en"), (1, "", "en"), (None, "12 ,.!", None), (2, "the " * 50_000, None),
            (2, "the " * 50_000, None), (3, "日本語", None), (4, "THE HERED!!", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(corpus(spark))
    got = language.identify(df, model).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and got[0].score == 0
    assert got[3].lang_pred == got[4].lang_pred == got[6].lang_pred == "en"
    assert got[5].lang_pred in SYLLABLES
    kept = language.keep_identified(df, model)
    assert kept.columns == df.columns and kept.count() == 4
    nothing = language.learn(df.where("lang = 'xx'"))
    assert {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}
    assert language.identify(df.limit(0), model).count() == 0


def labelled(spark, n=400):
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        good = i % 4 != 0
        words = prose("en", rnd.randint(20, 120), rnd).split()
        if not good:
            words = [w + rnd.choice(["%%%", "***", "###"]) for w in words]
        rows.append((i, " ".join(words), int(good), 0))
    docs = spark.createDataFrame([r[:2] + ("x",) for r in rows], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows],
                                   "doc_id long, quality int, toxic int")
    return docs, labels


AWKWARD = [(1, None, "x"), (1, "", "x"), (None, "a b", "x"), (2, "wörd " * 30_000, "x"),
           (2, "wörd " * 30_000, "x"), (3, " \t\n", "x")]


def test_quality_score(spark):
    docs, labels = labelled(spark)
    model = compress_quality.learn(docs, labels.where("doc_id % 3 != 0"))
    got = compress_quality.score_quality(docs, model).join(labels, "doc_id").toPandas()
    held = got[got.doc_id % 3 == 0]
    assert (held.predicted == held.quality).mean() >= 0.95
    assert held.score.between(0, 1).all() and ((held.score >= 0.3) == held.predicted).all()
    odd = spark.createDataFrame(AWKWARD, docs.schema)
    rows = compress_quality.score_quality(odd, model).collect()
    assert len(rows) == 6 and rows[0].score == rows[1].score and rows[3] == rows[4]
    assert compress_quality.score_quality(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("only,score", [("quality = 1", 1.0), ("quality > 1", 0.5)])
def test_quality_score_without_two_labels(spark, only, score):
    docs, labels = labelled(spark, 40)
    model = compress_quality.learn(docs, labels.where(only))
    row = compress_quality.score_quality(docs, model).first()
    assert row.score == pytest.approx(score, abs=0.05)


def test_compressed_difference_is_of_the_whole_text():
    settings = compress_quality.Settings(block=64)
    model = compress_quality.CompressionModel(b"good words here " * 20, b"%%% ### *** " * 20, settings)
    assert model.measure("") == model.measure(None) == (0.0, 1.0)
    start = "neutral text " * 50
    assert model.measure(start + "%%% ### ***" * 50)[0] < model.measure(start + "good words" * 50)[0]


def counts_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i:i + 5]), []).append(i)
    repeated = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)),
            "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated),
            "n_lines": len(lines), "n_same_words": sum(a == b for a, b in zip(words, words[1:]))}


def test_counts_by_hand():
    rnd = random.Random(11)
    texts = [None, "", " ", "a", "x\x85y \xa0z\x1c a", "a\n\na\n \n a", "é É ñ # | <>", "w " * 40]
    texts += [" ".join(rnd.choices("abcd", k=rnd.randint(0, 60))).replace("b ", "b\n") for _ in range(200)]
    got = quality_rules.count_texts(texts)
    for i, text in enumerate(texts):
        for name, value in counts_by_hand(text).items():
            assert got[name][i] == value, (name, text)


def test_rules_find_a_planted_conjunction():
    rnd = np.random.default_rng(1)
    features = pd.DataFrame({f: rnd.random(3000) for f in quality_rules.FEATURES})
    bad = ((features.symbol_share > 0.6) & (features.upper_share < 0.5)).to_numpy()
    rules = quality_rules.cover(features, bad, np.ones(3000))
    hit = np.zeros(3000, dtype=bool)
    for rule in rules.rules:
        hit |= np.logical_and.reduce([c.holds(features) for c in rule])
    assert (hit == bad).mean() > 0.97
    assert "symbol_share >=" in str(rules) and str(rules).endswith("else good")


def test_rules_find_a_rare_kind_of_bad_text():
    rnd = np.random.default_rng(6)
    n = 3500
    features = pd.DataFrame({f: rnd.random(n) / 20 for f in quality_rules.FEATURES})
    kinds = rnd.permutation(n)
    common, rare, noise = kinds[:285], kinds[285:290], kinds[290:296]
    features["symbol_share"] = 0.0
    features.loc[common, "symbol_share"] = 0.1 + rnd.random(len(common))
    features.loc[rare, "same_word_share"] = 0.4 + rnd.random(len(rare)) / 2
    bad = np.zeros(n, dtype=bool)
    bad[np.concatenate([common, rare, noise])] = True  # nothing tells the noise from good text
    rules = quality_rules.cover(features, bad, np.ones(n)).rules
    hit = np.zeros(n, dtype=bool)
    for rule in rules:
        hit |= quality_rules._covered(rule, features)
    assert hit[rare].all() and hit[common].mean() > 0.98 and not hit[~bad].any()


def test_rules_on_documents(spark):
    docs, labels = labelled(spark)
    rules = quality_rules.learn(docs, labels)
    got = quality_rules.judge(docs, rules).join(labels, "doc_id").toPandas()
    assert (got.kept[~got.base_failed] == (got.quality[~got.base_failed] == 1)).mean() > 0.95
    assert not got.kept[got.base_failed].any()
    kept = quality_rules.keep_good(docs, rules)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(got.doc_id[got.kept])
    odd = spark.createDataFrame(AWKWARD, docs.schema)
    rows = quality_rules.judge(odd, rules).collect()
    assert [r.n_words for r in rows] == [0, 0, 2, 30_000, 30_000, 0]
    assert all(r.base_failed and not r.kept for r in rows)
    assert quality_rules.judge(odd.limit(0), rules).count() == 0
    none = quality_rules.learn(docs, labels.limit(0))
    assert none.rules == () and quality_rules.keep_good(docs, none).count() > 0


def test_folds_match_the_checksum(spark):
    from tablelore.llm.queries import fold

    rows = spark.range(200).toDF("doc_id").withColumn("f", fold(5)).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)


def test_counting_texts_takes_bounded_memory():
    """Portions keep what counting takes small beside the worker, however large a batch is."""
    import tracemalloc

    import pyarrow as pa

    from tablelore.llm import quality_rules
    from tablelore.llm.batches import portions

    batch = pa.array([" ".join(f"w{i * j % 9973}" for j in range(2_000)) for i in range(300)])
    tracemalloc.start()
    counted = [quality_rules.count_texts(batch[b:e].to_pylist())["n_words"].sum()
               for b, e in portions(batch, quality_rules.PORTION_BYTES)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(counted) == 600_000 and len(counted) > 5 and peak < 30_000_000
