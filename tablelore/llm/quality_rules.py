"""Quality rules learned as a decision list.

Statistics of each text are counted in portions of many texts at once. From the
statistics of a bounded sample of labelled texts, sequential covering learns rules for
bad text: a rule grows by the threshold that gains most, is pruned on texts it was not
grown on, and is kept if it is right there often enough; then what it covers is set
aside. The ordered rules are a Spark conditional expression over the statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import samples
from .batches import portions
from .frames import fresh
from .workers import ship, tidy

WINDOW = 5
#: Words, their numbers and windows take some forty times the bytes of the texts they are of.
PORTION_BYTES = 250_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_upper", "n_marks", "n_same_words")
_SYMBOLS, _MARKS = b"#*$%&|<>", b"!?.,;:\"'()-"
_UPPER, _BLANK = bytes(range(65, 91)), b" \t\n\x0b\x0c\r"

#: What rules may ask about, as SQL over the counts. All are shares that drift neither with
#: the length of a text nor with its language.
FEATURES = {
    "symbol_share": "n_symbols / word_chars",
    "repeated_line_share": "n_dup_lines / n_lines",
    "repeated_word_share": "n_repeat_words / n_words",
    "upper_share": "n_upper / word_chars",
    "mark_share": "n_marks / word_chars",
    "same_word_share": "n_same_words / n_words",
}


#: The base: too few words, or more than a fifth of them repeated.
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def _without(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def count_texts(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The counts of each text.

    Words are what stands between ASCII white space. A word is repeated if one of the
    windows of five words around it occurs twice or more in its text, and the same if it
    equals the word before.
    """
    n = len(texts)
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    words = [d.split() for d in data]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    out = {"n_words": sizes}
    out["word_chars"] = np.array([len(t or "") - _without(d, _BLANK)
                                  for t, d in zip(texts, data, strict=True)], dtype=np.int64)
    for name, chars in (("n_symbols", _SYMBOLS), ("n_upper", _UPPER), ("n_marks", _MARKS)):
        out[name] = np.array([_without(d, chars) for d in data], dtype=np.int64)
    lines = [[line for line in d.split(b"\n") if line.strip()] for d in data]
    out["n_lines"] = np.array([len(x) for x in lines], dtype=np.int64)
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64)

    doc = np.repeat(np.arange(n), sizes)
    flat = np.empty(len(doc), dtype=object)
    flat[:] = [w for ws in words for w in ws]
    ids, kinds = pd.factorize(flat)
    ids, many = ids.astype(np.int64), len(kinds) + 1
    same = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    out["n_same_words"] = np.bincount(doc[1:][same], minlength=n)
    covered = np.zeros(len(doc) + 1, dtype=np.int64)
    begins = np.flatnonzero(doc[:-4] == doc[4:]) if len(doc) > 4 else doc[:0]
    if len(begins):
        pair = _codes(ids[:-1] * many + ids[1:])
        four = _codes(pair[:-2] * (pair.max() + 1) + pair[2:])
        window = four[begins] * many + ids[begins + 4]
        window = _codes(_codes(window) * n + doc[begins])
        twice = begins[np.bincount(window)[window] > 1]
        covered[:] = (np.bincount(twice, minlength=len(covered))
                      - np.bincount(twice + WINDOW, minlength=len(covered)))
    repeated = doc[np.cumsum(covered[:-1]) > 0]
    out["n_repeat_words"] = np.bincount(repeated, minlength=n)
    return {name: out[name] for name in COUNTS}


def _codes(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 on, equal where the values are equal."""
    return pd.factorize(values)[0].astype(np.int64)


_RESULT = T.StructType([T.StructField(n, T.LongType()) for n in COUNTS])


def count_column(spark, text: Column) -> Column:
    """Struct of the counts for a column of texts."""
    ship(spark)

    @F.arrow_udf(_RESULT)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in tidy(batches):
            parts = [count_texts(batch[b:e].to_pylist())
                     for b, e in portions(batch, PORTION_BYTES)]
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate([p[n] for p in parts]) if parts else [], pa.int64())
                 for n in COUNTS], names=list(COUNTS))

    return count(text)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, features: pd.DataFrame) -> np.ndarray:
        value = features[self.feature].to_numpy()
        return value >= self.threshold if self.at_least else value <= self.threshold

    def sql(self, of: str = "") -> str:
        """The condition over counts, which may be fields of ``of``."""
        text = FEATURES[self.feature]
        for name in COUNTS:
            text = text.replace(name, f"{of}{name}") if of else text
        return f"({text}) {'>=' if self.at_least else '<='} {self.threshold!r}D"

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample, of rules and conditions, and how right a rule must be.

    A rule must cover ``least_cover`` bad texts, however few of all bad texts they are, and
    more of them than ``chance`` allows for the best of all rules of its length.
    """

    texts: int = 4000
    rules: int = 12
    conditions: int = 4
    thresholds: int = 64
    precision: float = 0.9
    least_cover: int = 3
    chance: float = 0.01
    seed: int = 8


@dataclass(frozen=True)
class DecisionList:
    """Rules for bad text, in order; text that none covers is good."""

    rules: tuple[Rule, ...]

    def good(self, of: str = "") -> Column:
        """The ordered conditional expression over counts, or over the fields of ``of``."""
        out = None
        for rule in self.rules:
            test = F.expr(" AND ".join(c.sql(of) for c in rule))
            out = F.when(test, False) if out is None else out.when(test, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def __str__(self) -> str:
        return "\n".join(["bad if " + " and ".join(map(str, r)) for r in self.rules]
                         + ["else good"])


def _covered(rule: Rule, features: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(features), dtype=bool)
    for condition in rule:
        out &= condition.holds(features)
    return out


def _gains(features: pd.DataFrame, bad: np.ndarray, weight: np.ndarray, inside: np.ndarray,
           settings: Settings) -> list[tuple[float, Condition]]:
    """The condition of each feature and direction that gains most, the best of all first."""
    out: list[tuple[float, Condition]] = []
    p0, n0 = weight[inside & bad].sum(), weight[inside & ~bad].sum()
    for name in FEATURES:
        value = features[name].to_numpy()
        some = np.unique(np.quantile(value[inside & bad], np.linspace(0, 1, settings.thresholds),
                                     method="inverted_cdf"))
        for at_least in (True, False):
            best: tuple[float, Condition] | None = None
            for threshold in some:
                condition = Condition(name, at_least, float(threshold))
                hit = inside & condition.holds(features)
                p, n = weight[hit & bad].sum(), weight[hit & ~bad].sum()
                if p:
                    gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                    if gain > (best[0] if best else 0) + 1e-9:
                        best = gain, condition
            if best is not None:
                out.append(best)
    return sorted(out, key=lambda g: -g[0])


def _grow(first: Condition, features: pd.DataFrame, bad: np.ndarray, weight: np.ndarray,
          settings: Settings) -> Rule:
    """Conditions added one by one, each the one with the largest information gain."""
    rule = [first]
    inside = first.holds(features)
    while len(rule) < settings.conditions and (inside & ~bad).any():
        gains = _gains(features, bad, weight, inside, settings)
        if not gains:
            break
        rule.append(gains[0][1])
        inside &= gains[0][1].holds(features)
    return tuple(rule)


def _worth(rule: Rule, features: pd.DataFrame, bad: np.ndarray, weight: np.ndarray) -> float:
    hit = _covered(rule, features)
    p, n = weight[hit & bad].sum(), weight[hit & ~bad].sum()
    return (p - n) / (p + n) if p + n else -1.0


def _prune(rule: Rule, features: pd.DataFrame, bad: np.ndarray, weight: np.ndarray) -> Rule:
    """The beginning of the rule that is worth most on other texts; the shorter on a tie."""
    return max((rule[:i] for i in range(1, len(rule) + 1)),
               key=lambda r: (_worth(r, features, bad, weight), -len(r)))


def _shortest(rule: Rule) -> Rule:
    """The rule without conditions that a later one of the same kind implies."""
    last = {(c.feature, c.at_least): c for c in rule}
    return tuple(last.values())


def _widened(rule: Rule, features: pd.DataFrame, bad: np.ndarray) -> Rule:
    """The rule with each threshold half way to the next good text that it keeps out."""
    out = list(rule)
    for i, c in enumerate(rule):
        near = features[c.feature].to_numpy()[
            ~bad & ~c.holds(features) & _covered((*out[:i], *out[i + 1:]), features)]
        if len(near):
            edge = near.max() if c.at_least else near.min()
            out[i] = Condition(c.feature, c.at_least, float((c.threshold + edge) / 2))
    return tuple(out)


def _by_chance(covered: int, bad_covered: int, rows: int, bad: int) -> float:
    """Log of the chance that ``covered`` rows drawn blindly hold so many bad ones or more."""
    def ways(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    terms = [ways(bad, k) + ways(rows - bad, covered - k) - ways(rows, covered)
             for k in range(max(bad_covered, covered - rows + bad), min(covered, bad) + 1)]
    return max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms))


def _accepted(rule: Rule, hit: np.ndarray, left: np.ndarray, bad: np.ndarray,
              weight: np.ndarray, settings: Settings) -> bool:
    """Whether a rule covers enough bad texts, is right often enough, and not by chance."""
    right, wrong = weight[hit & bad].sum(), weight[hit & ~bad].sum()
    found = int((hit & bad).sum())
    if found < settings.least_cover or right < settings.precision * (right + wrong):
        return False
    tried = len(rule) * math.log(2 * settings.thresholds * len(FEATURES))
    return tried + _by_chance(int(hit.sum()), found, int(left.sum()),
                              int((left & bad).sum())) <= math.log(settings.chance)


def cover(features: pd.DataFrame, bad: np.ndarray, weight: np.ndarray,
          settings: Settings = Settings()) -> DecisionList:
    """A decision list for the rows marked ``bad``; every third row only serves to prune.

    Where a rule is refused, the next one begins with another condition; if none is
    accepted, the bad rows of the first no longer grow rules, so others are looked for.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    refused = np.zeros(len(bad), dtype=bool)
    prunes = np.arange(len(bad)) % 3 == 2
    while len(rules) < settings.rules:
        grow, check = left & ~refused & ~prunes, left & ~refused & prunes
        if not (bad & grow).any() or not (~bad & grow).any():
            break
        of = features[grow], bad[grow], weight[grow]
        missed = None
        for _, first in _gains(*of, np.ones(grow.sum(), dtype=bool), settings):
            rule = _grow(first, *of, settings)
            if (bad & check).any():
                rule = _prune(rule, features[check], bad[check], weight[check])
            rule = _widened(_shortest(rule), features[left], bad[left])
            hit = left & _covered(rule, features)
            if _accepted(rule, hit, left, bad, weight, settings):
                rules.append(rule)
                left &= ~hit
                break
            missed = hit & bad if missed is None else missed
        else:
            if missed is None:
                break
            refused |= missed
    return DecisionList(tuple(rules))


def features_of(counts: pd.DataFrame) -> pd.DataFrame:
    """The features of texts with words, as the rules see them."""
    out = pd.DataFrame(index=counts.index)
    for name, text in FEATURES.items():
        above, _, below = text.partition(" / ")
        out[name] = counts[above] / counts[below] if below else counts[above].astype(float)
    return out


def learn(documents: DataFrame, labels: DataFrame, settings: Settings = Settings(), *,
          key: str = "doc_id", text: str = "text", label: str = "quality") -> DecisionList:
    """Rules from documents joined with labels 0 and 1; null labels and texts teach nothing.

    Only keys and hashes are joined; the sample holds at most ``settings.texts`` different
    texts of each label, and rules count each label as often as it occurs in all. Texts
    that fail the base teach nothing. Without bad labelled texts there are no rules and
    everything is good.
    """
    hashed = samples.labelled_hashes(documents, labels, settings.seed, key=key, label=label,
                                     text=text)
    chosen = samples.choose(hashed, settings.texts, settings.seed)
    of = chosen.labels_of()
    found = (samples.sampled_texts(documents, chosen, text)
             .select("h", count_column(documents.sparkSession, F.col("text")).alias("c")).select("h", "c.*").toPandas())
    rows = [(r, name) for r, h in enumerate(found["h"]) for name in of[h] if name in ("0", "1")]
    counts = found.iloc[[r for r, _ in rows]].assign(label=[n for _, n in rows])
    counts = counts[~counts.eval(BASE_FAILED.lower())].sort_values(["h", "label"])
    weights = {n: chosen.totals[n] / max(1, len(chosen.hashes.get(n, ()))) for n in ("0", "1")}
    return cover(features_of(counts), (counts["label"] == "0").to_numpy(),
                 counts["label"].map(weights).to_numpy(dtype=float), settings)


def judge(documents: DataFrame, rules: DecisionList, *, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """One row per document: ``key``, the counts, ``base_failed`` and ``kept``.

    Whole texts are counted. A null or empty text has no words, so it fails the base.
    Repeated rows and null keys stay, other columns are left out, an empty table gives an
    empty result. No shuffle; the rules are one conditional expression in Spark.
    """
    counts = documents.select(key, count_column(
        documents.sparkSession, F.col(text)).alias("c")).select(key, "c.*")
    failed = F.expr(BASE_FAILED)
    return counts.select(key, *COUNTS, failed.alias("base_failed"),
                         F.when(failed, False).otherwise(rules.good()).alias("kept"))


def keep_good(documents: DataFrame, rules: DecisionList, *, text: str = "text") -> DataFrame:
    """The documents that pass the base and the rules; columns and repeated rows as they are."""
    name = fresh(documents, "counts")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    failed = BASE_FAILED.replace("n_", f"{name}.n_")
    return (documents.withColumn(name, count_column(documents.sparkSession, F.col(text)))
            .where(F.when(F.expr(failed), False).otherwise(rules.good(f"{name}.")))
            .select(*columns))
