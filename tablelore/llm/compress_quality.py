"""Quality of a text by how much better good text helps to compress it than bad text.

Two zstandard dictionaries are trained from bounded samples of good and bad labelled
text. A text is compressed with each in blocks; the difference of the two sizes is
normalised by length. A logistic curve, fitted to other labelled texts, turns it into the
score; its second term is how short a text is, since little text tells little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import samples
from .batches import portions
from .workers import ship, tidy


@dataclass(frozen=True)
class Settings:
    """Bounds of the model: texts of each label for dictionaries and for the calibration.

    A text is compressed whole, in blocks of ``block`` bytes, so that a dictionary helps
    as much at the end as at the start.
    """

    texts: int = 2000
    bytes_per_text: int = 4000
    dictionary_bytes: int = 262_144
    calibration_texts: int = 4000
    block: int = 2048
    few_bytes: int = 300
    level: int = 3
    seed: int = 6


def train(texts: list[bytes], settings: Settings) -> bytes:
    """A dictionary of the texts; the texts themselves where there are too few to train."""
    if sum(map(len, texts)) >= 8 * settings.dictionary_bytes // 4 and len(texts) >= 50:
        size = min(settings.dictionary_bytes, sum(map(len, texts)) // 4)
        return zstandard.train_dictionary(size, texts, k=200, d=8,
                                          level=settings.level).as_bytes()
    return b"".join(texts)[-settings.dictionary_bytes:]


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(
        level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None,
        write_content_size=False, write_checksum=False, write_dict_id=False)


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    settings: Settings
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def measure(self, text: str | None) -> tuple[float, float]:
        """Bytes that good text saves more than bad text does, per byte, and the shortness.

        Both are damped by ``few_bytes``, so no text at all has difference 0, shortness 1.
        """
        data = (text or "").encode("utf-8", "replace")
        good = _compressor(self.good, self.settings.level).compress
        bad = _compressor(self.bad, self.settings.level).compress
        saved = 0
        for start in range(0, len(data), self.settings.block):
            part = data[start:start + self.settings.block]
            saved += len(bad(part)) - len(good(part))
        few = self.settings.few_bytes
        return saved / (len(data) + few), few / (len(data) + few)

    def score(self, measures: np.ndarray) -> np.ndarray:
        """Scores of rows of (difference, shortness)."""
        odds = measures @ np.array(self.curve[:2]) + self.curve[2]
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def _texts(self, batch: pa.Array) -> np.ndarray:
        found = [self.measure(t) for begin, end in portions(batch)
                 for t in batch[begin:end].to_pylist()]
        return np.array(found, dtype=float).reshape(-1, 2)

    def score_column(self, spark, text: Column) -> Column:
        ship(spark)
        shared = spark.sparkContext.broadcast(self)  # two dictionaries of bounded size

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = shared.value
            for batch in tidy(batches):
                yield pa.array(model.score(model._texts(batch)), pa.float64())

        return score(text)

    def measure_column(self, spark, text: Column) -> Column:
        """Array of difference and shortness for a column of texts."""
        ship(spark)
        shared = spark.sparkContext.broadcast(self)

        @F.arrow_udf("array<double>")
        def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in tidy(batches):
                yield pa.array(list(shared.value._texts(batch)), pa.list_(pa.float64()))

        return measure(text)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray,
                 ridge: float = 1e-3) -> tuple[float, ...]:
    """Weights and offset of the weighted logistic curve from rows of ``x`` to ``y``."""
    scale = x.std(axis=0)
    scale[scale == 0] = 1.0
    design = np.column_stack([x / scale, np.ones(len(x))])
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -50, 50)))
        slope = design.T @ (weight * (y - p)) - ridge * beta
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design
        move = np.linalg.solve(bend + ridge * np.eye(len(beta)), slope)
        beta += np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-9:
            break
    return (*(beta[:-1] / scale).tolist(), float(beta[-1]))


def learn(documents: DataFrame, labels: DataFrame, settings: Settings = Settings(), *,
          key: str = "doc_id", text: str = "text", label: str = "quality") -> CompressionModel:
    """A model from documents joined with labels 0 and 1; null labels and texts teach nothing.

    Only keys and hashes are joined. Dictionaries come from different texts than the
    calibration; the curve counts each label as often as it occurs among all labelled
    rows. With one label or none the score is the share of label 1 (0.5 without labels).
    """
    hashed = samples.labelled_hashes(documents, labels, settings.seed, key=key, label=label,
                                     text=text)
    chosen = samples.choose(hashed, settings.texts + settings.calibration_texts, settings.seed)
    fit: dict[str, list[int]] = {}
    build: dict[str, list[int]] = {}
    for name, hashes in chosen.hashes.items():
        # Of few texts a quarter is left for the calibration.
        cut = min(settings.texts, -(-3 * len(hashes) // 4))
        build[name], fit[name] = hashes[:cut], hashes[cut:]
    texts = {"0": [], "1": []}
    wanted = samples.Sample(settings.seed, build, chosen.totals)
    of = wanted.labels_of()
    for row in sorted(samples.sampled_texts(documents, wanted, text).select(
            "h", F.substring("text", 1, settings.bytes_per_text).alias("text")).collect()):
        for name in of[row["h"]]:
            if name in texts:
                texts[name].append(row["text"].encode("utf-8", "replace"))
    model = CompressionModel(train(texts["1"], settings), train(texts["0"], settings), settings)
    if not (fit.get("0") and fit.get("1")):
        good, bad = chosen.totals["1"], chosen.totals["0"]
        prior = float(np.log((good + 0.5) / (bad + 0.5)))
        return CompressionModel(model.good, model.bad, settings, (0.0, 0.0, prior))
    wanted = samples.Sample(settings.seed, fit, chosen.totals)
    of = wanted.labels_of()
    rows = samples.sampled_texts(documents, wanted, text).select("h", model.measure_column(
        documents.sparkSession, F.col("text")).alias("measures")).collect()
    points = sorted((tuple(r["measures"]), name) for r in rows for name in of[r["h"]]
                    if name in ("0", "1"))
    weight = {name: chosen.totals[name] / sum(n == name for _, n in points)
              for name in ("0", "1")}
    curve = fit_logistic(np.array([m for m, _ in points]),
                         np.array([float(n) for _, n in points]),
                         np.array([weight[n] for _, n in points]))
    return CompressionModel(model.good, model.bad, settings, curve)


def score_quality(documents: DataFrame, model: CompressionModel, *, key: str = "doc_id",
                  text: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: ``key``, ``score`` (0 to 1), ``predicted`` (1 from the threshold).

    Whole texts are compressed, very long ones block by block. A null or empty text has
    difference 0 and shortness 1, and the score of that. Repeated rows and null keys stay, other columns
    are left out, an empty table gives an empty result. No shuffle.
    """
    score = model.score_column(documents.sparkSession, F.col(text))
    return documents.select(key, score.alias("score")).select(
        key, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
