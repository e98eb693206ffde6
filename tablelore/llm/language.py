"""Language of a text by cross-parsing against labelled text.

For each language the substrings of a bounded piece of labelled text are held in a
suffix automaton. A text is cut into phrases, each the longest stretch that occurs in a
language's labelled text; the language that needs the fewest phrases, normalised by the
bits that a phrase costs there, is the one the text is in.

Automata of all languages are one table of numbers, and blocks of many texts are parsed
against it side by side, one byte of each per step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import samples
from .batches import portions
from .frames import fresh
from .workers import ship, tidy

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()),
                        T.StructField("score", T.DoubleType())])


@dataclass(frozen=True)
class Settings:
    """Bounds of the model, for each language: texts, bytes of a text, and bytes in all.

    The automata take about half a kilobyte of memory a byte. A phrase never goes past a block of ``block`` bytes of the text it is cut from.
    """

    texts: int = 400
    bytes_per_text: int = 240
    bytes_per_language: int = 24_000
    block: int = 256
    seed: int = 4


#: Whatever is no letter and no part of one is a blank.
_BLANKS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def plain(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANKS).split())


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for byte in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and byte not in step[at]:
            step[at][byte] = new
            at = link[at]
        if at >= 0:
            old = step[at][byte]
            if length[at] + 1 == length[old]:
                link[new] = old
            else:
                copy = len(step)
                step.append(dict(step[old]))
                length.append(length[at] + 1)
                link.append(link[old])
                while at >= 0 and step[at].get(byte) == old:
                    step[at][byte] = copy
                    at = link[at]
                link[old] = link[new] = copy
        last = new
    return step


class CrossParser:
    """Automata of several languages as one table of the next row and a phrase mark."""

    def __init__(self, texts: tuple[tuple[str, bytes], ...], block: int):
        self.languages = [lang for lang, _ in texts]
        self.block = block
        used = sorted({b for _, t in texts for b in t})
        self._other, self._end = len(used), len(used) + 1  # a byte never seen, past the end
        width = len(used) + 2
        self._codes = np.full(256, self._other, dtype=np.uint8 if width <= 256 else np.int16)
        self._codes[used] = np.arange(len(used))
        code = {b: i for i, b in enumerate(used)}
        tables, self._starts, offset = [], [], 0
        for _, text in texts:
            step = suffix_automaton(text)
            table = np.full((len(step), width), -1, dtype=np.int32)
            for state in range(len(step)):
                for byte, target in step[state].items():
                    table[state, code[byte]] = target
                if state:
                    step[state] = {}  # done with
            first = np.where(table[0] >= 0, table[0], 0)
            missing = table < 0
            np.copyto(table, first[None, :], where=missing)
            table[:, self._end], missing[:, self._end] = np.arange(len(step)), False
            table += offset
            table *= width * 2
            table += missing
            tables.append(table)
            self._starts.append(offset * width)
            offset += len(step)
        self._table = np.concatenate(tables).ravel()
        self._bits = np.array([np.log2(len(t) + 1) for _, t in texts])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        blocks = -(-sizes // self.block)
        lanes = int(blocks.sum())
        ends = np.cumsum(blocks)
        codes = np.full(lanes * self.block, self._end, dtype=self._codes.dtype)
        for text, end, count in zip(texts, ends, blocks, strict=True):
            begin = int(end - count) * self.block
            codes[begin:begin + len(text)] = self._codes[np.frombuffer(text, dtype=np.uint8)]
        codes = np.ascontiguousarray(codes.reshape(lanes, self.block).T).astype(np.int32)
        states = np.repeat(np.array(self._starts, dtype=np.int32)[:, None], lanes, axis=1)
        found = np.zeros((len(self.languages), lanes), dtype=np.int32)
        for column in codes:
            after = self._table.take(states + column)
            found += after & 1
            states = after >> 1
        total = np.zeros((len(self.languages), lanes + 1), dtype=np.int64)
        np.cumsum(found, axis=1, out=total[:, 1:])
        return (total[:, ends] - total[:, ends - blocks]).T + 1

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language with the fewest bits, and how clear that is (0.5 to 1)."""
        bits = self.phrases(texts) * self._bits
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(bits)), best]
        rest = bits.copy()
        rest[np.arange(len(bits)), best] = np.inf
        second = rest.min(axis=1)
        score = np.ones(len(bits))
        np.divide(second, least + second, out=score, where=np.isfinite(second))
        return best, score


@lru_cache(maxsize=2)
def _parser(texts: tuple[tuple[str, bytes], ...], block: int) -> CrossParser:
    return CrossParser(texts, block)


@dataclass(frozen=True)
class LanguageModel:
    texts: tuple[tuple[str, bytes], ...]
    settings: Settings

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 without text, letters or model."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        usable = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if usable and self.texts:
            parser = _parser(self.texts, self.settings.block)
            best, score = parser.predict([plain(texts[i]) for i in usable])
            for i, b, s in zip(usable, best.tolist(), score.tolist(), strict=True):
                names[i], scores[i] = parser.languages[b], s
        return names, scores

    def column(self, spark, text: Column) -> Column:
        """Struct of ``lang_pred`` and ``score`` for a column of texts."""
        ship(spark)
        shared = spark.sparkContext.broadcast(self)  # bounded by the settings

        @F.arrow_udf(_RESULT)
        def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in tidy(batches):
                names: list[str] = []
                scores: list[float] = []
                for begin, end in portions(batch, 500_000):
                    for out, more in zip((names, scores), shared.value.predict(
                            batch[begin:end].to_pylist()), strict=True):
                        out.extend(more)
                yield pa.StructArray.from_arrays(
                    [pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=["lang_pred", "score"])

        return predict(text)


def learn(documents: DataFrame, settings: Settings = Settings(), *, text: str = "text",
          lang: str = "lang") -> LanguageModel:
    """A model from ``text`` and ``lang``; rows with a null or no letter teach nothing.

    The sample is bounded by the settings: different texts with the smallest hashes, and
    of each an equal share of the bytes.
    """
    rows = documents.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    chosen = samples.choose(rows.select(
        F.col(lang).alias("label"), samples.text_hash(text, settings.seed).alias("h")),
        settings.texts, settings.seed)
    of = chosen.labels_of()
    texts: dict[str, list[bytes]] = {}
    found = samples.sampled_texts(rows, chosen, text).select(
        "h", F.substring("text", 1, settings.bytes_per_text * 4).alias("text")).collect()
    for row in sorted(found):
        for label in of[row["h"]]:
            texts.setdefault(label, []).append(plain(row["text"])[:settings.bytes_per_text])
    return LanguageModel(tuple((label, b"\n".join(parts)[:settings.bytes_per_language])
                               for label, parts in sorted(texts.items())), settings)


def identify(documents: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score`` in place of columns of those names.

    Whole texts are read. A null text and one without letters is ``und`` with score 0; so
    is every text if nothing was learned. Of equal languages the first by name wins.
    Repeated rows and null keys stay. No shuffle; texts go to Python in portions.
    """
    name = fresh(documents, "language")
    keep = [F.col(f"`{c}`") for c in documents.columns if c not in ("lang_pred", "score")]
    return documents.withColumn(name, model.column(documents.sparkSession, F.col(text))).select(
        *keep, F.col(f"{name}.lang_pred").alias("lang_pred"),
        F.col(f"{name}.score").alias("score"))


def keep_identified(documents: DataFrame, model: LanguageModel, *, text: str = "text",
                    least_score: float = 0.5) -> DataFrame:
    """The rows whose language is known with at least ``least_score``; columns as they are."""
    found = model.column(documents.sparkSession, F.col(text))
    return documents.where((found["lang_pred"] != UNKNOWN) & (found["score"] >= least_score))
