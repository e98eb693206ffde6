"""Word-piece lengths of texts by a linear longest-match automaton."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import portions
from .tokens import PieceCounts
from .workers import ship, tidy

_FIELDS = ("n_words", "n_tokens", "n_unknown", "longest_word")
_RESULT = T.StructType([T.StructField(n, T.LongType()) for n in _FIELDS])


def read_vocabulary(path: str) -> tuple[bytes, ...]:
    """The tokens of a vocabulary file with one base64 token and its rank per line."""
    with open(path, "rb") as file:
        return tuple(base64.b64decode(line.split()[0]) for line in file if line.strip())


@lru_cache(maxsize=1)
def _counts(vocabulary: tuple[bytes, ...]) -> PieceCounts:
    return PieceCounts(vocabulary)


def measure(text: str | None, counts: PieceCounts) -> tuple[int, int, int, int]:
    """Words, pieces, words without pieces and the most pieces of a word."""
    words = (text or "").encode("utf-8", "replace").split()
    pieces = list(map(counts.__getitem__, words))
    unknown = pieces.count(0)
    return len(words), sum(pieces) + unknown, unknown, max(pieces, default=0)


def count_column(spark, text: Column, vocabulary: tuple[bytes, ...]) -> Column:
    """Struct of the four counts for a column of texts."""
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary)  # bounded by the vocabulary file

    @F.arrow_udf(_RESULT)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = _counts(shared.value)
        for batch in tidy(batches):
            rows = [measure(t, counts) for begin, end in portions(batch)
                    for t in batch[begin:end].to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(_FIELDS))],
                names=list(_FIELDS))

    return count(text)


def count_tokens(documents: DataFrame, vocabulary_path: str, *, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``n_words``, ``n_tokens``, ``n_unknown``, ``longest_word``.

    Words are what stands between ASCII white space, each read with a blank in front and
    cut greedily into the longest pieces of the vocabulary. A word that cannot be cut is
    one unknown token. A null or empty text has no words. Repeated rows and null keys
    stay, other columns are left out, an empty table gives an empty result. No shuffle.
    """
    found = count_column(documents.sparkSession, F.col(text), read_vocabulary(vocabulary_path))
    return documents.select(key, found.alias("found")).select(key, "found.*")
