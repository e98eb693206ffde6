"""Documents into sequences of bounded length by vector best-fit.

A document becomes token ids and is cut only where it is longer than a sequence. A piece
needs tokens, one place among the documents of a sequence, and attention cost (its length
squared). Each open sequence has a residual of all three capacities; a piece goes to the
open sequence that it fits best, by the norm of what would remain or by the weighted dot
product with what is free, and never past any capacity.

Needs depend on length alone, and there are at most as many lengths as a sequence has
tokens. So the plan is made on counts per length, longest first, with equal sequences
kept as one group, and its size is bounded by the sequence length. Pieces then look up
their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..store import written
from .batches import in_portions
from .tokens import WordIds
from .workers import ship, tidy


@dataclass(frozen=True)
class Capacity:
    """What a sequence can take, and how a place is chosen.

    ``documents`` and ``attention`` default to what never binds before the tokens do.
    ``choose`` is ``residual`` (smallest weighted norm of what remains) or ``product``
    (largest weighted dot product of need and residual).
    """

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)
    choose: str = "residual"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens,
                         self.attention or self.tokens ** 2], dtype=np.int64)

    def needs(self, length: int) -> np.ndarray:
        return np.array([length, 1, length * length], dtype=np.int64)


PLAN_COLUMNS = ("length", "low", "high", "first", "each", "offset")


def plan(counts: dict[int, int], capacity: Capacity) -> list[tuple[int, ...]]:
    """Places for ``counts[length]`` pieces of each length, as rows of ``PLAN_COLUMNS``.

    Pieces with rank ``low <= rank < high`` go ``each`` at a time into the sequences from
    ``first`` on, from ``offset`` on.
    """
    whole = capacity.vector()
    weights = np.array(capacity.weights) / whole
    free = np.empty((0, 3), dtype=np.int64)  # residuals of each group of equal sequences
    first = np.empty(0, dtype=np.int64)
    members = np.empty(0, dtype=np.int64)
    rows: list[tuple[int, ...]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        need, left, low = capacity.needs(length), counts[length], 0
        if not (need <= whole).all():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            fits = np.flatnonzero((free >= need).all(axis=1))
            if len(fits):
                room = free[fits]
                if capacity.choose == "residual":
                    score = (((room - need) * weights) ** 2).sum(axis=1)
                else:
                    score = -(room * need * weights / whole).sum(axis=1)
                at = int(fits[np.argmin(score)])
            else:
                each = int((whole // need).min())
                at = len(members)
                free = np.vstack([free, whole])
                first = np.append(first, opened)
                members = np.append(members, -(-left // each))
                opened += members[at]
            each = min(int((free[at] // need).min()), left)
            if capacity.choose != "residual":
                each = 1
            used = min(int(members[at]), left // each)
            if used < members[at]:  # the rest stays as it is
                free = np.vstack([free, free[at]])
                first = np.append(first, first[at] + used)
                members = np.append(members, members[at] - used)
                members[at] = used
            rows.append((length, low, low + used * each, int(first[at]), each,
                         int(capacity.tokens - free[at][0])))
            free[at] -= need * each
            low += used * each
            left -= used * each
        usable = (free > 0).all(axis=1)
        free, first, members = free[usable], first[usable], members[usable]
    return rows


_PIECES = ("{key} long, piece int, start long, length long, ids_crc32 long")


def pieces(documents: DataFrame, tokenizer_path: str, *, key: str = "doc_id",
           text: str = "text", tokens: int = 4096, end_id: int = 1) -> DataFrame:
    """Each document's ids and an end id, cut into pieces of at most ``tokens``."""
    ship(documents.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = documents.sparkSession.sparkContext.broadcast(file.read())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(shared.value)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in in_portions(tidy(batches), "text"):
            out: list[list] = [[], [], [], [], []]
            for doc, content in zip(batch.column("key").to_pylist(),
                                    batch.column("text").to_pylist(), strict=True):
                ids = memoryview(words.of(content or "") + end)
                for n, start in enumerate(range(0, len(ids), 4 * tokens)):
                    part = ids[start:start + 4 * tokens]
                    for column, value in zip(out, (doc, n, start // 4, len(part) // 4,
                                                   zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["key", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col(key).cast("long").alias("key"),
                            F.col(text).alias("text")).mapInArrow(cut, _PIECES.format(key="key"))


def pack(documents: DataFrame, tokenizer_path: str, capacity: Capacity = Capacity(), *,
         key: str = "doc_id", text: str = "text", end_id: int = 1,
         strands: int = 64) -> DataFrame:
    """One row per piece: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id`` and ``offset``.

    A null text counts as empty, and an empty text is its end id alone. Very long texts
    become many pieces. Documents with a null or repeated key are packed like any other,
    each row on its own. Other columns are left out. An empty table gives an empty
    result. Longer documents are cut at whole sequences only.

    Texts are tokenized once, where they are read; rows of a few numbers are written to
    the shared folder and shuffled. The rank within a length is counted in ``strands``
    that a hash of the piece chooses, so a third of all pieces of one length is spread.
    """
    spark = documents.sparkSession
    found = written(pieces(documents, tokenizer_path, key=key, text=text,
                           tokens=capacity.tokens, end_id=end_id), "pieces")
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    rows = plan(counts, capacity)
    schema = pa.schema([(n, pa.int64()) for n in PLAN_COLUMNS])
    places = spark.createDataFrame(pa.table(
        {n: np.array([r[i] for r in rows], dtype=np.int64)
         for i, n in enumerate(PLAN_COLUMNS)}, schema=schema)).withColumnRenamed("length", "of")

    same = ["key", "piece", "ids_crc32"]
    strand = F.pmod(F.xxhash64(*same), F.lit(strands)).cast("int")
    found = found.withColumn("strand", strand)
    before = Window.partitionBy("length").orderBy("strand").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (found.groupBy("length", "strand").agg(F.count(F.lit(1)).alias("rows"))
               .select(F.col("length").alias("l"), F.col("strand").alias("s"),
                       F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier")))
    within = Window.partitionBy("length", "strand").orderBy(*same, "start")
    ranked = found.withColumn("nth", F.row_number().over(within) - 1).join(
        offsets, (F.col("length") == F.col("l")) & (F.col("strand") == F.col("s"))).withColumn(
        "rank", F.col("earlier") + F.col("nth"))
    # The plan is bounded by the number of lengths, not by the data.
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("of"))
                         & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return placed.select(
        F.col("key").alias(key), "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("offset") + F.pmod(nth, F.col("each")) * F.col("length")).alias("offset"))
