"""Documents into shards by a consistent-hash ring with bounded loads.

Every shard has virtual nodes on a ring of cells, every document a point on it. A
document belongs to the shard of the first node clockwise; where that shard is full, the
documents of the arc that come last in ring order go on clockwise to the next shard with
room. Nothing else moves, so balance is guaranteed and movement is limited to overflow.

The ring is planned from document counts per cell, a number of counts that is a
parameter and not a size of the data. Documents then only look up where their rank
within their cell falls. Cells are ranked in parts, so one key may hold any share of them;
ties between points of the ring go by the order of keys, sizes and checksums.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..store import written

#: Parts of a cell that are ranked apart, and copies of a row that are unfolded at once.
_PARTS = 64
_STEP = 4096


@dataclass(frozen=True)
class Ring:
    """``cells`` bounds the plan, ``slack`` is the room above an equal share."""

    shards: int
    nodes_per_shard: int = 64
    cells: int = 65_536
    slack: float = 0.0

    def nodes(self) -> list[tuple[int, int]]:
        """(cell, shard) of all virtual nodes, in clockwise order."""
        def cell(shard: int, node: int) -> int:
            digest = hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest()
            return int.from_bytes(digest, "big") % self.cells

        return sorted((cell(s, v), s) for s in range(self.shards)
                      for v in range(self.nodes_per_shard))

    def capacities(self, rows: int) -> list[int]:
        """Rows a shard may take: equal shares, one apart, times one plus the slack."""
        share, rest = divmod(rows, self.shards)
        return [int((share + (s < rest)) * (1 + self.slack)) + (self.slack > 0)
                for s in range(self.shards)]


def point(key: Column) -> Column:
    return F.xxhash64(key)


def plan(ring: Ring, counts: dict[int, int]) -> dict[str, np.ndarray]:
    """Where the documents of each cell go, as ranges of ranks.

    Columns: ``cell``, ``low``, ``high`` (ranks in the cell), ``shard`` and ``slot`` (of
    the first rank). Each arc first offers its documents to its own shard, arcs in ring
    order; what a full shard cannot take goes on, one node at a time.
    """
    nodes = ring.nodes()
    starts = np.array([cell for cell, _ in nodes])
    owners = [shard for _, shard in nodes]
    filled = sorted(c for c, n in counts.items() if n)
    arcs: dict[int, list[int]] = {}
    for cell in filled:
        arcs.setdefault(int(np.searchsorted(starts, cell)) % len(nodes), []).append(cell)
    free = ring.capacities(sum(counts.values()))
    waiting = {arc: sum(counts[c] for c in cells) for arc, cells in sorted(arcs.items())}
    taken: dict[int, list[tuple[int, int]]] = {arc: [] for arc in arcs}
    step = 0
    while waiting:
        for arc in list(waiting):
            shard = owners[(arc + step) % len(nodes)]
            rows = min(free[shard], waiting[arc])
            if rows:
                free[shard] -= rows
                waiting[arc] -= rows
                taken[arc].append((shard, rows))
            if not waiting[arc]:
                del waiting[arc]
        step += 1

    out: list[tuple[int, int, int, int, int]] = []
    slots = [0] * ring.shards
    for arc, cells in arcs.items():
        shares = iter(taken[arc])
        shard, left = next(shares)
        for cell in cells:
            low = 0
            while low < counts[cell]:
                if not left:
                    shard, left = next(shares)
                rows = min(left, counts[cell] - low)
                out.append((cell, low, low + rows, shard, slots[shard]))
                slots[shard] += rows
                left -= rows
                low += rows
    names = ("cell", "low", "high", "shard", "slot")
    return {n: np.array([r[i] for r in out], dtype=np.int64) for i, n in enumerate(names)}


def _counted(documents: DataFrame, ring: Ring, key: str, text: str) -> DataFrame:
    """Distinct rows with their cell, their part of it and how often they occur."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(
        F.col(key).alias("key"),
        F.pmod(point(F.col(key)), F.lit(ring.cells)).cast("int").alias("at"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"))
    return rows.groupBy("at", "key", "size", "text_crc32").agg(
        F.count(F.lit(1)).alias("copies")).withColumn("part", F.pmod(
            F.xxhash64("key", "size", "text_crc32"), F.lit(_PARTS)).cast("int"))


def assign_shards(documents: DataFrame, ring: Ring, *, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``size``, ``text_crc32``, ``shard``, ``slot``.

    ``size`` is the number of UTF-8 bytes plus one, the checksum unsigned; a null text
    counts as empty, a very long one as one row. ``slot`` numbers the documents of a
    shard from 0 without gaps. With no slack shard counts differ by one at most. Documents
    with a null key, or with one key, share a cell of the ring; so may other keys. Within
    a cell they are put in order by a hash of key, size and checksum, in parts of about
    equal size, so no cell is ranked in one task. Rows that agree in all three are
    counted before they are shuffled and all come back, unfolded in steps. Other columns
    are left out. An empty table gives an empty result.

    Documents are read once; rows of a few numbers are written and shuffled, never texts.
    """
    spark = documents.sparkSession
    rows = written(_counted(documents, ring, key, text), "shard-rows")
    # At most as many rows as the ring has parts of cells, whatever the size of the data.
    sizes = written(rows.groupBy("at", "part").agg(F.sum("copies").alias("n")), "shard-cells")
    counts = {r["at"]: r["n"] for r in
              sizes.groupBy("at").agg(F.sum("n").alias("n")).collect()}
    ranges = plan(ring, counts)
    where = spark.createDataFrame(pa.table(
        ranges, schema=pa.schema([(n, pa.int64()) for n in ranges])))

    before = Window.partitionBy("at").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = sizes.select("at", "part", F.coalesce(
        F.sum("n").over(before), F.lit(0)).alias("start"))
    in_part = Window.partitionBy("at", "part").orderBy(
        point(F.col("key")), "key", "size", "text_crc32").rowsBetween(
        Window.unboundedPreceding, 0)
    ends = rows.join(starts, ["at", "part"]).withColumn(
        "end", F.col("start") + F.sum("copies").over(in_part))
    steps = ends.withColumn("first", F.explode(F.expr(
        f"sequence(end - copies, end - 1, {_STEP}L)"))).repartition("at", "first")
    ranked = steps.withColumn("rank", F.explode(F.expr(
        f"sequence(first, least(end, first + {_STEP}L) - 1)")))
    # At most one range per cell plus one per overflow: bounded by the ring, not the data.
    found = ranked.join(F.broadcast(where), (F.col("at") == F.col("cell"))
                        & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return found.select(
        F.col("key").alias(key), "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
        (F.col("slot") + F.col("rank") - F.col("low")).alias("slot"))
