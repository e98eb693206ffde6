"""Documents linked by the Jaccard similarity of their word shingles, exactly.

Two sets that are similar enough differ in at most ``U`` shingles. All shingles are dealt
by hash into more segments than that, a number that depends on the band of sizes, so two
similar sets agree in some segment. A set is indexed by a hash of what it has in each
segment; segments that are allowed one difference count double and are also indexed with
each shingle left out. Per band, a cost estimate chooses between many plain segments and
few with deletions. Bands have some segments to spare, so a set may leave out segments
where it has nothing, which would be the buckets of everyone.

Sets that share an index entry are candidates. Of each bucket first only the links to one
hub are verified, on whole texts; the components these make answer for most of the rest,
and only pairs of a bucket that are still in different components are verified after.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..store import small_or_whole, written
from .batches import in_portions
from .components import components
from .tokens import Memory
from .workers import ship, tidy

_BITS = 1024
_U64 = np.uint64


@dataclass(frozen=True)
class Settings:
    """Shingle size, similarity as ``share`` of 100, and the cost estimate.

    A segment of s shingles is expected to agree by chance with ``crowd * likeness ** s``
    other sets, each costing as much as an index entry.
    """

    words: int = 5
    share: int = 80
    growth: float = 1.45
    crowd: float = 200.0
    likeness: float = 0.2

    def differences(self, a: int, b: int) -> int:
        """Most shingles in which similar sets of these sizes differ."""
        return (a + b) * (100 - self.share) // (100 + self.share)


@dataclass(frozen=True)
class Band:
    """Sizes from ``low`` to ``high``, and the segments that sets are compared in there."""

    number: int
    low: int
    high: int
    differences: int
    segments: int
    deletions: bool

    def spare(self) -> int:
        return 0 if self.deletions else self.segments - self.differences - 1


@lru_cache(maxsize=8)
def bands(settings: Settings, largest: int) -> tuple[Band, ...]:
    """Bands that cover the sizes 1 to ``largest``."""
    out: list[Band] = []
    low = 1
    while low <= largest:
        high = max(low, int(low * settings.growth) - 1)
        most = settings.differences(high, high * 100 // settings.share)
        plain, middle = most + 1, (low + high) / 2
        bare = plain * math.exp(-low / plain)  # segments expected to be empty
        plain += math.ceil(bare + 3 * math.sqrt(bare)) if most else 0
        deleted = -(-(most + 1) // 2)
        plain_cost = plain * (1 + settings.crowd * settings.likeness ** (middle / plain))
        deleted_cost = (deleted + middle) * (
            1 + settings.crowd * settings.likeness ** max(0.0, middle / deleted - 1))
        deletions = most > 0 and deleted_cost < plain_cost
        out.append(Band(len(out), low, high, most, deleted if deletions else plain, deletions))
        low = high + 1
    return tuple(out)


def bands_of(size: int, settings: Settings) -> list[Band]:
    """The bands in which a set of this size meets its partners: those of its least partner
    up to its own."""
    all_bands = bands(settings, 1 << max(8, size.bit_length()))
    least = -(-size * settings.share // 100)
    return [b for b in all_bands if b.low <= size and b.high >= least]


def _mixed(values: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit hashes of 64-bit numbers."""
    x = values.astype(_U64, copy=True)
    x ^= x >> _U64(33)
    x *= _U64(0xFF51AFD7ED558CCD)
    x ^= x >> _U64(33)
    x *= _U64(0xC4CEB9FE1A85EC53)
    x ^= x >> _U64(33)
    return x


class WordHashes(Memory):
    def __init__(self):
        super().__init__(60_000)  # hashing a word again is cheap

    def _compute(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_hashes(words: list[bytes], size: int, memory: WordHashes) -> np.ndarray:
    """Sorted hashes of the different shingles; of all words as one if there are fewer."""
    if not words:
        return np.empty(0, dtype=_U64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))],
                        dtype=_U64)
    hashes = np.fromiter(map(memory.__getitem__, words), dtype=_U64, count=len(words))
    count = len(words) - size + 1
    total = np.zeros(count, dtype=_U64)
    factor = 0x9E3779B97F4A7C15
    for i in range(size):
        total += hashes[i:i + count] * _U64(factor)
        factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1
    return np.unique(_mixed(total))


def index_entries(hashes: np.ndarray, settings: Settings) -> np.ndarray:
    """The hashes under which a set is indexed, as signed 64-bit numbers."""
    out = []
    for band in bands_of(len(hashes), settings):
        m = band.segments
        segment = ((hashes >> _U64(20)) % _U64(m)).astype(np.int64)
        count = np.bincount(segment, minlength=m)
        low = np.bincount(segment, weights=(hashes & _U64(0xFFFFFFFF)).astype(float), minlength=m)
        high = np.bincount(segment, weights=(hashes >> _U64(32)).astype(float), minlength=m)
        total = low.astype(_U64) + (high.astype(_U64) << _U64(32))
        salt = _mixed(np.arange(m, dtype=_U64) + _U64((band.number + 1) << 32))
        if band.deletions:
            out += [_mixed(total ^ salt), _mixed((total[segment] - hashes) ^ salt[segment])]
        elif m - np.count_nonzero(count) <= band.spare():
            out.append(_mixed(total ^ salt)[count > 0])
        else:
            out.append(_mixed(total ^ salt))
    return np.unique(np.concatenate(out)).view(np.int64)


def parity_bits(hashes: np.ndarray, bits: int = _BITS) -> np.ndarray:
    """How often each of so many hash values occurs, modulo two, 64 of them a number.

    Two sets differ in at least as many shingles as these bits differ. The bits of half as
    many values are the first half and the second half, one xor the other.
    """
    odd = np.bincount((hashes & _U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_bits(hashes: np.ndarray) -> np.ndarray | None:
    """Parity bits that tell large sets apart, at least one a shingle; none for others."""
    if len(hashes) <= _BITS:
        return None
    return parity_bits(hashes, 1 << (len(hashes) - 1).bit_length())


_SETS = ("key long, t1 long, t2 long, size long, set1 long, set2 long, "
         "bits array<long>, wide array<long>, entries array<long>")


def _set_rows(settings: Settings):
    """Arrow batches of (key, t1, t2, text) to rows of a set's size, prints and entries.

    Entries of a set that a task has met before are not listed again.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, seen = WordHashes(), set()
        for batch in in_portions(tidy(batches), "text", 1_000_000):
            sizes, set1, set2, bits, wide, entries = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(words_of(text), settings.words, memory)
                sizes.append(len(hashes))
                one = int(hashes.sum(dtype=_U64).astype(np.int64)) if len(hashes) else 0
                two = int(_mixed(hashes).sum(dtype=_U64).astype(np.int64)) if len(hashes) else 0
                set1.append(one)
                set2.append(two)
                if not len(hashes) or (one, two) in seen:
                    bits.append(None)
                    wide.append(None)
                    entries.append(None)
                    continue
                if len(seen) < 100_000:
                    seen.add((one, two))
                bits.append(parity_bits(hashes))
                wide.append(wide_bits(hashes))
                entries.append(index_entries(hashes, settings))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("t1"), batch.column("t2"),
                 pa.array(sizes, pa.int64()), pa.array(set1, pa.int64()),
                 pa.array(set2, pa.int64()), pa.array(bits, pa.list_(pa.int64())),
                 pa.array(wide, pa.list_(pa.int64())), pa.array(entries, pa.list_(pa.int64()))],
                names=["key", "t1", "t2", "size", "set1", "set2", "bits", "wide", "entries"])
    return run


def _verify(settings: Settings):
    """Arrow batches of (a, b, text_a, text_b) to the pairs (a, b) that are similar."""
    def shingles(text: str) -> set:
        words = words_of(text)
        n = settings.words
        if len(words) < n:
            return {tuple(words)}
        return set(zip(*(words[i:] for i in range(n)), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, set] = OrderedDict()  # hubs come in a row

        def of(node: int, text: str) -> set:
            if node not in known:
                known[node] = shingles(text)
                if len(known) > 4:
                    known.popitem(last=False)
            return known[node]

        for batch in tidy(batches):
            a, b = [], []
            for i in range(batch.num_rows):
                left, right, one, two = (batch.column(c)[i].as_py() for c in range(4))
                x, y = of(left, one), shingles(two)
                shared = len(x & y)
                if 100 * shared >= settings.share * (len(x) + len(y) - shared):
                    a.append(left)
                    b.append(right)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _few_differ(x: str, y: str, settings: Settings) -> str:
    return (f"aggregate(zip_with({x}, {y}, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x) "
            f"<= (x_size + y_size) * {100 - settings.share} div {100 + settings.share}")


def _possible(settings: Settings):
    """Whether sizes and parity bits leave it possible that two sets are similar."""
    return F.expr(f"""
        least(x_size, y_size) * 100 >= {settings.share} * greatest(x_size, y_size)
        AND {_few_differ("x_bits", "y_bits", settings)}""")


def _still_possible(pairs: DataFrame, wide: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (with sizes) that the wide bits of large sets do not tell apart.

    Bits are worth their shuffle: the texts that they save are a hundred times as long.
    """
    def folded(bits: str, other: str) -> str:
        half = f"cast(size({bits}) / 2 as int)"
        return (f"if(size({bits}) > size({other}), zip_with(slice({bits}, 1, {half}), "
                f"slice({bits}, {half} + 1, {half}), (a, b) -> a ^ b), {bits})")

    for side in ("x", "y"):
        pairs = pairs.join(wide.select(F.col("node").alias(f"{side}_node"),
                                       F.col("wide").alias(f"{side}_wide")),
                           f"{side}_node", "left")
    return pairs.where(f"""x_wide is null or y_wide is null or {_few_differ(
        folded("x_wide", "y_wide"), folded("y_wide", "x_wide"), settings)}""").drop(
        "x_wide", "y_wide")


def _side(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(*(F.col(c).alias(f"{side}_{c}") for c in
                          ("node", "size", "bits", "t1", "t2")))


def _similar(pairs: DataFrame, documents: DataFrame, text: str, settings: Settings) -> DataFrame:
    """The pairs (with both sides' nodes and text hashes) whose texts are similar, as (a, b)."""
    wanted = written(pairs.select(F.explode(F.array(
        F.struct(F.col("x_t1").alias("t1"), F.col("x_t2").alias("t2")),
        F.struct(F.col("y_t1").alias("t1"), F.col("y_t2").alias("t2")))).alias("t"))
        .select("t.*").distinct(), "texts-wanted")
    wanted = small_or_whole(wanted)
    texts = (documents.select(*_text_hashes(text), F.col(text).alias("text"))
             .join(wanted, ["t1", "t2"], "left_semi")
             .groupBy("t1", "t2").agg(F.first("text").alias("text")))
    texts = written(texts, "texts")
    for side in ("y", "x"):
        pairs = pairs.join(
            texts.select(F.col("t1").alias(f"{side}_t1"), F.col("t2").alias(f"{side}_t2"),
                         F.col("text").alias(f"{side}_text")),
            [f"{side}_t1", f"{side}_t2"])
    return pairs.select("x_node", "y_node", "x_text", "y_text").mapInArrow(
        _verify(settings), "a long, b long")


def _text_hashes(text: str) -> list:
    return [F.xxhash64(F.col(text), F.lit(1)).alias("t1"),
            F.xxhash64(F.col(text), F.lit(2)).alias("t2")]


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links, which are few: between components, not nodes."""
    ends = links
    for end in ("a", "b"):
        known = groups.select(F.col("node").alias(end), F.col("component").alias(f"{end}_group"))
        ends = ends.join(known, end, "left").withColumn(
            f"{end}_group", F.coalesce(f"{end}_group", end))
    ends = written(ends.select("a", "b", "a_group", "b_group"), "ends")
    above = components(ends.select(F.col("a_group").alias("a"), F.col("b_group").alias("b")))
    above = above.select(F.col("node").alias("component"), F.col("component").alias("top"))
    alone = ends.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.col("a_group").alias("component")),
        F.struct(F.col("b").alias("node"), F.col("b_group").alias("component")))).alias("n")
    ).select("n.*")
    return groups.unionAll(alone).distinct().join(above, "component", "left").select(
        "node", F.coalesce("top", "component").alias("component"))


def link_components(documents: DataFrame, settings: Settings = Settings(), *,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``n_shingles`` and ``component_id``.

    The component is the smallest key that links reach from the document, itself
    included. Words are what stands between ASCII white space, A-Z lower-cased. A text
    with fewer words than a shingle has is one shingle; a null text and one without words
    has none and is linked with nothing. Documents with equal sets are linked. Repeated
    rows are documents like any other; documents with a null key take part, and a
    component of null keys alone has a null id. Other columns are left out. An empty
    table gives an empty result.

    What is shuffled: index entries (two numbers each, about a sixth of the shingles at a
    similarity of 0.9), then only the sets that share an entry, and texts of candidates
    whose parity bits do not tell them apart, as many bits as a large set has shingles.
    Copies are one set. Text hashes of 128 bits find texts again; sets have a 128-bit
    print, the index 64 bits of it, and links are verified on the words themselves.
    """
    spark = documents.sparkSession
    ship(spark)
    sets = written(documents.select(
        F.col(key).cast("long").alias("key"), *_text_hashes(text), F.col(text).alias("text"))
        .mapInArrow(_set_rows(settings), _SETS), "sets")
    full = sets.where("size > 0")

    entries = full.select(F.col("set1").alias("node"), F.explode("entries").alias("entry"))
    bucket = Window.partitionBy("entry")
    shared = written(
        entries.select("entry", "node", F.min("node").over(bucket).alias("least"),
                       F.max("node").over(bucket).alias("most"),
                       F.count(F.lit(1)).over(bucket).alias("members"))
        .where("least < most").groupBy("entry", "node").agg(
            F.max("members").alias("members")), "shared")
    met = shared.select("node").distinct()
    nodes = written(full.where(F.col("entries").isNotNull()).withColumnRenamed("set1", "node")
                    .join(met, "node", "left_semi").groupBy("node")
                    .agg(F.min(F.struct("size", "bits", "t1", "t2")).alias("s"))
                    .select("node", "s.*"), "nodes")
    wide = full.where("wide is not null").withColumnRenamed("set1", "node").join(
        met, "node", "left_semi").groupBy("node").agg(F.min("wide").alias("wide"))
    wide = written(wide, "wide")

    # The hub of a bucket is the set that shares most with others: the middle of a group.
    weight = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    hubs = shared.join(weight, "node").groupBy("entry").agg(
        F.max(F.struct("weight", "node")).alias("hub")).select("entry", "hub.node")
    stars = (shared.select("entry", F.col("node").alias("y_node"))
             .join(hubs.withColumnRenamed("node", "x_node"), "entry")
             .where("x_node != y_node").select("x_node", "y_node").distinct())
    stars = written(stars.join(_side(nodes, "x"), "x_node").join(_side(nodes, "y"), "y_node")
                    .where(_possible(settings)).drop("x_bits", "y_bits"), "stars")
    near = written(_still_possible(stars, wide, settings), "near-stars")
    links = written(_similar(near, documents, text, settings), "similar")
    groups = components(links)

    # Whatever shares a bucket and is still apart.
    labelled = shared.join(groups, "node", "left").select(
        "entry", "node", F.coalesce("component", "node").alias("component"))
    apart = labelled.groupBy("entry").agg(
        F.min("component").alias("least"), F.max("component").alias("most")).where(
        "least < most").select("entry")
    members = written(labelled.join(apart, "entry", "left_semi")
                      .join(nodes.select("node", "size", "bits"), "node"), "apart")
    x = members.select("entry", *(F.col(c).alias(f"x_{c}") for c in
                                  ("node", "size", "bits", "component")))
    y = members.select("entry", *(F.col(c).alias(f"y_{c}") for c in
                                  ("node", "size", "bits", "component")))
    rest = (x.join(y, "entry").where(F.col("x_component") < F.col("y_component"))
            .where(_possible(settings)).select("x_node", "y_node").distinct())
    done = stars.select(F.least("x_node", "y_node").alias("l"),
                        F.greatest("x_node", "y_node").alias("g"))
    rest = rest.join(done, (F.least("x_node", "y_node") == F.col("l"))
                     & (F.greatest("x_node", "y_node") == F.col("g")), "left_anti")
    where = nodes.select("node", "size", "t1", "t2")
    for side in ("x", "y"):
        rest = rest.join(where.select(*(F.col(c).alias(f"{side}_{c}") for c in
                                        ("node", "size", "t1", "t2"))), f"{side}_node")
    rest = written(_still_possible(rest, wide, settings), "rest")
    more = written(_similar(rest, documents, text, settings), "similar")
    if not more.isEmpty():
        groups = _joined(groups, more)

    # Classes of equal sets, then the components of those that have links.
    named = sets.select("key", "size", "set1", "set2").join(
        groups.select(F.col("node").alias("set1"), "component"), "set1", "left").select(
        "key", "size", F.coalesce("component", "set1").alias("group1"),
        F.when(F.col("component").isNull(), F.col("set2")).otherwise(0).alias("group2"))
    # Written, so that the join beside it can be split where a group is large.
    least = written(named.where("size > 0").groupBy("group1", "group2").agg(
        F.min("key").alias("least")), "least")
    linked = named.where("size > 0").join(least, ["group1", "group2"]).select(
        "key", "size", F.col("least").alias("component_id"))
    alone = named.where("size = 0").select("key", "size", F.col("key").alias("component_id"))
    return linked.unionAll(alone).select(
        F.col("key").alias(key), F.col("size").alias("n_shingles"), "component_id")
