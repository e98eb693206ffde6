"""Collocations from a weighted de Bruijn graph of words.

Texts are cut into pieces at punctuation. The nodes of the graph are runs of three words,
its edges runs of four, weighted by how often they occur; an edge leads from its first
three words to its last three. Only edges are counted in the texts, with what the last
words of every piece lack: the count of a shorter run is the weight that flows out of it,
plus the pieces that end with it.

Before that, pieces are cut where two neighbouring words stand together too rarely to be in
any candidate. No run that can become one is cut by that, so the counts of those that remain
are exact. Rare pairs are told by a filter of fixed size over the hashes of all pairs; a
hash that two pairs share can only keep a rare one.

Nodes that all occurrences enter by one edge and leave by one are no branches: chains of
them are compacted to one path with one weight, and the edges are read from the paths.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.counts import first_per_group
from ..store import written
from .batches import in_portions
from .tokens import Memory
from .workers import ship, tidy

#: Words of an edge.
WORDS = 4
_END = b"\xff"
_U64 = np.uint64


@dataclass(frozen=True)
class Settings:
    """``least`` is the count of a candidate, ``covered`` of 100 the share of its
    occurrences inside a longer one that makes it superfluous, ``top`` the phrases of a
    language, ``scale`` the number that the score is counted in.

    The filter of pairs has ``2 ** filter_bits`` bits (16 MB); where more pairs are
    frequent than that it keeps rare ones, too, which are then counted for nothing.
    """

    least: int = 30
    covered: int = 80
    top: int = 2_000
    scale: int = 2_000_000
    filter_bits: int = 27


def _letters() -> bytes:
    """What each byte of a text becomes: A-Z lower-cased, separators of pieces, blanks."""
    table = bytearray(range(256))
    for upper in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[upper] = upper + 32
    for mark in b".,;:!?\n\x0b\x0c\r":
        table[mark] = _END[0]
    table[ord("\t")] = ord(" ")
    return bytes(table)


_LETTERS = _letters()


def words_of(text: str) -> list[bytes]:
    """The words of a text, and an end mark after every piece.

    Blanks and tabs are all that is left of white space, and no text holds the mark's byte.
    """
    raw = text.encode("utf-8", "replace").translate(_LETTERS) + _END
    return raw.replace(_END, b" " + _END + b" ").split()


class _Hashes(Memory):
    def __init__(self):
        super().__init__(100_000)

    def _compute(self, word: bytes) -> int:
        return 0 if word == _END else xxhash.xxh3_64_intdigest(word) | 1


def _hashes(words: list[bytes], memory: _Hashes) -> np.ndarray:
    """Word hashes; 0 for an end mark."""
    return np.fromiter(map(memory.__getitem__, words), dtype=_U64, count=len(words))


def _pairs(hashes: np.ndarray, lang: str) -> np.ndarray:
    """40-bit hashes of neighbouring words in a language, as signed numbers."""
    salt = _U64(xxhash.xxh3_64_intdigest(lang.encode()) | 1)
    mixed = (hashes[:-1] ^ salt) * _U64(0x9E3779B97F4A7C15) + hashes[1:]
    mixed ^= mixed >> _U64(29)
    mixed *= _U64(0xBF58476D1CE4E5B9)
    return (mixed >> _U64(24)).view(np.int64)


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """The words of bounded portions of rows, language by language."""
    for batch in in_portions(tidy(batches), "text", 4_000_000):
        texts: dict[str, list[bytes]] = defaultdict(list)
        for lang, text in zip(batch.column("lang").to_pylist(),
                              batch.column("text").to_pylist(), strict=True):
            texts[lang] += words_of(text or "")
        yield from texts.items()


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair hashes with their counts in a portion."""
    memory = _Hashes()
    for lang, words in _by_language(batches):
        hashes = _hashes(words, memory)
        inside = (hashes[:-1] != 0) & (hashes[1:] != 0)
        pairs, counts = np.unique(_pairs(hashes, lang)[inside], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts.astype(np.int64))],
                                         names=["pair", "f"])


def _frequent(texts: DataFrame, settings: Settings) -> np.ndarray:
    """Bits of the filter that are set by pairs whose hash is frequent enough."""
    bits = settings.filter_bits
    counted = texts.mapInArrow(_pair_rows, "pair long, f long").groupBy("pair").agg(
        F.sum("f").alias("f")).where(F.col("f") >= settings.least)
    # A row for each 64 bits at most, however many pairs are frequent.
    slot = F.col("pair").bitwiseAND((1 << bits) - 1)
    rows = counted.select(F.shiftright(slot, 6).alias("word"),
                          F.expr("shiftleft(1L, cast(pair & 63 as int))").alias("bit")
                          ).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(1 << max(0, bits - 6), dtype=np.int64)
    found = rows.toArrow()
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table


_GRAMS = "lang string, size int, words string, f long"


def _gram_rows(table, settings: Settings):
    """Edges, the last words of pieces, and the words of a portion, each with its count.

    Sizes 1 to 3 are last words, 4 are edges, 0 counts all words. Inside a portion words
    are numbered, so runs of words are compared as exact pairs of numbers.
    """
    def counted(keys: np.ndarray, at: np.ndarray):
        """First positions and counts of different keys; ``keys`` belong to ``at``."""
        _, first, counts = np.unique(keys, return_index=True, return_counts=True)
        return at[first], counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, bits = _Hashes(), table.value
        mask = (1 << settings.filter_bits) - 1
        for lang, words in _by_language(batches):
            hashes = _hashes(words, memory)
            real = hashes != 0
            sizes, grams, counts = [0], [b""], [int(real.sum())]
            pair = _pairs(hashes, lang)
            joined = real[:-1] & real[1:]
            slot = pair & mask
            joined &= ((bits[slot >> 6] >> (slot & 63)) & 1).astype(bool)
            number: dict[bytes, int] = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for w in words),
                              dtype=np.int64, count=len(words))
            # Two words as one number, then two of these pairs numbered anew.
            two = (ids[:-1] << 32) | ids[1:]
            _, two = np.unique(two, return_inverse=True)
            n = len(words)
            starts = {1: real, 2: joined}
            starts[3] = joined[:-1] & joined[1:]
            starts[4] = starts[3][:-1] & joined[2:] if n > 3 else np.zeros(0, bool)
            keys = {1: ids, 2: two, 3: (two[:-1] << 32) | ids[2:],
                    4: (two[:-2] << 32) | two[2:] if n > 3 else np.zeros(0, np.int64)}
            last = np.ones(n, bool)  # words that nothing joins to the next one
            last[:-1] = ~joined
            for size in range(1, WORDS + 1):
                chosen = starts[size]
                if size < WORDS:
                    chosen = chosen & last[size - 1:]
                at = np.flatnonzero(chosen)
                first, f = counted(keys[size][at], at)
                sizes += [size] * len(first)
                grams += [b" ".join(words[i:i + size]) for i in first.tolist()]
                counts += f.tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(sizes), pa.string()), pa.array(sizes, pa.int32()),
                 pa.array(grams, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())],
                names=["lang", "size", "words", "f"])
    return run


def _firsts(count: int):
    return F.substring_index("words", " ", count)


def _lasts(count: int):
    return F.substring_index("words", " ", -count)


@dataclass(frozen=True)
class Graph:
    """Everything counted: ``grams`` (lang, size, words, f) of frequent runs, the ``paths``
    that chains of edges are compacted to, and ``totals`` (lang, n)."""

    grams: DataFrame
    paths: DataFrame
    totals: DataFrame


def _compacted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Frequent edges (lang, words, f) as paths (lang, words, f), a chain a path.

    A node continues a chain if the edge before it, the edge after it and the node itself
    have one count. Each edge learns the head of its chain by looking twice as far back in
    every round. A path has a thousand edges at most; longer chains are several paths.
    """
    flow = nodes.select("lang", F.col("words").alias("node"), F.col("f").alias("flow"))

    def at(node):
        return edges.select("lang", "words", "f", node.alias("node")).join(
            flow, ["lang", "node"]).where("f = flow").select("lang", "node", "words", "f")

    into = at(_lasts(WORDS - 1)).withColumnRenamed("words", "before")
    out = at(_firsts(WORDS - 1)).withColumnRenamed("words", "edge")
    links = into.join(out, ["lang", "node", "f"]).select("lang", "edge", "before")
    state = written(edges.select("lang", F.col("words").alias("edge"), "f").join(
        links, ["lang", "edge"], "left").select(
        "lang", "edge", "f", F.coalesce("before", "edge").alias("head"),
        F.col("before").isNotNull().cast("long").alias("steps")), "chains")
    while True:
        back = state.select("lang", F.col("edge").alias("head"), F.col("head").alias("further"),
                            F.col("steps").alias("more"))
        state = written(state.join(back, ["lang", "head"]).select(
            "lang", "edge", "f", F.col("further").alias("head"),
            (F.col("steps") + F.col("more")).alias("steps"), "more"), "chains")
        moved = state.where("more > 0").isEmpty()
        state = state.drop("more")
        if moved:
            break
    parted = state.withColumn("part", (F.col("steps") / 1000).cast("long"))
    chains = parted.groupBy("lang", "head", "part").agg(
        F.first("f").alias("f"), F.sort_array(F.collect_list(F.struct("steps", "edge"))).alias("l"))
    following = F.transform("l", lambda s: F.substring_index(s["edge"], " ", -1))
    return chains.select("lang", F.concat_ws(
        " ", F.col("l")[0]["edge"],
        F.array_join(F.slice(following, 2, 1000), " ")).alias("words"), "f").select(
        "lang", F.rtrim("words").alias("words"), "f")


def graph(documents: DataFrame, settings: Settings = Settings(), *, lang: str = "lang",
          text: str = "text") -> Graph:
    """The frequent part of the word graph of each language.

    Null languages are ``und``, null and empty texts have no words. Texts count whole, and
    repeated rows count each. Other columns are left out; an empty table gives empty tables.
    A task holds the words of four million bytes of text or of one longer text at a time.
    What is shuffled: 40-bit hashes of neighbouring words with their counts in a task, then
    runs of up to four words without rare neighbours, and the words that end pieces.
    """
    spark = documents.sparkSession
    ship(spark)
    texts = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                             F.col(text).alias("text"))
    bits = spark.sparkContext.broadcast(_frequent(texts, settings))  # of fixed size
    counted = written(texts.mapInArrow(_gram_rows(bits, settings), _GRAMS).groupBy(
        "lang", "size", "words").agg(F.sum("f").alias("f")), "grams")
    totals = counted.where("size = 0").select("lang", F.col("f").alias("n"))
    often = F.col("f") >= settings.least
    flows = {WORDS: counted.where(f"size = {WORDS}").select("lang", "words", "f")}
    for size in range(WORDS - 1, 0, -1):
        ends = counted.where(f"size = {size}").select("lang", "words", "f")
        flows[size] = written(
            flows[size + 1].select("lang", _firsts(size).alias("words"), "f").unionAll(ends)
            .groupBy("lang", "words").agg(F.sum("f").alias("f")), f"flow-{size}")
    edges = flows[WORDS].where(often)
    paths = written(_compacted(edges, flows[WORDS - 1]), "paths")
    word = F.split("words", " ")
    in_paths = paths.select("lang", "f", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(word) - WORDS + 1),
        lambda i: F.array_join(F.slice(word, i, WORDS), " "))).alias("words"))
    grams = in_paths.select("lang", F.lit(WORDS).alias("size"), "words", "f")
    for size in range(1, WORDS):
        grams = grams.unionAll(flows[size].where(often).select(
            "lang", F.lit(size).alias("size"), "words", "f"))
    return Graph(written(grams, "frequent"), paths, totals)


def collocations(documents: DataFrame, settings: Settings = Settings(), *, lang: str = "lang",
                 text: str = "text") -> DataFrame:
    """The best phrases of two to four words of each language.

    Columns: ``lang``, ``rank``, ``phrase``, ``a`` (its count), ``l`` and ``r`` (the counts
    of its two parts at the weakest cut, the first one of equals), ``n`` (words of the
    language) and ``score``, ``scale * a / (l + r)`` rounded down. Phrases whose words lie
    in a longer candidate nearly as often are left out. Ties of the score go to the higher
    count, then to the smaller phrase by its bytes. Nulls, empty texts and the like are as
    in ``graph``.
    """
    found = graph(documents, settings, lang=lang, text=text)
    grams = found.grams
    phrases = grams.where("size > 1")
    counts = grams.select("lang", F.col("words").alias("part"), F.col("f").alias("part_f"))
    cuts = phrases.select("lang", "size", F.col("words").alias("phrase"), F.col("f").alias("a"),
                          F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    words = F.split("phrase", " ")
    for name, part in (("l", F.slice(words, 1, F.col("k"))),
                       ("r", F.slice(words, F.col("k") + 1, F.col("size")))):
        cuts = cuts.withColumn("part", F.array_join(part, " ")).join(
            counts, ["lang", "part"]).withColumnRenamed("part_f", name).drop("part")
    exact = "cast({} as decimal(20, 0))"
    score = F.expr(f"({exact.format('a')} * {exact.format(settings.scale)}) div "
                   f"({exact.format('l')} + {exact.format('r')})")
    weakest = cuts.groupBy("lang", "phrase", "size", "a").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", "size", "a", "cut.score", "cut.l", "cut.r")
    inner = phrases.where("size > 2").select("lang", F.col("f").alias("longer"), F.explode(
        F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(
            F.sequence(F.lit(1), F.col("size") - s + 1),
            lambda i: F.array_join(F.slice(F.split("words", " "), i, s), " "))))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = weakest.join(most, ["lang", "phrase"], "left").where(F.expr(
        f"longer is null or 100 * {exact.format('longer')} < "
        f"{settings.covered} * {exact.format('a')}"))
    # Ranks are cut in every task before they are shuffled.
    ranked = first_per_group(
        kept, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], settings.top)
    return ranked.join(found.totals, "lang").select(
        "lang", F.col("rank_in_group").cast("long").alias("rank"), "phrase", "a", "l", "r",
        "n", "score")
