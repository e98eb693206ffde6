"""Documents that contain a benchmark item, up to a budget of edits.

Text and items are compared as lower-case letters and digits with single blanks between
words. An item may be changed by as many edits as its budget, a share of its length. It
is split into one piece more than that, so one piece at least is untouched wherever the
item occurs: an automaton of all pieces finds exact hits, and Myers' bit-parallel edit
distance then verifies the item around each hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import portions
from .workers import ship, tidy


@dataclass(frozen=True)
class Settings:
    """Edits allowed per character of an item, and the shortest item that may be changed.

    Items of fewer than ``least_chars`` normalised characters are searched for as whole
    words and without edits. ``items_per_block`` bounds the automaton of one pass.
    """

    error_rate: float = 0.07
    least_chars: int = 20
    items_per_block: int = 5000

    def budget(self, chars: int) -> int:
        return int(chars * self.error_rate) if chars >= self.least_chars else 0


#: Runs of characters are gathered for stretches of a text that begin at multiples of this.
_STRETCH = 1_024
#: ASCII characters that are neither letter nor digit become blanks.
_BLANKS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_WORD = re.compile(r"(?:[^\W_]|[^\x00-\x7f])+")


def normal(text: str) -> str:
    data = text.lower().encode("utf-8", "replace").translate(_BLANKS)
    return b" ".join(data.split()).decode("utf-8")


def edit_masks(pattern: str) -> dict[str, int]:
    """For each character the positions it has in the pattern, as bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def nearest(masks: dict[str, int], length: int, text: str, anchored: bool = False
            ) -> tuple[int, int]:
    """Least edit distance of a pattern to a stretch of ``text``, and where it ends first.

    With ``anchored`` the stretch must begin where the text does.
    """
    full, high, carry = (1 << length) - 1, 1 << (length - 1), int(anchored)
    plus, minus, score = full, 0, length
    best, end = length, 0
    for at, c in enumerate(text, 1):
        same = masks.get(c, 0)
        down = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up_plus = minus | ~(across | plus) & full
        up_minus = plus & across
        if up_plus & high:
            score += 1
        elif up_minus & high:
            score -= 1
        up_plus = (up_plus << 1 | carry) & full
        up_minus = up_minus << 1 & full
        plus = up_minus | ~(down | up_plus) & full
        minus = up_plus & down
        if score < best:
            best, end = score, at
    return best, end


def grams(text: str) -> set[str]:
    """All runs of three characters; an edit takes three of them at most."""
    return {text[i:i + 3] for i in range(len(text) - 2)}


@dataclass(frozen=True)
class Match:
    item: int
    distance: int
    budget: int
    begin: int
    end: int


class ItemFinder:
    """Pieces of many items in one automaton, and the verification around their hits.

    Where many items begin alike, a hit of what they share is a hit of all of them. The
    distance is only computed where enough of an item's runs of three characters are near.
    """

    def __init__(self, items: Iterable[tuple[int, str]], settings: Settings):
        self._items: list[tuple[int, str, int, dict[str, int], set[str]]] = []
        self._least = settings.least_chars
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            pattern = normal(text)
            if not pattern:
                continue
            budget = settings.budget(len(pattern))
            at = len(self._items)
            self._items.append((item, pattern, budget, edit_masks(pattern), grams(pattern)))
            edges = [len(pattern) * i // (budget + 1) for i in range(budget + 2)]
            for begin, end in zip(edges, edges[1:], strict=False):
                pieces.setdefault(pattern[begin:end], []).append((at, begin))
        self._automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self._automaton.add_word(piece, (len(piece), tuple(places)))
        if pieces:
            self._automaton.make_automaton()

    def matches(self, text: str | None) -> list[Match]:
        """The best match of each item in a text, with its span in normalised characters."""
        if not text or not self._items:
            return []
        plain = normal(text)
        starts: dict[int, set[int]] = {}
        for last, (length, places) in self._automaton.iter(plain):
            for at, begin in places:
                starts.setdefault(at, set()).add(last + 1 - length - begin)
        found = []
        near: dict[tuple[int, int], set[str]] = {}
        for at, where in starts.items():
            item, pattern, budget, masks, own = self._items[at]
            if len(pattern) < self._least:
                begin = next((b for b in sorted(where) if _whole_words(
                    plain, b, b + len(pattern))), None)
                if begin is not None:
                    found.append(Match(item, 0, 0, begin, begin + len(pattern)))
                continue
            best: tuple[int, int] | None = None
            for low, high in _runs(sorted(where), 2 * budget):
                low, high = max(0, low - budget), high + len(pattern) + budget
                around = low // _STRETCH, -(-high // _STRETCH)
                if around not in near:
                    near[around] = grams(plain[around[0] * _STRETCH:around[1] * _STRETCH])
                if len(own - near[around]) > 3 * budget:
                    continue
                distance, end = nearest(masks, len(pattern), plain[low:high])
                if distance <= budget and (best is None or distance < best[0]):
                    best = distance, low + end
            if best:
                distance, end = best
                back = plain[max(0, end - len(pattern) - budget):end][::-1]
                _, size = nearest(edit_masks(pattern[::-1]), len(pattern), back, True)
                found.append(Match(item, distance, budget, end - size, end))
        return sorted(found, key=lambda m: m.item)


def _whole_words(plain: str, begin: int, end: int) -> bool:
    return plain[begin - 1:begin] in ("", " ") and plain[end:end + 1] in ("", " ")


def _runs(sorted_values: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """First and last of each run of values that are at most ``gap`` apart."""
    first = last = sorted_values[0]
    for value in sorted_values[1:]:
        if value - last > gap:
            yield first, last
            first = value
        last = value
    yield first, last


def original_span(text: str, begin: int, end: int) -> tuple[int, int]:
    """The span of ``text`` whose words have the normalised characters from begin to end.

    The span takes in whole words.
    """
    at, first, last = 0, None, 0
    for word in _WORD.finditer(text):
        size = len(normal(word.group()))
        if at + size > begin and first is None:
            first = word.start()
        if at < end:
            last = word.end()
        at += size + 1
    return (first or 0), last


@lru_cache(maxsize=1)
def _finder(items: tuple[tuple[int, str], ...], settings: Settings) -> ItemFinder:
    return ItemFinder(items, settings)


_MATCHES = T.ArrayType(T.StructType([
    T.StructField("item", T.LongType()), T.StructField("distance", T.LongType()),
    T.StructField("budget", T.LongType()), T.StructField("begin", T.LongType()),
    T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in
                             ("item", "distance", "budget", "begin", "end")]))


def match_column(spark, text: Column, items: tuple[tuple[int, str], ...],
                 settings: Settings) -> Column:
    """Array of the matches of a block of items in a column of texts."""
    ship(spark)
    shared = spark.sparkContext.broadcast(items)  # at most items_per_block

    @F.arrow_udf(_MATCHES)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = _finder(shared.value, settings)
        for batch in tidy(batches):
            rows = []
            for low, high in portions(batch):
                for text in batch[low:high].to_pylist():
                    found = []
                    for m in finder.matches(text):
                        begin, end = original_span(text, m.begin, m.end)
                        found.append({"item": m.item, "distance": m.distance,
                                      "budget": m.budget, "begin": begin, "end": end})
                    rows.append(found)
            yield pa.array(rows, _ARROW)

    return find(text)


def item_blocks(items: DataFrame, settings: Settings, *, item: str = "item_id",
                text: str = "text") -> Iterator[tuple[tuple[int, str], ...]]:
    """The items in blocks that a pass can hold; null ids and texts are left out."""
    rows = items.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")
                        ).dropna().distinct()
    block: list[tuple[int, str]] = []
    for row in rows.toLocalIterator():
        block.append((row["item"], row["text"]))
        if len(block) == settings.items_per_block:
            yield tuple(sorted(block))
            block = []
    if block:
        yield tuple(sorted(block))


_NO_MATCHES = ("doc_id long, item_id long, distance long, budget long, begin long, end long")


def find_items(documents: DataFrame, items: DataFrame, settings: Settings = Settings(), *,
               key: str = "doc_id", text: str = "text", item: str = "item_id",
               item_text: str = "text") -> DataFrame:
    """One row per document and item that it contains: ``key``, ``item``, ``distance``,
    ``budget``, ``begin``, ``end`` (code points of the text, whole words).

    Of several occurrences the nearest counts, then the first. Documents without a match
    have no row; null and empty texts and items never match, nor do items without a letter
    or digit; short items match as whole words, without edits. Repeated documents keep
    their rows, repeated items count once, null keys stay. Extra columns are left out.
    Empty tables give an empty result. Whole texts are searched, in one pass over the
    documents per block of items; nothing is shuffled but the items.
    """
    spark = documents.sparkSession
    found = None
    for block in item_blocks(items, settings, item=item, text=item_text):
        part = documents.select(key, match_column(
            spark, F.col(text), block, settings).alias("found")).select(
            key, F.explode("found").alias("m"))
        found = part if found is None else found.unionAll(part)
    if found is None:
        kind = documents.schema[key].dataType.simpleString()
        return spark.createDataFrame([], _NO_MATCHES.replace("doc_id long", f"{key} {kind}")
                                     .replace("item_id", item))
    return found.select(key, F.col("m.item").alias(item), "m.distance", "m.budget",
                        "m.begin", "m.end")


def drop_contaminated(documents: DataFrame, items: DataFrame, settings: Settings = Settings(),
                      *, text: str = "text", item: str = "item_id",
                      item_text: str = "text") -> DataFrame:
    """The documents that contain no item; columns and repeated rows stay as they are."""
    spark = documents.sparkSession
    for block in item_blocks(items, settings, item=item, text=item_text):
        documents = documents.where(
            F.size(match_column(spark, F.col(text), block, settings)) == 0)
    return documents
