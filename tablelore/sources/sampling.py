"""Samples of a table, taken only when the caller asks for one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from ..store import written

# Random keys are below this; histograms have so many bins, and the last one is read when it
# holds few keys. Bin edges are doubles, exact to a few hundred.
_KEYS = 1 << 62
_BINS = 1_000
_FEW = 10_000
_SLACK = 1 << 10
# Rows of a file that a block sample keeps or leaves together.
BLOCK_ROWS = 1_000
_SLOTS = 1_000_000


@dataclass(frozen=True)
class Scan:
    """What a recipe reads: the whole table or a sample of it.

    ``row_count`` is the true size of the table when it is known.
    """

    data: DataFrame
    row_count: int | None = None
    sampled: bool = False
    sample_size: int | None = None


def _place(df: DataFrame, *numbers: Column) -> Column | None:
    """A hash of where a row stands in its file, if the frame comes from files.

    A file is known by its length and the lasting part of its name, so the hashes stay when
    the table is moved or written again alike.
    """
    try:
        meta = df.metadataColumn("_metadata")
        # What follows the number of a part is new whenever a table is written.
        place = F.xxhash64(F.substring_index(meta["file_name"], "-", 2), meta["file_size"],
                           *(numbers or (meta["row_index"],)))
        df.select(place).schema  # resolves the hidden column or raises
    except AnalysisException:
        return None
    return place


def _row_key(df: DataFrame, seed: int) -> Column:
    """A seeded random number from 0 to 2^62 for each row, the same in every run."""
    place = _place(df)
    if place is None:
        place = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    return F.shiftrightunsigned(F.xxhash64(place, F.lit(seed)), 2)


def _nth_key(keys: DataFrame, n: int, total: int) -> tuple[int, int]:
    """The n-th smallest key, and how many of the rows that hold it are among the first n.

    A histogram of a thousand bins brackets it, first around where it is expected, then
    again within the bin that holds it, until that bin's keys are few or all the same.
    """
    expected, around = n / total, 6 * (n / total / total) ** 0.5 + 1e-12
    low = max(0, int((expected - around) * _KEYS))
    high = min(_KEYS, int((expected + around) * _KEYS) + 1)
    key = F.col("key")
    while True:
        width = max(1, -(-(high - low) // _BINS))
        place = F.when(key < low, -1).when(key >= high, _BINS).otherwise(
            F.floor((key - low) / F.lit(float(width))))
        counted = {r["bin"]: r["n"] for r in keys.groupBy(place.alias("bin")).agg(
            F.count(F.lit(1)).alias("n")).collect()}
        below, chosen = counted.pop(-1, 0), None
        if below < n:
            for number in sorted(counted):
                if below + counted[number] >= n:
                    chosen = number
                    break
                below += counted[number]
        if chosen is None or chosen == _BINS:
            if (low, high) == (0, _KEYS):
                return _KEYS, 0  # fewer rows than were said
            low, high = 0, _KEYS  # not where it was expected
            continue
        # Bins are told by doubles, so the edges are taken one key wider on both sides.
        first = low + chosen * width
        if counted[chosen] <= _FEW or width == 1:
            bin_keys = keys.where(key.between(first - _SLACK, first + width + _SLACK) & (
                place == chosen)).groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy("key")
            for row in bin_keys.toLocalIterator():
                if below + row["n"] >= n:
                    return row["key"], n - below
                below += row["n"]
        low, high = max(0, first - _SLACK), min(_KEYS, first + width + _SLACK)


def sample_rows(df: DataFrame, n: int, total: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows of a table of ``total`` rows, every row with the same chance.

    Each row has a seeded random key, and the rows with the smallest keys are taken: two
    small histograms tell the last key, so nothing is sorted or shuffled and the sample
    stays spread over the tasks that read the table. Rows of files are known by their place,
    so the same rows come back however the files are split; other rows by what they hold,
    so copies come together as far as the size allows.
    """
    if n <= 0:
        raise ValueError(f"sample size must be positive, got {n}")
    if n >= total:
        return df
    key = _row_key(df, seed)
    keys = df.select(key.alias("key"))
    last, of_last = _nth_key(keys, n, total)
    drawn = df.where(key <= last)
    if keys.where(F.col("key") == last).count() == of_last:
        return drawn
    return df.where(key < last).unionAll(df.where(key == last).limit(of_last))


def percent_sample(df: DataFrame, percent: float, seed: int = 0) -> DataFrame:
    return df.sample(min(percent / 100, 1.0), seed)


def block_sample(df: DataFrame, percent: float, seed: int = 0,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """About ``percent`` of the blocks of ``block_rows`` neighbouring rows of all files.

    Blocks are chosen by a hash of their file and place, so files count by their rows
    and the same blocks come back however the table is split. They also come
    back after the table has been moved or written again alike. A frame that does not come
    from Parquet files is thinned row by row.
    """
    if _place(df) is None:
        return percent_sample(df, percent, seed)
    block = F.floor(df.metadataColumn("_metadata")["row_index"] / block_rows)
    chosen = F.pmod(F.xxhash64(_place(df, block), F.lit(seed)), F.lit(_SLOTS))
    return df.where(chosen < int(min(percent / 100, 1.0) * _SLOTS))


def modulus_sample(df: DataFrame, key: Column, n: int, total: int) -> DataFrame:
    """Every m-th key, m = total / n: repeatable and taken without a sort.

    An integer key is used as it is; hash other keys first, for example with
    ``F.xxhash64``. All matching rows are kept.
    """
    if n <= 0:
        raise ValueError(f"sample size must be positive, got {n}")
    return df.where(F.pmod(key, F.lit(max(total // n, 1))) == 0)


def plan_scan(df: DataFrame, sample: int | None = None, no_sample: bool = False,
              seed: int = 0) -> Scan:
    """The whole table, or ``sample`` of its rows if that is asked for.

    Without ``sample``, or with ``no_sample``, everything is read, however large the table
    is. A sample is drawn once and written to the shared folder, so all passes of a recipe
    read the same few rows; for that the table is counted, which for Parquet reads footers.
    """
    if no_sample or sample is None:
        return Scan(df)
    total = df.count()
    if sample >= total:
        return Scan(df, total)
    return Scan(written(sample_rows(df, sample, total, seed), "sample"), total, True, sample)
