"""A stored inverted index for lexical search.

The index holds, for every term and every block of a few thousand neighbouring documents,
one row with the documents of the block that have the term, how often, their lengths, and
the highest share of a score that the term has in any of them. Rows are sorted and split by
term, so a query reads the rows of its terms alone; and it first reads only the highest shares, which
bound what a block can score. The best blocks are scored whole, and then only the blocks
whose bound reaches the score of the last document found so far. The order is the same as
that of scoring every document.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..functions.text import terms
from ..store import written
from .search import query_terms

#: Documents of a block, and folders that terms are dealt into.
BLOCK_DOCUMENTS = 4_096
_FOLDERS = 64
#: Scores are ordered by three decimals.
_ROUNDING = 0.002
#: Postings that one task of a build sorts.
_TASK_POSTINGS = 2_000_000
# Documents by their place in the block; what makes up their shares as whole numbers, which
# shuffle and store in a fraction of the bytes.
_TERMS = ("term string, block long, documents long, highest double, places array<int>, "
          "counts array<int>, lengths array<bigint>, folder int")


def _folder_of(term):
    return F.pmod(F.xxhash64(term), F.lit(_FOLDERS)).cast("int")


def _share(tf, length, average):
    """What a term gives to the score of a document but for its weight."""
    norm = fixed.BM25_K1 * (1.0 - fixed.BM25_B + fixed.BM25_B * length / average)
    return tf * (fixed.BM25_K1 + 1) / (tf + norm)


def _average(totals) -> float:
    return totals["length"] / max(totals["documents"], 1) or 1.0


def _runs(sorted_terms):
    """The distinct terms of a sorted array and how often each occurs, as two arrays."""
    n = F.size(sorted_terms)
    begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (
        F.get(sorted_terms, i - 1) != F.get(sorted_terms, i - 2)))
    ends = F.concat(F.slice(begins, F.lit(2), n), F.array(n + 1))
    return F.when(n > 0, F.struct(
        F.transform(begins, lambda i: F.get(sorted_terms, i - 1)).alias("terms"),
        F.zip_with(ends, begins, lambda e, b: e - b).alias("counts")))


def build_index(docs: DataFrame, weights: Mapping[str, int], key: Sequence[str],
                folder: str) -> None:
    """Write the index of ``docs`` into ``folder``, which must not exist yet.

    ``weights`` maps text columns to the weight of their terms, ``key`` names the columns
    that searches return. Every row is a document; null texts have no terms. Terms are
    counted in the row of their document, which is written with them instead of its texts.
    Then whole documents are shuffled by block, and a block's rows of a few numbers a
    document into the order of terms; no group is larger than a block, however common a
    term is.
    """
    spark = docs.sparkSession
    found = [terms(F.col(f"`{c}`")) for c in weights]
    # A weight of two counts a term twice.
    weighed = [t if w == 1 else F.flatten(F.array_repeat(t, w))
               for t, w in zip(found, weights.values(), strict=True)]
    # Numbers are given once and stored; neighbours in the table are neighbours in blocks.
    stored = docs.select(*(F.col(f"`{c}`") for c in key), F.sort_array(
        weighed[0] if len(weighed) == 1 else F.concat(*weighed)).alias("_all")).withColumn(
        "_doc", F.monotonically_increasing_id())
    numbered = written(stored.select(
        *(F.col(f"`{c}`") for c in key), "_doc", F.size("_all").cast("bigint").alias("_len"),
        _runs(F.col("_all")).alias("_runs")), "numbered")
    numbered.select("_doc", "_len", *(F.col(f"`{c}`") for c in key)).write.parquet(
        f"{folder}/documents")
    spark.read.parquet(f"{folder}/documents").agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("_len"), F.lit(0)).alias("length")).write.parquet(f"{folder}/totals")
    totals = spark.read.parquet(f"{folder}/totals").first()
    # A document's postings are no more than its length.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                totals["length"] // _TASK_POSTINGS + 1)
    block = F.floor(F.col("_doc") / BLOCK_DOCUMENTS)
    postings = numbered.select("_len", block.alias("block"), F.pmod(
        "_doc", F.lit(BLOCK_DOCUMENTS)).cast("int").alias("place"), "_runs").repartition(
        tasks, "block").select("block", "place", "_len", F.inline(F.arrays_zip(
            F.col("_runs.terms").alias("term"), F.col("_runs.counts").alias("tf"))))
    # The lists of a group are of the same rows in the same order.
    blocks = postings.toDF("block", "place", "_len", "term", "tf").groupBy("block", "term").agg(
        F.count(F.lit(1)).alias("documents"),
        F.max(_share(F.col("tf"), F.col("_len"), _average(totals))).alias("highest"),
        F.collect_list("place").alias("places"), F.collect_list("tf").alias("counts"),
        F.collect_list("_len").alias("lengths"))
    blocks.withColumn("folder", _folder_of(F.col("term"))).repartitionByRange(
        "folder", "term", "block").sortWithinPartitions("folder", "term", "block").write.partitionBy(
        "folder").parquet(f"{folder}/terms")


def _postings(spark: SparkSession, folder: str, asked: Sequence[str]) -> DataFrame:
    """The rows of the asked terms; other folders and row groups are not read."""
    names = spark.createDataFrame([(t,) for t in asked], "term string")
    folders = sorted({r[0] for r in names.select(_folder_of(F.col("term"))).collect()})
    rows = spark.read.schema(_TERMS).parquet(f"{folder}/terms")
    return rows.where(F.col("folder").isin(folders) & F.col("term").isin(list(asked)))


def search_index(spark: SparkSession, folder: str, query: str, limit: int = 5,
                 order: Sequence[str] = (), texts: DataFrame | None = None,
                 excerpt: str | None = None) -> DataFrame:
    """The best documents of a stored index: key columns, ``score`` and ``matched_terms``.

    Scores, rounding and order are those of ``rank_documents``; documents without any term
    of the query are not found. With ``texts`` and ``excerpt``, a table that has the key
    columns and a text column of it, documents whose text holds the whole query get the
    bonus for that; only texts of documents that the bonus could carry in are looked at.
    Keys must be unique for that. ``order`` names key columns that break ties.
    """
    asked = query_terms(query)
    distinct = list(dict.fromkeys(asked))
    documents = spark.read.parquet(f"{folder}/documents")
    key = [c for c in documents.columns if c not in ("_doc", "_len")]
    nothing = documents.limit(0).select(*key, F.lit(0.0).alias("score"), F.array().cast(
        "array<string>").alias("matched_terms"))
    if not distinct or limit <= 0:
        return nothing
    rows = _postings(spark, folder, distinct)
    totals = spark.read.parquet(f"{folder}/totals").first()
    n, average = totals["documents"], _average(totals)
    found = {r["term"]: r["documents"] for r in rows.groupBy("term").agg(
        F.sum("documents").alias("documents")).collect()}  # a row per asked term
    if not found:
        return nothing
    idf = {t: asked.count(t) * F.log(F.lit(1.0 + (n - df + 0.5) / (df + 0.5)))
           for t, df in found.items()}
    weight = reduce(lambda so_far, t: so_far.when(F.col("term") == t, idf[t]), found,
                    F.when(F.lit(False), F.lit(0.0)))
    weighed = rows.withColumn("weight", weight)
    bounds = written(weighed.groupBy("block").agg(
        F.sum(F.col("weight") * F.col("highest")).alias("bound")), "bounds")

    def scored(blocks: DataFrame) -> DataFrame:
        entries = weighed.join(blocks.select("block"), "block", "left_semi").select(
            "term", "weight", "block", F.inline(F.arrays_zip("places", "counts", "lengths")))
        share = _share(F.col("counts"), F.col("lengths"), average)
        return entries.groupBy((F.col("block") * BLOCK_DOCUMENTS + F.col("places")).alias(
            "_doc")).agg(
            F.sum(F.col("weight") * share).alias("_raw"),
            F.collect_set("term").alias("_terms"))

    # Each block holds a document at least, so the best blocks hold as many as asked for.
    best = scored(bounds.orderBy(F.desc("bound"), "block").limit(limit)).orderBy(
        F.desc("_raw")).limit(limit).agg(F.min("_raw").alias("least"),
                                         F.count(F.lit(1)).alias("n")).first()
    bonus = fixed.EXCERPT_CONTAINS_BONUS if excerpt and texts is not None else 0.0
    least = (best["least"] if best["n"] == limit else 0.0) - bonus - _ROUNDING
    hopeful = scored(bounds.where(F.col("bound") >= least)).where(F.col("_raw") >= least)
    named = hopeful.join(documents, "_doc")
    extra = F.lit(0.0)
    if bonus:
        hopeful = written(named, "hopeful")
        own = texts.select(*(F.col(f"`{c}`") for c in key), F.contains(
            F.lower(F.coalesce(F.col(f"`{excerpt}`"), F.lit(""))),
            F.lit(query.lower().strip())).alias("_whole"))
        named = hopeful.join(own.where("_whole"), key, "left")
        extra = F.when(F.col("_whole"), bonus).otherwise(0.0)
    matched = F.filter(F.lit(distinct), lambda t: F.array_contains("_terms", t))
    return named.withColumn("score", F.round(F.col("_raw") + extra, 3)).orderBy(
        F.desc("score"), *order).limit(limit).select(
        *key, "score", matched.alias("matched_terms"))
