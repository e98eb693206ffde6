"""A training corpus from raw documents, in five stages.

Each stage takes the session, the documents its predecessor kept and the folder of the
input tables, and returns a DataFrame; its rows are written and read again for the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelore.llm import (
    decontaminate,
    jaccard,
    language,
    packing,
    quality_rules,
)
from tablelore.llm.frames import fresh
from tablelore.llm.queries import fold, table, tokenizer_file
from tablelore.store import shared_folder, small_or_whole, written

#: Below this a text is as near to a second language as to the first.
LEAST_LANGUAGE_SCORE = 0.505


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cross-parsing tells; others, and those without letters, go.

    The model learns from the documents of the learning folds. Columns stay as they are.
    """
    model = language.learn(docs.where(fold(4) != 2))
    return language.keep_identified(docs, model, least_score=LEAST_LANGUAGE_SCORE)


def well_formed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the learned decision list."""
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, rules)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, 0.8 alike.

    Rows are compared, not ids: the row with the smallest id of a group stays, of several
    texts under one id any one, and one of rows that repeat. Null ids name no document, so
    of a group's rows without id one stays, too. Rows without words are in no group and
    stay. A row is known by a 64-bit hash of its id and text.
    """
    row = fresh(docs, "row_key")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    docs = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    found = written(jaccard.link_components(docs, key=row).where("n_shingles > 0").select(
        F.col(row).alias("row"), "component_id"), "groups")
    ids = docs.select(F.col(row).alias("row"), F.col("doc_id").alias("id")).distinct()
    named = written(found.distinct().join(ids, "row"), "named")
    first = named.groupBy("component_id", F.col("id").isNull().alias("nameless")).agg(
        F.min(F.struct("id", "row")).alias("least")).select("least.row")
    beaten = small_or_whole(written(named.select(F.col("row").alias(row)).join(
        first.withColumnRenamed("row", row), row, "left_anti"), "beaten"))
    repeated = small_or_whole(written(found.groupBy(F.col("row").alias(row)).count().where(
        "count > 1").select(row), "repeated"))
    docs = docs.join(beaten, row, "left_anti")
    once = docs.join(repeated, row, "left_semi").dropDuplicates([row])
    return docs.join(repeated, row, "left_anti").select(*columns).unionAll(
        once.select(*columns))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its budget of edits."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", identified),
    ("quality_rules", well_formed),
    ("near_duplicates", unlike),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

#: Learned models, an exact similarity join and a tokenizer are not to be said in SQL; the
#: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/tablelore-pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
