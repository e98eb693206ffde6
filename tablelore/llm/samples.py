"""Bounded samples of labelled texts."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Sample:
    """Hashes of the sampled texts by label, and how many labelled rows there are in all."""

    seed: int
    hashes: dict[str, list[int]]
    totals: Counter

    def labels_of(self) -> dict[int, list[str]]:
        out: dict[int, list[str]] = {}
        for label, hashes in self.hashes.items():
            for h in hashes:
                out.setdefault(h, []).append(label)
        return out


def text_hash(text: str, seed: int) -> Column:
    return F.xxhash64(F.col(text), F.lit(seed))


def choose(labelled: DataFrame, per_label: int, seed: int) -> Sample:
    """At most ``per_label`` different texts of each label, from rows of (label, h).

    ``h`` is the seeded hash of a text; the texts with the smallest hashes are taken, so
    equal texts count once and the choice depends on nothing but texts and labels. Only
    hashes are shuffled, and each task keeps at most ``per_label`` of a label.
    """
    counted = labelled.dropna().groupBy("label", "h").agg(F.count(F.lit(1)).alias("rows"))
    smallest = Window.partitionBy("label").orderBy("h")
    picked = (counted.withColumn("nth", F.row_number().over(smallest))
              .where(F.col("nth") <= per_label).select("label", "h").collect())
    totals = Counter({r["label"]: r["rows"] for r in
                      labelled.dropna().groupBy("label").agg(
                          F.count(F.lit(1)).alias("rows")).collect()})
    hashes: dict[str, list[int]] = {}
    for r in picked:
        hashes.setdefault(r["label"], []).append(r["h"])
    return Sample(seed, {k: sorted(v) for k, v in sorted(hashes.items())}, totals)


def sampled_texts(documents: DataFrame, sample: Sample, text: str = "text") -> DataFrame:
    """The sampled texts, each once, as rows of (h, text)."""
    spark = documents.sparkSession
    wanted = spark.createDataFrame([(h,) for h in sample.labels_of()], "h long")
    # The sample bounds the broadcast side.
    return (documents.select(F.col(text).alias("text"))
            .withColumn("h", text_hash("text", sample.seed))
            .join(F.broadcast(wanted), "h", "left_semi")
            .dropDuplicates(["h"]).select("h", "text"))


def labelled_hashes(documents: DataFrame, labels: DataFrame, seed: int, *,
                    key: str = "doc_id", label: str, text: str = "text") -> DataFrame:
    """(label, h) of every labelled document; only keys and hashes are joined."""
    return documents.where(F.col(text).isNotNull()).select(
        F.col(key).alias("key"), text_hash(text, seed).alias("h")).join(
        labels.select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"))
        .dropna(), "key").select("label", "h")
