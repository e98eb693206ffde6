"""Current facts from a stored fold of the log and the writes since.

A snapshot is what ``current_facts`` says up to one write id, with the last write ids of
every table. Folding later writes on top gives the same facts as folding the whole log,
so a scan starts from the newest snapshot and reads only the end of the log. Snapshots
are folders named by their write id; older ones may be deleted at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..store import small_or_whole, written
from . import counts
from .facts import current_facts, undo

#: Write ids kept for every table: as many writes can be undone without the whole log.
KEPT_WRITES = 50


def snapshots(spark: SparkSession, folder: str) -> list[int]:
    """Write ids of the finished snapshots in a folder, oldest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = path(folder)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    names = [s.getPath().getName() for s in system.listStatus(root)]
    # The facts are written last, so a snapshot that has them all is whole.
    return sorted(int(n[5:]) for n in names if n.startswith("upto-")
                  and system.exists(path(f"{folder}/{n}/facts/_SUCCESS")))


def _stored(log: DataFrame, folder: str) -> tuple[int, DataFrame, DataFrame] | None:
    """Write id, facts and kept write ids of the newest snapshot."""
    spark = log.sparkSession
    found = snapshots(spark, folder)
    if not found:
        return None
    at = f"{folder}/upto-{found[-1]}"
    return found[-1], spark.read.parquet(f"{at}/facts"), spark.read.parquet(f"{at}/ids")


def _folded(log: DataFrame, facts: DataFrame | None) -> DataFrame:
    """Facts of a log on top of facts of earlier writes; their order of writes is kept."""
    return current_facts(log if facts is None else facts.select(*log.columns).unionByName(log))


def _last_ids(log: DataFrame, ids: DataFrame | None, writes: int) -> DataFrame:
    """The last ``writes`` write ids of every table."""
    seen = log.select("table_name", "write_id")
    if ids is not None:
        seen = seen.unionByName(ids.select("table_name", "write_id"))
    return counts.first_per_group(
        seen.distinct(), ["table_name"], [F.desc("write_id")], writes).select(
        "table_name", "write_id")


def store_snapshot(log: DataFrame, folder: str) -> int | None:
    """Store the facts of all writes so far; the write id they go up to.

    Only writes after the newest snapshot are read. Nothing is stored, and nothing
    returned but the newest id, if there are none.
    """
    before = _stored(log, folder)
    tail = log if before is None else log.where(F.col("write_id") > before[0])
    upto = tail.agg(F.max("write_id")).collect()[0][0]
    if upto is None:
        return before[0] if before else None
    # Writes that come in meanwhile belong to the next snapshot.
    tail = tail.where(F.col("write_id") <= upto)
    at = f"{folder}/upto-{upto}"
    _last_ids(tail, before and before[2], KEPT_WRITES).write.mode("overwrite").parquet(
        f"{at}/ids")
    _folded(tail, before and before[1]).write.mode("overwrite").parquet(f"{at}/facts")
    return upto


def facts_now(log: DataFrame, folder: str) -> DataFrame:
    """``current_facts(log)``, from the newest snapshot and the writes since.

    Without a snapshot the whole log is folded. The log must not have lost writes that a
    snapshot holds; delete snapshots beyond the write id to which a log was cut back.
    """
    stored = _stored(log, folder)
    if stored is None:
        return current_facts(log)
    upto, facts, _ = stored
    return _folded(log.where(F.col("write_id") > upto), facts)


def facts_undone(log: DataFrame, folder: str, writes: int = 1) -> DataFrame:
    """``current_facts(undo(log, writes))`` from the newest snapshot.

    Tables whose undone writes all came after the snapshot need only the end of the log.
    Of the others the log is read again, and of it their rows alone are folded. More
    writes than a snapshot keeps ids of are undone on the whole log.
    """
    stored = _stored(log, folder)
    if stored is None or writes > KEPT_WRITES:
        return current_facts(undo(log, writes))
    if writes < 1:
        return facts_now(log, folder)
    upto, facts, ids = stored
    tail = log.where(F.col("write_id") > upto)
    # One row per table.
    cuts = written(_last_ids(tail, ids, writes).groupBy("table_name").agg(
        F.min("write_id").alias("cut")), "cuts")
    recent = small_or_whole(written(cuts.where(F.col("cut") > upto), "recent-cuts"))
    kept = tail.join(recent, "table_name").where("write_id < cut").drop("cut")
    old = cuts.where(F.col("cut") <= upto)
    if not old.isEmpty():
        kept = kept.unionByName(log.join(
            small_or_whole(written(old, "old-cuts")), "table_name").where(
            "write_id < cut").drop("cut").select(*kept.columns))
    return _folded(kept, facts.join(recent.drop("cut"), "table_name", "left_semi"))
