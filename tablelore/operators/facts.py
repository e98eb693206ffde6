"""The table of facts: what scans and people know about tables and columns.

One row is one written fact.  ``column_name`` is null for facts about a table;
``values`` holds lists, ``value`` everything else as text.  A fact with ``source`` and
``confidence`` was written by a scan, one without was typed by a person.  The log is
append-only; ``write_id`` grows with every write.  Filter to one connection first when
a log holds several.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.numbers import exact_round, share
from ..functions.text import has_content
from ..store import small_or_whole, written
from . import counts

LOG_SCHEMA = (
    "connection string, table_name string, column_name string, field string, "
    "value string, values array<string>, source string, confidence double, "
    "written_at timestamp, author string, session string, write_id bigint"
)
_KEY = ("table_name", "column_key", "field")
_BODY = ("value", "values", "source", "confidence", "written_at", "author", "session",
         "write_id")
# Renames up to this many travel inside the plan as a literal map, more are joined.
LITERAL_RENAMES = 1000


def by_scan(f: str = "") -> Column:
    """The fact carries provenance."""
    return F.col(f + "source").isNotNull() & F.col(f + "confidence").isNotNull()


def filled(f: str = "") -> Column:
    """The fact says something: not blank, not a placeholder, not an empty list."""
    return (F.coalesce(F.size(F.col(f + "values")) > 0, F.lit(False))
            | has_content(F.col(f + "value")))


def stored(f: str = "") -> Column:
    return F.col(f + "value").isNotNull() | F.col(f + "values").isNotNull()


def confidence_of(f: str = "") -> Column:
    """Scans state their confidence; a person's word counts 1, a placeholder 0."""
    return (F.when(by_scan(f), F.col(f + "confidence"))
            .when(filled(f), F.lit(1.0)).otherwise(F.lit(0.0)))


def is_human(f: str = "") -> Column:
    """Protected from scans: typed by a person or confirmed with full confidence."""
    return F.coalesce(confidence_of(f) >= 1.0, F.lit(False))


def shown_value(f: str = "") -> Column:
    """The value as later scans see it, null when there is none."""
    return F.when(has_content(F.col(f + "value")), F.trim(F.col(f + "value")))


def _keyed(facts: DataFrame) -> DataFrame:
    """Facts with the key of their column: its name in lower case, empty for the table."""
    return facts.withColumn("column_key", F.lower(F.coalesce("column_name", F.lit(""))))


def _folded(facts: DataFrame, name: str) -> DataFrame:
    """Key columns and one struct with the rest of the fact."""
    body = [c for c in _BODY if c in facts.columns]
    return _keyed(facts).select(*_KEY, F.struct("column_name", *body).alias(name))


def current_facts(log: DataFrame) -> DataFrame:
    """The last written fact per table, column and field."""
    rest = [c for c in log.columns if c not in ("table_name", "column_name", "field")]
    last = F.max(F.struct("write_id", *[c for c in rest if c != "write_id"], "column_name"))
    return _keyed(log).groupBy(*_KEY).agg(last.alias("f")).select(
        "table_name", "f.column_name", "field", *[F.col(f"f.{c}").alias(c) for c in rest]
    )


def decide_writes(current: DataFrame, updates: DataFrame, columns: DataFrame,
                  force: bool = False) -> DataFrame:
    """What applying ``updates`` would do, without doing it.

    ``columns`` lists the known ``(table_name, column_name)``.  Facts of a person stay
    unless ``force``; facts about unknown columns are skipped.
    """
    known = columns.select("table_name", F.lower("column_name").alias("column_key")
                           ).distinct().withColumn("known", F.lit(True))
    joined = (
        _keyed(updates).alias("u")
        .join(_folded(current, "old"), list(_KEY), "left")
        .join(known, ["table_name", "column_key"], "left")
    )
    unknown = F.col("column_name").isNotNull() & F.col("known").isNull()
    kept = is_human("old.") if not force else F.lit(False)
    reason = (F.when(unknown, "column_not_found")
              .when(F.coalesce(kept, F.lit(False)), "human_authored"))
    return (
        joined.withColumn("reason", reason)
        .withColumn("action", F.when(F.col("reason").isNull(), "written")
                    .otherwise("skipped"))
        .select("table_name", "column_name", "field", "value", "values", "confidence",
                "source", "action", "reason")
    )


def apply_updates(current: DataFrame, updates: DataFrame, columns: DataFrame,
                  write_id: int, written_at: Column, author: str = "unknown",
                  session: str | None = None, connection: str | None = None,
                  force: bool = False) -> DataFrame:
    """The log rows to append for ``updates``; append them to make the write happen."""
    return (
        decide_writes(current, updates, columns, force)
        .where(F.col("action") == "written")
        .select(
            F.lit(connection).cast("string").alias("connection"),
            "table_name", "column_name", "field", "value", "values", "source", "confidence",
            written_at.cast("timestamp").alias("written_at"),
            F.lit(author).alias("author"), F.lit(session).cast("string").alias("session"),
            F.lit(write_id).cast("bigint").alias("write_id"),
        )
    )


def refresh(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Facts after a new scan: machine fields from ``fresh``, human fields kept.

    ``fresh`` holds every column the table has now; columns it lacks disappear, and so
    do scan results that were not renewed.  Facts about a table stay unless ``fresh``
    renews a machine field or fills a gap.
    """
    live = _keyed(fresh).select("table_name", "column_key").distinct().withColumn(
        "live", F.lit(True))
    both = (
        _folded(current, "old").join(_folded(fresh, "new"), list(_KEY), "full")
        .join(live, ["table_name", "column_key"], "left")
    )
    field, old, new = F.col("field"), F.col("old"), F.col("new")
    of_table = F.col("column_key") == ""
    table_fact = F.when(
        field.isin(*fixed.MACHINE_TABLE_FIELDS) | old.isNull(), F.coalesce(new, old)
    ).otherwise(old)
    # Only fields a person may fill are seeded for a table.
    table_fact = F.when(
        old.isNull() & ~field.isin(*fixed.MACHINE_TABLE_FIELDS, *fixed.HUMAN_TABLE_FIELDS),
        F.lit(None)).otherwise(table_fact)
    column_fact = F.when(F.col("live").isNotNull(), F.when(
        field.isin(*fixed.HUMAN_COLUMN_FIELDS), F.coalesce(old, new)).otherwise(new))
    chosen = F.when(of_table, table_fact).otherwise(column_fact)
    return both.withColumn("f", chosen).where(F.col("f").isNotNull()).select(
        "table_name", "f.column_name", "field",
        *[F.col(f"f.{c}").alias(c) for c in _BODY if c in current.columns])


def _importable(field: Column, of_table: Column) -> Column:
    never = (*fixed.MACHINE_TABLE_FIELDS, *fixed.IDENTITY_TABLE_FIELDS)
    return F.when(of_table, ~field.isin(*never)).otherwise(
        ~field.isin(*fixed.MACHINE_COLUMN_FIELDS, "name"))


def merge_decisions(
    local: DataFrame, incoming: DataFrame, strategy: str = "keep_higher",
    status: DataFrame | None = None,
) -> DataFrame:
    """One decision per incoming fact: write or skip, and why.

    ``strategy`` is ``keep_higher`` (confidence, then the later write), ``theirs`` or
    ``mine``.  ``status`` is the result of ``diff.fingerprint_status``: when a table's
    schema drifted, facts about columns unknown here are skipped.  Machine fields
    describe the other database and are never taken.
    """
    _known_strategy(strategy)
    decided = _decided(local, incoming, strategy, status).where(
        F.col("inc").isNotNull() & F.col("importable"))
    return decided.select(
        "table_name", "inc.column_name", "field", "v.action", "v.reason",
        *[F.col(f"inc.{c}").alias(c) for c in _BODY if c in incoming.columns],
        confidence_of("loc.").alias("local_confidence"),
        confidence_of("inc.").alias("incoming_confidence"))


def _sides(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per table, column and field with both sides' facts, each read once.

    ``has_column`` tells whether the local side knows the column; the facts of a column
    meet for that and are then folded where they are.
    """
    def side(facts: DataFrame, name: str, other: str) -> DataFrame:
        kinds = {c: f.dataType for d in (local, incoming) for c, f in
                 ((f.name, f) for f in d.schema.fields) if c in _BODY}
        body = [(F.col(c) if c in facts.columns else F.lit(None)).cast(kinds[c]).alias(c)
                for c in _BODY if c in kinds]
        own = F.struct("column_name", *body)
        return _keyed(facts).select(
            *_KEY, own.alias(name), F.when(F.lit(False), own).alias(other),
            F.lit(name == "loc").alias("is_local"))

    both = side(local, "loc", "inc").unionByName(side(incoming, "inc", "loc"))
    column = Window.partitionBy("table_name", "column_key")
    return both.withColumn("has_column", F.max("is_local").over(column)).groupBy(*_KEY).agg(
        F.max("loc").alias("loc"), F.max("inc").alias("inc"),
        F.max("has_column").alias("has_column"))


def _decided(local: DataFrame, incoming: DataFrame, strategy: str,
             status: DataFrame | None) -> DataFrame:
    """Both sides of every fact with the verdict ``v`` on the incoming one."""
    of_table = F.col("column_key") == ""
    joined = _sides(local, incoming).withColumn(
        "importable", _importable(F.col("field"), of_table))
    drifted = F.lit(False)
    if status is not None:
        drift = written(status.select(
            "table_name", (F.col("status") == "drift").alias("drift")), "status")
        joined = joined.join(small_or_whole(drift), "table_name", "left")
        drifted = F.coalesce("drift", F.lit(False))
    new_column = ~of_table & ~F.col("has_column")

    ours, theirs = confidence_of("loc."), confidence_of("inc.")
    newer = F.coalesce(F.col("inc.written_at") > F.col("loc.written_at"), F.lit(False))
    no_local = F.col("loc").isNull() | ~stored("loc.") | (ours == 0.0)
    wins = {
        "theirs": F.lit(True),
        "mine": F.lit(False),
        "keep_higher": (theirs > ours) | ((theirs == ours) & newer),
    }[strategy]
    verdict = (
        F.when(new_column & drifted, F.struct(F.lit("skip").alias("action"),
                                              F.lit("schema_drift").alias("reason")))
        .when(new_column, _verdict("write", "new_column"))
        .when(~stored("inc."), _verdict("skip", None))
        .when(no_local | wins, _verdict("write", strategy))
        .otherwise(_verdict("skip", "local_wins") if strategy == "mine" else
                   F.when(ours > theirs, _verdict("skip", "local_higher_confidence"))
                   .otherwise(_verdict("skip", "local_newer")))
    )
    return joined.withColumn("v", verdict)


def _known_strategy(strategy: str) -> str:
    if strategy not in ("keep_higher", "theirs", "mine"):
        raise ValueError(f"unknown merge strategy {strategy!r}")
    return strategy


def _verdict(action: str, reason: str | None) -> Column:
    return F.struct(F.lit(action).alias("action"),
                    F.lit(reason).cast("string").alias("reason"))


def merge(local: DataFrame, incoming: DataFrame, strategy: str = "keep_higher",
          status: DataFrame | None = None) -> DataFrame:
    """Local facts after the merge; each side is read once."""
    body = [c for c in _BODY if c in local.columns and c in incoming.columns]
    taken = (F.col("inc").isNotNull() & F.col("importable")
             & (F.col("v.action") == "write"))
    both = _decided(local, incoming, _known_strategy(strategy), status)
    return both.withColumn("f", F.when(taken, F.col("inc")).otherwise(F.col("loc"))).where(
        F.col("f").isNotNull()).select(
        "table_name", "f.column_name", "field", *[F.col(f"f.{c}").alias(c) for c in body])


def best_of_bundles(bundles: DataFrame) -> DataFrame:
    """The strongest fact per table, column and field over any number of bundles.

    Confidence decides, then the later write, then the bundle name.  The choice is an
    aggregate, so a field present in every bundle shrinks before it is shuffled.
    """
    rest = [c for c in bundles.columns if c not in ("table_name", "column_name", "field")]
    best = F.max(F.struct(confidence_of().alias("_c"), F.col("written_at").alias("_w"),
                          F.col("bundle").alias("_b"), *rest))
    return bundles.where(stored()).groupBy("table_name", "column_name", "field").agg(
        best.alias("f")
    ).select("table_name", "column_name", "field", *[F.col(f"f.{c}").alias(c) for c in rest])


def undo(log: DataFrame, writes: int = 1) -> DataFrame:
    """The log without the last ``writes`` writes of every table."""
    if writes < 1:
        return log
    ids = log.select("table_name", "write_id").distinct()
    cut = (
        counts.first_per_group(ids, ["table_name"], [F.desc("write_id")], writes)
        .groupBy("table_name").agg(F.min("write_id").alias("cut"))
    )
    # One row per table beside a log that one table may fill.
    return log.join(small_or_whole(written(cut, "cuts")), "table_name").where(
        F.col("write_id") < F.col("cut")).drop("cut")


def redact(facts: DataFrame) -> DataFrame:
    """Facts without the data-revealing fields of columns marked as personal."""
    keys = ["table_name", "column_key"]
    personal = _keyed(facts.where(
        (F.col("field") == "pii") & (F.lower("value") == "true")
        & F.col("column_name").isNotNull())).select(*keys).distinct().withColumn(
        "personal", F.lit(True))
    revealing = F.col("field").isin(*fixed.REDACTED_FIELDS) & F.col("personal").isNotNull()
    return _keyed(facts).join(personal, keys, "left").where(
        ~F.coalesce(revealing, F.lit(False))).select(*facts.columns)


def rename_tables(facts: DataFrame, names: Mapping[str, str] | DataFrame) -> DataFrame:
    """Facts under the table names of the importing side.

    ``names`` is a mapping or, for many tables, a frame ``(source, target)``.
    """
    if isinstance(names, DataFrame):
        pairs = written(names.select(F.col("source").alias("table_name"), "target"), "names")
        renamed = facts.join(small_or_whole(pairs), "table_name", "left")
        return renamed.withColumn(
            "table_name", F.coalesce("target", "table_name")).drop("target")
    if len(names) > LITERAL_RENAMES:
        return rename_tables(facts, facts.sparkSession.createDataFrame(
            list(names.items()), "source string, target string"))
    if not names:
        return facts
    literal = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return facts.withColumn("table_name", F.coalesce(
        F.element_at(literal, F.col("table_name")), F.col("table_name")))


def completeness(current: DataFrame, as_of: Column) -> DataFrame:
    """How well each table is described, worst first, and which columns lack what.

    Half the score is described columns, three tenths the listed values of columns that
    could list them, two tenths the age of the last write.
    """
    def value(name: str) -> Column:
        return F.max(F.when(F.col("field") == name, F.col("value")))

    of_column = F.col("column_name").isNotNull()
    per_column = (
        _keyed(current).groupBy("table_name", "column_key")
        .agg(
            F.max(of_column).alias("of_column"),
            F.max((F.col("field") == "description") & is_human()).alias("described"),
            value("type").alias("type"),
            value("distinct_count").try_cast("double").alias("distinct"),
            F.max((F.col("field") == "valid_values") & filled()).alias("listed"),
            F.max("written_at").alias("written_at"),
            F.max("column_name").alias("column_name"),
        )
    )
    text = F.lit(False)
    for word in fixed.TEXT_TYPE_WORDS:
        text = text | F.contains(F.upper("type"), F.lit(word))
    target = F.coalesce(text & (F.col("distinct") > 1)
                        & (F.col("distinct") <= fixed.VALID_VALUES_CEILING), F.lit(False))
    column = F.col("of_column")

    def names(which: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(which, F.col("column_name"))))

    # The lists hold columns of one table.
    totals = per_column.groupBy("table_name").agg(
        names(column & ~F.coalesce("described", F.lit(False))).alias("missing_descriptions"),
        names(column & target & ~F.coalesce("listed", F.lit(False))).alias(
            "missing_valid_values"),
        F.count_if(column).alias("column_count"),
        F.count_if(column & F.col("described")).alias("described"),
        F.count_if(column & target).alias("valid_values_targets"),
        F.count_if(column & target & F.col("listed")).alias("listed"),
        F.max("written_at").alias("written_at"),
    )

    def covered(part: str, whole: str) -> Column:
        return F.coalesce(share(F.col(part), F.col(whole)), F.lit(100.0))

    days = F.greatest(F.lit(0.0), F.timestamp_diff(
        "MICROSECOND", F.col("written_at").cast("timestamp"), as_of.cast("timestamp"))
        / F.lit(86_400_000_000.0))
    fresh = F.coalesce(freshness_credit(days), F.lit(0.0))
    score = (
        F.lit(fixed.DESCRIPTION_WEIGHT) * (covered("described", "column_count") / 100.0)
        + F.lit(fixed.VALID_VALUES_WEIGHT) * (covered("listed", "valid_values_targets") / 100.0)
        + F.lit(fixed.FRESHNESS_WEIGHT) * fresh
    )
    return totals.select(
        "table_name", exact_round(score, 2).alias("score"), "column_count",
        exact_round(covered("described", "column_count"), 1).alias("column_description_pct"),
        exact_round(covered("listed", "valid_values_targets"), 1).alias(
            "valid_values_coverage_pct"),
        "valid_values_targets", exact_round(days, 1).alias("freshness_days"),
        "missing_descriptions", "missing_valid_values",
    ).orderBy("score", "table_name")


def freshness_credit(days: Column) -> Column:
    """1 up to a week, falling in a straight line to 0 at ninety days."""
    return (
        F.when(days <= fixed.FRESH_DAYS, F.lit(1.0))
        .when(days >= fixed.STALE_DAYS, F.lit(0.0))
        .when(days.isNotNull(),
              F.lit(1.0) - (days - fixed.FRESH_DAYS) / (fixed.STALE_DAYS - fixed.FRESH_DAYS))
    )


def average_score(scores: DataFrame) -> DataFrame:
    return scores.agg(exact_round(F.avg("score"), 2).alias("average_score"),
                      F.count(F.lit(1)).alias("table_count"))
