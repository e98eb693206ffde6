import datetime

import pytest
from conftest import by
from pyspark.sql import functions as F

from tablelore.operators import facts as f
from tablelore.operators import knowledge as k
from tablelore.operators.columns import column_categories
from tablelore.operators.profile import profile
from tablelore.operators.quality import quality
from tablelore.plans import recipes

SCHEMA = ("table_name string, column_name string, field string, value string, "
          "values array<string>, source string, confidence double, written_at timestamp, "
          "author string, session string, write_id bigint")


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


@pytest.fixture
def facts(frame):
    """Facts given as (column, field, value or list, confidence or None, day)."""
    def build(rows, table="t"):
        out = []
        for i, (column, field, value, confidence, when) in enumerate(rows):
            listed = isinstance(value, list)
            out.append((table, column, field, None if listed else value,
                        value if listed else None,
                        None if confidence is None else "scan", confidence, day(when),
                        "ann", None, i))
        return frame(SCHEMA, out)
    return build


def decided(df):
    return {(r.column_name, r.field): (r.action, r.reason) for r in df.collect()}


# --- writing ----------------------------------------------------------------------

def test_people_are_protected(facts, frame):
    current = facts([
        ("a", "description", "typed", None, 0), ("b", "description", "<description>", None, 0),
        ("c", "description", "  ", None, 0), ("d", "description", "scanned", 0.8, 0),
        ("e", "description", "confirmed", 1.0, 0), ("f", "valid_values", [], None, 0),
        ("g", "valid_values", ["x"], None, 0)])
    updates = facts([(c, "valid_values" if c in "fg" else "description", "new", 0.9, 1)
                     for c in "abcdefg"] + [("zz", "temporal", "true", 0.9, 1),
                                            (None, "notes", "n", 0.5, 1)])
    columns = frame("table_name string, column_name string", [("t", c) for c in "abcdefg"])
    got = decided(f.decide_writes(current, updates, columns))
    kept = ("skipped", "human_authored")
    assert got["a", "description"] == kept and got["e", "description"] == kept
    assert got["g", "valid_values"] == kept
    for column in "bcd":
        assert got[column, "description"] == ("written", None)
    assert got["f", "valid_values"] == ("written", None)
    assert got["zz", "temporal"] == ("skipped", "column_not_found")
    assert got[None, "notes"] == ("written", None)
    forced = decided(f.decide_writes(current, updates, columns, force=True))
    assert forced["a", "description"] == ("written", None)
    assert forced["zz", "temporal"] == ("skipped", "column_not_found")


def test_apply_appends_and_the_last_write_counts(facts, frame):
    log = facts([("a", "temporal", "false", 0.5, 0)])
    columns = frame("table_name string, column_name string", [("t", "a")])
    rows = f.apply_updates(f.current_facts(log), facts([("a", "temporal", "true", 0.9, 0)]),
                           columns, 7, F.lit("2024-02-01"), author="bob", session="s1")
    row = rows.collect()[0]
    assert (row.author, row.session, row.write_id, row.value) == ("bob", "s1", 7, "true")
    now = f.current_facts(log.unionByName(rows.drop("connection"))).collect()
    assert [(r.value, r.write_id) for r in now] == [("true", 7)]


def test_undo_goes_back_per_table(facts):
    log = facts([("a", "pii", "1", 0.5, 0), ("a", "pii", "2", 0.5, 1), ("a", "pii", "3", 0.5, 2)])
    other = facts([("a", "pii", "x", 0.5, 0)], table="u")
    both = log.unionByName(other)
    for writes, expected in ((0, {"t": "3", "u": "x"}), (1, {"t": "2"}), (2, {"t": "1"}),
                             (9, {})):
        got = {r.table_name: r.value for r in f.current_facts(f.undo(both, writes)).collect()}
        assert got == expected


def test_refresh_keeps_people_and_drops_the_vanished(facts):
    current = facts([
        ("a", "description", "typed", None, 0), ("a", "distinct_count", "3", None, 0),
        ("a", "temporal", "true", 0.9, 0), ("gone", "description", "bye", None, 0),
        (None, "data_owner", "Ann", None, 0), (None, "row_count", "10", None, 0)])
    fresh = facts([
        ("a", "description", "<description>", None, 1), ("a", "distinct_count", "4", None, 1),
        ("new", "description", "<description>", None, 1), (None, "row_count", "12", None, 1),
        (None, "data_owner", "<data_owner>", None, 1), (None, "notes", "", None, 1)])
    got = {(r.column_name, r.field): r.value for r in f.refresh(current, fresh).collect()}
    assert got == {
        ("a", "description"): "typed", ("a", "distinct_count"): "4",
        ("new", "description"): "<description>", (None, "row_count"): "12",
        (None, "data_owner"): "Ann", (None, "notes"): ""}


# --- merging ----------------------------------------------------------------------

def test_merge_rules(facts):
    local = facts([
        ("a", "description", "low", 0.5, 5), ("b", "description", "high", 0.9, 5),
        ("c", "description", "old", 0.7, 1), ("d", "description", "newer", 0.7, 9),
        ("e", "description", "typed", None, 5), ("f", "description", "<todo>", None, 5),
        ("a", "min_val", "1", None, 5)])
    incoming = facts([
        ("a", "description", "x", 0.8, 5), ("b", "description", "x", 0.8, 9),
        ("c", "description", "x", 0.7, 5), ("d", "description", "x", 0.7, 5),
        ("e", "description", "x", 0.9, 9), ("f", "description", "x", 0.1, 0),
        ("a", "pii", "true", 0.2, 5), ("z", "description", "x", 0.8, 5),
        ("a", "min_val", "0", None, 5), ("b", "pii", None, 0.8, 5), (None, "notes", "n", None, 1),
        (None, "row_count", "5", None, 1)])
    got = decided(f.merge_decisions(local, incoming))
    assert got == {
        ("a", "description"): ("write", "keep_higher"),
        ("b", "description"): ("skip", "local_higher_confidence"),
        ("c", "description"): ("write", "keep_higher"),
        ("d", "description"): ("skip", "local_newer"),
        ("e", "description"): ("skip", "local_higher_confidence"),
        ("f", "description"): ("write", "keep_higher"),
        ("a", "pii"): ("write", "keep_higher"),
        ("z", "description"): ("write", "new_column"),
        ("b", "pii"): ("skip", None),
        (None, "notes"): ("write", "keep_higher")}
    assert decided(f.merge_decisions(local, incoming, "theirs"))["b", "description"] == (
        "write", "theirs")
    assert decided(f.merge_decisions(local, incoming, "mine"))["a", "description"] == (
        "skip", "local_wins")
    merged = {(r.column_name, r.field): r.value for r in f.merge(local, incoming).collect()}
    assert merged["a", "description"] == "x" and merged["b", "description"] == "high"
    assert merged["a", "min_val"] == "1" and merged["z", "description"] == "x"
    with pytest.raises(ValueError):
        f.merge_decisions(local, incoming, "coin toss")


def test_drift_skips_unknown_columns(facts, frame):
    status = frame("table_name string, status string", [("t", "drift")])
    got = decided(f.merge_decisions(facts([("a", "pii", "true", 0.5, 0)]),
                                    facts([("z", "pii", "true", 0.5, 0),
                                           ("a", "pii", "false", 0.6, 0)]), status=status))
    assert got["z", "pii"] == ("skip", "schema_drift")
    assert got["a", "pii"] == ("write", "keep_higher")


def test_best_of_many_bundles(facts):
    bundles = facts([("a", "pii", "1", 0.5, 9), ("a", "pii", "2", 0.8, 1),
                     ("a", "pii", "3", 0.8, 2),
                     ("a", "pii", None, 1.0, 9)]).withColumn("bundle", F.lit("b"))
    assert [r.value for r in f.best_of_bundles(bundles).collect()] == ["3"]


def test_redact_and_rename(facts):
    df = facts([("a", "pii", "TRUE", None, 0), ("a", "sample_values", "x", None, 0),
                ("a", "description", "d", None, 0), ("a", "valid_values", ["q"], None, 0),
                ("b", "pii", "false", None, 0), ("b", "sample_values", "y", None, 0)])
    left = {(r.column_name, r.field) for r in f.redact(df).collect()}
    assert left == {("a", "pii"), ("a", "description"), ("b", "pii"), ("b", "sample_values")}
    assert {r.table_name for r in f.rename_tables(df, {"t": "u"}).collect()} == {"u"}
    assert {r.table_name for r in f.rename_tables(df, {}).collect()} == {"t"}


# --- score ------------------------------------------------------------------------

@pytest.mark.parametrize("days,credit", [(0, 1.0), (7, 1.0), (48.5, 0.5), (90, 0.0), (400, 0.0)])
def test_freshness_credit(spark, days, credit):
    got = spark.range(1).select(f.freshness_credit(F.lit(float(days))).alias("v")).collect()[0].v
    assert got == pytest.approx(credit)


def test_score(facts):
    described = [("a", "description", "text", None, 0), ("a", "type", "string", None, 0),
                 ("a", "distinct_count", "5", None, 0), ("a", "valid_values", ["x"], 0.8, 0),
                 ("b", "description", "<description>", None, 0), ("b", "type", "string", None, 0),
                 ("b", "distinct_count", "20", None, 0), ("c", "description", "scan", 0.8, 0),
                 ("c", "type", "bigint", None, 0), ("c", "distinct_count", "5", None, 0),
                 ("d", "type", "string", None, 0), ("d", "distinct_count", "21", None, 0),
                 ("c", "distinct_count", "unknown", None, 0)]
    row = f.completeness(facts(described), F.lit(day(0))).collect()[0]
    assert (row.column_count, row.column_description_pct, row.valid_values_targets,
            row.valid_values_coverage_pct, row.freshness_days) == (4, 25.0, 2, 50.0, 0.0)
    assert row.score == round(0.5 * 0.25 + 0.3 * 0.5 + 0.2, 2)
    untargeted = f.completeness(facts([("a", "description", "x", None, 0)]),
                                F.lit(day(100))).collect()[0]
    assert untargeted.score == 0.8


def test_worst_table_first(facts):
    both = facts([("a", "description", "x", None, 0)], "good").unionByName(
        facts([("a", "description", "<x>", None, 0)], "bad"))
    scores = f.completeness(both, F.lit(day(0)))
    assert [r.table_name for r in scores.collect()] == ["bad", "good"]
    assert f.average_score(scores).collect()[0].average_score == 0.75


# --- knowledge --------------------------------------------------------------------

def flat(df):
    return {(r.column_name, r.field): r["values"] or r.value for r in df.collect()}


def test_derived_facts(spark):
    df = spark.range(2000).select(
        "id", F.current_timestamp().alias("created_at"), F.lit("x").alias("ship_date"),
        F.concat(F.lit("s"), F.col("id") % 3).alias("status"),
        F.concat(F.lit("s"), F.col("id") % 19).alias("nineteen"),
        F.concat(F.lit("s"), F.col("id") % 20).alias("twenty"),
        F.col("id").cast("string").alias("unique"),
        F.when(F.col("id") % 100 == 0, "v").alias("rare"),
        F.when(F.col("id") % 20 == 0, "v").alias("ninety_five"),
        F.lit(None).cast("string").alias("nothing"))
    got = flat(k.derived_facts(df, "t"))
    assert got == {
        ("created_at", "temporal"): "true", ("rare", "likely_sparse"): "true",
        ("nothing", "likely_sparse"): "true", ("status", "valid_values"): ["s0", "s1", "s2"],
        ("ship_date", "valid_values"): ["x"], ("rare", "valid_values"): ["v"],
        ("ninety_five", "valid_values"): ["v"],
        ("nineteen", "valid_values"): sorted(f"s{i}" for i in range(19))}


def test_small_sets_stay_exact_among_many_values(spark):
    # Far more values than the sketch has slots, in columns of every size around the limit.
    df = spark.range(200_000).select(*[
        F.concat(F.lit("v"), F.col("id") % n).alias(f"n{n}")
        for n in (1, 5, 19, 20, 21, 90, 700, 5000, 200_000)])
    rows = by(k.small_value_sets(df), "column_name")
    assert {c: r["distinct_count"] for c, r in rows.items()} == {"n1": 1, "n5": 5, "n19": 19}


def test_suggestions_are_new_only(spark, facts):
    df = spark.range(100).select(
        F.concat(F.lit("s"), F.col("id") % 3).alias("a"),
        F.concat(F.lit("s"), F.col("id") % 2).alias("b"),
        F.concat(F.lit("s"), F.col("id") % 4).alias("c"), F.lit("one").alias("d"))
    stored = facts([("a", "valid_values", ["s0", "s1", "s2"], 0.8, 0),
                    ("b", "valid_values", ["mine"], None, 0),
                    ("c", "valid_values", ["s0"], 0.8, 0)])
    assert set(flat(k.suggestions(df, "t", stored))) == {("c", "valid_values")}
    # a column that the store does not know gets none
    unknown = df.withColumn("e", F.col("b"))
    assert set(flat(k.suggestions(unknown, "t", stored))) == {("c", "valid_values")}
    assert set(flat(k.suggestions(df, "t", stored, force=True))) == {
        ("b", "valid_values"), ("c", "valid_values")}


def test_facts_come_back_in_every_scan(frame, facts):
    df = frame("id int, status string, amount double",
               [(1, "open", 1.0), (2, "done", 2.0), (3, "open", 3.0), (4, "lost", 4.0),
                (5, "open", 5.0)])
    stored = facts([("status", "valid_values", ["open", "done"], 0.8, 0),
                    ("status", "description", "<description>", None, 0),
                    ("amount", "description", " In euros ", None, 0)])
    for rows in (k.with_facts(profile(df), stored, "t"), k.with_facts(quality(df), stored, "t"),
                 k.context(df, "t", stored), k.context(df, "t", stored, exact=True)):
        found = by(rows, "column_name")
        assert found["status"]["valid_values"] == ["open", "done"]
        assert found["status"]["description"] is None
        assert found["amount"]["description"] == "In euros" and len(found) == 3
    checked = by(k.quality_with_facts(df, stored, "t", exact=True), "column_name")
    assert checked["status"]["invalid_count"] == 1 and checked["status"]["status"] == "fail"
    assert checked["id"]["status"] == "ok" and checked["id"]["issues"] == []


def test_context_samples(frame):
    df = frame("s string, n int", [("b", 1), ("a", 2), ("b", 3), (None, 4)])
    for exact in (True, False):
        rows = by(k.context(df, "t", exact=exact), "column_name")
        assert rows["s"]["sample_values"] == ["b", "a"] and rows["n"]["sample_values"] is None
    got = flat(k.facts_from_context(k.context(df, "t", sample_values=1), "t"))
    assert got == {}  # one sample of two values proves nothing
    got = flat(k.facts_from_context(k.context(df, "t", sample_values=2), "t"))
    assert got == {("s", "valid_values"): ["a", "b"]}


def test_sets_are_complete_only_if_one_more_was_asked_for(spark):
    # Columns with 6 to 20 values each, ten of which are sampled.
    sizes = {f"n{n}_{i}": n for n in range(6, 21) for i in range(14)}
    df = spark.range(400).select(*[
        F.concat(F.lit(f"{c}v"), F.col("id") % n).alias(c) for c, n in sizes.items()])
    got = flat(k.facts_from_context(k.context(df, "t", sample_values=10), "t"))
    assert {c for c, _ in got} == {c for c, n in sizes.items() if n <= 10}
    assert all(len(v) == sizes[c] for (c, _), v in got.items())


def test_default_categories_are_those_of_the_exact_profile(spark):
    df = spark.range(20_000).select(
        *[(F.xxhash64("id", F.lit(i)) % 1_000_000_007 * 20_000 + F.col("id")).alias(f"key{i}")
          for i in range(20)],
        *[F.concat(F.lit(f"x{i}"), F.col("id") % 2).alias(f"two{i}") for i in range(100)],
        F.lit("one").alias("one"))
    got = {r.column_name: r.category for r in column_categories(profile(df, quick=True)).collect()}
    assert {got[f"key{i}"] for i in range(20)} == {"high_cardinality"}
    assert "constant" not in {got[f"two{i}"] for i in range(100)} and got["one"] == "constant"


def test_stored_lists_hold_for_every_type_and_spelling(spark):
    df = spark.sql("select cast(1.5 as decimal(10,2)) d, cast(2.5 as double) f, 3 i, 's' s, "
                   "timestamp_ntz'2024-01-02 00:00:00' ts, true b")
    lists = {"D": ["1.5"], "f": ["2.50"], "I": ["3.0"], "S": ["s"], "TS": ["2024-01-02"],
             "B": ["TRUE"]}
    for wrong in (False, True):
        stored = spark.createDataFrame(
            [("T", c, "valid_values", None, ["7"] if wrong else v, None, None)
             for c, v in lists.items()],
            "table_name string, column_name string, field string, value string, "
            "values array<string>, source string, confidence double")
        rows = by(k.quality_with_facts(df, stored, "t", exact=True), "column_name")
        assert {r["status"] for r in rows.values()} == {"fail" if wrong else "ok"}, rows
        assert all(r["valid_values"] for r in rows.values())


def test_documentation_becomes_facts(frame):
    df = frame("id int, s string", [(1, "x"), (2, None), (3, "z"), (4, "w")])
    rows = by(k.documentation(df, "t", order_by=["id"], exact=True), "column_name")
    assert rows["s"]["sample_values"] == "x, z" and rows["id"]["sample_values"] == "1, 2, 3"
    assert rows["id"]["max_val"] == 4.0 and rows["s"]["null_count"] == 1
    got = flat(k.machine_facts(k.documentation(df, "t", exact=True)))
    assert got["id", "distinct_count"] == "4" and got["s", "description"] == "<description>"
    assert got[None, "row_count"] == "4" and got[None, "data_owner"] == "<data_owner>"
    assert got["id", "primary_key"] == "false"


def test_recipes_have_their_parts(frame, facts):
    df = frame("id int, s string", [(1, "x"), (2, "y")])
    empty = df.limit(0)
    assert set(recipes.table_report({"t": df, "u": df}, "t", facts([]))) == {
        "context", "quality", "joins", "facts"}
    assert set(recipes.feature_target(df, "t", "s")) == {"schema", "profile", "quality", "target"}
    assert recipes.wide_table_triage(df)["categories"].count() == 1
    dive = recipes.column_deep_dive(df, "t", "s")
    assert dive["summary"].collect()[0].distinct_count == 2
    assert recipes.table_summary(empty, "t")["quality"].count() == 2
    handed = recipes.table_handoff(empty, "t")
    assert handed["schema"].count() == 2 and handed["profile"].count() == 0
    looked = recipes.table_investigate(df, "t", focus="id")
    assert set(looked) == {"context", "quality", "values", "distribution"}
