"""Time the headline questions and print one JSON line.

``BENCH_SF_DIR`` is the folder of test tables, ``BENCH_CPUS`` the number of cores.
Every question runs ``BENCH_WARMUPS`` times to warm up and is then timed; the best of
``BENCH_RUNS`` counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablelore.operators import facts, knowledge  # noqa: E402
from tablelore.operators.diff import fingerprints, schema_diff  # noqa: E402
from tablelore.operators.freshness import freshness  # noqa: E402
from tablelore.operators.joins import key_evidence  # noqa: E402
from tablelore.operators.profile import approx_top_values, profile  # noqa: E402
from tablelore.operators.quality import duplicate_rows, quality  # noqa: E402
from tablelore.operators.search import rank_documents, search_facts  # noqa: E402
from tablelore.operators.values import (  # noqa: E402
    categories, distinct_values, histogram, top_values,
)
from tablelore.registry import derived  # noqa: E402
from tablelore.session import local_session  # noqa: E402
from tablelore.sources.rows import preview  # noqa: E402
from tablelore.sources.sampling import plan_scan  # noqa: E402
from tablelore.sources.tables import inspect  # noqa: E402


def questions(spark, sf: str) -> dict:
    def t(name):
        return spark.read.parquet(f"{sf}/{name}.parquet")

    lineitem, orders, customer = t("lineitem"), t("orders"), t("customer")
    documents, events = t("documents"), t("events")
    return {
        "preview_100": lambda: preview(lineitem, 100),
        "inspect": lambda: inspect(lineitem, "lineitem"),
        "profile_approx": lambda: profile(lineitem),
        "profile_exact": lambda: profile(lineitem, exact=True),
        "profile_quick": lambda: profile(lineitem, quick=True),
        "profile_sample_100k": lambda: profile(plan_scan(lineitem, sample=100_000)),
        "histogram": lambda: histogram(lineitem, "l_extendedprice"),
        "histogram_sample_100k": lambda: histogram(
            plan_scan(lineitem, sample=100_000), "l_extendedprice"),
        "categories": lambda: categories(lineitem, "l_returnflag"),
        "distinct_values": lambda: distinct_values(lineitem, "l_partkey"),
        "top_values_all_columns": lambda: top_values(lineitem, top=10),
        "approx_top_values_all_columns": lambda: approx_top_values(lineitem, top=10),
        "quality_approx": lambda: quality(lineitem),
        "quality_exact": lambda: quality(lineitem, exact=True),
        "duplicate_rows": lambda: duplicate_rows(lineitem),
        "freshness": lambda: freshness(events),
        "join_evidence": lambda: key_evidence(orders, "o_custkey", customer, "c_custkey"),
        "derived_facts": lambda: knowledge.derived_facts(lineitem, "lineitem"),
        "context": lambda: knowledge.context(lineitem, "lineitem"),
        "search_documents": lambda: rank_documents(
            documents, "the reation thering", {"text": 1}, excerpt="text",
            order=("doc_id",), limit=20),
        "search_facts": lambda: search_facts(
            derived.dictionary(spark, sf), "pii true src3", 15),
        "facts_merge": lambda: facts.merge_decisions(*(
            facts.current_facts(derived.fact_log(spark, sf).where(side)) for side in (
                f"written_at < timestamp_ntz'{derived.MIDDLE}'",
                f"written_at >= timestamp_ntz'{derived.MIDDLE}'"))),
        "facts_score": lambda: facts.completeness(
            derived.dictionary(spark, sf), documents.selectExpr(
                "max(timestamp'2024-02-15 00:00:00')").scalar()),
        "schema_diff": lambda: schema_diff(*(
            derived.observed_catalog(spark, sf, side) for side in (
                f"ts < timestamp_ntz'{derived.MIDDLE}'",
                f"ts >= timestamp_ntz'{derived.MIDDLE}'"))),
        "fingerprints": lambda: fingerprints(derived.observed_catalog(spark, sf)),
    }


def seconds(question) -> float:
    started = time.perf_counter()
    question().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    warmups = int(os.environ.get("BENCH_WARMUPS", "2"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:]
    times = {}
    for name, question in questions(spark, sf).items():
        if wanted and name not in wanted:
            continue
        for _ in range(warmups):
            seconds(question)
        times[name] = round(min(seconds(question) for _ in range(runs)), 4)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
