"""Headline queries at one scale; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Every
query is planned and executed in full into the no-op sink: the median of three
runs after a first one, of one where the first took eight seconds. The first run and
the number of result rows stand beside the median."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import Observation, functions as F

from ledgerloom.plans import catalogue
from ledgerloom.session import local_session

HEADLINE = (
    "finance_insights", "category_breakdown", "spend_rank", "budget_usage", "anomaly_summary", "policy_violations",
    "expense_anomalies", "recurring_candidates", "claim_lines", "approval_evidence", "reviewer_workload", "audit_pack",
    "rolling_error_rate", "csv_import_validated", "lexical_search", "document_class", "engine_summary", "risk_coverage",
    "hardcase_mining", "source_balanced_sample", "reading_order",
)


def timed(run, name: str) -> float:
    start = time.time()
    run(name)
    return time.time() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    queries = catalogue.queries()
    rows: dict[str, int] = {}

    def run(name: str) -> None:
        seen = Observation()
        queries[name](spark, sf_dir).observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        rows[name] = seen.get["rows"]

    for name in ("category_breakdown", "claim_lines"):
        run(name)
    seconds, first = {}, {}
    for name in HEADLINE:
        first[name] = round(timed(run, name), 3)
        seconds[name] = round(median(timed(run, name) for _ in range(3 if first[name] < 8 else 1)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "first": first, "rows": {n: rows[n] for n in HEADLINE}, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
