"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from terralith.config import build_session, tune  # noqa: E402
from terralith.plans.queries import QUERIES, _found as stored_findings  # noqa: E402
from terralith.sources import derived  # noqa: E402

HEADLINE = ["review_queue", "br3_duplicates", "br4_chronology", "br7_admin", "parcel_link", "parcel_neighbours",
            "cross_status", "mis_snapshot", "record_search", "audit_verify", "file_dedup", "word_stats",
            "mutation_chain", "apply_corrections", "duplicate_scan", "extract_records", "all_rules"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    tune(spark)
    times: dict[str, float] = {}
    start = time.time()
    derived.records(spark, sf_dir).count()
    times["derive_records"] = round(time.time() - start, 3)
    start = time.time()
    stored_findings(spark, sf_dir).count()
    times["derive_findings"] = round(time.time() - start, 3)
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
