"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: data folder (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8).
Each query is executed in full into the noop sink, twice; the second run is reported.
"""

from __future__ import annotations

import contextlib
import io
import json
import os
import sys
import tempfile
import time

HEADLINE = (
    "curation_funnel", "first_reason", "best_per_key", "two_level_dedup", "apply_rules_long", "apply_rules_wide", "rules_summary",
    "group_summary", "grain_rollup", "series_summary", "dup_groups", "ordered_fingerprint", "panel_margin", "symbol_inventory",
    "acceptance_rate", "range_compress", "reconcile_full_outer", "cross_matrix", "triangular_pairs", "range_pairs", "longest_prefix",
    "upsert", "hash_chain", "event_validation", "manifest_verify", "pattern_scan", "lcs_pairs", "kabsch_pairs", "diverse_select",
    "conformer", "hotspot_contacts", "mmcif_atoms", "stream_windows",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from siftline.plans import QUERIES
    from siftline.session import build_session

    settings = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
                "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")}
    with contextlib.redirect_stdout(io.StringIO()):
        spark = build_session("bench", f"local[{cpus}]", **settings)
        spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    run = lambda name: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        run(name)
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
