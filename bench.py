"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from linkguard.plans import catalog  # noqa: E402
from linkguard.session import local_session  # noqa: E402

HEADLINE = ["url_normalize", "url_features", "typosquat_matches", "rule_score", "scan_batch",
            "feature_assemble", "ip_combined_risk", "traffic_features", "eg_resolved",
            "alert_throttle", "alert_status_history", "top_malicious_domains", "recent_threats",
            "geo_threat_distribution", "traffic_summary", "feed_union_dedup", "url_upsert",
            "ml_roc_points", "stream_rate_window", "stream_threat_alerts"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    n_urls = catalog.QUERIES["url_count"](spark, folder).first().n
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    run(catalog.QUERIES["url_normalize"](spark, folder))  # warm up
    times, build = {}, {}
    for name in HEADLINE:
        t0 = time.time()
        df = catalog.QUERIES[name](spark, folder)
        build[name] = round(time.time() - t0, 3)
        run(df)
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({
        "metric": "total wall-clock of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "build": build, "sf": os.path.basename(folder.rstrip("/")),
        "urls_per_sec_scan": round(n_urls / times["scan_batch"], 1)}))


if __name__ == "__main__":
    main()
