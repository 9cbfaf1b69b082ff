"""Headline timings: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all cores) choose the
data and the size of the local cluster. Every query is read to the end; nothing is kept
between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tarsift.catalog import QUERIES  # noqa: E402
from tarsift.catalog.content import files  # noqa: E402
from tarsift.operators.content_rules import scan_files  # noqa: E402
from tarsift.session import build_session  # noqa: E402

HEADLINE = [
    "c1_url_domains",
    "c3_c2_webhook",
    "c11_high_entropy_blob",
    "c16_suspicious_pattern",
    "o1_advanced_obfuscation",
    "h1_phishing_form",
    "m5_lifecycle_script",
    "t2_edit_distance_matches",
    "t8_all_pairs",
    "x1_install_chain_risk",
    "r1_scores",
    "y1_signature_matches",
    "g1_summary",
    "g4_riskiest_versions",
    "g13_c2_versions",
    "g18_daily_activity",
    "g20_finding_histogram",
    "g23_score_board",
    "t12_name_similarity_report",
    "u3_replace_findings",
    "q5_queue_from_feeds",
    "s1_archive_members",
    "e1_batch_scan",
]


def finish(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    parts = str(os.cpu_count() if cpus == "*" else int(cpus))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": parts,
            "spark.driver.memory": "20g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    finish(spark.read.parquet(f"{folder}/lineitem.parquet"))

    # All file rules over all files. Most of a short run is building and compiling the
    # one large plan, so the second run on the same plan is the rate of the work itself.
    source = files(spark, folder)
    content = source.selectExpr("sum(octet_length(content)) AS b", "count(*) AS n").first()
    timings: dict[str, float] = {}
    began = time.time()
    scan = scan_files(source)
    finish(scan)
    timings["scan_all_file_rules"] = time.time() - began
    began = time.time()
    finish(scan)
    warm = time.time() - began

    for name in HEADLINE:
        began = time.time()
        finish(QUERIES[name](spark, folder))
        timings[name] = time.time() - began

    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": {name: round(spent, 3) for name, spent in timings.items()},
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": cpus,
                "scan_warm_sec": round(warm, 3),
                "scan_warm_mb_per_sec": round(content["b"] / 1e6 / warm, 2),
                "scan_warm_files_per_hour": round(content["n"] / warm * 3600),
            }
        )
    )


if __name__ == "__main__":
    main()
