"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_REPEAT
the timed runs per query (the median counts, after one warm-up run). ``value``
is the total of the HEADLINE queries, as in the first round; ``build`` is the
part of each time that passed before the plan was there, small jobs included.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from casework.plans.queries import QUERIES
from casework.session import build_session

HEADLINE = (
    "envelope_documents",
    "envelope_audit",
    "injection_scan",
    "mask_traces",
    "transcripts",
    "composed_task",
    "prior_context",
    "vendor_enrich",
    "id_consistency",
    "ledger_parse",
    "plan_workers",
    "facts_delta",
    "replay_trace",
    "replay_summary",
    "stall_runs",
    "loop_detect",
    "registry_view",
    "model_usage",
    "batch_score",
    "render_prompts",
    "po_invoice_recon",
    "delivery_recon",
    "dunning",
    "field_extract",
    "field_accuracy",
    "kpis",
    "attr_history",
    "attr_as_of",
)


def run(spark, name: str, folder: str) -> tuple[float, float]:
    """Seconds in all, and those until the query was built."""
    start = time.perf_counter()
    df = QUERIES[name](spark, folder)
    built = time.perf_counter() - start
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start, built


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times, build = {}, {}
    for name in sys.argv[1:] or [*HEADLINE, *[n for n in QUERIES if n not in HEADLINE]]:
        run(spark, name, folder)
        totals, builds = zip(*[run(spark, name, folder) for _ in range(repeat)], strict=True)
        times[name], build[name] = round(statistics.median(totals), 4), round(statistics.median(builds), 4)
    spark.stop()
    total = round(sum(s for n, s in times.items() if n in HEADLINE), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "build": build, "sf": float(scale)}))


if __name__ == "__main__":
    main()
