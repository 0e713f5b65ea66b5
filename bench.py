"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with ``local[$BENCH_CPUS]``,
forcing full execution with the ``noop`` sink (no driver collection). One warm-up pass, then
``$BENCH_RUNS`` timed passes; the per-query number is the median. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from preftable.plans import registry  # noqa: E402
from preftable.session import local_session  # noqa: E402

HEADLINE = [
    "sft_text",
    "vocab",
    "encode_docs",
    "sft_sequences",
    "pair_sequences",
    "pt_blocks",
    "pt_blocks_long",
    "batches",
    "replay",
    "collate_sft",
    "strip_and_join",
    "gae_array",
    "gae_long",
    "whiten",
    "ppo_total_loss",
    "rollout_metrics",
    "dpo_loss",
    "rm_loss_all",
    "token_logprobs",
    "step_metrics",
]


def run_once(spark, fn, base: str) -> float:
    t0 = time.perf_counter()
    fn(spark, base).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus if cpus != "*" else "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_session(cpus, parts, app="preftable-bench")
    qs = registry.queries()
    times: dict[str, float] = {}
    for name in names:
        fn = qs[name]
        run_once(spark, fn, base)  # warm-up: JIT, file listing, broadcast sizes
        times[name] = round(statistics.median(run_once(spark, fn, base) for _ in range(runs)), 3)
    spark.stop()
    sf = os.path.basename(base.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total_wall",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": cpus,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
