"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is materialised with the ``noop`` sink (full execution, nothing collected).
The value is the total wall time of all headline queries in seconds.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strata.session import get_spark  # noqa: E402

HEADLINE = ["q_cascade", "q_keyword_score", "q_neardup_best", "q_doc_dedup", "q_cosine_top1", "q_vote_majority",
            "q_containment", "q_price_asof", "q_price_hold", "q_running", "q_arith_templates", "q_llm_cost"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), driver_memory="16g")
    from strata.plans import registry as Rg
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        t0 = time.time()
        Rg.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]} s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
