"""Times the headline queries and prints one JSON line.

Every query starts from the raw tables: staged intermediates of earlier queries
are forgotten first, so each time covers the query's whole work.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from crestline import catalog  # noqa: E402
from crestline.session import build_session  # noqa: E402

HEADLINE = [
    "g4_library_totals",
    "g6_dedup_cap",
    "g8_pileup_treat",
    "j3_pair_signal",
    "w2_q_table",
    "w4_narrow_peaks",
    "w5_candidates",
    "j11_broad_peaks",
    "g15_em_converged",
    "k7_multi_peaks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus)
    queries = catalog.queries()
    names = [n for n in HEADLINE if n in queries]
    # two untimed runs first: class loading, code generation and the JIT are not the queries' work
    for name in ("w4_narrow_peaks", "k7_multi_peaks"):
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        catalog.reset()
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_time_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
