"""Bench: warm wall seconds per query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``BENCH_QUERIES`` (comma separated, or ``all``) picks other queries, ``BENCH_RUNS`` the number
of warm runs of which the best counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eventide.plans import Tables, load_all  # noqa: E402
from eventide.session import local_session  # noqa: E402

HEADLINE = (
    "flagship ohlcv_minute_bars asof_lookbacks forward_prices_tolerance forward_reaction_window pre_event_momentum "
    "next_bar_anchor rolling_hv event_study append_unseen upsert_merge dedup_first class_weights parse_times "
    "feature_validity_impute text_flags_mentions clean_lines page_text tag_resolution top_sentences embedding_topk stream_bars"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    found = load_all()
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(found) if asked == "all" else [n for n in asked.split(",") if n] or HEADLINE
    spark = local_session(cpus, "bench", **{"spark.sql.shuffle.partitions": cpus})
    tables, took = Tables(spark, folder), {}
    for name in names:
        best = None
        for i in range(runs + 1):
            start = time.perf_counter()
            found[name].build(tables).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            if i:
                best = spent if best is None else min(best, spent)
            if os.environ.get("BENCH_VERBOSE"):
                print(f"{name} run {i} {spent:.2f}", file=sys.stderr, flush=True)
        took[name] = round(best, 3)
    spark.stop()
    out = {
        "metric": "warm wall time of the headline queries",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": float(os.path.basename(folder.rstrip("/")).removeprefix("sf") or 0),
        "cpus": int(cpus),
    }
    print(json.dumps(out), flush=True)


if __name__ == "__main__":
    main()
