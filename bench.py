"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans.catalogue import QUERIES  # noqa: E402
from tessera.session import build_session, drop_stored  # noqa: E402

HEADLINE = (
    "wer_by_source", "wer_components", "wer_summary", "perplexity_diff", "grammar_pos", "grammar_lexical", "coherence_scores",
    "agreement_metrics", "feature_stability_m1", "corr_by_source", "corr_matrix_long", "synthetic_wer", "speaker_by_time", "oof_regression",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1)))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["wer_by_source"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts workers
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        drop_stored(spark)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
