"""Headline queries, one JSON line: BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from labelweave.catalog import QUERIES  # noqa: E402
from labelweave.session import build_session  # noqa: E402

HEADLINE = (
    "metrics_by_lang", "class_report", "norm_all", "norm_elongation", "codeswitch", "validate_issues", "validate_summary",
    "disagreements", "iaa_pairs", "resolve_majority", "split_stratified", "split_group", "oversample",
    "reliability_bins", "calibration_summary", "temperature", "pr_curve", "conformal_tau", "review_uncertain",
    "bootstrap_ci", "char_ngrams", "doc_freq", "tfidf_long", "word_counts", "bpe_merges", "train_predict", "plugin_scoring",
    "stress_mixed_script", "stress_elongation", "stress_zero_width",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session("bench", master=f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus})

    def timed(name: str) -> float:
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took = time.time() - started
        spark.catalog.clearCache()
        return took

    timed("metrics_by_lang")
    times = {n: round(statistics.median(timed(n) for _ in range(runs)), 3) for n in HEADLINE}
    print(json.dumps({"metric": "total_wall", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus, "runs": runs, "spark": spark.version}))


if __name__ == "__main__":
    main()
