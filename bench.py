"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paracorpus.plans.queries import REGISTRY  # noqa: E402
from paracorpus.plans.views import INPUT_PARTITIONS  # noqa: E402
from paracorpus.session import build_session  # noqa: E402

HEADLINE = [
    "eval_summary", "eval_documents", "corpus_wer", "corpus_cer", "sample_scores", "corpus_bleu",
    "corpus_chrf", "word_overlap", "normalize_text", "knn_topk", "knn_translate", "exact_match",
    "unit_runs", "unit_dedupe", "assign_units", "embedding_score", "split_exact", "encode_labels",
    "pad_labels", "participant_lookup", "union_sources", "confidence_hist", "confidence_rank",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{INPUT_PARTITIONS: 4 * int(cpus), "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # Start the JVM's and the Python workers' machinery once; it is not part of any query.
    REGISTRY["corpus_bleu"](spark, "/root/testdata/sf0.001").collect()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        # Every column is computed, nothing is sent to the driver.
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
