"""Headline-query benchmark.

Runs the headline queries on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints ONE JSON line. Every query is executed in full with
the ``noop`` sink (all rows computed, nothing collected to the driver); cached model
tables are dropped between queries so each timing includes its whole plan.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["clean_social_text", "word_tokens", "tfidf", "top_words", "score_probabilities", "mc_dropout",
            "softmax_uncertainty", "f1_retention_curve", "topics_over_time", "classification_metrics"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from vellum.plans import model_fixture, q_model
    from vellum.plans.catalog import QUERIES
    from vellum.session import get_session
    spark = get_session(f"local[{cpus}]", int(cpus) * 2)
    n_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    # Untimed warm-up (JIT, codegen, Python workers) on a slice of the same table.
    from vellum.operators import tokens as TK
    warm = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(200)
    TK.term_counts(TK.with_tokens(warm, "text"), "tokens").write.format("noop").mode("overwrite").save()
    times, rows = {}, {}
    for name in names:
        model_fixture._CACHE.clear()
        q_model._FISHER_CACHE.clear()
        spark.catalog.clearCache()
        t0 = time.time()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        rows[name] = round(n_docs / times[name], 1)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "docs_per_sec": rows, "sf": float(m.group(1)) if m else None, "cpus": int(cpus)}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
