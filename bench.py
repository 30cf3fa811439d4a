"""Headline queries timed at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from verdigris.plans import catalog
from verdigris.plans.retrieval_queries import text_index
from verdigris.session import local_session

HEADLINE = [
    "vector_topk", "lexical_topk", "hybrid_rrf", "bm25", "passages", "belief_fold", "learning_summary", "two_hop", "prerequisite_closure", "session_summaries", "history_windows",
    "routed_turns", "sentence_spread", "style_rates", "cleaned_documents", "violations_by_rule", "fuzzy_names", "merged_edges",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 16, "16g")
    every = catalog.queries()
    every["vector_topk"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up is not timed
    took = {}
    began = time.time()
    text_index(spark, folder)  # what lexical_topk, bm25, hybrid_rrf and passages read
    took["text_index"] = round(time.time() - began, 3)
    for name in HEADLINE:
        if name in every:
            began = time.time()
            every[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
