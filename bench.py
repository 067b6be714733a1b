"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from eventgraph.plans import registry
from eventgraph.session import local_session

HEADLINE = ("count_events", "count_events_bounds", "preceding_event", "superlative_event", "rank_with_ties", "chronology", "previous_edition", "bm25_top30", "rrf_fusion", "cosine_topk", "link_event_f1", "containment_join", "resolve_conflicts", "retrieval_metrics", "summary_by_type", "rate_cap", "session", "chunk_documents", "redact")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), partitions=16)
    queries = dict(registry.QUERIES)
    names = list(HEADLINE)
    try:
        from eventgraph.llm import queries as own

        queries |= own.QUERIES
        names += list(own.QUERIES)
    except ImportError:
        pass
    run = lambda name: queries[name](spark, folder).write.format("noop").mode("overwrite").save()
    run("count_events")  # the session is warm when timing begins
    took = {}
    for name in names:
        began = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "seconds for all headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
