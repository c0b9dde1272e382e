"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then BENCH_RUNS times (default 3); the
median counts.  Results are consumed by the "noop" sink, so nothing reaches
the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scriptoria.plans import adapter  # noqa: E402
from scriptoria.plans.registry import registered  # noqa: E402
from scriptoria.session import local_session  # noqa: E402

HEADLINES = [
    "postings_table", "postings_positions", "search_two_terms_per_work", "search_many_queries", "search_phrase",
    "expanded_search", "forms_per_lemma_of_every_token", "parsed_words", "previous_and_next_chapter", "reading_progress",
    "resolve_citation_strings", "bible_divisions", "equivalent_work_groups", "notes_of_passages", "chapter_plain_texts",
    "tei_verses", "search_section_field", "search_page_of_many_queries", "citations_longest_match", "policy_pattern_rules",
]
# Written once for an application; the searches above read it, so its time stands apart from theirs.
INDEX_BUILD = "stored_index_build"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = sys.argv[1:] or [*HEADLINES, INDEX_BUILD]
    spark = local_session("scriptoria-bench", cores)
    queries = registered()
    seconds: dict[str, float] = {}
    for name in wanted:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            if name == INDEX_BUILD:
                adapter.stored_index(spark, sf_dir, fresh=True)
            else:
                queries[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{seconds[name]:8.2f}s {name}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": int(cores), "runs": runs, "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
