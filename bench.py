"""Times the headline queries; prints one JSON line."""
from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from rostrum.plans.catalog import QUERIES  # noqa: E402
from rostrum.session import local_session  # noqa: E402

HEADLINE = ["accepted_first_topn", "result_merge_fuller_title", "relevance_filter", "variant_early_stop", "company_group_people", "company_keys",
            "site_candidates_best", "company_registry_link", "page_links_ranked", "page_text_blocked", "page_leaders", "name_variant_merge",
            "registry_officers", "registry_index", "registry_cascade", "company_leaders", "direct_cascade", "profile_link_best", "title_leaders", "source_merge_rows", "fallback_cascade",
            "report_summary", "engine_cooldown", "first_accepted_cutoff", "job_state"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "16g"), "rostrum-bench")
    QUERIES["report_rows"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the session
    took = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": pathlib.Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
