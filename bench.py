"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.  Every query's result is written to the
noop sink, so all rows and columns are computed and none reach the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortlens.session import build

HEADLINE = [
    "cohort_text_profile", "comments_cleaned", "scoring_prefilter", "entities_normalised", "entity_positions", "ngram_features",
    "emotion_attribution", "linguistic_features", "content_categories", "user_self_declarations", "gendered_markers",
    "user_scores", "user_behaviour", "analysis_dataset", "subgroup_table", "exact_price_percentiles",
    "age_effect", "tied_rank_tests", "levene_test", "two_way_anova_margins", "priority_status_independence",
    "spearman_correlation", "high_low_quartiles", "threshold_sensitivity", "ols_demographics", "hierarchical_models",
    "influence_report", "leave_one_community_out", "variance_explained", "bootstrap_coefficients",
    "rater_agreement", "score_version_comparison", "rater_consensus", "user_projection", "ensemble_vote",
    "lexicon_scores", "batch_scoring", "daily_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
        spark__cohortlens__textPartitions=cpus,  # the tables are one file each
    )
    spark.sparkContext.setLogLevel("ERROR")
    from cohortlens.plans import catalog

    wanted = sys.argv[1:] or HEADLINE
    # one small job first: JVM, Parquet and Arrow start-up belong to no query
    spark.read.parquet(f"{sf_dir}/nation.parquet").mapInPandas(lambda it: it, "n_nationkey int, n_name string, n_regionkey int").count()
    times: dict[str, float] = {}
    for name in wanted:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
