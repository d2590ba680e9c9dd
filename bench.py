"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  table folder, default /root/testdata/sf0.1
BENCH_CPUS    local cores, default 8
BENCH_ONLY    comma-separated query names instead of the headline list
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tagloom.plans import catalog  # noqa: E402
from tagloom.session import build_session  # noqa: E402

HEADLINE = [
    "prompt_instruction",
    "prompt_conversation",
    "prompt_message_tree",
    "labels_to_tags",
    "long_context_input",
    "tagging_prompt",
    "router_prompt",
    "truncate_head_tail",
    "parse_tags_strict",
    "parse_tags_objects",
    "parse_tags_lines",
    "parse_route_single",
    "parse_route_lenient",
    "standardize_tagged",
    "tag_frequency",
    "tag_rule_groups",
    "tag_similarity_pairs",
    "tag_semantic_groups",
    "frequent_pairs",
    "association_pairs",
    "tag_mapping_final",
    "tag_stats",
    "tag_reduction",
    "mapped_sessions",
    "apply_tag_mapping",
    "clean_tag_records",
    "tag_top20",
    "tag_model_score",
    "route_tag_lists",
    "route_summary",
    "route_train_val",
    "score_report",
    "accuracy_lenient",
    "prediction_distribution",
    "tag_f1_exact",
    "tag_f1_semantic",
    "dedup_first_last",
    "shard_assign",
    "batch_infer",
    "tag_generation",
    "router_evaluation",
    "stream_tagging",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or HEADLINE
    spark = build_session(
        "tagloom-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("prompt_instruction")  # starts the JVM's scan and code generation paths
    seconds = {}
    for name in names:
        seconds[name] = round(run(name), 3)
        print(f"{name}: {seconds[name]}s", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
