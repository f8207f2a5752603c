"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` is the folder of the tables, ``BENCH_CPUS`` the number of local cores. Each query
runs twice and the faster run counts, so that the first one also warms up the JVM. ``reference_shape``
times, on the same session, the statements a profiler needs that asks for one column at a time.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, functions as F

from tablelore.operators.profile import column_stats, profile_table
from tablelore.session import build_session
from workload.registry import QUERIES
from workload.tables import Tables

HEADLINE = (
    "profile_lineitem", "profile_lineitem_approximate", "enum_values_lineitem", "profile_every_table",
    "personal_data_in_documents", "lineage_snippets", "statement_mentions", "usage_snippets", "library_upsert",
    "library_reuse", "context_within_budget", "column_batches", "prompt_steps", "model_drafts", "reply_drafts",
    "rubric_scores", "scored_drafts", "hard_signals", "gate_questions", "confidence_summary", "review_actions",
    "apply_decisions", "apply_summary", "run_rollup", "session_history", "run_detail", "rewritten_drafts",
)


def finish(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work, repeats: int = 2) -> float:
    best = float("inf")
    for _ in range(repeats):
        started = time.perf_counter()
        work()
        best = min(best, time.perf_counter() - started)
    return round(best, 3)


def one_statement_per_column(df: DataFrame) -> None:
    """Count, then per column its statistics, then per enumeration its common values."""
    rows = df.count()
    for name, kind in df.dtypes:
        ranged = [F.min(name), F.max(name)] if kind != "string" else []
        row = df.agg(F.count(F.lit(1)), F.count(name), F.approx_count_distinct(name).alias("d"), *ranged).first()
        if rows and 0 < row.d <= 50:
            df.filter(F.col(name).isNotNull()).groupBy(name).count().orderBy(F.desc("count")).limit(20).collect()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, folder)
    seconds = {name: timed(lambda name=name: finish(QUERIES[name].run(tables))) for name in HEADLINE}

    def whole_profile() -> None:
        made = profile_table(tables["lineitem"], "samples.tpch.lineitem")
        finish(made.columns)
        finish(made.tables)

    compared = {
        "whole_profile": timed(whole_profile),
        "whole_profile_one_statement_per_column": timed(lambda: one_statement_per_column(tables["lineitem"])),
        "statistics_only": timed(lambda: finish(column_stats(tables["lineitem"], "samples.tpch.lineitem"))),
    }
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "reference_shape": compared, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
