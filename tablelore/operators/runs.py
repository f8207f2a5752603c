"""Runs over a whole schema, and the history of sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import ref_part
from ..schemas import FINISHED_SESSION_STATUSES, REVIEWABLE_SESSION_STATUSES, RUN_COUNT_KEYS
from .review import confidence_summary

KIND_COUNTS = {"ready_for_review": "ready", "needs_input": "needs_input"}
LONGEST_PAGE = 200


def pending_tables(tables: DataFrame, sessions: DataFrame) -> DataFrame:
    """Tables of a run without a finished session in it, so that a rerun redoes what failed or broke off."""
    done = sessions.filter(F.col("status").isin(*FINISHED_SESSION_STATUSES)).select(
        "schema_run_id", F.concat_ws(".", "catalog", "schema", "table").alias("table_ref")).distinct()
    return tables.join(done, ["schema_run_id", "table_ref"], "left_anti")


def count_key(kind: Column) -> Column:
    """The counter an outcome goes to; anything unexpected is an error."""
    out = F.when(kind.isin(*RUN_COUNT_KEYS), kind).otherwise("error")
    for outcome, key in KIND_COUNTS.items():
        out = F.when(kind == outcome, key).otherwise(out)
    return out


def checked_key(key: str) -> str:
    if key not in RUN_COUNT_KEYS:
        raise ValueError(f"unknown run counter {key!r}")
    return key


def rollup(outcomes: DataFrame) -> DataFrame:
    """Counters per run from the outcomes of its tables."""
    key = count_key(F.col("kind"))
    return outcomes.groupBy("schema_run_id").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(key == k).alias(k) for k in RUN_COUNT_KEYS])


def merged_rollups(*parts: DataFrame) -> DataFrame:
    """Counters per run from those of several parts, such as the outcomes so far and those that came since."""
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("schema_run_id").agg(*[F.sum(k).alias(k) for k in ("total", *RUN_COUNT_KEYS)])


def run_status(counts: DataFrame, enumeration_failed: Column | None = None, *,
               returned_failures_count: bool = True) -> DataFrame:
    """Final status of each run. Failures a table returned count like raised ones, unless switched off.

    With the switch off, ``counts`` needs ``raised`` (tables that broke off with an exception).
    """
    failed = F.lit(False) if enumeration_failed is None else enumeration_failed
    errors = F.col("error") if returned_failures_count else F.col("raised")
    return counts.withColumn("status", F.when(failed, "failed").when(
        errors > 0, "completed_with_errors").otherwise("completed"))


def new_runs(requests: DataFrame, at: Column) -> DataFrame:
    """Run rows as they start: enumerating, with no counts."""
    return requests.select(
        "id", "catalog", "schema", F.lit("enumerating").alias("status"), "filters",
        F.lit(None).cast("int").alias("total_tables"), F.create_map().cast("map<string,int>").alias("counts"),
        F.lit(None).cast("long").alias("job_run_id"), "created_by", at.alias("created_at"), at.alias("updated_at"))


def update_runs(runs: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """Runs with the given fields changed; a NULL field leaves the stored value."""
    fields = [c for c in ("status", "total_tables", "job_run_id", "counts") if c in changes.columns]
    named = changes.select("id", *[F.col(c).alias(f"new_{c}") for c in fields])
    joined = runs.join(named.withColumn("_hit", F.lit(True)), "id", "left")
    touched = F.coalesce("_hit", F.lit(False))
    out = {c: F.coalesce(f"new_{c}", c) for c in fields}
    out["updated_at"] = F.when(touched, at).otherwise(F.col("updated_at"))
    return joined.withColumns(out).select(*runs.columns)


def page_of(df: DataFrame, order: list[Column], limit: int, offset: int, longest: int) -> DataFrame:
    """One page of ordered rows; a page longer than ``longest`` is refused, not shortened."""
    if not 1 <= limit <= longest or offset < 0:
        raise ValueError(f"limit must be 1 to {longest} and offset not negative, got {limit} and {offset}")
    return df.orderBy(*order).offset(offset).limit(limit)


def session_history(sessions: DataFrame, drafts: DataFrame, *, status: str | None = None, table: str | None = None,
                    schema_run_id: str | None = None, limit: int = 50, offset: int = 0,
                    longest: int = LONGEST_PAGE) -> DataFrame:
    """One page of sessions, newest first, with their column counts.

    The page is cut first, so drafts are only counted for its sessions; it has at most ``longest`` rows.
    """
    kept = sessions
    if status is not None:
        kept = kept.filter(F.col("status") == status)
    if table is not None:
        catalog, schema, name = (F.split_part(F.lit(table), F.lit("."), F.lit(i)) for i in (1, 2, 3))
        kept = kept.filter((F.col("catalog") == catalog) & (F.col("schema") == schema) & (F.col("table") == name))
    if schema_run_id is not None:
        kept = kept.filter(F.col("schema_run_id") == schema_run_id)
    shown = page_of(kept, [F.col("updated_at").desc(), F.col("session_id")], limit, offset, longest)
    counts = (
        drafts.filter(F.col("target") != "__table__")
        .join(shown.select("session_id"), "session_id", "left_semi")
        .groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("n_columns"), F.count_if(F.col("apply_status") == "applied").alias("n_applied"))
    )
    return shown.join(counts, "session_id", "left").select(
        "session_id", F.concat_ws(".", "catalog", "schema", "table").alias("target"), "status", "created_by",
        "created_at", "updated_at", F.coalesce("n_columns", F.lit(0)).alias("n_columns"),
        F.coalesce("n_applied", F.lit(0)).alias("n_applied"))


def list_runs(runs: DataFrame, *, limit: int = 50, offset: int = 0, longest: int = LONGEST_PAGE) -> DataFrame:
    return page_of(runs, [F.col("created_at").desc(), F.col("id")], limit, offset, longest)


def run_detail(sessions: DataFrame, drafts: DataFrame, run_id: str | None = None) -> DataFrame:
    """Sessions of a run (or of every run) with a confidence summary where the drafts are settled."""
    kept = sessions if run_id is None else sessions.filter(F.col("schema_run_id") == run_id)
    settled = kept.filter(F.col("status").isin(*REVIEWABLE_SESSION_STATUSES)).select("session_id")
    summaries = confidence_summary(drafts.join(settled, "session_id", "left_semi"))
    return kept.join(summaries, "session_id", "left")


def session_table(table_ref: Column) -> list[Column]:
    return [ref_part(table_ref, i).alias(n) for i, n in ((1, "catalog"), (2, "schema"), (3, "table"))]
