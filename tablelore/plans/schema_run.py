"""One run over the tables of a schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import runs
from ..sources.catalog import describe_table, list_tables, read_table, tables_to_document
from .documenting import Documented, Models, document


@dataclass(frozen=True)
class SchemaRun:
    documented: Documented | None
    counts: DataFrame


def run_schema(spark: SparkSession, run_id: str, catalog: str, schema: str, models: Models, *,
               earlier: DataFrame | None = None, listing: Callable[[], DataFrame] | None = None,
               filters: dict | None = None, **options) -> SchemaRun:
    """Documents every table of a schema that this run has not finished before, and counts the outcomes.

    ``earlier`` are stored sessions; ``listing`` replaces the catalog as the source of table names. A
    listing that fails ends the run as failed and is raised.
    """
    tables = tables_to_document((listing or (lambda: list_tables(spark, catalog, schema)))(), **(filters or {}))
    wanted = tables.select(F.lit(run_id).alias("schema_run_id"),
                           F.concat_ws(".", F.lit(catalog), F.lit(schema), "table_name").alias("table_ref"))
    todo = wanted if earlier is None else runs.pending_tables(wanted, earlier)
    refs = [row.table_ref for row in todo.collect()]
    skipped = wanted.join(todo, "table_ref", "left_anti").select("schema_run_id", F.lit("skipped").alias("kind"))
    if not refs:
        return SchemaRun(None, runs.run_status(runs.rollup(skipped)))
    options.setdefault("describe", lambda ref: describe_table(spark, ref))
    made = document(spark, {ref: (lambda ref=ref: read_table(spark, ref)) for ref in refs}, models, run=run_id, **options)
    kind = F.when(F.col("status") == "awaiting_input", "needs_input").when(
        F.col("status") == "ready_for_review", "ready_for_review").otherwise("failed")
    outcomes = made.sessions.select("schema_run_id", kind.alias("kind")).unionByName(skipped)
    return SchemaRun(made, runs.run_status(runs.rollup(outcomes)))
