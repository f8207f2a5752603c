"""Writing approved comments back: the plan is a DataFrame, its statements run on the driver, some tables at a time."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby, islice

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from ..functions.text import is_blank, quoted_name, quoted_text, split_table_ref, strip, table_key
from ..schemas import APPLYABLE_DRAFT_STATUSES, AUDIT, TABLE_TARGET
from ..sources.catalog import list_columns, list_tables
from .library import entries_from_drafts

OUTCOME = "session_id string, table_ref string, target string, error string"
BATCH, AT_ONCE = 1000, 8
EMPTY_OVER_GOOD = "refusing to write an empty comment over an existing one"


def live_comments(spark: SparkSession, refs: list[str]) -> DataFrame:
    """Comments as they are in the catalog now: ``table_ref, target, live``."""
    columns = list_columns(spark, refs).select("table_ref", F.col("name").alias("target"), F.col("comment").alias("live"))
    schemas = {split_table_ref(ref)[:2] for ref in refs}
    tables = None
    for catalog, schema in sorted(schemas):
        rows = list_tables(spark, catalog, schema).select(
            F.concat_ws(".", "table_catalog", "table_schema", "table_name").alias("table_ref"),
            F.lit(TABLE_TARGET).alias("target"), F.col("comment").alias("live"))
        tables = rows if tables is None else tables.unionByName(rows)
    if tables is None:
        return columns
    named = spark.createDataFrame([(ref,) for ref in refs], "table_ref string")
    return columns.unionByName(tables.join(named, "table_ref", "left_semi"))


def eligible(drafts: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Approved and edited drafts; of those, the named targets where any are named."""
    kept = drafts.filter(F.col("status").isin(*APPLYABLE_DRAFT_STATUSES))
    return kept if targets is None else kept.join(targets, ["session_id", "target"], "left_semi")


def decision(live: Column, current: Column, proposed: Column, confirm: Column) -> Column:
    """What happens to one comment, as ``status`` and ``reason``; first rule that holds."""
    def norm(text: Column) -> Column:
        return F.coalesce(strip(text), F.lit(""))

    def result(status: str, reason: str | None = None) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))

    return (
        F.when((norm(live) != norm(current)) & ~confirm, result("conflict", "the live comment changed"))
        .when(is_blank(proposed) & is_blank(live), result("skipped_noop", "both empty"))
        .when(is_blank(proposed), result("failed", EMPTY_OVER_GOOD))
        .when(norm(proposed) == norm(live), result("skipped_noop"))
        .otherwise(result("write"))
    )


def _table(table_ref: Column) -> Column:
    return F.array_join(F.transform(F.split(table_key(table_ref), r"\."), quoted_name), ".")


def statement(table_ref: Column, target: Column, comment: Column) -> Column:
    """The statement that writes one comment, names and text quoted."""
    table = _table(table_ref)
    return F.when(
        target == TABLE_TARGET,
        F.concat(F.lit("COMMENT ON TABLE "), table, F.lit(" IS "), quoted_text(comment)),
    ).otherwise(F.concat(
        F.lit("ALTER TABLE "), table, F.lit(" ALTER COLUMN "), quoted_name(target), F.lit(" COMMENT "),
        quoted_text(comment)))


def plan_apply(drafts: DataFrame, live: DataFrame, *, confirm: bool | str = False,
               targets: DataFrame | None = None) -> DataFrame:
    """Every eligible draft with its decision and, where it is to be written, the statement.

    ``live`` has ``table_ref, target, live``; ``confirm`` is one choice or a column of the drafts.
    """
    joined = eligible(drafts, targets).join(live, ["table_ref", "target"], "left")
    sure = F.coalesce(F.col(confirm), F.lit(False)) if isinstance(confirm, str) else F.lit(confirm)
    made = decision(F.col("live"), F.col("current_comment"), F.col("proposed_comment"), sure)
    text = statement(F.col("table_ref"), F.col("target"), F.col("proposed_comment"))
    return joined.withColumn("_d", made).select(
        *drafts.columns, "live", F.col("_d.status").alias("decision"), F.col("_d.reason").alias("reason"),
        F.when(F.col("_d.status") == "write", text).alias("statement"))


def execute(plan: DataFrame, out: str, run: str | None = None, *, at_once: int = AT_ONCE,
            send: Callable[[str], object] | None = None) -> DataFrame:
    """Runs the planned statements: tables side by side, a table's columns in one statement where the catalog takes it.

    A statement for several columns that fails is followed by one per column, so that every item has an outcome of its
    own; a failed item leaves its error and the rest go on. The rows to write are streamed to the driver, where
    catalog statements have to run, ``at_once`` tables at a time. Outcomes are stored every few items under
    ``out``, in a folder of this ``run``, so that a broken run shows what it had done, the driver holds few of them, and
    earlier runs into the same folder stay apart. ``send`` runs a statement in place of the session.
    """
    spark = plan.sparkSession
    out, send = f"{out.rstrip('/')}/run={run or uuid.uuid4().hex}", send or spark.sql
    part = F.concat(quoted_name(F.col("target")), F.lit(" COMMENT "), quoted_text(F.col("proposed_comment")))
    writes = plan.filter(F.col("decision") == "write").select(
        "session_id", "table_ref", "target", "statement", F.concat(F.lit("ALTER TABLE "), _table(F.col("table_ref")), F.lit(" ALTER COLUMN ")).alias("head"),
        F.when(F.col("target") != TABLE_TARGET, part).alias("part"))
    near = writes.repartition("table_ref").sortWithinPartitions("table_ref", (F.col("target") != TABLE_TARGET), "target", "session_id")
    spark.createDataFrame([], OUTCOME).write.mode("overwrite").parquet(out)
    rows = near.toLocalIterator()
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        while chunk := list(islice(rows, BATCH)):
            tables = [list(own) for _, own in groupby(chunk, key=lambda row: row.table_ref)]
            outcomes = [x for done in pool.map(lambda own: _write_table(own, send), tables) for x in done]
            spark.createDataFrame(outcomes, OUTCOME).write.mode("append").parquet(out)
    return spark.read.schema(OUTCOME).parquet(out)


def _write_table(rows: list[Row], send: Callable[[str], object]) -> list[tuple]:
    """Outcomes of the items of one table: all its columns at once first, if each is named once."""
    def tried(text: str) -> str | None:
        try:
            send(text)
            return None
        except Exception as failure:  # shown on the item
            return str(failure).splitlines()[0] if str(failure) else type(failure).__name__

    columns = [row for row in rows if row.part is not None]
    together = len(columns) > 1 and len({row.target for row in columns}) == len(columns)
    done = together and tried(columns[0].head + ", ".join(row.part for row in columns)) is None
    return [(row.session_id, row.table_ref, row.target, None if done and row.part is not None else tried(row.statement)) for row in rows]


def results(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The plan with the final ``result`` of each item."""
    ran = outcomes.withColumn("_ran", F.lit(True))
    joined = plan.join(ran, ["session_id", "table_ref", "target"], "left")
    written = (F.col("decision") == "write") & F.coalesce("_ran", F.lit(False)) & F.col("error").isNull()
    final = F.when(written, "applied").when(F.col("decision") == "write", "failed").otherwise(F.col("decision"))
    return joined.withColumns({
        "result": final,
        "reason": F.coalesce("error", F.when((F.col("decision") == "write") & F.col("_ran").isNull(), "not run"), "reason"),
    }).drop("_ran", "error")


def mark_applied(drafts: DataFrame, done: DataFrame, by: str, at: Column) -> DataFrame:
    """Drafts with the outcome of the write-back."""
    keys = ["session_id", "table_ref", "target"]
    joined = drafts.join(done.select(*keys, "result", "live"), keys, "left")
    applied = F.coalesce(F.col("result") == "applied", F.lit(False))
    same = (F.col("result") == "skipped_noop") & ~is_blank(F.col("proposed_comment"))
    return joined.withColumns({
        "apply_status": F.coalesce("result", "apply_status"),
        "status": F.when(applied, "applied").otherwise(F.col("status")),
        "applied_comment": F.when(applied, F.col("proposed_comment")).when(same, F.col("live")).otherwise(F.col("applied_comment")),
        "applied_at": F.when(applied, at).otherwise(F.col("applied_at")),
        "applied_by": F.when(applied, F.lit(by)).otherwise(F.col("applied_by")),
    }).select(*drafts.columns)


def audit_rows(done: DataFrame, by: str, at: Column) -> DataFrame:
    """One audit row per written comment, with the comment before and after."""
    def snapshot(comment: str) -> Column:
        return F.to_json(F.struct(F.col(comment).alias("comment")), {"ignoreNullFields": "false"})

    return done.filter(F.col("result") == "applied").select(
        "session_id", F.when(F.col("target") == TABLE_TARGET, "table").otherwise("column").alias("draft_kind"),
        F.lit(None).cast("string").alias("draft_id"), F.lit("applied").alias("action"), F.lit(by).alias("actor"),
        snapshot("live").alias("before"), snapshot("proposed_comment").alias("after"),
        at.cast("timestamp").alias("created_at")).select(*AUDIT.names)


def library_rows(done: DataFrame, by: str, at: Column) -> DataFrame:
    """Library rows that mark the written comments as applied, without counting another use."""
    return entries_from_drafts(done.filter(F.col("result") == "applied"), by, at, status="applied", bump=False)


def summary(done: DataFrame) -> DataFrame:
    return done.groupBy("session_id", F.col("result").alias("status")).agg(F.count(F.lit(1)).alias("items"))
