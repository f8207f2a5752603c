"""Routing of drafts: keep, or ask, with the reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import append_line
from ..schemas import ASKING_MODES, OPEN_DRAFT_STATUSES, PHASE_ROLLUP, TABLE_TARGET
from .skew import number_by_ordinal

# Thresholds of the signals and of keeping a draft.
HIGH_NULL_FRACTION = 0.5
KEYLIKE_RATIO = 0.98
SHORT_NAME = 3
KEEP_THRESHOLD = 0.75
SIGNALS = ("ambiguous_name", "has_usage_evidence", "high_null_fraction", "enum_candidate",
           "has_decode_source", "keylike", "has_key_target")


def informed_columns(snippets: DataFrame) -> DataFrame:
    """Columns some snippet of their table speaks about."""
    return snippets.select("table_ref", F.explode("informs").alias("name")).distinct()


def hard_signals(columns: DataFrame, snippets: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """Per column: what the profile, the declared keys and the context say about it."""
    informed = informed_columns(snippets).withColumn("_used", F.lit(True))
    declared = foreign_keys.select("table_ref", F.col("column").alias("name")).distinct().withColumn("_fk", F.lit(True))
    joined = columns.join(informed, ["table_ref", "name"], "left").join(declared, ["table_ref", "name"], "left")
    used = F.coalesce("_used", F.lit(False))
    bare = F.length(F.trim(F.col("name"), F.lit("_")))
    return joined.select(
        "table_ref", "name",
        ((F.coalesce(bare, F.lit(0)) <= SHORT_NAME) & ~used).alias("ambiguous_name"),
        used.alias("has_usage_evidence"),
        F.coalesce(F.col("null_fraction") > HIGH_NULL_FRACTION, F.lit(False)).alias("high_null_fraction"),
        F.coalesce("is_enum_candidate", F.lit(False)).alias("enum_candidate"),
        used.alias("has_decode_source"),
        F.coalesce(F.col("cardinality_ratio") >= KEYLIKE_RATIO, F.lit(False)).alias("keylike"),
        (F.coalesce("_fk", F.lit(False)) | used).alias("has_key_target"))


def hard_trips() -> Column:
    """Reasons that force a question whatever the score, in fixed order."""
    c = {name: F.coalesce(F.col(name), F.lit(False)) for name in SIGNALS}
    return F.array_compact(F.array(
        F.when(c["ambiguous_name"] & ~c["has_usage_evidence"] & c["high_null_fraction"],
               F.lit("ambiguous_unused_high_null")),
        F.when(c["enum_candidate"] & ~c["has_decode_source"], F.lit("enum_no_decode")),
        F.when(c["keylike"] & ~c["has_key_target"], F.lit("keylike_no_target")),
    ))


def reasons(confidence: Column, trips: Column, threshold: float = KEEP_THRESHOLD) -> Column:
    """Why a draft is not kept; empty if it is."""
    return (
        F.when(F.size(trips) > 0, trips)
        .when(confidence.isNull(), F.array(F.lit("no_confidence")))
        .when(confidence < threshold, F.array(F.lit("below_threshold")))
        .otherwise(F.array().cast("array<string>"))
    )


def question_text(target: Column, why: Column) -> Column:
    who = F.when(target == TABLE_TARGET, F.lit("this table")).otherwise(
        F.concat(F.lit("column `"), target, F.lit("`")))
    # The wording of the questions.
    return (
        F.when(F.array_contains(why, "enum_no_decode"), F.concat(
            who, F.lit(" holds coded values with no decode source — what do the codes mean?")))
        .when(F.array_contains(why, "keylike_no_target"), F.concat(
            who, F.lit(" looks like a key but no lineage resolves its target — what does it reference?")))
        .when(F.array_contains(why, "ambiguous_unused_high_null"), F.concat(
            who, F.lit(" has an ambiguous name, no usage history, and is mostly null — what is it for?")))
        .otherwise(F.concat(F.lit("What is the business meaning of "), who,
                            F.lit("? (low confidence — needs confirmation)")))
    )


def route(drafts: DataFrame, signals: DataFrame, threshold: float = KEEP_THRESHOLD) -> DataFrame:
    """Drafts with the ``reasons`` against them; only open drafts can have any, table drafts no trips."""
    flags = signals.withColumnRenamed("name", "target")
    joined = drafts.join(flags, ["table_ref", "target"], "left")
    is_open = F.col("status").isin(*OPEN_DRAFT_STATUSES)
    why = reasons(F.col("confidence"), hard_trips(), threshold)
    none = F.array().cast("array<string>")
    return joined.withColumn("reasons", F.when(is_open, why).otherwise(none)).select(*drafts.columns, "reasons")


def settle(routed: DataFrame, mode: str) -> DataFrame:
    """Status of each draft after routing: ask where somebody answers, else mark it and say why."""
    tripped = F.size("reasons") > 0
    if mode in ASKING_MODES:
        status = F.when(tripped, "needs_input").otherwise(F.col("status"))
        return routed.withColumn("status", status).drop("reasons")
    note = F.concat(F.lit("low confidence: "), F.array_join("reasons", ", "))
    return routed.withColumns({
        "status": F.when(tripped, "low_confidence").otherwise(F.col("status")),
        "rationale": F.when(tripped, append_line(F.col("rationale"), note)).otherwise(F.col("rationale")),
    }).drop("reasons")


def questions(routed: DataFrame) -> DataFrame:
    """One question per tripped draft, numbered within its session: the table first, then columns."""
    asked = routed.filter(F.size("reasons") > 0).withColumn(
        "_place", F.when(F.col("target") == TABLE_TARGET, -1).otherwise(F.col("ordinal")))
    numbered = number_by_ordinal(asked, ["session_id"], "_place", [F.col("target")], "n")
    is_table = F.col("target") == TABLE_TARGET
    return numbered.select(
        "session_id", F.concat(F.lit("q"), F.col("n")).alias("qid"),
        F.when(is_table, "table").otherwise("column").alias("target_kind"),
        F.when(~is_table, F.col("target")).alias("target_name"),
        question_text(F.col("target"), F.col("reasons")).alias("text"),
        F.lit(False).alias("answered"), F.lit(None).cast("string").alias("suggested_answer"))


def session_status(phase: Column) -> Column:
    """The stored status of a working phase."""
    out = phase
    for inner, shown in PHASE_ROLLUP.items():
        out = F.when(phase == inner, shown).otherwise(out)
    return out


def outcomes(routed: DataFrame, mode: str) -> DataFrame:
    """Per session: whether it waits for answers, and its stored status."""
    tripped = F.count_if(F.size("reasons") > 0)
    counted = routed.groupBy("session_id").agg(tripped.alias("questions"))
    asks = F.lit(mode in ASKING_MODES) & (F.col("questions") > 0)
    return counted.select(
        "session_id", F.when(asks, F.col("questions")).otherwise(0).cast("long").alias("questions"),
        F.when(asks, "needs_input").otherwise("ready_for_review").alias("kind"),
        F.when(asks, "awaiting_input").otherwise("ready_for_review").alias("status"))
