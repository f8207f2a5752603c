"""Row shapes exchanged between operators, and the value sets of their status columns."""

from __future__ import annotations

from pyspark.sql import types as T

# Status and mode names of the documentation life cycle.
SESSION_MODES = ("interactive", "batch", "hands_off")
ASKING_MODES = ("interactive", "hands_off")
SESSION_STATUSES = (
    "created", "profiling", "gathering_context", "reasoning", "awaiting_input", "ready_for_review",
    "applying", "applied", "paused", "failed", "cancelled",
)
TERMINAL_SESSION_STATUSES = ("awaiting_input", "ready_for_review", "applied", "failed", "cancelled")
FINISHED_SESSION_STATUSES = ("awaiting_input", "ready_for_review", "applied", "cancelled")
REVIEWABLE_SESSION_STATUSES = ("ready_for_review", "awaiting_input")
PHASE_ROLLUP = {"judging": "reasoning", "gating": "reasoning"}
DRAFT_STATUSES = (
    "draft", "needs_input", "low_confidence", "error", "reviewed", "edited", "approved", "applied",
    "rejected",
)
OPEN_DRAFT_STATUSES = ("draft", "needs_input", "low_confidence")
APPLYABLE_DRAFT_STATUSES = ("approved", "edited")
APPLY_STATUSES = ("not_applied", "applied", "conflict", "failed", "unsupported", "skipped_noop")
LIBRARY_REUSABLE_STATUSES = ("approved", "applied")
RUN_STATUSES = (
    "enumerating", "running", "completed", "completed_with_errors", "failed", "cancelled",
)
RUN_COUNT_KEYS = ("ready", "needs_input", "applied", "error", "skipped")
AUDIT_ACTIONS = ("generated", "edited", "approved", "applied", "rejected", "reverted")
TABLE_TARGET = "__table__"
PROFILE_VERSION = "1.0"

TOP_VALUES = T.ArrayType(T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("count", T.LongType()),
]))

PII = T.StructType([
    T.StructField("detected", T.BooleanType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("action", T.StringType()),
])

TABLE_PROFILE = T.StructType([
    T.StructField("table_ref", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("row_count_is_estimate", T.BooleanType()),
    T.StructField("sampled", T.BooleanType()),
    T.StructField("column_count", T.IntegerType()),
    T.StructField("partition_columns", T.ArrayType(T.StringType())),
    T.StructField("existing_comment", T.StringType()),
    T.StructField("stats_source", T.StringType()),
    T.StructField("profiled_at", T.TimestampType()),
    T.StructField("warnings", T.ArrayType(T.StringType())),
    T.StructField("profile_version", T.StringType()),
])

COLUMN_STATS = T.StructType([
    T.StructField("table_ref", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("type_class", T.StringType()),
    T.StructField("nullable", T.BooleanType()),
    T.StructField("existing_comment", T.StringType()),
    T.StructField("null_fraction", T.DoubleType()),
    T.StructField("distinct_count", T.LongType()),
    T.StructField("distinct_is_approx", T.BooleanType()),
    T.StructField("cardinality_ratio", T.DoubleType()),
    T.StructField("min", T.StringType()),
    T.StructField("max", T.StringType()),
    T.StructField("is_enum_candidate", T.BooleanType()),
])

COLUMN_PROFILE = T.StructType(COLUMN_STATS.fields + [
    T.StructField("top_k", TOP_VALUES),
    T.StructField("pii", PII),
])

PROFILE_ERROR = T.StructType([
    T.StructField("table_ref", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("message", T.StringType()),
])

SNIPPET = T.StructType([
    T.StructField("table_ref", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("informs", T.ArrayType(T.StringType())),
    T.StructField("relevance", T.DoubleType()),
    T.StructField("seq", T.IntegerType()),
])

DRAFT = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("table_ref", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("current_comment", T.StringType()),
    T.StructField("proposed_comment", T.StringType()),
    T.StructField("rationale", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("subscores", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("issues", T.ArrayType(T.StringType())),
    T.StructField("evidence_refs", T.ArrayType(T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("facts", T.MapType(T.StringType(), T.StringType())),
    T.StructField("conditional_fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("status", T.StringType()),
    T.StructField("apply_status", T.StringType()),
    T.StructField("applied_comment", T.StringType()),
    T.StructField("applied_at", T.TimestampType()),
    T.StructField("applied_by", T.StringType()),
])

QUESTION = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("qid", T.StringType()),
    T.StructField("target_kind", T.StringType()),
    T.StructField("target_name", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("answered", T.BooleanType()),
    T.StructField("suggested_answer", T.StringType()),
])

SESSION = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("catalog", T.StringType()),
    T.StructField("schema", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("template_id", T.StringType()),
    T.StructField("config", T.StringType()),
    T.StructField("created_by", T.StringType()),
    T.StructField("schema_run_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

LIBRARY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("match_key", T.StringType()),
    T.StructField("canonical_comment", T.StringType()),
    T.StructField("conditional_fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("usage_count", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("source_session_id", T.StringType()),
    T.StructField("source_table_ref", T.StringType()),
    T.StructField("approved_by", T.StringType()),
    T.StructField("approved_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("sunset_at", T.TimestampType()),
    T.StructField("sunset_by", T.StringType()),
])

AUDIT = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("draft_kind", T.StringType()),
    T.StructField("draft_id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("actor", T.StringType()),
    T.StructField("before", T.StringType()),
    T.StructField("after", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
