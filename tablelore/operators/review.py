"""Review of drafts: bulk approval, decisions, rollups, answers and redrafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_blank
from ..schemas import TABLE_TARGET
from ..session import TABLES_PER_TASK, dealt, hashed, tasks_for
from .gate import KEEP_THRESHOLD

REVIEW_ACTIONS = {"approve": "approved", "reject": "rejected", "edit": "edited"}
ALL_TARGETS = "__all__"


def approvable(threshold: float = KEEP_THRESHOLD) -> Column:
    """Drafts a bulk approval takes: kept by the gate, and at or above the threshold."""
    return F.coalesce((F.col("status") == "draft") & (F.col("confidence") >= threshold), F.lit(False))


def approve_high_confidence(drafts: DataFrame, threshold: float = KEEP_THRESHOLD) -> DataFrame:
    return drafts.withColumn("status", F.when(approvable(threshold), "approved").otherwise(F.col("status")))


def confidence_summary(drafts: DataFrame, threshold: float = KEEP_THRESHOLD) -> DataFrame:
    """Per session: overall confidence, how many drafts are where, and the weakest one."""
    is_table = F.col("target") == TABLE_TARGET
    scored = F.col("confidence").isNotNull()
    place = F.when(is_table, -1).otherwise(F.coalesce("ordinal", F.lit(0)))
    ready = F.col("status").isin("draft", "approved", "edited") & (F.col("confidence") >= threshold)
    grouped = drafts.groupBy("session_id").agg(
        F.max(F.when(is_table, F.col("confidence"))).alias("_table"),
        F.avg(F.when(~is_table, F.col("confidence"))).alias("_columns"),
        F.count_if(ready).alias("review_ready"),
        F.count_if(F.col("status") == "needs_input").alias("needs_input"),
        F.count_if(F.col("status") == "low_confidence").alias("low"),
        F.count_if(approvable(threshold)).alias("approvable"),
        F.min(F.when(scored, F.struct("confidence", place.alias("place"), "target"))).alias("_weakest"))
    both = 0.5 * F.col("_table") + 0.5 * F.col("_columns")
    return grouped.select(
        "session_id", F.coalesce(both, F.col("_table"), F.col("_columns")).alias("overall"),
        "review_ready", "needs_input", "low", "approvable",
        F.col("_weakest.target").alias("weakest_target"), F.col("_weakest.confidence").alias("weakest_confidence"))


def readiness(drafts: DataFrame) -> DataFrame:
    """Per session: share of drafts written, and how many are ready to write."""
    return drafts.groupBy("session_id").agg(
        F.avg(F.when(F.col("apply_status") == "applied", 1.0).otherwise(0.0)).alias("readiness"),
        F.count_if(F.col("status").isin("approved", "edited")).alias("approvable"))


def target_name(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(TABLE_TARGET)).otherwise(name)


def review(drafts: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts after the reviewers' actions, and the actions that could not be taken.

    ``actions`` has ``session_id, target, action, comment, seq``. Several on one draft act in order:
    the last decides the status, the last edit the comment.
    """
    named = actions.withColumn("target", target_name(F.col("target")))
    known = drafts.select("session_id", "target").distinct().withColumn("_known", F.lit(True))
    checked = named.join(known, ["session_id", "target"], "left").withColumn(
        "error",
        F.when(F.col("_known").isNull(), F.concat(F.lit("draft not found: "), F.col("target")))
        .when((F.col("action") == "edit") & is_blank(F.col("comment")), "edit requires a non-empty proposed_comment")
        .when(~F.coalesce(F.col("action"), F.lit("")).isin(*REVIEW_ACTIONS),
              F.concat(F.lit("unknown action: "), F.coalesce("action", F.lit("")))))
    rejected = checked.filter(F.col("error").isNotNull()).select(
        "session_id", "target", "action", "seq", "error")
    edited = F.when(F.col("action") == "edit", F.struct("seq", "comment"))
    last = checked.filter(F.col("error").isNull()).groupBy("session_id", "target").agg(
        F.max(F.struct("seq", "action")).alias("_last"), F.max(edited).alias("_edit"))
    status = F.col("status")
    for action, result in REVIEW_ACTIONS.items():
        status = F.when(F.col("_last.action") == action, result).otherwise(status)
    after = drafts.join(last, ["session_id", "target"], "left").withColumns({
        "status": status,
        "proposed_comment": F.coalesce(F.col("_edit.comment"), F.col("proposed_comment")),
    }).select(*drafts.columns)
    return after, rejected


def fold_answers(questions: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers as snippets of full relevance, and the questions with the answered ones marked.

    ``questions`` carries ``table_ref``; answers to unknown questions are dropped.
    """
    matched = answers.join(
        questions.select("session_id", "table_ref", "qid", "target_name"), ["session_id", "qid"])
    who = F.coalesce("target_name", F.lit("the table"))
    snippets = matched.select(
        "session_id", "table_ref", "target_name",
        F.concat(F.lit("Operator answer about "), who, F.lit(": "), F.col("answer")).alias("text"),
        F.lit("user_answer").alias("source"),
        F.array_compact(F.array("target_name")).alias("informs"),
        F.lit(1.0).alias("relevance"), F.lit(0).alias("seq"))
    hit = answers.select("session_id", "qid").distinct().withColumn("_hit", F.lit(True))
    marked = questions.join(hit, ["session_id", "qid"], "left").withColumn(
        "answered", F.col("answered") | F.coalesce("_hit", F.lit(False))).select(*questions.columns)
    return snippets, marked


def affected_targets(answer_snippets: DataFrame) -> DataFrame:
    return answer_snippets.select("session_id", target_name(F.col("target_name")).alias("target")).distinct()


def expand_targets(requests: DataFrame, drafts: DataFrame) -> DataFrame:
    """Targets to redo: the named ones, or the table and every column where none or all are asked for."""
    everything = (F.coalesce(F.size("targets"), F.lit(0)) <= 0) | F.coalesce(
        F.array_contains("targets", ALL_TARGETS), F.lit(False))
    tasks = tasks_for(requests, TABLES_PER_TASK)
    whole = requests.filter(everything).select("session_id").distinct()
    all_of = drafts.select("session_id", "target").join(hashed(whole, requests.count()), "session_id", "left_semi")
    tables = whole.select("session_id", F.lit(TABLE_TARGET).alias("target"))
    named = requests.filter(~everything).select("session_id", F.explode("targets").alias("target")).withColumn(
        "target", target_name(F.col("target")))
    return dealt(all_of.unionByName(tables).unionByName(named), tasks, "session_id").distinct()


def merge_redrafts(drafts: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh drafts in place of the old ones of the same target; all others unchanged."""
    keys = ["session_id", "target"]
    rest = [c for c in drafts.columns if c not in keys]
    new = fresh.select(*keys, F.struct(*rest).alias("_new"))
    joined = drafts.select(*keys, F.struct(*rest).alias("_old")).join(new, keys, "left")
    return joined.select(*keys, F.coalesce("_new", "_old").alias("d")).select(*keys, "d.*").select(*drafts.columns)
