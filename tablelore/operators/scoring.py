"""Rubric scores of drafts and the evidence they are judged on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import append_line, tokens
from ..schemas import TABLE_TARGET
from .profile import VOLATILE_FIELDS

# Rubric dimensions and their weights.
RUBRIC = {"completeness": 0.30, "specificity": 0.30, "grounding": 0.25, "template_conformance": 0.15}
MEANINGS = {
    "completeness": "what the template asks for is there", "specificity": "it says more than the name and type do",
    "grounding": "every claim has its evidence", "template_conformance": "shape and length are as asked",
}


def clean_score(raw: Column) -> Column:
    """A number in [0, 1]; 0 for what is missing or not a number."""
    number = F.nanvl(F.coalesce(raw.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))


def clean_subscores(raw: Column, rubric: dict[str, float] = RUBRIC) -> Column:
    """The rubric's dimensions only, each cleaned."""
    pairs = []
    for name in rubric:
        pairs += [F.lit(name), clean_score(F.try_element_at(raw, F.lit(name)))]
    return F.create_map(*pairs)


def overall(subscores: Column, rubric: dict[str, float] = RUBRIC) -> Column:
    total = F.lit(0.0)
    for name, weight in rubric.items():
        total = total + F.element_at(subscores, F.lit(name)) * weight
    return F.round(total, 4)


def score_drafts(drafts: DataFrame, verdicts: DataFrame, rubric: dict[str, float] = RUBRIC) -> DataFrame:
    """Drafts with the scores of their verdicts; the weighted score replaces the confidence.

    ``verdicts`` has ``session_id, target, raw_subscores MAP<STRING,STRING>, raw_issues, failure``.
    A failed verdict turns the draft into an error; drafts without a verdict stay as they are.
    """
    joined = drafts.join(verdicts.withColumn("_judged", F.lit(True)), ["session_id", "target"], "left")
    judged, failed = F.col("_judged").isNotNull(), F.col("failure").isNotNull()
    scores = clean_subscores(F.coalesce("raw_subscores", F.create_map().cast("map<string,string>")), rubric)
    note = F.concat(F.lit("[judge failed: "), F.col("failure"), F.lit("]"))
    none = F.array().cast("array<string>")
    return joined.withColumn("_scores", scores).withColumns({
        "subscores": F.when(judged & ~failed, F.col("_scores")).when(~judged, F.col("subscores")),
        "issues": F.when(judged & ~failed, F.coalesce("raw_issues", none)).when(~judged, F.col("issues")),
        "confidence": F.when(judged & ~failed, overall(F.col("_scores"), rubric)).otherwise(F.col("confidence")),
        "status": F.when(failed, "error").otherwise(F.col("status")),
        "rationale": F.when(failed, append_line(F.col("rationale"), note)).otherwise(F.col("rationale")),
    }).select(*drafts.columns)


def judge_content(kind: Column, draft: Column, evidence: Column) -> Column:
    """The message a judge gets about one draft."""
    return F.concat(F.lit("DRAFT ("), kind, F.lit(" comment):\n"), draft, F.lit("\n\nEVIDENCE:\n"), evidence)


def evidence_rows(drafts: DataFrame, tables: DataFrame, columns: DataFrame, keys: DataFrame,
                  snippets: DataFrame, budget: int | None = None, system: str = "") -> DataFrame:
    """What each draft is judged on, as JSON; drafts in error are not judged.

    ``keys`` has one ``schema_meta`` text and ``snippets`` one ``context`` array per table. Over the
    budget the context is replaced by its size; the draft and its own profile always stay. The budget
    is for the messages as sent, ``system`` included.
    """
    open_drafts = drafts.filter(F.col("status") != "error")
    table_profile = tables.select("table_ref", F.to_json(F.struct(*[c for c in tables.columns if c not in VOLATILE_FIELDS])).alias("table_profile"))
    column_profile = columns.select(
        "table_ref", F.col("name").alias("target"), F.to_json(F.struct(*columns.columns)).alias("column_profile"))
    # The joins by table stand together, so that the drafts are dealt by column once and by table once.
    joined = (
        open_drafts.join(column_profile, ["table_ref", "target"], "left")
        .join(table_profile, "table_ref", "left").join(keys, "table_ref", "left").join(snippets, "table_ref", "left")
    )
    none = F.array().cast("array<struct<text:string,source:string,informs:array<string>,relevance:double>>")
    context = F.coalesce("context", none)
    is_table = F.col("target") == TABLE_TARGET
    draft = F.to_json(F.struct("proposed_comment", "rationale", "evidence_refs"))
    profile = F.when(is_table, F.col("table_profile")).otherwise(F.coalesce("column_profile", F.lit("{}")))
    meta = F.when(~is_table, F.coalesce("schema_meta", F.lit("{}")))

    def evidence(context_text: Column) -> Column:
        return F.to_json(F.struct(profile.alias("profile"), meta.alias("schema_meta"), context_text.alias("context")))

    count = F.when(F.size(context) > 0, F.format_string("<%d context snippets omitted to fit budget>", F.size(context)))
    kind = F.when(is_table, "table").otherwise("column")
    texts = joined.withColumns({"_draft": draft, "_full": evidence(F.to_json(context))})  # each is used twice
    cost = tokens(F.lit(system)) + tokens(judge_content(kind, F.col("_draft"), F.col("_full")))
    chosen = F.col("_full") if budget is None else F.when(cost > budget, evidence(count)).otherwise(F.col("_full"))
    return texts.select(
        "session_id", "table_ref", "target",
        kind.alias("kind"), F.col("_draft").alias("draft"), chosen.alias("evidence"))
