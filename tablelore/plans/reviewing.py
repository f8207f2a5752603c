"""Decisions on drafts, and writing the approved ones back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import apply, library, review
from ..session import checkpoint_folder, cut_lineage
from ..sources.store import append_audit


@dataclass(frozen=True)
class Reviewed:
    drafts: DataFrame
    rejected: DataFrame
    library: DataFrame


def take_reviews(drafts: DataFrame, actions: DataFrame, entries: DataFrame, by: str, at: Column) -> Reviewed:
    """Drafts after the reviewers' actions; what was approved or edited also enters the library."""
    after, rejected = review.review(drafts, actions)
    after = cut_lineage(after)
    acted = actions.filter(F.col("action").isin("approve", "edit")).select(
        "session_id", review.target_name(F.col("target")).alias("target")).distinct()
    approved = after.filter(F.col("status").isin("approved", "edited")).join(acted, ["session_id", "target"], "left_semi")
    return Reviewed(after, rejected, library.upsert(entries, library.entries_from_drafts(approved, by, at)))


def take_bulk_approval(drafts: DataFrame, entries: DataFrame, by: str, at: Column, threshold: float) -> Reviewed:
    """Approves what the gate kept at or above the threshold; everything flagged waits for a reviewer."""
    kept = cut_lineage(drafts.filter(review.approvable(threshold)))
    after = review.approve_high_confidence(drafts, threshold)
    return Reviewed(after, kept.limit(0), library.upsert(entries, library.entries_from_drafts(kept, by, at)))


@dataclass(frozen=True)
class Written:
    results: DataFrame
    drafts: DataFrame
    audit: DataFrame
    library: DataFrame


def write_back(drafts: DataFrame, live: DataFrame, entries: DataFrame, by: str, at: Column, *,
               confirm: bool | str = False, targets: DataFrame | None = None, out: str | None = None,
               run: str | None = None, audit: str | None = None) -> Written:
    """Writes reviewed comments to the catalog and records what happened to each.

    The plan is stored before anything runs, so that every later step sees the comments as they were.
    Outcomes go to ``out``, in a folder of this ``run``; without it to the session's shared folder. With
    ``audit`` the audit rows are appended there.
    """
    plan = cut_lineage(apply.plan_apply(drafts, live, confirm=confirm, targets=targets))
    folder = out or f"{checkpoint_folder(drafts.sparkSession).rstrip('/')}/outcomes"
    done = cut_lineage(apply.results(plan, apply.execute(plan, folder, run)))
    trail = apply.audit_rows(done, by, at)
    if audit:
        append_audit(trail, audit)
    return Written(done, apply.mark_applied(drafts, done, by, at), trail,
                   library.upsert(entries, apply.library_rows(done, by, at)))
