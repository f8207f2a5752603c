"""The library of approved comments: upsert, life cycle, reuse and listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_blank, strip, table_key
from ..schemas import LIBRARY_REUSABLE_STATUSES, TABLE_TARGET
from .runs import page_of
from .skew import top_per_key

KEY = ("scope", "match_key")
REUSED_PER_KEY = 3
LONGEST_PAGE = 500
# Columns an upsert replaces; the rest of an entry survives.
REPLACED = ("canonical_comment", "conditional_fields", "tags", "source_session_id", "source_table_ref",
            "approved_by", "status")


def latest_per_key(incoming: DataFrame) -> DataFrame:
    """One row per (scope, key): the newest wins, usage bumps add up, the first one is kept apart.

    ``incoming`` has the replaced columns plus ``at``, ``seq`` (order among equal times) and ``bump``.
    """
    return incoming.groupBy(*KEY).agg(
        F.max_by(F.struct(*[c for c in REPLACED if c in incoming.columns], "at"), F.struct("at", "seq")).alias("last"),
        F.sum(F.col("bump").cast("long")).alias("bumps"),
        F.min_by(F.col("bump").cast("long"), F.struct("at", "seq")).alias("first_bump"),
    ).select(*KEY, "last.*", "bumps", "first_bump")


def upsert(library: DataFrame, incoming: DataFrame, new_id: Column | None = None) -> DataFrame:
    """The library after the incoming rows: new keys start at one use, known ones take the new fields."""
    changes = latest_per_key(incoming)
    ids = F.sha2(F.concat_ws("\n", *KEY), 256) if new_id is None else new_id
    fields = [c for c in REPLACED if c in changes.columns]
    fresh = changes.select(*KEY, *[F.col(c).alias(f"new_{c}") for c in [*fields, "at", "bumps", "first_bump"]])
    both = library.join(fresh, list(KEY), "full_outer")
    touched, known = F.col("new_at").isNotNull(), F.col("id").isNotNull()
    out = {c: F.when(touched, F.col(f"new_{c}")).otherwise(F.col(c)) for c in fields}
    out["usage_count"] = (
        F.when(~touched, F.col("usage_count"))
        .when(known, F.col("usage_count") + F.col("new_bumps"))
        .otherwise(1 + F.col("new_bumps") - F.col("new_first_bump")))
    for stamp in ("approved_at", "updated_at"):
        if stamp in library.columns:
            out[stamp] = F.when(touched, F.col("new_at")).otherwise(F.col(stamp))
    out["id"] = F.coalesce("id", ids)
    return both.withColumns(out).select(*library.columns)


def _marked(library: DataFrame, ids: DataFrame) -> DataFrame:
    return library.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")


def sunset(library: DataFrame, ids: DataFrame, by: str | None, at: Column) -> DataFrame:
    """Retires entries: kept, but hidden and never reused."""
    hit = F.coalesce("_hit", F.lit(False))
    return _marked(library, ids).withColumns({
        "status": F.when(hit, "sunset").otherwise(F.col("status")),
        "sunset_at": F.when(hit, at).otherwise(F.col("sunset_at")),
        "sunset_by": F.when(hit, F.lit(by)).otherwise(F.col("sunset_by")),
        "updated_at": F.when(hit, at).otherwise(F.col("updated_at")),
    }).select(*library.columns)


def revive(library: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Back to approved, without the marks of retirement."""
    hit = F.coalesce("_hit", F.lit(False))
    return _marked(library, ids).withColumns({
        "status": F.when(hit, "approved").otherwise(F.col("status")),
        "sunset_at": F.when(~hit, F.col("sunset_at")),
        "sunset_by": F.when(~hit, F.col("sunset_by")),
        "updated_at": F.when(hit, at).otherwise(F.col("updated_at")),
    }).select(*library.columns)


def reusable(library: DataFrame, scope: str, keys: DataFrame, per_key: int = REUSED_PER_KEY) -> DataFrame:
    """The most used entries of each wanted key, newest first among equals."""
    wanted = keys.select("match_key").filter(F.coalesce(F.col("match_key"), F.lit("")) != "").distinct()
    candidates = (
        library.filter((F.col("scope") == scope) & F.col("status").isin(*LIBRARY_REUSABLE_STATUSES))
        .join(wanted, "match_key", "left_semi")
        .select("id", "match_key", "canonical_comment", "tags", "usage_count", "updated_at")
    )
    order = [F.col("usage_count").desc(), F.col("updated_at").desc(), F.col("id")]
    best = top_per_key(candidates, ["match_key"], order, max(1, int(per_key)), ["id"], sliced=True)
    return best.select("match_key", "canonical_comment", "tags", "usage_count", "rank")


def page(library: DataFrame, *, scope: str | None = None, include_sunset: bool = False,
         limit: int = 100, offset: int = 0, longest: int = LONGEST_PAGE) -> DataFrame:
    """One page of entries, most used first."""
    kept = library if scope is None else library.filter(F.col("scope") == scope)
    if not include_sunset:
        kept = kept.filter(F.col("status") != "sunset")
    order = [F.col("usage_count").desc(), F.col("updated_at").desc(), F.col("id")]
    return page_of(kept, order, limit, offset, longest)


def match_key(target: Column, table_ref: Column) -> Column:
    return F.when(target == TABLE_TARGET, table_key(table_ref)).otherwise(target)


def entries_from_drafts(drafts: DataFrame, by: str, at: Column, *, status: str = "approved",
                        bump: bool = True) -> DataFrame:
    """Library rows for reviewed drafts; drafts with a blank comment give none."""
    return drafts.filter(~is_blank(F.col("proposed_comment"))).select(
        F.when(F.col("target") == TABLE_TARGET, "table").otherwise("column").alias("scope"),
        match_key(F.col("target"), F.col("table_ref")).alias("match_key"),
        strip(F.col("proposed_comment")).alias("canonical_comment"),
        "conditional_fields", "tags",
        F.col("session_id").alias("source_session_id"), F.col("table_ref").alias("source_table_ref"),
        F.lit(by).alias("approved_by"), F.lit(status).alias("status"),
        at.alias("at"), F.coalesce("ordinal", F.lit(0)).alias("seq"), F.lit(int(bump)).alias("bump"))
