"""Stored working state: rows, JSON snapshots and the audit trail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.loose_json import text_list, text_map
from ..schemas import DRAFT, TABLE_TARGET
from ..session import gathered, hashed, tasks_for

DRAFT_FIELDS = {
    "column_name": "string", "ordinal": "int", "data_type": "string", "current_comment": "string", "proposed_comment": "string",
    "rationale": "string", "confidence": "double", "judge_scores": "map<string,double>", "issues": "array<string>",
    "tags": "array<string>", "evidence_refs": "array<string>", "facts": "map<string,string>",
    "conditional_fields": "map<string,string>", "status": "string", "apply_status": "string", "applied_comment": "string",
    "applied_at": "timestamp", "applied_by": "string",
}
DRAFT_STATE = "struct<" + ",".join(f"{name}:{kind}" for name, kind in DRAFT_FIELDS.items()) + ">"
CONTEXT_STATE = "struct<text:string,source:string,informs:array<string>,relevance:double>"
QUESTION_STATE = ("struct<id:string,target_kind:string,target_name:string,text:string,answered:boolean,"
                  "suggested_answer:string>")
STATE = (
    "target string, session_id string, template_id string, phase string, "
    "config struct<mode:string,keep_threshold:double>, "
    f"context array<{CONTEXT_STATE}>, table_draft {DRAFT_STATE}, column_drafts array<{DRAFT_STATE}>, "
    f"open_questions array<{QUESTION_STATE}>"
)
COLUMNS_PER_PART = 500
# Drafts and questions without a number are spread over this many parts by their name.
UNNUMBERED_PARTS = 64
# Sessions, each with its snapshots, that one task takes.
SESSIONS_PER_TASK = 20_000


def read_state(snapshots: DataFrame, column: str = "state") -> DataFrame:
    """Snapshots as nested rows; what a snapshot leaves out gets its default.

    ``config``, ``profile`` and ``schema_meta`` come back as the JSON they were stored as. The session a row
    was stored under is kept as ``stored_under``, next to the ``session_id`` that its snapshot states.
    """
    raw = {name: F.get_json_object(column, f"$.{name}") for name in ("config", "profile", "schema_meta")}
    parsed = snapshots.withColumns({"_s": F.from_json(F.col(column), STATE), **{f"_{n}": v for n, v in raw.items()}}).drop(column)
    mode = F.coalesce("_s.config.mode", F.lit("interactive"))
    threshold = F.coalesce("_s.config.keep_threshold", F.lit(0.75))

    def listed(name: str, of: str) -> Column:
        return F.coalesce(f"_s.{name}", F.array().cast(f"array<{of}>"))

    own = ("_s", "target", "session_id", *[f"_{n}" for n in raw])
    key = [F.col("session_id").alias("stored_under")] if "session_id" in snapshots.columns else []
    return parsed.select(
        *[c for c in parsed.columns if c not in own], *key,
        F.col("_s.target").alias("target"), F.col("_s.session_id").alias("session_id"),
        F.col("_s.template_id").alias("template_id"), F.coalesce("_s.phase", F.lit("created")).alias("phase"),
        mode.alias("mode"), threshold.alias("keep_threshold"), *[F.col(f"_{n}").alias(n) for n in raw],
        listed("context", CONTEXT_STATE).alias("context"),
        F.col("_s.table_draft").alias("table_draft"), listed("column_drafts", DRAFT_STATE).alias("column_drafts"),
        listed("open_questions", QUESTION_STATE).alias("open_questions"))


def whole_sessions(state: DataFrame) -> DataFrame:
    """One row per session from the rows of its parts, in the order of their ``part``; a session is as large as its table is wide.

    What is said once is taken from the first part that says it. Rows without ``part`` count as the first.
    Rows are grouped by what they were stored under as well, so that those of ``write_state`` are grouped where they lie.
    """
    lists = ("context", "column_drafts", "open_questions")
    single = ("target", "template_id", "phase", "mode", "keep_threshold", "config", "profile", "schema_meta", "table_draft")
    place = F.coalesce(F.col("part").cast("int"), F.lit(0)) if "part" in state.columns else F.lit(0)

    def in_order(name: str) -> Column:
        parts = F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col(name).alias("part"))),
                             lambda x, y: F.when(x["place"] < y["place"], -1).when(x["place"] > y["place"], 1).otherwise(0))
        return F.flatten(F.transform(parts, lambda x: x["part"]))

    keys = [c for c in ("stored_under", "session_id") if c in state.columns]
    return state.groupBy(*keys).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in single], *[in_order(c).alias(c) for c in lists]).drop("stored_under")


def drafts_of_state(state: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """The drafts inside the snapshots, table draft first, with every field of a draft.

    Each draft also has the ``carried`` columns of its row, so that nobody has to read the state again and join it.
    """
    none = F.array().cast("array<string>")
    both = F.concat(F.array_compact(F.array("table_draft")), F.col("column_drafts"))
    told = [F.col(name).alias(f"_{name}") for name in carried]
    rows = state.select("session_id", F.col("target").alias("table_ref"), *told, F.explode(both).alias("d"))
    fields = {
        "session_id": F.col("session_id"), "table_ref": F.col("table_ref"),
        "target": F.coalesce("d.column_name", F.lit(TABLE_TARGET)), "subscores": F.col("d.judge_scores"),
        "tags": F.coalesce("d.tags", none), "evidence_refs": F.coalesce("d.evidence_refs", none),
        "status": F.coalesce("d.status", F.lit("draft")), "apply_status": F.coalesce("d.apply_status", F.lit("not_applied"))}
    return rows.select(*[(fields[n] if n in fields else F.col(f"d.{n}")).alias(n) for n in DRAFT.names],
                       *[F.col(f"_{name}").alias(name) for name in carried])


def write_state(sessions: DataFrame, drafts: DataFrame, questions: DataFrame, extras: DataFrame | None = None,
                width: int = COLUMNS_PER_PART) -> DataFrame:
    """Sessions as JSON snapshots, one row per session and part: ``session_id, part, state``.

    A part holds the columns of ``width`` ordinals, so that no session has to fit in one row; part 0 is
    always there and carries what is said once. ``extras`` adds per session a ``context`` array and the
    JSON texts ``profile`` and ``schema_meta``. ``whole_sessions`` puts the parts together again.
    """
    def part(number: Column, name: str) -> Column:
        return F.coalesce(F.floor(number / width), F.pmod(F.xxhash64(name), F.lit(UNNUMBERED_PARTS))).cast("int")

    is_table = F.col("target") == TABLE_TARGET
    have = set(drafts.columns)
    named = {"judge_scores": "subscores"}
    fields = [F.when(~is_table, F.col("target")).alias("column_name")] + [
        F.col(named.get(f, f)).alias(f) for f in DRAFT_FIELDS if named.get(f, f) in have]
    number = F.regexp_extract("qid", r"\d+", 0).try_cast("int")
    body = F.to_json(F.struct(*fields))
    question = F.to_json(F.struct(F.col("qid").alias("id"), "target_kind", "target_name", "text", "answered", "suggested_answer"))
    made = drafts.select(
        "session_id", F.when(is_table, 0).otherwise(part(F.col("ordinal"), "target")).alias("part"),
        F.when(is_table, body).alias("table_draft"), F.when(~is_table, F.struct("ordinal", "target", body.alias("body"))).alias("col"))
    asked = questions.select("session_id", part(number, "qid").alias("part"), F.struct(number.alias("n"), question.alias("body")).alias("q"))
    first = sessions.select("session_id", F.lit(0).alias("part"))
    pieces = made.unionByName(asked, allowMissingColumns=True).unionByName(first, allowMissingColumns=True)
    # Drafts and questions are dealt by session, as texts: neither the joins below nor ``whole_sessions`` deal them again.
    count = sessions.count()
    tasks = tasks_for(sessions, SESSIONS_PER_TASK, count)
    grouped = gathered(pieces, tasks, "session_id").groupBy("session_id", "part").agg(
        F.max("table_draft").alias("table_draft"), F.sort_array(F.collect_list("col")).alias("cols"),
        F.sort_array(F.collect_list("q")).alias("qs"))
    heads, none = gathered(sessions.drop("part"), tasks, "session_id"), F.lit(None).cast("string")
    if extras is None:
        heads = heads.withColumns({"context": none, "profile": none, "schema_meta": none})
    else:
        told = extras.select("session_id", F.to_json("context").alias("context"), "profile", "schema_meta")
        heads = heads.join(hashed(told, count), "session_id", "left")
    parts = grouped.join(hashed(heads, count), "session_id")
    stored = F.col("config") if "config" in sessions.columns else none

    def bodies(name: str) -> Column:
        return F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(name, lambda x: x["body"]), ","), F.lit("")), F.lit("]"))

    def once(name: str, empty: str) -> Column:
        return F.coalesce(F.when(F.col("part") == 0, F.col(name)), F.lit(empty))

    head = F.to_json(F.struct(
        F.concat_ws(".", "catalog", "schema", "table").alias("target"), "session_id", "template_id", F.col("status").alias("phase")))
    pieces = [F.regexp_replace(head, r"\}$", "")]
    for name, body in (("config", F.coalesce(stored, F.to_json(F.struct("mode")))), ("context", once("context", "[]")),
                       ("profile", once("profile", "null")), ("schema_meta", once("schema_meta", "null")),
                       ("table_draft", F.coalesce("table_draft", F.lit("null"))), ("column_drafts", bodies("cols")),
                       ("open_questions", bodies("qs"))):
        pieces += [F.lit(f',"{name}":'), body]
    return parts.select("session_id", "part", F.concat(*pieces, F.lit("}")).alias("state"))


def uuid_or_null(value: Column) -> Column:
    """The canonical form of a UUID; NULL for any other text, such as a template name."""
    bare = F.regexp_replace(F.lower(value), r"^(urn:)?(uuid:)?\{?|\}$", "")
    digits = F.replace(bare, F.lit("-"), F.lit(""))
    shape = F.regexp_replace(digits, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), shape)


UPDATED_ON_SAVE = ("status", "template_id", "config", "updated_at")


def save_sessions(sessions: DataFrame, saved: DataFrame) -> DataFrame:
    """Sessions after a save: new ones added, known ones updated.

    Who created a session and its run stay as first saved. Of several saves in one batch the last by
    ``updated_at`` counts for the updated fields, the first for the others.
    """
    fields = [c for c in sessions.columns if c != "session_id"]
    rows = saved.withColumn("template_id", uuid_or_null(F.col("template_id"))).withColumn(
        "schema_run_id", uuid_or_null(F.col("schema_run_id")))
    changes = rows.groupBy("session_id").agg(
        F.min_by(F.struct(*fields), F.col("updated_at")).alias("_first"),
        F.max_by(F.struct(*fields), F.col("updated_at")).alias("_last"))
    joined = sessions.withColumn("_known", F.lit(True)).join(changes, "session_id", "full_outer")
    known, touched = F.col("_known").isNotNull(), F.col("_last").isNotNull()
    out = {}
    for name in fields:
        if name in UPDATED_ON_SAVE:
            out[name] = F.when(touched, F.col(f"_last.{name}")).otherwise(F.col(name))
        else:
            out[name] = F.when(known, F.col(name)).otherwise(F.col(f"_first.{name}"))
    return joined.select("session_id", *[v.alias(k) for k, v in out.items()])


def merged_sessions(earlier: DataFrame, saved: DataFrame) -> DataFrame:
    """Stored sessions of some runs after saving ``saved``: who made a session and when stay as first stored."""
    first = earlier.select("session_id", F.col("created_by").alias("_by"), F.col("created_at").alias("_at"))
    fresh = saved.join(first, "session_id", "left").withColumns({
        "created_by": F.coalesce("_by", "created_by"), "created_at": F.coalesce("_at", "created_at")}).select(*saved.columns)
    return earlier.join(saved.select("session_id"), "session_id", "left_anti").select(*saved.columns).unionByName(fresh)


def rewrite_drafts(drafts: DataFrame, fresh: DataFrame, saved: DataFrame) -> DataFrame:
    """Drafts with those of the saved sessions replaced.

    Column drafts carry the id of their table draft; a session saved without one stores no columns.
    """
    table_id = F.sha2(F.concat_ws("\n", "session_id", F.lit(TABLE_TARGET)), 256)
    number = saved.count()  # the fresh drafts are those of the saved sessions
    with_table = hashed(fresh.filter(F.col("target") == TABLE_TARGET).select("session_id").distinct(), number)
    rows = fresh.join(with_table, "session_id", "left_semi").withColumn("table_draft_id", table_id)
    kept = drafts.join(hashed(saved.select("session_id").distinct(), number), "session_id", "left_anti")
    return kept.unionByName(rows.select(*kept.columns))


def lenient_columns(rows: DataFrame, lists: Sequence[str] = (), maps: Sequence[str] = ()) -> DataFrame:
    """Text columns holding JSON lists or objects as arrays and maps; malformed text gives empty ones."""
    out = {c: text_list(F.col(c)) for c in lists} | {c: text_map(F.col(c)) for c in maps}
    return rows.withColumns(out)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def replace_partitions(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replaces the partitions of ``path`` that ``rows`` has rows for, and no others.

    ``rows`` may have been read from ``path``: they are written next to it first, and only then over
    the old partitions. A run that breaks off in between is repaired by running it again.
    """
    spark = rows.sparkSession
    staged = path.rstrip("/") + "__staged"
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(staged)
    (
        spark.read.schema(rows.schema).parquet(staged)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    )
