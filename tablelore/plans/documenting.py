"""From tables to reviewed-ready drafts, and back again with answers."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators import context, gate, inference, profile, prompts, review, scoring
from ..operators.runs import session_table
from ..schemas import DRAFT, QUESTION, TABLE_TARGET
from ..session import cut_lineage
from ..sources import store
from ..sources.replies import KEEP_EVERY, Replies
from ..sources.sampling import Sample
from ..sources.versions import Moved, Versions, key_of

Model = inference.Model
QUESTIONS_PER_PROMPT = 25
JUDGE_RULES = (
    "Score the comment draft below, from 0 to 1, on each of: "
    + "; ".join(f"{name} ({meaning})" for name, meaning in scoring.MEANINGS.items()) + ". Name every claim the "
    "evidence does not bear out as an issue. Answer with one JSON object: "
    '{"subscores": {dimension: number}, "issues": [text]}'
)
ANSWER_RULES = (
    "Propose a short answer to each question, from the evidence in it. Answer with one JSON object: "
    '{"answers": [{"id", "answer"}]}'
)


@dataclass(frozen=True)
class Settings:
    """``replies`` is a folder that keeps every reply of a model, so that a run begun again asks only what is missing.

    A task puts its replies away after ``keep_every`` calls. With ``store`` a run is saved there as it goes: when its
    tables are profiled, when they are drafted, scored and routed, and after each time it goes on.
    """

    mode: str = "hands_off"
    keep_threshold: float = gate.KEEP_THRESHOLD
    context_budget: int = context.CONTEXT_BUDGET
    prompt_budget: int | None = None
    columns_per_prompt: int = prompts.COLUMNS_PER_PROMPT
    calls_at_once: int | None = None
    replies: str | None = None
    keep_every: int = KEEP_EVERY
    store: str | None = None
    sample: Sample = Sample()
    profile: profile.ProfileOptions = profile.ProfileOptions()


@dataclass(frozen=True)
class Models:
    """The callables asked for drafts, scores, suggested answers and summaries; each takes chat messages."""

    write: Model
    judge: Model
    suggest: Model | None = None
    summarise: Model | None = None


@dataclass(frozen=True)
class Keys:
    """Declared keys: ``table_ref, constraint_name, constraint_type, column, pos`` and the references."""

    declared: DataFrame
    foreign: DataFrame

    @staticmethod
    def none(spark: SparkSession) -> "Keys":
        return Keys(
            spark.createDataFrame([], "table_ref string, constraint_name string, constraint_type string, column string, pos int"),
            spark.createDataFrame([], "table_ref string, constraint_name string, column string, ref_table string, "
                                      "ref_column string, pos int"))


@dataclass(frozen=True)
class Documented:
    """The working state of a run, every part a DataFrame."""

    tables: DataFrame
    columns: DataFrame
    keys: Keys
    snippets: DataFrame
    drafts: DataFrame
    questions: DataFrame
    sessions: DataFrame
    errors: DataFrame
    warnings: list[str]
    settings: Settings


def session_key(run: str, table_ref: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(run), table_ref), 256)


def _asked(prompted: DataFrame, model: Model, settings: Settings, stage: str) -> DataFrame:
    """Replies, stored: a model may answer differently when asked again.

    With ``settings.replies`` each prompt is asked once ever per stage: its words are its key, and replies are kept
    as they come. Failed calls are made again by the next run.
    """
    if settings.replies is None:
        return cut_lineage(inference.infer(prompted, model, partitions=settings.calls_at_once))
    kept = Replies(prompted.sparkSession, f"{settings.replies.rstrip('/')}/{stage}", settings.keep_every)
    named = cut_lineage(prompted.withColumn("call_id", F.sha2(F.concat_ws("\n", "prompt_id", "messages"), 256)))
    answered = kept.ask(named, model, settings.calls_at_once)
    return cut_lineage(named.join(answered, "call_id").drop("call_id"))


def _fitted(asked: DataFrame, models: Models, settings: Settings, stage: str) -> DataFrame:
    """Prompts within the budget; contexts that halving leaves too long are summarised by the model."""
    if settings.prompt_budget is None or models.summarise is None:
        return prompts.fit_prompts(asked, settings.prompt_budget)
    told = _asked(prompts.summary_requests(asked, settings.prompt_budget), models.summarise, settings, f"{stage}_summaries")
    return prompts.fit_prompts(asked, settings.prompt_budget, summaries=told)


def _drafts(state: Documented, tables: DataFrame, columns: DataFrame, models: Models) -> DataFrame:
    """Drafts of the tables and the columns given; columns are asked for with the fresh table comment."""
    settings = state.settings
    ids = state.sessions.select("session_id", F.concat_ws(".", "catalog", "schema", "table").alias("table_ref"))
    contexts = prompts.context_lists(state.snippets)
    meta = prompts.schema_meta(state.keys.declared, state.keys.foreign)

    asked = _fitted(prompts.table_prompts(tables, contexts), models, settings, "tables")
    asked = asked.join(ids, "table_ref").select(
        "prompt_id", "session_id", "table_ref", "existing_comment", "actions", prompts.messages().alias("messages"))
    of_tables = inference.table_drafts(_asked(asked, models.write, settings, "tables"))
    comments = of_tables.filter("status <> 'error'").select("table_ref", F.col("proposed_comment").alias("comment"))

    asked = prompts.column_prompts(columns, contexts, meta, comments, settings.columns_per_prompt)
    asked = _fitted(asked, models, settings, "columns").join(ids, "table_ref").select(
        "prompt_id", "session_id", "table_ref", "asked", "actions", prompts.messages().alias("messages"))
    of_columns = inference.column_drafts(_asked(asked, models.write, settings, "columns"))
    return of_tables.unionByName(of_columns)


def _judged(state: Documented, drafts: DataFrame, model: Model) -> DataFrame:
    contexts = prompts.context_lists(state.snippets)
    meta = prompts.schema_meta(state.keys.declared, state.keys.foreign)
    rows = scoring.evidence_rows(drafts, state.tables, state.columns, meta, contexts, state.settings.prompt_budget, JUDGE_RULES)
    content = scoring.judge_content(F.col("kind"), F.col("draft"), F.col("evidence"))
    listed = F.array(F.struct(F.lit("system").alias("role"), F.lit(JUDGE_RULES).alias("content")),
                     F.struct(F.lit("user").alias("role"), content.alias("content")))
    asked = rows.select(F.concat_ws("|", "session_id", "target").alias("prompt_id"), "session_id", "target",
                        F.to_json(listed).alias("messages"))
    replies = _asked(asked, model, state.settings, "scores")
    return cut_lineage(scoring.score_drafts(drafts, inference.verdicts(replies)))


def _suggested(state: Documented, questions: DataFrame, model: Model | None) -> DataFrame:
    """Questions with proposed answers, asked for in batches; without a model they stay open."""
    if model is None or state.settings.mode not in gate.ASKING_MODES:
        return questions
    evidence = state.columns.join(
        state.sessions.select("session_id", F.concat_ws(".", "catalog", "schema", "table").alias("table_ref")), "table_ref").select(
        "session_id", F.col("name").alias("target_name"),
        F.to_json(F.struct("data_type", "top_k", "min", "max", "is_enum_candidate", "cardinality_ratio", "null_fraction")).alias("profile"))
    number = F.regexp_extract("qid", r"\d+", 0).cast("int")
    batched = questions.filter(F.col("suggested_answer").isNull()).join(evidence, ["session_id", "target_name"], "left").withColumn(
        "batch", F.floor((number - 1) / QUESTIONS_PER_PROMPT))
    items = F.sort_array(F.collect_list(F.struct(
        number.alias("n"), F.struct(F.col("qid").alias("id"), F.coalesce("target_name", F.lit(TABLE_TARGET)).alias("target"),
                                    F.col("text").alias("question"), "profile").alias("item"))))
    grouped = batched.groupBy("session_id", "batch").agg(items.alias("items"))
    content = F.to_json(F.struct(F.transform("items", lambda x: x["item"]).alias("questions")))
    listed = F.array(F.struct(F.lit("system").alias("role"), F.lit(ANSWER_RULES).alias("content")),
                     F.struct(F.lit("user").alias("role"), content.alias("content")))
    asked = grouped.select(F.concat_ws("|", "session_id", F.col("batch").cast("string")).alias("prompt_id"), "session_id",
                           F.to_json(listed).alias("messages"))
    return cut_lineage(inference.suggest_answers(questions, inference.answers_of(_asked(asked, model, state.settings, "answers"))))


def _gated(state: Documented, drafts: DataFrame, models: Models) -> Documented:
    settings = state.settings
    signals = gate.hard_signals(state.columns, state.snippets, state.keys.foreign)
    routed = cut_lineage(gate.route(drafts, signals, settings.keep_threshold))
    asks = settings.mode in gate.ASKING_MODES
    questions = gate.questions(routed) if asks else routed.sparkSession.createDataFrame([], QUESTION)
    outcome = gate.outcomes(routed, settings.mode).select("session_id", F.col("status").alias("_status"))
    sessions = state.sessions.join(outcome, "session_id", "left").withColumn(
        "status", F.coalesce("_status", F.lit("failed"))).drop("_status")
    return replace(state, drafts=gate.settle(routed, settings.mode), sessions=cut_lineage(sessions),
                   questions=_suggested(state, questions, models.suggest))


def document(spark: SparkSession, tables: Mapping[str, Callable[[], DataFrame]], models: Models, *,
             providers: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None, keys: Keys | None = None,
             describe: Callable[[str], dict] | None = None, settings: Settings = Settings(), run: str = "",
             created_by: str = "", out: str | None = None) -> Documented:
    """Profiles the tables, gathers context, drafts comments, scores them and routes the weak ones.

    ``tables`` maps names to loaders. A table that cannot be profiled ends as a failed session and an
    error row; a provider that is down leaves a warning; a failed call marks its own drafts.
    """
    keys = keys or Keys.none(spark)
    made = profile.profile_tables(spark, tables, options=settings.profile, sample=settings.sample, describe=describe, out=out)
    profiles, columns = cut_lineage(made.tables), cut_lineage(made.columns)
    gathered = context.gather(providers or {}, columns.select("table_ref", "name", "ordinal"), settings.context_budget)
    refs = profiles.select("table_ref").unionByName(made.errors.select("table_ref"))
    now = F.current_timestamp()
    sessions = refs.select(
        session_key(run, F.col("table_ref")).alias("session_id"), *session_table(F.col("table_ref")),
        F.lit(settings.mode).alias("mode"), F.lit("reasoning").alias("status"), F.lit(None).cast("string").alias("template_id"),
        F.lit(None).cast("string").alias("config"), F.lit(created_by).alias("created_by"), F.lit(run).alias("schema_run_id"),
        now.alias("created_at"), now.alias("updated_at"))
    state = Documented(profiles, columns, keys, cut_lineage(gathered.snippets), spark.createDataFrame([], inference.DRAFT),
                       spark.createDataFrame([], QUESTION), cut_lineage(sessions), made.errors, gathered.warnings, settings)
    _kept(state)
    drafted = replace(state, drafts=cut_lineage(_drafts(state, profiles, columns, models)))
    _kept(drafted)
    scored = replace(drafted, drafts=_judged(drafted, drafted.drafts, models.judge))
    _kept(scored)
    return _kept(_gated(scored, scored.drafts, models))


def _kept(state: Documented) -> Documented:
    """The state, saved where its settings say."""
    if state.settings.store:
        save(state, state.settings.store)
    return state


def _redone(state: Documented, targets: DataFrame, models: Models) -> Documented:
    """Drafts the named targets again, with what is known by now, and routes all open drafts anew."""
    ids = state.sessions.select("session_id", F.concat_ws(".", "catalog", "schema", "table").alias("table_ref"))
    named = cut_lineage(targets.join(ids, "session_id"))
    tables = state.tables.join(named, "table_ref", "left_semi")
    columns = state.columns.join(named.select("table_ref", F.col("target").alias("name")), ["table_ref", "name"], "left_semi")
    fresh = _drafts(state, tables, columns, models).join(named, ["session_id", "target"], "left_semi")
    merged = review.merge_redrafts(state.drafts, _judged(state, cut_lineage(fresh), models.judge))
    return _kept(_gated(state, merged, models))


def resume(state: Documented, answers: DataFrame, models: Models) -> Documented:
    """Goes on with the reviewers' answers as evidence; ``answers`` has ``session_id, qid, answer``."""
    ids = state.sessions.select("session_id", F.concat_ws(".", "catalog", "schema", "table").alias("table_ref"))
    said, marked = review.fold_answers(state.questions.join(ids, "session_id"), answers)
    said = cut_lineage(said)
    added = said.select("table_ref", "text", "source", "informs", "relevance", "seq", F.lit(-1).alias("provider_seq"))
    known = replace(state, snippets=state.snippets.unionByName(added), questions=marked.drop("table_ref"))
    return _redone(known, review.affected_targets(said), models)


def regenerate(state: Documented, requests: DataFrame, models: Models) -> Documented:
    """Drafts the requested targets again; ``requests`` has ``session_id, targets``, none meaning all."""
    return _redone(state, review.expand_targets(requests, state.drafts), models)


#: The parts of a store; drafts and questions may still be missing while a run goes on.
STORED = {"sessions": None, "snapshots": None, "drafts": T.StructType(DRAFT.fields + [T.StructField("schema_run_id", T.StringType())]),
          "questions": T.StructType(QUESTION.fields + [T.StructField("schema_run_id", T.StringType())])}
SAVE_TRIES = 5


def save(state: Documented, folder: str) -> None:
    """Adds a run's sessions, drafts, questions and JSON snapshots to the store; run again, it replaces what it redid.

    All parts change at once, in one new version of the store, and only for the runs of this state. If another writer
    was first, what it left is read again and this state added to it; ``Moved`` after ``SAVE_TRIES`` such cases.
    """
    versions = Versions(state.sessions.sparkSession, folder)
    runs = [row[0] for row in state.sessions.select(key_of("schema_run_id")).distinct().collect()]
    named = state.sessions.select("session_id", "schema_run_id")
    for again in range(SAVE_TRIES):
        base = versions.snapshot()

        def earlier(part: str, like: DataFrame) -> DataFrame:
            return versions.read(part, like.schema, base, runs).select(like.columns)

        rows = {"sessions": store.merged_sessions(earlier("sessions", state.sessions), state.sessions)}
        for part, fresh in (("drafts", state.drafts), ("questions", state.questions), ("snapshots", store.write_state(
                state.sessions, state.drafts, state.questions, _said_once(state)))):
            fresh = fresh.join(named, "session_id")
            rows[part] = earlier(part, fresh).join(named.select("session_id"), "session_id", "left_anti").unionByName(fresh)
        written = {part: versions.write(part, made, "schema_run_id") for part, made in rows.items()}
        try:
            versions.commit(base, {part: {k: written[part].get(k) for k in runs} for part in rows})
            return
        except Moved:
            versions.forget()
            if again + 1 == SAVE_TRIES:
                raise


def _said_once(state: Documented) -> DataFrame:
    """What a snapshot holds besides drafts and questions: context, table profile and declared keys."""
    ids = state.sessions.select("session_id", F.concat_ws(".", "catalog", "schema", "table").alias("table_ref"))
    profiles = state.tables.select("table_ref", F.to_json(F.struct(*state.tables.columns)).alias("profile"))
    meta = prompts.schema_meta(state.keys.declared, state.keys.foreign)
    return ids.join(prompts.context_lists(state.snippets), "table_ref", "left").join(profiles, "table_ref", "left").join(
        meta, "table_ref", "left").select("session_id", "context", "profile", "schema_meta")


def saved(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """One of the stored parts, of all runs; ``snapshots`` is read with ``store.read_state``."""
    if part not in STORED:
        raise ValueError(f"unknown part {part!r}, expected one of {tuple(STORED)}")
    versions = Versions(spark, folder)
    snapshot = versions.snapshot()
    if not snapshot.version:
        raise ValueError(f"nothing was saved in {folder}")
    return versions.read(part, STORED[part], snapshot)
