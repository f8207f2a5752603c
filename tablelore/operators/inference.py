"""Calling a model over a prompt table, and reading its replies into drafts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.loose_json import is_object, json_body
from ..functions.text import append_line, clean_facts, clean_tags, is_blank, strip
from ..schemas import DRAFT, TABLE_TARGET

Model = Callable[[list[dict[str, str]]], str]

TABLE_REPLY = ("proposed_comment string, rationale string, tags array<string>, facts map<string,string>, "
               "evidence_refs array<string>, self_confidence double")
COLUMN_REPLY = ("columns array<struct<name:string,proposed_comment:string,rationale:string,tags:array<string>,"
                "conditional_fields:map<string,string>,evidence_refs:array<string>,self_confidence:double>>")
VERDICT_REPLY = "subscores map<string,string>, issues array<string>"
ANSWER_REPLY = "answers array<struct<id:string,answer:string>>"


def infer(prompts: DataFrame, model: Model, *, done: DataFrame | None = None, key: str = "prompt_id",
          partitions: int | None = None) -> DataFrame:
    """Prompts with the model's ``reply``, or the ``failure`` of that one call.

    ``prompts`` has ``prompt_id`` and ``messages`` besides what is passed through. Prompts already in
    ``done``, by ``key``, are not asked again, so a rerun after a loss only makes the missing calls. The caller
    stores the result before using it twice: asking again may give other words.
    """
    todo = prompts if done is None else prompts.join(done.select(key), key, "left_anti")
    if partitions:
        todo = todo.repartition(partitions, "prompt_id")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies, failures = [], []
            for text in batch.column("messages").to_pylist():
                try:
                    replies.append(model(json.loads(text)))
                    failures.append(None)
                except Exception as failure:  # one failed call must not fail the batch
                    replies.append(None)
                    failures.append(str(failure) or type(failure).__name__)
            added = [pa.array(replies, pa.string()), pa.array(failures, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added], names=[*batch.schema.names, "reply", "failure"])

    schema = T.StructType([*todo.schema.fields, T.StructField("reply", T.StringType()),
                           T.StructField("failure", T.StringType())])
    return todo.mapInArrow(ask, schema)


def parsed(replies: DataFrame, schema: str) -> DataFrame:
    """Replies with ``answer``, or a failure where the call failed or the reply holds no JSON object."""
    body = replies.withColumn("_body", json_body(F.col("reply")))
    usable = F.col("failure").isNull() & is_object(F.col("_body"))
    problem = F.when(~usable, F.lit("model output is not a valid JSON object"))
    return body.withColumns({
        "answer": F.when(usable, F.from_json("_body", schema)),
        "failure": F.coalesce("failure", problem),
    }).drop("_body", "reply")


def _noted(rationale: Column, actions: Column) -> Column:
    """The rationale with a line on how the prompt was made to fit."""
    note = F.concat(F.lit("[context compacted to fit token budget: "), F.array_join(actions, ", "), F.lit("]"))
    return F.when(F.size(actions) > 0, append_line(rationale, note)).otherwise(rationale)


def _draft_row(values: dict[str, Column]) -> list[Column]:
    return [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in DRAFT.fields]


def _draft_status(failure: Column) -> Column:
    return F.when(failure.isNotNull(), "error").otherwise("draft")


def table_drafts(replies: DataFrame) -> DataFrame:
    """One draft per table prompt; ``replies`` carries ``session_id, table_ref, existing_comment, actions``."""
    rows = parsed(replies, TABLE_REPLY)
    answer, failed = F.col("answer"), F.col("failure")
    return rows.select(*_draft_row({
        "session_id": F.col("session_id"), "table_ref": F.col("table_ref"), "target": F.lit(TABLE_TARGET),
        "ordinal": F.lit(0), "current_comment": F.col("existing_comment"),
        "proposed_comment": answer["proposed_comment"],
        "rationale": F.when(failed.isNotNull(), F.concat(F.lit("reasoning failed: "), failed)).otherwise(
            _noted(answer["rationale"], F.col("actions"))),
        "confidence": answer["self_confidence"],
        "evidence_refs": F.when(failed.isNull(), F.coalesce(answer["evidence_refs"], F.array().cast("array<string>"))),
        "tags": F.when(failed.isNull(), clean_tags(answer["tags"])),
        "facts": clean_facts(answer["facts"]), "status": _draft_status(failed), "apply_status": F.lit("not_applied"),
    }))


def _last_named(answers: Column, name: Column) -> Column:
    """The last of the answers with this name; NULL if there is none."""
    from_end = F.reverse(answers["name"])
    place = F.when(name.isNotNull(), F.array_position(from_end, name)).otherwise(
        F.array_position(F.transform(from_end, lambda n: n.isNull()), F.lit(True)))
    return F.get(answers, (F.size(answers) - place).cast("int"))


def column_drafts(replies: DataFrame) -> DataFrame:
    """One draft per asked column; a column the reply leaves out is an error, one never asked for is ignored.

    Each prompt row carries the columns it asked about, so the reply is read in place. Of several
    answers for one column the last counts.
    """
    rows = parsed(replies, COLUMN_REPLY)
    given = F.coalesce(F.col("answer.columns"), F.array().cast(
        "array<struct<name:string,proposed_comment:string,rationale:string,tags:array<string>,"
        "conditional_fields:map<string,string>,evidence_refs:array<string>,self_confidence:double>>"))
    # The answers are looked up inside the prompt's row, so that no column carries those of all others.
    found = rows.withColumn("given", given).select("session_id", "table_ref", "failure", "actions", F.inline(F.transform(
        "asked", lambda c: F.struct(
            c["name"].alias("name"), c["ordinal"].alias("ordinal"), c["data_type"].alias("data_type"),
            c["current_comment"].alias("current_comment"), _last_named(F.col("given"), c["name"]).alias("a")))))
    missing = F.col("a").isNull()
    rationale = (
        F.when(F.col("failure").isNotNull(), F.concat(F.lit("reasoning failed: "), F.col("failure")))
        .when(missing, "model did not return a draft for this column")
        .otherwise(_noted(F.col("a.rationale"), F.col("actions"))))
    fields = F.when(F.size("a.conditional_fields") > 0, F.col("a.conditional_fields"))
    return found.select(*_draft_row({
        "session_id": F.col("session_id"), "table_ref": F.col("table_ref"), "target": F.col("name"),
        "ordinal": F.col("ordinal"), "data_type": F.col("data_type"), "current_comment": F.col("current_comment"),
        "proposed_comment": F.col("a.proposed_comment"), "rationale": rationale,
        "confidence": F.col("a.self_confidence"),
        "evidence_refs": F.when(~missing, F.coalesce("a.evidence_refs", F.array().cast("array<string>"))),
        "tags": F.when(~missing, clean_tags(F.col("a.tags"))), "conditional_fields": fields,
        "status": F.when(missing, "error").otherwise("draft"), "apply_status": F.lit("not_applied"),
    }))


def verdicts(replies: DataFrame) -> DataFrame:
    """Scores per draft from the judge's replies, as ``score_drafts`` takes them."""
    return parsed(replies, VERDICT_REPLY).select(
        "session_id", "target", F.col("answer.subscores").alias("raw_subscores"),
        F.col("answer.issues").alias("raw_issues"), "failure")


def answers_of(replies: DataFrame) -> DataFrame:
    """Proposed answers per question from the model's replies; failed calls propose nothing."""
    rows = parsed(replies, ANSWER_REPLY).filter(F.col("failure").isNull())
    return rows.select("session_id", F.posexplode("answer.answers").alias("seq", "a")).select(
        "session_id", F.col("a.id").alias("qid"), F.col("a.answer").alias("answer"), "seq")


def suggest_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with a proposed answer where none was there yet; blank proposals count as none."""
    last = answers.groupBy("session_id", "qid").agg(F.max(F.struct("seq", "answer")).alias("_last"))
    usable = F.when(~is_blank(F.col("_last.answer")), strip(F.col("_last.answer")))
    return questions.join(last, ["session_id", "qid"], "left").withColumn(
        "suggested_answer", F.coalesce("suggested_answer", usable)).select(*questions.columns)
