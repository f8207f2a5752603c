import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tablelore.operators import apply, lineage
from tablelore.operators.profile import ProfileOptions
from tablelore.plans.documenting import Models, Settings, document, regenerate, resume, save, saved
from tablelore.plans.schema_run import run_schema
from tablelore.plans.reviewing import take_bulk_approval, take_reviews, write_back
from tablelore.schemas import LIBRARY
from tablelore.sources import store

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write(messages):
    task = messages[-1]["content"]
    if "Draft the table comment" in task:
        return json.dumps({"proposed_comment": "Orders placed.", "facts": {"grain": "one order", "owner": "unknown"}, "tags": ["Fact"]})
    names = task.rsplit("columns: ", 1)[1].rstrip(".").split(", ")
    assert "Orders placed." in task
    heard = "Operator answer" in json.dumps(messages)
    return json.dumps({"columns": [
        {"name": n, "proposed_comment": ("Answered " if heard else "About ") + n, "self_confidence": 1} for n in names if n != "dropped"]})


def judge(messages):
    text = messages[-1]["content"]
    if "About flag" in text:
        raise RuntimeError("judge down")
    score = 0.5 if "About note" in text else 1
    return "```json\n" + json.dumps({"subscores": dict.fromkeys(
        ("completeness", "specificity", "grounding", "template_conformance"), score), "issues": []}) + "\n```"


def suggest(messages):
    asked = json.loads(messages[-1]["content"])["questions"]
    return json.dumps({"answers": [{"id": q["id"], "answer": "maybe " + q["target"]} for q in asked]})


MODELS = Models(write, judge, suggest)


@pytest.fixture(scope="module")
def state(spark):
    rows = spark.range(200).select(
        F.col("id").alias("order_key"), F.concat(F.lit("n"), F.col("id") % 60).alias("note"),
        (F.col("id") % 3).cast("string").alias("flag"), (F.col("id") % 70).alias("dropped"), (F.col("id") % 2).alias("tier"))
    column_edges = spark.createDataFrame(
        [("c.s.raw", "k", "c.s.orders", "order_key")],
        "source_table_full_name string, source_column_name string, target_table_full_name string, target_column_name string")
    edges = spark.createDataFrame([("c.s.raw", "c.s.orders")], "source_table_full_name string, target_table_full_name string")

    def gone():
        raise ValueError("cannot read")

    def down(targets):
        raise ConnectionError("no route")

    return document(
        spark, {"c.s.orders": lambda: rows, "c.s.gone": gone}, MODELS,
        providers={"uc_lineage": lambda t: lineage.lineage_snippets(edges, column_edges, t), "wiki": down},
        settings=Settings(profile=ProfileOptions(exact=True)), run="r1", created_by="me")


def by_target(frame):
    return {r.target: r for r in frame.collect()}


def test_drafts_are_scored_and_routed(state):
    rows = by_target(state.drafts)
    assert rows["__table__"].proposed_comment == "Orders placed." and rows["__table__"].facts == {"grain": "one order"}
    assert rows["order_key"].status == "draft" and rows["order_key"].confidence == 1.0
    assert rows["note"].status == "needs_input" and rows["note"].confidence == 0.5
    assert rows["dropped"].status == "error" and rows["flag"].status == "error"
    assert "judge failed: judge down" in rows["flag"].rationale
    assert rows["tier"].status == "needs_input"  # an enumeration nothing decodes


def test_questions_sessions_and_failures(state):
    questions = sorted(state.questions.collect(), key=lambda q: q.qid)
    assert [(q.qid, q.target_name, q.suggested_answer) for q in questions] == [
        ("q1", "note", "maybe note"), ("q2", "tier", "maybe tier")]
    assert {r.table: r.status for r in state.sessions.collect()} == {"orders": "awaiting_input", "gone": "failed"}
    assert [r.table_ref for r in state.errors.collect()] == ["c.s.gone"]
    assert state.warnings == ["wiki: unavailable (no route)"]
    assert "order_key" in [n for r in state.snippets.collect() for n in r.informs]


def test_a_saved_run_comes_back_whole(state, spark, tmp_path):
    folder = str(tmp_path / "store")
    for _ in range(2):
        save(state, folder)
    assert by_target(saved(spark, folder, "drafts")).keys() == by_target(state.drafts).keys()
    assert saved(spark, folder, "sessions").count() == state.sessions.count()
    whole = store.whole_sessions(store.read_state(saved(spark, folder, "snapshots")))
    row = whole.filter("target = 'c.s.orders'").first()
    assert row.phase == "awaiting_input" and row.context and '"row_count":200' in row.profile
    back, kept = by_target(store.drafts_of_state(whole)), by_target(state.drafts)
    for name in ("note", "order_key", "__table__"):
        assert (back[name].subscores, back[name].facts, back[name].confidence) == (kept[name].subscores, kept[name].facts, kept[name].confidence)
    assert len(row.open_questions) == state.questions.count()


def test_resume_redoes_only_the_answered_draft(state, spark):
    session = state.questions.first().session_id
    answers = spark.createDataFrame([(session, "q1", "free text"), (session, "q9", "lost")], "session_id string, qid string, answer string")
    after = resume(state, answers, MODELS)
    rows = by_target(after.drafts)
    assert rows["note"].proposed_comment == "Answered note" and rows["note"].status == "draft"
    assert rows["tier"].proposed_comment == "About tier" and rows["tier"].status == "needs_input"
    assert rows["order_key"].proposed_comment == "About order_key"
    assert [q.target_name for q in after.questions.collect()] == ["tier"]


def test_regenerate_everything(state, spark):
    session = state.questions.first().session_id
    requests = spark.createDataFrame([(session, [])], "session_id string, targets array<string>")
    after = regenerate(state, requests, MODELS)
    assert after.drafts.count() == state.drafts.count()


def test_batch_mode_asks_nothing(spark):
    rows = spark.range(100).select((F.col("id") % 2).alias("tier"))
    made = document(spark, {"c.s.t": lambda: rows}, MODELS, settings=Settings(mode="batch"), run="r2")
    assert made.questions.count() == 0
    tier = by_target(made.drafts)["tier"]
    assert tier.status == "low_confidence" and "low confidence: enum_no_decode" in tier.rationale
    assert made.sessions.first().status == "ready_for_review"


def test_schema_run_and_write_back(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS lore_test")
    for name, note in (("a", ""), ("b", "COMMENT 'known'")):
        spark.sql(f"DROP TABLE IF EXISTS lore_test.{name}")
        spark.sql(f"CREATE TABLE lore_test.{name} (id BIGINT, `odd name` STRING) USING parquet {note}")
        spark.sql(f"INSERT INTO lore_test.{name} SELECT id, concat('v', id) FROM range(80)")
    made = run_schema(spark, "r3", "spark_catalog", "lore_test", MODELS, created_by="me")
    counts = made.counts.first()
    assert (counts.total, counts.ready + counts.needs_input, counts.error) == (1, 1, 0) and counts.status == "completed"

    again = run_schema(spark, "r3", "spark_catalog", "lore_test", MODELS, earlier=made.documented.sessions)
    assert again.documented is None and again.counts.first().skipped == 1

    documented = run_schema(spark, "r4", "spark_catalog", "lore_test", MODELS, filters={"skip_documented": False}).documented
    ref = "spark_catalog.lore_test.b"
    drafts = documented.drafts.filter(F.col("table_ref") == ref)
    assert by_target(drafts)["__table__"].current_comment == "known"
    session = drafts.first().session_id
    actions = spark.createDataFrame(
        [(session, "", "edit", "It's edited.", 1), (session, "id", "approve", None, 2), (session, "odd name", "edit", " ", 3)],
        "session_id string, target string, action string, comment string, seq int")
    now, entries = F.current_timestamp(), spark.createDataFrame([], LIBRARY)
    reviewed = take_reviews(drafts, actions, entries, "me", now)
    assert [r.target for r in reviewed.rejected.collect()] == ["odd name"]
    learned = {r.match_key: (r.status, r.usage_count) for r in reviewed.library.collect()}
    assert learned == {ref: ("approved", 1), "id": ("approved", 1)}

    written = write_back(reviewed.drafts, apply.live_comments(spark, [ref]), reviewed.library, "me", now, out=str(tmp_path / "outcomes"))
    assert {r.target: r.result for r in written.results.collect()} == {"__table__": "applied", "id": "applied"}
    assert {r.before for r in written.audit.collect()} == {'{"comment":"known"}', '{"comment":null}'}
    assert {r.match_key: (r.status, r.usage_count) for r in written.library.collect()} == {ref: ("applied", 1), "id": ("applied", 1)}
    after = by_target(written.drafts)
    assert after["id"].status == "applied" and after["id"].applied_by == "me" and after["odd name"].apply_status == "not_applied"
    live = {r.target: r.live for r in apply.live_comments(spark, [ref]).collect()}
    assert live == {"__table__": "It's edited.", "id": "About id", "odd name": None}

    bulk = take_bulk_approval(drafts, entries, "me", now, 0.75)
    assert {r.status for r in bulk.drafts.collect()} <= {"approved", "needs_input", "error"}
    plan = apply.plan_apply(reviewed.drafts, apply.live_comments(spark, [ref]), confirm=True)
    broken = plan.withColumn("decision", F.lit("write")).withColumn("statement", F.when(
        F.col("target") == "id", "COMMENT ON TABLE nowhere.at IS 'x'").otherwise("COMMENT ON TABLE lore_test.b IS 'again'"))
    outcomes = {r.target: r.error for r in apply.execute(broken, str(tmp_path / "broken")).collect()}
    assert outcomes["id"] and outcomes["__table__"] is None

    windows = "path C:\\temp\\new, it's here\\"
    edited = reviewed.drafts.withColumn("proposed_comment", F.lit(windows))
    for _ in range(2):  # a second run into one folder gives one row per item again
        now_live = apply.live_comments(spark, [ref])
        second = write_back(edited, now_live, entries, "me", now, confirm=True, out=str(tmp_path / "outcomes"), audit=str(tmp_path / "audit"))
        rows = second.results.collect()
        assert len(rows) == len({r.target for r in rows}) == 2
    assert {r.result for r in rows} == {"skipped_noop"} and spark.read.parquet(str(tmp_path / "audit")).count() == 2
    live = {r.target: r.live for r in apply.live_comments(spark, [ref]).collect()}
    assert live["__table__"] == live["id"] == windows
    for name in ("a", "b"):
        spark.sql(f"DROP TABLE lore_test.{name}")


def test_a_run_begun_again_asks_only_what_is_missing(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 2).alias("tier"), F.col("id").alias("k"))
    log = str(tmp_path / "calls")
    open(log, "w").close()

    def counted(model, fails=False):
        def ask(messages):
            with open(log, "a") as file:
                file.write("x")
            if fails:
                raise RuntimeError("down")
            return model(messages)
        return ask

    def run(judge_fails):
        models = Models(counted(write), counted(judge, judge_fails))
        made = document(spark, {"c.s.t": lambda: rows}, models, settings=Settings(mode="batch", replies=str(tmp_path / "replies")), run="r9")
        made.drafts.count()
        calls = len(open(log).read())
        open(log, "w").close()
        return calls, {r.target: r.status for r in made.drafts.collect()}

    first, broken = run(True)
    again, mended = run(False)
    third, _ = run(False)
    assert set(broken.values()) == {"error"} and "error" not in mended.values()
    assert (first, again, third) == (5, 3, 0)


def test_tables_are_written_side_by_side_and_columns_together(spark, tmp_path):
    import threading
    import time

    rows = [(f"s{t}", f"c.s.t{t}", n, f"ALTER {t}.{n}" if n != "__table__" else f"TABLE {t}", "write", f"about {n}'s")
            for t in range(100) for n in ("__table__", "a", "b", "bad" if t == 7 else "c")]
    rows += [("twice", "c.s.t3", "a", "ALTER 3.a again", "write", "other"), ("no", "c.s.t3", "a", None, "skipped_noop", "x")]
    plan = spark.createDataFrame(rows, "session_id string, table_ref string, target string, statement string, decision string, proposed_comment string")
    sent, running, most, lock = [], 0, 0, threading.Lock()

    def send(text):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
            sent.append(text)
        time.sleep(0.01)
        with lock:
            running -= 1
        if "bad" in text:
            raise RuntimeError("no such column\nmore")

    found = {(r.session_id, r.table_ref, r.target): r.error for r in apply.execute(plan, str(tmp_path / "out"), at_once=4, send=send).collect()}
    assert len(found) == 401 and {k for k, e in found.items() if e} == {("s7", "c.s.t7", "bad")} and found[("s7", "c.s.t7", "bad")] == "no such column"
    assert 1 < most <= 4
    together = [x for x in sent if x.count(" COMMENT ") == 3]
    assert len(together) == 99 and "ALTER TABLE `c`.`s`.`t5` ALTER COLUMN `a` COMMENT 'about a''s', `b` COMMENT 'about b''s', `c` COMMENT 'about c''s'" in sent
    assert [x for x in sent if x.startswith("ALTER 3")] and sum(x.startswith("ALTER 7") for x in sent) == 3
