"""Worked examples of the single steps."""

import json

import pytest
from pyspark.sql import functions as F

from tablelore.functions.loose_json import json_body, result_texts, text_list, text_map
from tablelore.functions.text import clean_tags, table_key, tokens
from tablelore.operators import apply, context, gate, history, inference, library, lineage, prompts, review, runs, scoring
from tablelore.sources import catalog, store

SIGNALS = ", ".join(f"{s} boolean" for s in gate.SIGNALS)


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("text, expected", [("", 0), ("a", 1), ("a" * 10, 2), ("a" * 14, 4), ("a" * 400, 100), (None, 0)])
def test_tokens_round_half_even(spark, text, expected):
    assert one(spark, text, tokens) == expected


def test_tokens_refuse_a_bad_rate():
    with pytest.raises(ValueError):
        tokens(F.lit("x"), 0)


@pytest.mark.parametrize("reply, body", [
    ('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('so: {"a": {"b": 2}} ok', '{"a": {"b": 2}}'), ("none", None), (None, None)])
def test_json_body(spark, reply, body):
    assert one(spark, reply, json_body) == body


@pytest.mark.parametrize("payload, texts", [
    (None, []), ("plain", ["plain"]), ('["a", {"text": "b"}, {"snippet": "c"}]', ["a", "b", "c"]),
    ('{"results": [{"text": "x"}]}', ["x"]), ('{"content": {"items": {"data": "deep"}}}', ["deep"]), ('{"summary": "s"}', ["s"]), ('{"results": null}', [])])
def test_result_texts(spark, payload, texts):
    assert one(spark, payload, result_texts) == texts


def test_lenient_lists_and_maps(spark):
    assert one(spark, '["a"]', text_list) == ["a"] and one(spark, "oops", text_list) == [] and one(spark, None, text_map) == {}


def test_names_and_tags(spark):
    assert one(spark, " `a` . b.`c` ", table_key) == "a.b.c"
    assert one(spark, [" Key", "key", "", "PII", "a", "b", "c", "d", "e"], clean_tags, "array<string>") == ["key", "pii", "a", "b", "c", "d"]


def test_lineage_and_history_snippets(spark):
    edges = spark.createDataFrame([("c.s.raw", "t.t.orders"), ("t.t.orders", "c.s.mart"), (None, "t.t.orders")],
                                  "source_table_full_name string, target_table_full_name string")
    column_edges = spark.createDataFrame([("c.s.dim", "id", "t.t.orders", "o_custkey")], "source_table_full_name string, source_column_name string, "
                                         "target_table_full_name string, target_column_name string")
    targets = spark.createDataFrame([("t.t.orders",)], "table_ref string")
    rows = {r.text: (r.relevance, r.informs) for r in lineage.lineage_snippets(edges, column_edges, targets).collect()}
    assert rows["Upstream sources (lineage): c.s.raw."] == (0.7, []) and rows["Downstream consumers (lineage): c.s.mart."] == (0.55, [])
    assert rows["Column `o_custkey` derives from `c.s.dim`.`id` (column lineage → FK/derivation hint)."] == (0.8, ["o_custkey"])
    log = spark.createDataFrame([(1, 1, "SELECT 1 FROM T.t.orders o JOIN c ON o.o_custkey = c.c_custkey WHERE 1=1 GROUP BY o.o_orderstatus")],
                                "statement_id int, start_time int, statement_text string")
    texts = [r.text for r in history.usage_snippets(log, targets).collect()]
    assert "Common join conditions (query history): o.o_custkey = c.c_custkey." in texts
    assert "Common GROUP BY (grain hint): o.o_orderstatus." in texts and "Observed in 1 recent queries referencing this table." in texts


def test_columns_of_a_prompt_travel_once(spark):
    columns = spark.createDataFrame([("a.b.t", n, o, "int", None, {"k": n}) for o, n in enumerate("dcba")],
                                    "table_ref string, name string, ordinal int, data_type string, existing_comment string, extra map<string,string>")
    contexts = spark.createDataFrame([], "table_ref string, context array<struct<text:string,source:string,informs:array<string>,relevance:double>>")
    none = spark.createDataFrame([], "table_ref string, schema_meta string")
    comments = none.withColumnRenamed("schema_meta", "comment")
    rows = sorted(prompts.column_prompts(columns, contexts, none, comments, 3).collect(), key=lambda r: r.batch)
    assert [[a.name for a in r.asked] for r in rows] == [["d", "c", "b"], ["a"]]
    assert json.loads(rows[1].profile)["columns"] == [{"name": "a", "ordinal": 3, "data_type": "int", "extra": {"k": "a"}}]
    asked = prompts.column_prompts(columns.drop("extra"), contexts, none, comments, 3).select("prompt_id", "asked")
    assert "StructsToJson" not in asked._jdf.queryExecution().optimizedPlan().toString()


def test_answers_are_found_in_the_row_of_their_prompt(spark):
    names = ["a", None, "b", "c"]
    reply = json.dumps({"columns": [{"name": n, "proposed_comment": f"{n} {k}"} for k in range(2) for n in ("b", None, "a", "x")]})
    kind = "struct<name:string,ordinal:int,data_type:string,current_comment:string>"
    replies = spark.createDataFrame([("s", "a.b.t", [(n, i, "int", None) for i, n in enumerate(names)], [], reply, None)],
                                    f"session_id string, table_ref string, asked array<{kind}>, actions array<string>, reply string, failure string")
    found = inference.column_drafts(replies)
    assert [(r.target, r.proposed_comment, r.status) for r in sorted(found.collect(), key=lambda r: r.ordinal)] == [
        ("a", "a 1", "draft"), (None, "None 1", "draft"), ("b", "b 1", "draft"), ("c", None, "error")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline(transform(asked" in plan and "Generate inline(asked" not in plan


def physical(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_many_sessions_rewrite_their_drafts_without_sorting_them(spark, monkeypatch):
    monkeypatch.setattr("tablelore.session.KEYS_SENT_WHOLE", 0)
    drafts = spark.createDataFrame([("s", "__table__", "x"), ("s", "c", None), ("t", "c", "x")], "session_id string, target string, table_draft_id string")
    fresh = drafts.filter("session_id = 's'").drop("table_draft_id").unionByName(spark.createDataFrame([("u", "c")], "session_id string, target string"))
    made = store.rewrite_drafts(drafts, fresh, spark.createDataFrame([("s",), ("u",)], "session_id string"))
    assert physical(made).count("ShuffledHashJoin") >= 2 and "SortMergeJoin" not in physical(made)
    assert sorted((r.session_id, r.target) for r in made.collect()) == [("s", "__table__"), ("s", "c"), ("t", "c")]


def test_targets_to_redo_meet_in_more_tasks_when_there_are_more_requests(spark, monkeypatch):
    monkeypatch.setattr(review, "tasks_for", lambda rows, each: 37)
    monkeypatch.setattr("tablelore.session.KEYS_SENT_WHOLE", 0)
    requests = spark.createDataFrame([("s", []), ("s", ["c"]), ("t", ["d", "d"])], "session_id string, targets array<string>")
    made = review.expand_targets(requests, spark.createDataFrame([("s", "c"), ("t", "c")], "session_id string, target string"))
    assert ", 37)" in physical(made) and "ShuffledHashJoin" in physical(made)
    assert sorted(tuple(r) for r in made.collect()) == [("s", "__table__"), ("s", "c"), ("t", "d")]


def test_evidence_texts_are_made_once(spark):
    drafts = spark.createDataFrame([("s", "a.b.t", "c", "words", None, [], "draft"), ("s", "a.b.t", "__table__", "more", None, [], "draft")],
                                   "session_id string, table_ref string, target string, proposed_comment string, rationale string, evidence_refs array<string>, status string")
    tables = spark.createDataFrame([("a.b.t", 5)], "table_ref string, row_count int")
    columns = spark.createDataFrame([("a.b.t", "c", 1)], "table_ref string, name string, ordinal int")
    keys = spark.createDataFrame([], "table_ref string, schema_meta string")
    contexts = spark.createDataFrame([("a.b.t", [("note", "wiki", [], 0.5)])], "table_ref string, context array<struct<text:string,source:string,informs:array<string>,relevance:double>>")
    made = scoring.evidence_rows(drafts, tables, columns, keys, contexts, 1000)
    found = {r.target: json.loads(r.evidence) for r in made.collect()}
    assert found["c"]["profile"] and "ordinal" in found["c"]["profile"] and "row_count" in found["__table__"]["profile"]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "_full" in plan and "_draft" in plan


SNIPPET = "table_ref string, text string, source string, informs array<string>, relevance double, seq int, provider_seq int"


@pytest.mark.parametrize("sizes, budget, kept", [([8, 8, 8], 3, 1), ([400], 10, 1), ([8, 8, 8], 6, 3)])
def test_context_budget(spark, sizes, budget, kept):
    rows = [("t", chr(97 + i) * n, "s", [], 0.9 - i / 10, i, 0) for i, n in enumerate(sizes)]
    assert context.within_budget(spark.createDataFrame(rows, SNIPPET), budget).count() == kept


def test_library_life_cycle(spark):
    fields = "id string, scope string, match_key string, canonical_comment string, tags array<string>, usage_count bigint, status string, " \
             "approved_by string, approved_at int, updated_at int, sunset_at int, sunset_by string"
    rows = spark.createDataFrame([
        ("lib-1", "column", "o_orderdate", "Date.", ["date"], 7, "applied", "a", 1, 1, None, None),
        ("lib-3", "table", "samples.tpch.legacy", "Old.", [], 1, "sunset", "a", 1, 1, 1, "x")], fields)
    assert [r.id for r in library.page(rows).collect()] == ["lib-1"] and library.page(rows, include_sunset=True).count() == 2
    keys = spark.createDataFrame([("o_orderdate",), ("samples.tpch.legacy",), ("",)], "match_key string")
    assert library.reusable(rows, "table", keys).count() == 0
    revived = library.revive(rows, rows.select("id"), F.lit(9))
    assert {r.status for r in revived.collect()} == {"approved"} and all(r.sunset_at is None for r in revived.collect())
    change = "scope string, match_key string, canonical_comment string, tags array<string>, status string, approved_by string, at int, seq int, bump int"
    for bump, expected in ((1, 8), (0, 7)):
        new = spark.createDataFrame([("column", "o_orderdate", "New.", [], "approved", "b", 5, 1, bump),
                                     ("column", "fresh", "F1", [], "approved", "b", 5, 1, bump), ("column", "fresh", "F2", [], "applied", "c", 6, 1, 0)], change)
        after = {r.match_key: r for r in library.upsert(rows, new).collect()}
        assert after["o_orderdate"].usage_count == expected and after["o_orderdate"].canonical_comment == "New."
        assert after["fresh"].usage_count == 1 and after["fresh"].canonical_comment == "F2" and after["fresh"].id


@pytest.mark.parametrize("confidence, flags, reasons", [
    (0.95, {"keylike", "has_key_target"}, []), (0.99, {"enum_candidate"}, ["enum_no_decode"]), (0.5, set(), ["below_threshold"]),
    (0.75, set(), []), (None, set(), ["no_confidence"]), (0.9, {"enum_candidate", "keylike"}, ["enum_no_decode", "keylike_no_target"]),
    (0.9, {"ambiguous_name", "high_null_fraction"}, ["ambiguous_unused_high_null"]), (0.9, {"ambiguous_name"}, [])])
def test_routing(spark, confidence, flags, reasons):
    row = spark.createDataFrame([(confidence, *[s in flags for s in gate.SIGNALS])], f"confidence double, {SIGNALS}")
    assert row.select(gate.reasons(F.col("confidence"), gate.hard_trips()).alias("r")).first().r == reasons


def test_resolved_drafts_are_not_routed(spark):
    drafts = spark.createDataFrame([("s", "t", "a", 1, 0.1, "approved", None), ("s", "t", "b", 2, 0.1, "draft", "why")],
                                   "session_id string, table_ref string, target string, ordinal int, confidence double, status string, rationale string")
    routed = gate.route(drafts, spark.createDataFrame([], f"table_ref string, name string, {SIGNALS}"))
    assert {r.target: r.reasons for r in routed.collect()} == {"a": [], "b": ["below_threshold"]}
    settled = {r.target: r for r in gate.settle(routed, "batch").collect()}
    assert settled["a"].status == "approved" and settled["b"].rationale == "why\nlow confidence: below_threshold"


@pytest.mark.parametrize("raw, overall", [
    (dict.fromkeys(scoring.RUBRIC, "0.8"), 0.8), ({"completeness": "1"}, 0.3),
    ({"completeness": "1.5", "specificity": "-0.2", "grounding": "0.5"}, 0.425), ({"completeness": "NaN", "grounding": "high"}, 0.0)])
def test_weighted_score(spark, raw, overall):
    assert one(spark, raw, lambda v: scoring.overall(scoring.clean_subscores(v)), "map<string,string>") == overall


DRAFTS = [("__table__", 0, 0.90, "draft"), ("a", 1, 0.95, "draft"), ("b", 2, 0.50, "needs_input"), ("c", 3, 0.60, "low_confidence"), ("d", 4, 0.80, "draft")]


def test_confidence_summary(spark):
    drafts = spark.createDataFrame([("s", *d) for d in DRAFTS] + [("n", "x", 1, None, "draft")],
                                   "session_id string, target string, ordinal int, confidence double, status string")
    rows = {r.session_id: r for r in review.confidence_summary(drafts).collect()}
    s = rows["s"]
    assert round(s.overall, 6) == 0.80625 and (s.review_ready, s.approvable, s.needs_input, s.low) == (3, 3, 1, 1)
    assert (s.weakest_target, s.weakest_confidence) == ("b", 0.5) and rows["n"].overall is None and rows["n"].weakest_target is None
    assert {r.target for r in review.approve_high_confidence(drafts).filter("status = 'approved'").collect()} == {"__table__", "a", "d"}


@pytest.mark.parametrize("current, live, proposed, confirm, result", [
    (None, None, "x", False, "write"), ("same", "same", "same", False, "skipped_noop"), ("old", "changed", "new", False, "conflict"),
    ("old", "changed", "new", True, "write"), ("good", "good", "  ", False, "failed"), (None, None, "", False, "skipped_noop")])
def test_apply_decisions(spark, current, live, proposed, confirm, result):
    row = spark.createDataFrame([(current, live, proposed, confirm)], "c string, l string, p string, y boolean")
    assert row.select(apply.decision(F.col("l"), F.col("c"), F.col("p"), F.col("y"))["status"].alias("s")).first().s == result


def test_statement_quoting(spark):
    row = spark.createDataFrame([("a.b`.t", "k`y", "it's the key")], "r string, t string, c string")
    text = row.select(apply.statement(F.col("r"), F.col("t"), F.col("c")).alias("s")).first().s
    assert text == "ALTER TABLE `a`.`b`.`t` ALTER COLUMN `k``y` COMMENT 'it''s the key'"


def test_only_reviewed_drafts_are_applied(spark):
    drafts = spark.createDataFrame([("s", "a.b.c", s, None, "x", s) for s in ("draft", "approved", "edited", "error")],
                                   "session_id string, table_ref string, target string, current_comment string, proposed_comment string, status string")
    live = spark.createDataFrame([], "table_ref string, target string, live string")
    assert {r.target for r in apply.plan_apply(drafts, live).collect()} == {"approved", "edited"}


def test_tables_to_document(spark):
    tables = spark.createDataFrame([("fact_a", None, "MANAGED"), ("fact_b", "already documented", "MANAGED"), ("dim_c", "  ", "EXTERNAL"),
                                    ("__mat", None, "MANAGED"), ("v", None, "VIEW")], "table_name string, comment string, table_type string")
    assert [r.table_name for r in catalog.tables_to_document(tables).collect()] == ["dim_c", "fact_a"]
    assert catalog.tables_to_document(tables, max_tables=1).count() == 1


@pytest.mark.parametrize("kinds, status", [(["ready_for_review", "needs_input"], "completed"), (["ready_for_review", "boom"], "completed_with_errors")])
def test_run_counts(spark, kinds, status):
    row = runs.run_status(runs.rollup(spark.createDataFrame([("r", k) for k in kinds], "schema_run_id string, kind string"))).first()
    assert row.status == status and row.ready == 1 and row.total == 2
    with pytest.raises(ValueError):
        runs.checked_key("other")


def test_prompt_steps_keep_what_fits(spark):
    rows = spark.createDataFrame([("s", [("src", "x" * 400)] * 4, "p" * 40, "p", "go")], "system string, context array<struct<source:string,text:string>>, "
                                 "profile string, brief_profile string, instruction string")
    for budget, actions, fits in ((1000, [], True), (260, ["trim_context"], True), (160, ["trim_context", "summarize_context"], True),
                                  (5, ["trim_context", "summarize_context", "reduce_profile"], False)):
        row = prompts.fit_prompts(rows, budget, summary=lambda text: F.left(text, F.lit(500))).first()
        assert (row.actions, row.within_budget) == (actions, fits)


def test_failed_and_missing_replies(spark):
    rows = spark.createDataFrame([
        ("s", "t", [("a", 1), ("b", 2)], [], '{"columns": [{"name": "a", "proposed_comment": "A"}, {"name": "zz"}]}', None),
        ("s2", "t", [("c", 1)], [], None, "timeout"), ("s3", "t", [("d", 1)], [], "[1]", None)],
        "session_id string, table_ref string, asked array<struct<name:string,ordinal:int>>, actions array<string>, reply string, failure string")
    rows = rows.withColumn("asked", F.transform("asked", lambda a: F.struct(a["name"].alias("name"), a["ordinal"].alias("ordinal"), F.lit("bigint").alias("data_type"), F.lit(None).cast("string").alias("current_comment"))))
    made = {r.target: (r.status, r.rationale) for r in inference.column_drafts(rows).collect()}
    assert made == {"a": ("draft", None), "b": ("error", "model did not return a draft for this column"), "c": ("error", "reasoning failed: timeout"),
                    "d": ("error", "reasoning failed: model output is not a valid JSON object")}


def test_drafts_carry_what_their_snapshot_says(spark):
    state = store.read_state(spark.createDataFrame(
        [('{"target": "a.b.c", "session_id": "s", "phase": "ready", "column_drafts": [{"column_name": "x"}, {"column_name": "y"}]}',)], "state string"))
    rows = store.drafts_of_state(state, ["phase", "mode"])
    assert sorted((r.target, r.phase, r.mode, r.status) for r in rows.collect()) == [
        ("x", "ready", "interactive", "draft"), ("y", "ready", "interactive", "draft")]


def test_state_defaults(spark):
    text = '{"target": "a.b.c", "session_id": "s", "table_draft": {"confidence": 0.9}, "column_drafts": [{"column_name": "k", "status": "approved"}]}'
    state = store.read_state(spark.createDataFrame([(text,), ("broken",)], "state string"))
    row = state.filter("session_id = 's'").first()
    assert (row.phase, row.mode, row.keep_threshold, row.context, row.open_questions) == ("created", "interactive", 0.75, [], [])
    drafts = {r.target: (r.status, r.apply_status) for r in store.drafts_of_state(state.filter("session_id = 's'")).collect()}
    assert drafts == {"__table__": ("draft", "not_applied"), "k": ("approved", "not_applied")}


def test_replaced_partitions_and_audit(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(10).select("id", (F.col("id") % 2).alias("p")).write.partitionBy("p").parquet(path)
    old = spark.read.parquet(path)
    store.replace_partitions(old.filter("p = 1").withColumn("id", F.col("id") + 100), path, ["p"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 2, 4, 6, 8, 101, 103, 105, 107, 109]
    audit = spark.createDataFrame([("s", "applied")], "session_id string, action string")
    for _ in range(2):
        store.append_audit(audit, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2


def test_failed_summaries_fall_back_to_a_prefix(spark):
    rows = spark.createDataFrame([(i, "s", [("src", f"note {i} " + "x" * 400)] * 4, "p" * 40, "p", "go") for i in ("a", "b", "c")],
                                 "prompt_id string, system string, context array<struct<source:string,text:string>>, "
                                 "profile string, brief_profile string, instruction string")
    asked = prompts.summary_requests(rows, 160)
    assert asked.count() == 3 and prompts.summary_requests(rows, 260).count() == 0

    def condense(messages):
        if "note b" in messages[1]["content"]:
            raise RuntimeError("busy")
        return "short notes" if "note a" in messages[1]["content"] else " "

    fitted = prompts.fit_prompts(rows, 160, summaries=inference.infer(asked, condense), fallback_length=30)
    told = {r.prompt_id: r.context[0].text for r in fitted.collect()}
    assert told["a"] == "short notes" and told["b"].startswith("- (src) note b") and len(told["b"]) == 30 and len(told["c"]) == 30
    assert prompts.fit_prompts(rows, 160).first().context[1].text.startswith("note")  # without a model nothing is cut


def test_pages_that_are_too_long_are_refused(spark):
    rows = spark.range(5).select(F.col("id").cast("string"), F.lit(1).alias("created_at"))
    assert runs.list_runs(rows, limit=2, offset=1).count() == 2
    with pytest.raises(ValueError):
        runs.list_runs(rows, limit=201)
    assert runs.list_runs(rows, limit=201, longest=500).count() == 5


def test_rows_are_drawn_from_the_whole_table(spark, monkeypatch):
    from tablelore.sources import sampling
    table = spark.range(0, 40_000, numPartitions=7).select("id", F.floor(F.col("id") / 4000).alias("tenth"))
    for few in (10_000, 20):
        monkeypatch.setattr(sampling, "FEW", few)
        kept = sampling.apply_sample(table, sampling.Sample("rows", 2000))
        ids = [r.id for r in kept.collect()]
        assert len(ids) == len(set(ids)) == 2000 and sorted(ids) == sorted(r.id for r in kept.collect())
        shares = [sum(i // 4000 == k for i in ids) for k in range(10)]
        assert all(abs(s - 200) <= 5 * (2000 * 0.09) ** 0.5 for s in shares)
        other = {r.id for r in sampling.apply_sample(table, sampling.Sample("rows", 2000, seed=7)).collect()}
        assert len(other & set(ids)) < 200
    assert sampling.apply_sample(table, sampling.Sample("rows", 50_000)).count() == 40_000
    assert sampling.apply_sample(table.limit(0), sampling.Sample("rows", 5)).count() == 0
    assert sampling.apply_sample(table, sampling.Sample("rows", 1)).count() == 1


def test_many_objects_under_one_name_need_as_many_rounds_as_they_lie_deep(spark):
    from tablelore.functions.loose_json import nesting, result_texts
    many = json.dumps({"results": [{"text": f"t{k}", "more": {"a": "}{"}} for k in range(10_000)]})
    payloads = [(many, 3), ('{"data": {"items": {"results": {"text": "x{{{"}}}}', 4), ('{"a": "\\"{"}', 1), ("[1]", 0), ("no {json", 1), (None, None)]
    rows = spark.createDataFrame(payloads, "payload string, deep int").select(
        "deep", nesting(F.col("payload")).alias("found"), result_texts(F.col("payload")).alias("texts")).collect()
    assert all(r.deep == r.found for r in rows)
    assert rows[0].texts == [f"t{k}" for k in range(10_000)] and rows[1].texts == ["x{{{"]


def test_parts_come_together_in_order(spark):
    parts = [(p, json.dumps({"target": "a.b.c", "session_id": "s", "phase": "reviewing" if p else None,
                             "column_drafts": [{"column_name": f"c{p}_{k}"} for k in range(3)],
                             "open_questions": [{"id": f"q{p}"}], "table_draft": {"proposed_comment": f"t{p}"} if p in (3, 1) else None}))
             for p in (4, 0, 3, 1, 2)]
    state = store.read_state(spark.createDataFrame(parts, "part int, state string").repartition(5))
    row = store.whole_sessions(state).first()
    assert [d.column_name for d in row.column_drafts] == [f"c{p}_{k}" for p in range(5) for k in range(3)]
    assert [q.id for q in row.open_questions] == [f"q{p}" for p in range(5)] and row.table_draft.proposed_comment == "t1"


def test_drafts_are_dealt_once_on_their_way_through_snapshots(spark):
    sessions = spark.range(30).select(
        F.col("id").cast("string").alias("session_id"), F.lit("c").alias("catalog"), F.lit("s").alias("schema"), F.concat(F.lit("t"), "id").alias("table"),
        F.lit("hands_off").alias("mode"), F.lit("ready_for_review").alias("status"), F.lit("default").alias("template_id"))
    targets = F.concat(F.array(F.lit("__table__")), F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: F.concat(F.lit("c"), k.cast("string"))))
    drafts = sessions.filter("session_id <> '7'").select("session_id", F.posexplode(targets).alias("ordinal", "target")).withColumn(
        "proposed_comment", F.concat("session_id", F.lit(": "), "target"))
    unknown = drafts.limit(1).withColumn("session_id", F.lit("gone"))
    questions = drafts.filter("ordinal IN (2, 9)").select(
        "session_id", F.concat(F.lit("q"), "ordinal").alias("qid"), F.lit("column").alias("target_kind"), F.col("target").alias("target_name"),
        F.lit("?").alias("text"), F.lit(False).alias("answered"), F.lit(None).cast("string").alias("suggested_answer"))
    note = F.struct(F.concat(F.lit("note "), "session_id").alias("text"), F.lit("wiki").alias("source"),
                    F.array().cast("array<string>").alias("informs"), F.lit(0.5).alias("relevance"))
    extras = sessions.filter("session_id <> '8'").select(
        "session_id", F.array(note).alias("context"), F.lit('{"rows":1}').alias("profile"), F.lit(None).cast("string").alias("schema_meta"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more sessions than can be sent to every task
    try:
        snapshots = store.write_state(sessions, drafts.unionByName(unknown), questions, extras, width=4)
        whole = store.whole_sessions(store.read_state(snapshots))
        plan = whole._jdf.queryExecution().executedPlan().toString()
        rows = {r.session_id: r for r in whole.collect()}
        parts = sorted((r.session_id, r.part) for r in snapshots.select("session_id", "part").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(") == 3  # drafts with questions, sessions, extras: each once
    assert parts == sorted((str(k), p) for k in range(30) for p in ((0,) if k == 7 else (0, 1, 2)))
    assert rows.keys() == {str(k) for k in range(30)}
    for key, row in rows.items():
        assert row.target == f"c.s.t{key}" and row.phase == "ready_for_review" and row.mode == "hands_off"
        assert [c.text for c in row.context] == ([] if key == "8" else [f"note {key}"]) and row.profile == (None if key == "8" else '{"rows":1}')
        assert [d.proposed_comment for d in row.column_drafts] == ([] if key == "7" else [f"{key}: c{k}" for k in range(1, 10)])
        assert (row.table_draft and row.table_draft.proposed_comment) == (None if key == "7" else f"{key}: __table__")
        assert [q.id for q in row.open_questions] == ([] if key == "7" else ["q2", "q9"])


def test_a_broken_snapshot_leaves_its_session_as_it_is(spark):
    text = json.dumps({"target": "a.b.c", "session_id": "s", "phase": "reviewing", "column_drafts": [{"column_name": "x"}]})
    rows = spark.createDataFrame([("s", 0, "broken"), ("s", 1, text)], "session_id string, part int, state string")
    whole = {r.session_id: r for r in store.whole_sessions(store.read_state(rows)).collect()}
    assert whole["s"].phase == "reviewing" and [d.column_name for d in whole["s"].column_drafts] == ["x"]
