"""Review, write-back, runs and stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablelore.functions.columns import confidence_band
from tablelore.operators import apply, review, runs
from tablelore.schemas import RUN_COUNT_KEYS
from tablelore.session import hashed
from tablelore.sources import catalog, store

from .tables import Tables, query


@query("bulk_approval", """SELECT session_id, target, CASE WHEN status = 'draft' AND confidence >= 0.75 THEN 'approved' ELSE status END AS status FROM drafts""", ["drafts"])
def bulk_approval(t: Tables) -> DataFrame:
    return review.approve_high_confidence(t["drafts"]).select("session_id", "target", "status")


SUMMARY = """
SELECT session_id, round(coalesce(0.5 * max(confidence) FILTER (WHERE target = '__table__') + 0.5 * avg(confidence) FILTER (WHERE target <> '__table__'),
    max(confidence) FILTER (WHERE target = '__table__'), avg(confidence) FILTER (WHERE target <> '__table__')), 6) AS overall,
  count(*) FILTER (WHERE status IN ('draft', 'approved', 'edited') AND confidence >= 0.75) AS review_ready,
  count(*) FILTER (WHERE status = 'needs_input') AS needs_input, count(*) FILTER (WHERE status = 'low_confidence') AS low,
  count(*) FILTER (WHERE status = 'draft' AND confidence >= 0.75) AS approvable,
  arg_min(target, {'c': confidence, 'o': ordinal}) FILTER (WHERE confidence IS NOT NULL) AS weakest_target,
  min(confidence) AS weakest_confidence FROM drafts GROUP BY session_id"""


@query("confidence_summary", SUMMARY, ["drafts"])
def confidence_summary(t: Tables) -> DataFrame:
    return review.confidence_summary(t["drafts"]).withColumn("overall", F.round("overall", 6))


@query("readiness", """SELECT session_id, round(avg(CASE WHEN apply_status = 'applied' THEN 1.0 ELSE 0.0 END), 6) AS readiness,
  count(*) FILTER (WHERE status IN ('approved', 'edited')) AS approvable FROM drafts GROUP BY session_id""", ["drafts"])
def readiness(t: Tables) -> DataFrame:
    return review.readiness(t["drafts"]).withColumn("readiness", F.round("readiness", 6))


@query("confidence_bands", """SELECT session_id, target, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'mid' ELSE 'low' END AS band FROM drafts""", ["drafts"])
def confidence_bands(t: Tables) -> DataFrame:
    return t["drafts"].select("session_id", "target", confidence_band(F.col("confidence")).alias("band"))


ACTIONS = """
SELECT cast(l_orderkey AS string) AS session_id,
       CASE WHEN l_linenumber = 1 THEN '' ELSE concat('c', cast(l_linenumber + l_suppkey % 2 AS string)) END AS target,
       CASE WHEN l_discount < 0.03 THEN 'approve' WHEN l_discount < 0.06 THEN 'reject' WHEN l_discount < 0.1 THEN 'edit' ELSE 'undo' END AS action,
       CASE WHEN l_tax = 0 THEN ' ' ELSE concat('edited on ', l_shipdate) END AS comment,
       l_extendedprice + l_suppkey * 1000000 AS seq
FROM {lineitem}
"""
ACTION_SQL = """actions AS (SELECT session_id, CASE WHEN target = '' THEN '__table__' ELSE target END AS target, action, comment, seq
  FROM (""" + ACTIONS.format(lineitem="lineitem").replace("l_shipdate", "strftime(l_shipdate, '%Y-%m-%d')") + """)),
checked AS (SELECT a.*, CASE WHEN d.target IS NULL THEN concat('draft not found: ', a.target)
    WHEN a.action = 'edit' AND trim(a.comment) = '' THEN 'edit requires a non-empty proposed_comment'
    WHEN a.action NOT IN ('approve', 'reject', 'edit') THEN concat('unknown action: ', a.action) END AS error
  FROM actions a LEFT JOIN drafts d ON a.session_id = d.session_id AND a.target = d.target)"""


def actions(t: Tables) -> DataFrame:
    text = ACTIONS.replace("concat('edited on ', l_shipdate)", "concat('edited on ', date_format(l_shipdate, 'yyyy-MM-dd'))")
    return t.spark.sql(text, lineitem=t["lineitem"])


@query("review_actions", f"""WITH {ACTION_SQL},
last AS (SELECT session_id, target, arg_max(action, seq) AS action, arg_max(comment, seq) FILTER (WHERE action = 'edit') AS comment FROM checked WHERE error IS NULL GROUP BY 1, 2)
SELECT d.session_id, d.target, CASE l.action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'edit' THEN 'edited' ELSE d.status END AS status,
  coalesce(l.comment, d.proposed_comment) AS proposed_comment FROM drafts d LEFT JOIN last l ON d.session_id = l.session_id AND d.target = l.target""", ["drafts"])
def review_actions(t: Tables) -> DataFrame:
    return review.review(t["drafts"], actions(t))[0].select("session_id", "target", "status", "proposed_comment")


@query("review_errors", f"WITH {ACTION_SQL} SELECT session_id, target, action, seq, error FROM checked WHERE error IS NOT NULL", ["drafts"])
def review_errors(t: Tables) -> DataFrame:
    return review.review(t["drafts"], actions(t))[1]


@query("folded_answers", """SELECT a.session_id, q.table_ref, concat('Operator answer about ', coalesce(target_name, 'the table'), ': ', a.answer) AS text,
  coalesce(target_name, '') AS informs, 1.0 AS relevance FROM answers a JOIN questions q ON a.session_id = q.session_id AND a.qid = q.qid""", ["questions", "answers"], relevance="double")
def folded_answers(t: Tables) -> DataFrame:
    snippets, _ = review.fold_answers(t["questions"], t["answers"])
    return snippets.select("session_id", "table_ref", "text", F.array_join("informs", ",").alias("informs"), "relevance")


@query("answered_questions", """SELECT session_id, qid, EXISTS (SELECT 1 FROM answers a WHERE a.session_id = q.session_id AND a.qid = q.qid) AS answered
FROM questions q""", ["questions", "answers"])
def answered_questions(t: Tables) -> DataFrame:
    return review.fold_answers(t["questions"], t["answers"])[1].select("session_id", "qid", "answered")


@query("redraft_targets", """
WITH whole AS (SELECT cast(o_orderkey AS varchar) AS session_id FROM orders WHERE o_orderstatus IN ('P', 'O'))
SELECT DISTINCT session_id, target FROM drafts WHERE session_id IN (SELECT session_id FROM whole)
UNION SELECT session_id, '__table__' FROM whole
UNION SELECT cast(o_orderkey AS varchar), unnest(['c2', '__table__']) FROM orders WHERE o_orderstatus NOT IN ('P', 'O')""", ["drafts"])
def redraft_targets(t: Tables) -> DataFrame:
    none = F.array().cast("array<string>")
    asked = (F.when(F.col("o_orderstatus") == "P", none).when(F.col("o_orderstatus") == "O", F.array(F.lit("c1"), F.lit("__all__")))
             .otherwise(F.array(F.lit("c2"), F.lit(""), F.lit("c2"))))
    requests = t["orders"].select(F.col("o_orderkey").cast("string").alias("session_id"), asked.alias("targets"))
    return review.expand_targets(requests, t["drafts"])


@query("merged_redrafts", """SELECT d.session_id, d.target, CASE WHEN s.target IS NOT NULL THEN 'redrafted' ELSE d.proposed_comment END AS proposed_comment,
  CASE WHEN s.target IS NOT NULL THEN 'draft' ELSE d.status END AS status, CASE WHEN s.target IS NOT NULL THEN NULL ELSE d.confidence END AS confidence
FROM drafts d LEFT JOIN subscores s ON d.session_id = s.session_id AND d.target = s.target AND s.grounding > 0.5""", ["drafts", "subscores"])
def merged_redrafts(t: Tables) -> DataFrame:
    named = t["subscores"].filter("grounding > 0.5").select("session_id", "target")
    fresh = t["drafts"].join(named, ["session_id", "target"], "left_semi").withColumns({
        "proposed_comment": F.lit("redrafted"), "status": F.lit("draft"), "confidence": F.lit(None).cast("double")})
    return review.merge_redrafts(t["drafts"], fresh).select("session_id", "target", "proposed_comment", "status", "confidence")


PLAN = """plan AS (
  SELECT d.*, l.live, CASE
    WHEN trim(coalesce(l.live, '')) <> trim(coalesce(d.current_comment, '')) AND NOT d.confirm THEN 'conflict'
    WHEN trim(coalesce(d.proposed_comment, '')) = '' AND trim(coalesce(l.live, '')) = '' THEN 'skipped_noop'
    WHEN trim(coalesce(d.proposed_comment, '')) = '' THEN 'failed'
    WHEN trim(d.proposed_comment) = trim(coalesce(l.live, '')) THEN 'skipped_noop' ELSE 'write' END AS decision
  FROM (SELECT *, confidence > 0.5 AS confirm_raw, coalesce(confidence > 0.5, false) AS confirm FROM drafts WHERE status IN ('approved', 'edited')) d
  LEFT JOIN live l ON d.table_ref = l.table_ref AND d.target = l.target)"""
DONE = PLAN + """,
done AS (SELECT *, CASE WHEN decision <> 'write' THEN decision WHEN ordinal % 5 = 4 THEN 'failed' ELSE 'applied' END AS result FROM plan)"""
APPLY_INPUTS = ["drafts", "live"]


def plan(t: Tables) -> DataFrame:
    return apply.plan_apply(t["drafts"].withColumn("confirm", F.col("confidence") > 0.5), t["live"], confirm="confirm")


def done(t: Tables) -> DataFrame:
    """Outcomes as a catalog would give them: columns at ordinal 4 are refused."""
    planned = plan(t)
    ran = planned.filter("decision = 'write'").select(
        "session_id", "table_ref", "target", F.when(F.col("ordinal") % 5 == 4, "no permission").alias("error"))
    return apply.results(planned, ran)


@query("apply_decisions", f"WITH {PLAN} SELECT session_id, target, decision FROM plan", APPLY_INPUTS)
def apply_decisions(t: Tables) -> DataFrame:
    return plan(t).select("session_id", "target", "decision")


@query("apply_statements", f"""WITH {PLAN} SELECT session_id, target, CASE WHEN target = '__table__'
  THEN concat('COMMENT ON TABLE `', replace(table_ref, '.', '`.`'), '` IS ''', replace(replace(proposed_comment, chr(92), chr(92) || chr(92)), '''', ''''''), '''')
  ELSE concat('ALTER TABLE `', replace(table_ref, '.', '`.`'), '` ALTER COLUMN `', target, '` COMMENT ''', replace(replace(proposed_comment, chr(92), chr(92) || chr(92)), '''', ''''''), '''') END AS statement
FROM plan WHERE decision = 'write'""", APPLY_INPUTS)
def apply_statements(t: Tables) -> DataFrame:
    return plan(t).filter("decision = 'write'").select("session_id", "target", "statement")


@query("apply_targets", f"WITH {PLAN} SELECT session_id, target, decision FROM plan WHERE (session_id, target) IN (SELECT session_id, target FROM subscores)",
       [*APPLY_INPUTS, "subscores"])
def apply_targets(t: Tables) -> DataFrame:
    drafts = t["drafts"].withColumn("confirm", F.col("confidence") > 0.5)
    return apply.plan_apply(drafts, t["live"], confirm="confirm", targets=t["subscores"]).select("session_id", "target", "decision")


@query("apply_summary", f"WITH {DONE} SELECT session_id, result AS status, count(*) AS items FROM done GROUP BY 1, 2", APPLY_INPUTS)
def apply_summary(t: Tables) -> DataFrame:
    return apply.summary(done(t))


@query("apply_audit", f"""WITH {DONE} SELECT session_id, CASE WHEN target = '__table__' THEN 'table' ELSE 'column' END AS draft_kind, 'applied' AS action,
  concat('{{"comment":', CASE WHEN live IS NULL THEN 'null' ELSE concat('"', replace(live, chr(92), chr(92) || chr(92)), '"') END, '}}') AS before,
  concat('{{"comment":"', replace(proposed_comment, chr(92), chr(92) || chr(92)), '"}}') AS after FROM done WHERE result = 'applied'""", APPLY_INPUTS)
def apply_audit(t: Tables) -> DataFrame:
    return apply.audit_rows(done(t), "me", F.current_timestamp()).select("session_id", "draft_kind", "action", "before", "after")


@query("applied_library_rows", f"""WITH {DONE} SELECT session_id AS source_session_id, CASE WHEN target = '__table__' THEN table_ref ELSE target END AS match_key,
  trim(proposed_comment) AS canonical_comment, 'applied' AS status, 0 AS bump FROM done WHERE result = 'applied'""", APPLY_INPUTS)
def applied_library_rows(t: Tables) -> DataFrame:
    rows = done(t).withColumns({"tags": F.array().cast("array<string>"), "conditional_fields": F.create_map().cast("map<string,string>")})
    return apply.library_rows(rows, "me", F.lit(1)).select("source_session_id", "match_key", "canonical_comment", "status", "bump")


@query("applied_drafts", f"""WITH {DONE} SELECT d.session_id, d.target, CASE WHEN n.result = 'applied' THEN 'applied' ELSE d.status END AS status,
  coalesce(n.result, d.apply_status) AS apply_status,
  CASE WHEN n.result = 'applied' THEN d.proposed_comment WHEN n.result = 'skipped_noop' AND trim(coalesce(d.proposed_comment, '')) <> '' THEN n.live END AS applied_comment
FROM drafts d LEFT JOIN done n ON d.session_id = n.session_id AND d.target = n.target""", APPLY_INPUTS)
def applied_drafts(t: Tables) -> DataFrame:
    drafts = t["drafts"].withColumns({"applied_comment": F.lit(None).cast("string"), "applied_at": F.lit(None).cast("timestamp"),
                                      "applied_by": F.lit(None).cast("string")})
    return apply.mark_applied(drafts, done(t), "me", F.current_timestamp()).select(
        "session_id", "target", "status", "apply_status", "applied_comment")


TABLE_LIST = """
SELECT 'main' AS table_catalog, 'sales' AS table_schema,
       concat(CASE WHEN p_size = 1 THEN '__' ELSE '' END, replace(p_name, ' ', '_'), '_', cast(p_partkey AS string)) AS table_name,
       CASE WHEN p_type = 'ECONOMY' THEN 'VIEW' WHEN p_size < 25 THEN 'MANAGED' ELSE 'EXTERNAL' END AS table_type,
       CASE WHEN p_size = 2 THEN 'known' WHEN p_size = 3 THEN '  ' END AS comment
FROM {part}
"""


@query("tables_to_document", "SELECT table_name FROM (" + TABLE_LIST.format(part="part") + """) WHERE table_type IN ('MANAGED', 'EXTERNAL')
AND left(table_name, 2) <> '__' AND table_name LIKE 'small%' AND trim(coalesce(comment, '')) = '' ORDER BY table_name LIMIT 150""")
def tables_to_document(t: Tables) -> DataFrame:
    tables = t.spark.sql(TABLE_LIST, part=t["part"])
    return catalog.tables_to_document(tables, name_like="small%", max_tables=150).select("table_name")


@query("every_base_table", "SELECT table_name FROM (" + TABLE_LIST.format(part="part") + ") WHERE table_type IN ('MANAGED', 'EXTERNAL')")
def every_base_table(t: Tables) -> DataFrame:
    tables = t.spark.sql(TABLE_LIST, part=t["part"])
    return catalog.tables_to_document(tables, include_internal=True, skip_documented=False).select("table_name")


@query("pending_tables", """
SELECT concat('run', o_custkey % 100) AS schema_run_id, concat('main.s', o_custkey % 20, '.t', o_orderkey) AS table_ref FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW')""")
def pending_tables(t: Tables) -> DataFrame:
    tables = t["orders"].select(F.concat(F.lit("run"), F.col("o_custkey") % 100).alias("schema_run_id"),
                                F.concat(F.lit("main.s"), F.col("o_custkey") % 20, F.lit(".t"), "o_orderkey").alias("table_ref"))
    return runs.pending_tables(tables, t["sessions"])


OUTCOMES = """
SELECT concat('run', cast(o_custkey % 100 AS string)) AS schema_run_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'ready_for_review' WHEN '2-HIGH' THEN 'needs_input' WHEN '3-MEDIUM' THEN 'skipped'
       WHEN '5-LOW' THEN 'applied' ELSE CASE WHEN o_custkey % 50 < 10 THEN 'failed' ELSE 'skipped' END END AS kind FROM {orders}
"""


@query("run_rollup", "WITH outcomes AS (" + OUTCOMES.format(orders="orders") + """)
SELECT schema_run_id, count(*) AS total, count(*) FILTER (WHERE kind = 'ready_for_review') AS ready, count(*) FILTER (WHERE kind = 'needs_input') AS needs_input,
  count(*) FILTER (WHERE kind = 'applied') AS applied, count(*) FILTER (WHERE kind = 'failed') AS error, count(*) FILTER (WHERE kind = 'skipped') AS skipped,
  CASE WHEN count(*) FILTER (WHERE kind = 'failed') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM outcomes GROUP BY 1""")
def run_rollup(t: Tables) -> DataFrame:
    counts = runs.rollup(t.spark.sql(OUTCOMES, orders=t["orders"]))
    return runs.run_status(counts).select("schema_run_id", "total", *RUN_COUNT_KEYS, "status")


@query("started_runs", "SELECT c_custkey AS id, 'enumerating' AS status, 0 AS counted FROM customer")
def started_runs(t: Tables) -> DataFrame:
    requests = t["customer"].select(F.col("c_custkey").alias("id"), F.lit("main").alias("catalog"), F.lit("s").alias("schema"),
                                    F.create_map().cast("map<string,string>").alias("filters"), F.col("c_name").alias("created_by"))
    return runs.new_runs(requests, F.lit(1)).select("id", "status", F.size("counts").alias("counted"))


@query("updated_runs", """
WITH changes AS (SELECT concat('run', o_custkey) AS id, CASE WHEN count(*) > 10 THEN 'completed' END AS status, cast(count(*) AS int) AS total_tables FROM orders GROUP BY o_custkey)
SELECT r.id, coalesce(c.status, r.status) AS status, coalesce(c.total_tables, r.total_tables) AS total_tables,
  CASE WHEN c.id IS NULL THEN r.updated_at ELSE 5000 END AS updated_at FROM runs r LEFT JOIN changes c ON r.id = c.id""", ["runs"])
def updated_runs(t: Tables) -> DataFrame:
    changes = t["orders"].groupBy(F.concat(F.lit("run"), "o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n")).select(
        "id", F.when(F.col("n") > 10, "completed").alias("status"), F.col("n").cast("int").alias("total_tables"))
    return runs.update_runs(t["runs"], changes, F.lit(5000)).select("id", "status", "total_tables", "updated_at")


@query("run_list", "SELECT id, status, created_at FROM runs ORDER BY created_at DESC, id LIMIT 50 OFFSET 10", ["runs"])
def run_list(t: Tables) -> DataFrame:
    return runs.list_runs(t["runs"], limit=50, offset=10).select("id", "status", "created_at")


@query("session_history", """
WITH page AS (SELECT * FROM sessions ORDER BY updated_at DESC, session_id LIMIT 500 OFFSET 5)
SELECT session_id, concat_ws('.', catalog, schema, "table") AS target, status, created_by,
  (SELECT count(*) FROM column_drafts c WHERE c.session_id = s.session_id) AS n_columns,
  (SELECT count(*) FROM column_drafts c WHERE c.session_id = s.session_id AND apply_status = 'applied') AS n_applied FROM page s""", ["sessions", "column_drafts"])
def session_history(t: Tables) -> DataFrame:
    shown = runs.session_history(t["sessions"], t["drafts"], limit=500, offset=5, longest=500)
    return shown.select("session_id", "target", "status", "created_by", "n_columns", "n_applied")


@query("run_detail", "WITH summed AS (" + SUMMARY + """)
SELECT s.session_id, s.status, s.schema_run_id, c.overall, c.approvable, c.weakest_target FROM sessions s
LEFT JOIN summed c ON s.session_id = c.session_id AND s.status IN ('ready_for_review', 'awaiting_input')""", ["sessions", "drafts"])
def run_detail(t: Tables) -> DataFrame:
    return runs.run_detail(t["sessions"], t["drafts"]).select(
        "session_id", "status", "schema_run_id", F.round("overall", 6).alias("overall"), "approvable", "weakest_target")


@query("saved_sessions", """
WITH saves AS (SELECT cast(l_orderkey AS varchar) AS session_id, arg_max(concat('s', l_returnflag), l_extendedprice) AS status,
  arg_min(concat('by ', l_suppkey), l_extendedprice) AS created_by FROM lineitem WHERE l_discount > 0.04 GROUP BY 1)
SELECT coalesce(o.session_id, n.session_id) AS session_id, coalesce(n.status, o.status) AS status, coalesce(o.created_by, n.created_by) AS created_by
FROM (SELECT * FROM sessions WHERE status <> 'failed') o FULL OUTER JOIN saves n ON o.session_id = n.session_id""", ["sessions"])
def saved_sessions(t: Tables) -> DataFrame:
    saves = t["lineitem"].filter("l_discount > 0.04").select(
        F.col("l_orderkey").cast("string").alias("session_id"), F.concat(F.lit("s"), "l_returnflag").alias("status"),
        F.lit("default").alias("template_id"), F.concat(F.lit("by "), "l_suppkey").alias("created_by"),
        F.lit(None).cast("string").alias("schema_run_id"), F.lit("{}").alias("config"), F.col("l_extendedprice").alias("updated_at"))
    before = t["sessions"].filter("status <> 'failed'").select(
        "session_id", "status", "template_id", "created_by", "schema_run_id", F.lit("{}").alias("config"), F.lit(0.0).alias("updated_at"))
    return store.save_sessions(before, saves).select("session_id", "status", "created_by")


@query("template_ids", "SELECT session_id, CASE WHEN template_id <> 'default' THEN lower(template_id) END AS template_id FROM sessions", ["sessions"])
def template_ids(t: Tables) -> DataFrame:
    return t["sessions"].select("session_id", store.uuid_or_null(F.col("template_id")).alias("template_id"))


@query("rewritten_drafts", """
WITH saved AS (SELECT session_id FROM sessions WHERE status IN ('applied', 'failed'))
SELECT session_id, target, status FROM drafts WHERE session_id NOT IN (SELECT session_id FROM saved)
UNION ALL SELECT session_id, target, 'draft' FROM drafts WHERE session_id IN (SELECT session_id FROM saved)
  AND session_id IN (SELECT session_id FROM table_drafts)""", ["drafts", "sessions"])
def rewritten_drafts(t: Tables) -> DataFrame:
    saved = t["sessions"].filter("status IN ('applied', 'failed')")
    fresh = t["drafts"].join(hashed(saved, saved.count()), "session_id", "left_semi").withColumn("status", F.lit("draft"))
    stored = t["drafts"].withColumn("table_draft_id", F.lit(None).cast("string"))
    return store.rewrite_drafts(stored, fresh, saved).select("session_id", "target", "status")


@query("state_round_trip", """
SELECT d.session_id, concat_ws('.', s.catalog, s.schema, s."table") AS table_ref, target, ordinal, d.status, confidence, current_comment,
  proposed_comment, rationale, apply_status, concat(d.status, '/', coalesce(confidence, 0) > 0.5) AS scored, concat('owner of ', target) AS owner,
  'null means ' || d.status AS null_meaning, d.status AS issue, CASE WHEN apply_status = 'applied' THEN 'me' END AS applied_by,
  CASE WHEN apply_status = 'applied' THEN 1577836800 END AS applied_at, 'ready in ' || s.mode AS note,
  CASE WHEN s.mode = 'hands_off' THEN 0.5 ELSE 0.75 END AS keep_threshold, s.mode, s.status AS phase, concat('{"rows":', d.session_id, '}') AS profile,
  (SELECT count(*) FROM questions q WHERE q.session_id = d.session_id) AS questions
FROM drafts d JOIN sessions s ON d.session_id = s.session_id""", ["drafts", "sessions", "questions"], keep_threshold="double")
def state_round_trip(t: Tables) -> DataFrame:
    """Every field of a draft, the settings, the context and the profile, through snapshots of several parts."""
    none = F.array().cast("array<string>")
    applied = F.col("apply_status") == "applied"
    drafts = t["drafts"].withColumns({
        "data_type": F.lit("bigint"), "tags": none, "evidence_refs": none, "applied_comment": F.lit(None).cast("string"),
        "subscores": F.create_map("status", F.coalesce("confidence", F.lit(0.0))), "issues": F.array("status"),
        "facts": F.create_map(F.lit("owner"), F.concat(F.lit("owner of "), "target")),
        "conditional_fields": F.create_map(F.lit("null_meaning"), F.concat(F.lit("null means "), "status")),
        "applied_by": F.when(applied, "me"), "applied_at": F.when(applied, F.timestamp_seconds(F.lit(1577836800)))})
    questions = t["questions"].withColumn("target_kind", F.when(F.col("target_name").isNull(), "table").otherwise("column")).withColumn("text", F.lit("?"))
    sessions = t["sessions"].withColumn("config", F.when(F.col("mode") == "hands_off", F.to_json(F.struct("mode", F.lit(0.5).alias("keep_threshold")))))
    note = F.struct(F.concat(F.lit("ready in "), "mode").alias("text"), F.lit("wiki").alias("source"), none.alias("informs"), F.lit(0.5).alias("relevance"))
    extras = sessions.select("session_id", F.array(note).alias("context"), F.concat(F.lit('{"rows":'), "session_id", F.lit("}")).alias("profile"),
                             F.lit(None).cast("string").alias("schema_meta"))
    whole = store.whole_sessions(store.read_state(store.write_state(sessions, drafts, questions, extras, width=4)))
    about = {"note": F.get("context", F.lit(0))["text"], "questions": F.size("open_questions").cast("bigint")}
    carried = [*about, "keep_threshold", "mode", "phase", "profile"]
    score = F.map_keys("subscores")[0]
    return store.drafts_of_state(whole.withColumns(about), carried).select(
        "session_id", "table_ref", "target", "ordinal", "status", "confidence", "current_comment", "proposed_comment", "rationale", "apply_status",
        F.concat(score, F.lit("/"), (F.map_values("subscores")[0] > 0.5).cast("string")).alias("scored"), F.col("facts")["owner"].alias("owner"),
        F.col("conditional_fields")["null_meaning"].alias("null_meaning"), F.col("issues")[0].alias("issue"), "applied_by",
        F.unix_timestamp("applied_at").cast("int").alias("applied_at"), "note", "keep_threshold", "mode", "phase", "profile", "questions")


@query("lenient_columns", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type ELSE '' END AS tags,
  CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END AS k FROM events""")
def lenient_columns(t: Tables) -> DataFrame:
    tags = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["'), "event_type", F.lit('"]'))).when(F.col("event_id") % 3 == 1, F.lit("oops ["))
    counts = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.lit("{bad"))
    rows = t["events"].select("event_id", tags.alias("tags"), counts.alias("counts"))
    read = store.lenient_columns(rows, lists=["tags"], maps=["counts"])
    return read.select("event_id", F.array_join("tags", ",").alias("tags"), F.try_element_at("counts", F.lit("k")).alias("k"))
