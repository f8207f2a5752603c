"""Prompts, model replies, rubric scores and gating."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from tablelore.functions.loose_json import json_body
from tablelore.functions.text import clean_facts, clean_tags
from tablelore.operators import gate, inference, prompts, scoring
from tablelore.operators.context import within_budget
from tablelore.schemas import ASKING_MODES

from .tables import Tables, query


def order_columns(t: Tables) -> DataFrame:
    """One column per supplier, order and line; made distinct as numbers, before the names are spelled out."""
    keys = t["lineitem"].select("l_suppkey", "l_orderkey", "l_linenumber").distinct()
    return keys.select(
        F.concat(F.lit("main.sales.s"), "l_suppkey").alias("table_ref"), F.concat_ws("_", F.lit("c"), "l_orderkey", "l_linenumber").alias("name"),
        F.col("l_orderkey").cast("int").alias("ordinal"))


@query("column_batches", """
WITH named AS (SELECT DISTINCT concat('main.sales.s', l_suppkey) AS table_ref, concat_ws('_', 'c', l_orderkey, l_linenumber) AS name, l_orderkey AS ordinal FROM lineitem)
SELECT table_ref, name, cast((row_number() OVER (PARTITION BY table_ref ORDER BY ordinal, name) - 1) // 25 AS int) AS batch FROM named""")
def column_batches(t: Tables) -> DataFrame:
    return prompts.column_batches(order_columns(t)).select("table_ref", "name", "batch")


SUPPLIER_NOTES = """notes AS (SELECT concat('main.sales.s', doc_id % 100 + 1) AS table_ref, text, source, relevance, provider_seq, seq FROM snippets),
costed AS (SELECT *, cast(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, round_even(length(text) / 4.0, 0)) END AS bigint) AS cost FROM notes),
summed AS (SELECT *, sum(cost) OVER w AS used, row_number() OVER w AS place FROM costed
  WINDOW w AS (PARTITION BY table_ref ORDER BY relevance DESC, provider_seq, seq, text, source ROWS UNBOUNDED PRECEDING)),
told AS (SELECT table_ref, count(*) AS notes, md5(string_agg(concat(source, ':', text), chr(10) ORDER BY place)) AS context
  FROM summed WHERE used <= 500 OR place = 1 GROUP BY table_ref)"""


def notes_of(t: Tables, table_ref) -> DataFrame:
    """The documents as notes on the tables of the drafts, cut to a token budget."""
    rows = t["snippets"].withColumn("table_ref", table_ref).withColumn("informs", F.array().cast("array<string>"))
    return prompts.context_lists(within_budget(rows, 500))


def supplier_notes(t: Tables) -> DataFrame:
    return notes_of(t, F.concat(F.lit("main.sales.s"), F.col("doc_id") % 100 + 1))


@query("column_prompts", f"""
WITH {SUPPLIER_NOTES}, named AS (SELECT DISTINCT concat('main.sales.s', l_suppkey) AS table_ref, concat_ws('_', 'c', l_orderkey, l_linenumber) AS name, l_orderkey AS ordinal FROM lineitem),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY table_ref ORDER BY ordinal, name) - 1) // 25 AS batch FROM named),
grouped AS (SELECT table_ref, batch, count(*) AS asked, string_agg(name, ', ' ORDER BY ordinal, name) AS names FROM numbered GROUP BY ALL)
SELECT concat(grouped.table_ref, '|', batch) AS prompt_id, asked, CASE WHEN s_acctbal > 5000 THEN concat('The table comment, just drafted:
', s_name, '

Draft comments for columns: ', names, '.') ELSE concat('Draft comments for columns: ', names, '.') END AS instruction,
  coalesce(notes, 0) AS notes, coalesce(context, md5('')) AS context
FROM grouped JOIN supplier ON grouped.table_ref = concat('main.sales.s', s_suppkey) LEFT JOIN told ON told.table_ref = grouped.table_ref""",
       ["snippets"], asked="int", notes="int")
def column_prompts(t: Tables) -> DataFrame:
    columns = order_columns(t).withColumns({"data_type": F.lit("bigint"), "existing_comment": F.lit(None).cast("string")})
    comments = t["supplier"].select(F.concat(F.lit("main.sales.s"), "s_suppkey").alias("table_ref"),
                                    F.when(F.col("s_acctbal") > 5000, F.col("s_name")).otherwise(" ").alias("comment"))
    meta = t.spark.createDataFrame([], "table_ref string, schema_meta string")
    made = prompts.column_prompts(columns, supplier_notes(t), meta, comments)
    told = F.array_join(F.transform("context", lambda c: F.concat_ws(":", c["source"], c["text"])), "\n")
    return made.select("prompt_id", F.size("asked").alias("asked"), "instruction", F.size("context").alias("notes"), F.md5(told).alias("context"))


def document_prompts(t: Tables) -> DataFrame:
    """One prompt per document: its lines as context, all of it as profile."""
    lines = F.split("text", "\n")
    return t["documents"].select(
        "doc_id", F.lit("Explain the table.").alias("system"),
        F.transform(lines, lambda line: F.struct(F.col("source").alias("source"), line.alias("text"))).alias("context"),
        F.col("text").alias("profile"), F.lit("{}").alias("brief_profile"), F.lit("Go.").alias("instruction"))


def cost_sql(text: str) -> str:
    return f"CASE WHEN length({text}) = 0 THEN 0 ELSE greatest(1, round_even(length({text}) / 4.0, 0)) END"


@query("prompt_steps", f"""
WITH cut AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda line: concat('- (', source, ') ', line)) AS lines FROM documents),
texts AS (SELECT doc_id, text AS profile, array_to_string(lines, chr(10)) AS whole,
  array_to_string(lines[1:greatest(1, len(lines) // 2)], chr(10)) AS half FROM cut),
costs AS (SELECT doc_id, {cost_sql("'Explain the table.'")} + {cost_sql("'Go.'")} AS fixed,
    {cost_sql("concat('CONTEXT:' || chr(10), whole)")} AS c0, {cost_sql("concat('CONTEXT:' || chr(10), half)")} AS c1,
    {cost_sql("concat('CONTEXT:' || chr(10), '- (summary) ', left(half, 500))")} AS c2,
    {cost_sql("concat('PROFILE:' || chr(10), profile)")} AS p0, {cost_sql("concat('PROFILE:' || chr(10), '{}')")} AS p1 FROM texts),
sums AS (SELECT doc_id, fixed + c0 + p0 AS t0, fixed + c1 + p0 AS t1, fixed + c2 + p0 AS t2, fixed + c2 + p1 AS t3 FROM costs),
steps AS (SELECT *, CASE WHEN t0 <= 600 THEN 0 WHEN t1 <= 600 THEN 1 WHEN t2 <= 600 THEN 2 ELSE 3 END AS rung FROM sums)
SELECT doc_id, cast(CASE rung WHEN 0 THEN t0 WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END AS int) AS tokens,
  CASE rung WHEN 3 THEN t3 <= 600 ELSE true END AS within_budget,
  concat_ws(',', CASE WHEN rung >= 1 AND t1 < t0 THEN 'trim_context' END, CASE WHEN rung >= 2 AND t2 < t1 THEN 'summarize_context' END,
    CASE WHEN rung >= 3 AND t3 < t2 THEN 'reduce_profile' END) AS actions FROM steps""")
def prompt_steps(t: Tables) -> DataFrame:
    fitted = prompts.fit_prompts(document_prompts(t), 600, summary=lambda text: F.left(text, F.lit(500)))
    return fitted.select("doc_id", "tokens", "within_budget", F.array_join("actions", ",").alias("actions"))


def naming_model():
    """A deterministic stand-in for a model: restates the columns it is asked about."""
    def reply(messages: list[dict[str, str]]) -> str:
        asked = messages[-1]["content"].rsplit("columns: ", 1)[1].rstrip(".").split(", ")
        if asked[0].endswith("7"):
            raise RuntimeError("model busy")
        return "```json\n" + json.dumps({"columns": [
            {"name": n, "proposed_comment": f"Holds {n}", "rationale": "named so", "tags": ["Key", "key "], "self_confidence": 0.5}
            for n in asked if not n.endswith("5")]}) + "\n```"

    return reply  # a closure travels to the workers whole, wherever this package is installed


@query("model_drafts", """
WITH named AS (SELECT DISTINCT concat('main.sales.s', l_suppkey) AS table_ref, concat_ws('_', 'c', l_orderkey, l_linenumber) AS name, l_orderkey AS ordinal FROM lineitem),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY table_ref ORDER BY ordinal, name) - 1) // 25 AS batch FROM named),
led AS (SELECT *, first_value(name) OVER (PARTITION BY table_ref, batch ORDER BY ordinal, name) AS head FROM numbered)
SELECT table_ref, name AS target, CASE WHEN right(head, 1) = '7' OR right(name, 1) = '5' THEN 'error' ELSE 'draft' END AS status,
  CASE WHEN right(head, 1) = '7' THEN 'reasoning failed: model busy' WHEN right(name, 1) = '5' THEN 'model did not return a draft for this column'
       ELSE 'named so' END AS rationale,
  CASE WHEN right(head, 1) <> '7' AND right(name, 1) <> '5' THEN concat('Holds ', name) END AS proposed_comment,
  CASE WHEN right(head, 1) <> '7' AND right(name, 1) <> '5' THEN 'key' END AS tags FROM led""")
def model_drafts(t: Tables) -> DataFrame:
    columns = order_columns(t).withColumns({"data_type": F.lit("bigint"), "existing_comment": F.lit(None).cast("string")})
    empty = t.spark.createDataFrame([], "table_ref string, schema_meta string")
    contexts = supplier_notes(t)
    asked = prompts.column_prompts(columns, contexts, empty, empty.withColumnRenamed("schema_meta", "comment"))
    fitted = prompts.fit_prompts(asked, None).withColumn("messages", prompts.messages())
    replies = inference.infer(
        fitted.select("prompt_id", F.col("table_ref").alias("session_id"), "table_ref", "asked", "actions", "messages"), naming_model())
    return inference.column_drafts(replies).select(
        "table_ref", "target", "status", "rationale", "proposed_comment", F.array_join("tags", ",").alias("tags"))


REPLY = """CASE event_id % 6
  WHEN 0 THEN concat('```json
', props, '
```') WHEN 1 THEN concat('Sure: ', props, ' as asked') WHEN 2 THEN props WHEN 3 THEN concat('no ', event_type)
  WHEN 4 THEN concat('```', props, '```') ELSE '' END"""


@query("reply_bodies", """SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2, 4) THEN props END AS body FROM events""")
def reply_bodies(t: Tables) -> DataFrame:
    raw = t["events"].select("event_id", F.expr(REPLY).alias("raw"))
    return raw.select("event_id", json_body(F.col("raw")).alias("body"))


@query("reply_drafts", """
WITH lines AS (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS supp, max(l_quantity) AS qty FROM lineitem GROUP BY ALL)
SELECT cast(l_orderkey AS varchar) AS session_id, concat('c', l_linenumber) AS target, l_linenumber AS ordinal,
  CASE WHEN l_linenumber = 4 THEN 'error' ELSE 'draft' END AS status,
  CASE WHEN l_linenumber = 4 THEN 'model did not return a draft for this column' WHEN l_orderkey % 2 = 0
       THEN 'because
[context compacted to fit token budget: trim_context]' ELSE 'because' END AS rationale,
  CASE WHEN l_linenumber <> 4 THEN concat('later ', supp) END AS proposed_comment,
  CASE WHEN l_linenumber <> 4 THEN qty / 50 END AS confidence FROM lines""")
def reply_drafts(t: Tables) -> DataFrame:
    """One reply per order; line 4 is left out of it, each other line is answered twice."""
    lines = t["lineitem"].groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("supp"), F.max("l_quantity").alias("qty"))
    name = F.concat(F.lit("c"), "l_linenumber")

    def answer(word: str):
        return F.struct(name.alias("name"), F.concat(F.lit(word), "supp").alias("proposed_comment"),
                        F.lit("because").alias("rationale"), (F.col("qty") / 50).alias("self_confidence"))

    per_order = lines.groupBy("l_orderkey").agg(
        F.collect_list(F.struct(name.alias("name"), F.col("l_linenumber").alias("ordinal"), F.lit("bigint").alias("data_type"),
                                F.lit(None).cast("string").alias("current_comment"))).alias("asked"),
        F.flatten(F.collect_list(F.when(F.col("l_linenumber") != 4, F.array(answer("first "), answer("later "))))).alias("given"))
    replies = per_order.select(
        F.col("l_orderkey").cast("string").alias("session_id"), F.concat(F.lit("main.t"), "l_orderkey").alias("table_ref"), "asked",
        F.when(F.col("l_orderkey") % 2 == 0, F.array(F.lit("trim_context"))).otherwise(F.array().cast("array<string>")).alias("actions"),
        F.to_json(F.struct(F.col("given").alias("columns"))).alias("reply"), F.lit(None).cast("string").alias("failure"))
    return inference.column_drafts(replies).select(
        "session_id", "target", "ordinal", "status", "rationale", "proposed_comment", "confidence")


@query("draft_tags", """
WITH raw AS (SELECT p_partkey, unnest(string_split(concat(p_name, ' ', p_type, ' ', p_brand, '  ', p_type, ' X ', p_size, ' y z w v'), ' ')) AS tag,
    generate_subscripts(string_split(concat(p_name, ' ', p_type, ' ', p_brand, '  ', p_type, ' X ', p_size, ' y z w v'), ' '), 1) AS spot FROM part),
first AS (SELECT p_partkey, lower(trim(tag)) AS tag, min(spot) AS spot FROM raw WHERE trim(tag) <> '' GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY spot) AS n FROM first)
SELECT p_partkey, string_agg(tag, '|' ORDER BY spot) AS tags FROM numbered WHERE n <= 6 GROUP BY p_partkey""")
def draft_tags(t: Tables) -> DataFrame:
    raw = F.split(F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand", F.lit("  "), "p_type", F.lit(" X "), "p_size", F.lit(" y z w v")), " ")
    return t["part"].select("p_partkey", F.array_join(clean_tags(raw), "|").alias("tags"))


@query("draft_facts", """
SELECT o_orderkey, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN NULL ELSE trim(o_orderpriority) END AS owner,
  CASE WHEN o_custkey % 3 = 0 THEN concat('order ', o_custkey) END AS grain FROM orders""")
def draft_facts(t: Tables) -> DataFrame:
    owner = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", " Unknown ").otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    grain = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("order "), "o_custkey")).when(F.col("o_custkey") % 3 == 1, "N/A")
    facts = clean_facts(F.create_map(F.lit("owner"), owner, F.lit("grain"), grain))
    return t["orders"].select("o_orderkey", F.try_element_at(facts, F.lit("owner")).alias("owner"),
                              F.try_element_at(facts, F.lit("grain")).alias("grain"))


@query("suggested_answers", """
WITH last AS (SELECT session_id, qid, arg_max(answer, seq) AS answer FROM answers GROUP BY 1, 2)
SELECT q.session_id, q.qid, coalesce(q.suggested_answer, CASE WHEN trim(a.answer) <> '' THEN trim(a.answer) END) AS suggested_answer
FROM questions q LEFT JOIN last a ON q.session_id = a.session_id AND q.qid = a.qid""", ["questions", "answers"])
def suggested_answers(t: Tables) -> DataFrame:
    return inference.suggest_answers(t["questions"], t["answers"]).select("session_id", "qid", "suggested_answer")


@query("applicable_fields", """
WITH signals AS (SELECT table_ref, name, is_enum_candidate AS enum, nullable, cardinality_ratio < 0.98 AS low,
    EXISTS (SELECT 1 FROM declared_fks f WHERE f.table_ref = p.table_ref AND f."column" = p.name) AS fk FROM column_profiles p)
SELECT table_ref, name, 'definition' AS field, 'required' AS requirement FROM signals
UNION ALL SELECT table_ref, name, 'units', 'conditional' FROM signals WHERE low AND NOT fk
UNION ALL SELECT table_ref, name, 'allowed_values', 'conditional' FROM signals WHERE enum
UNION ALL SELECT table_ref, name, 'null_meaning', 'conditional' FROM signals WHERE nullable
UNION ALL SELECT table_ref, name, 'fk_reference', 'conditional' FROM signals WHERE fk""", ["column_profiles", "declared_fks"])
def applicable_fields(t: Tables) -> DataFrame:
    columns = t["column_profiles"].withColumn("pii", F.struct(F.lit(False).alias("detected")))
    signals = prompts.field_signals(columns, t["declared_fks"])
    return prompts.applicable_fields(signals).select("table_ref", "name", "field", "requirement")


@query("template_errors", """
WITH rubric AS (SELECT concat('t', o_custkey) AS template, CASE WHEN o_orderstatus = 'P' THEN 0.5 ELSE 0.25 END AS weight FROM orders),
checked AS (SELECT template, sum(weight) AS total FROM rubric GROUP BY 1),
fields AS (SELECT concat('t', c_custkey) AS template, c_mktsegment AS segment FROM customer)
SELECT template, 'rubric weights must sum to 1' AS message FROM checked WHERE abs(total - 1) > 1e-6
UNION ALL SELECT template, 'column fields must require a definition' FROM fields WHERE segment = 'BUILDING'
UNION ALL SELECT template, 'table fields must not be empty' FROM fields WHERE segment <> 'MACHINERY'
UNION ALL SELECT template, 'unknown condition' FROM fields WHERE segment = 'HOUSEHOLD'
UNION ALL SELECT template, 'rubric must not be empty' FROM fields WHERE template NOT IN (SELECT template FROM rubric)""")
def template_errors(t: Tables) -> DataFrame:
    rubric = t["orders"].select(F.concat(F.lit("t"), "o_custkey").alias("template"), F.col("o_orderkey").alias("dim"),
                                F.when(F.col("o_orderstatus") == "P", 0.5).otherwise(0.25).alias("weight"))
    named = t["customer"].select(F.concat(F.lit("t"), "c_custkey").alias("template"), "c_mktsegment")
    rows = F.array(
        F.struct(F.lit("column").alias("scope"), F.when(F.col("c_mktsegment") == "BUILDING", "units").otherwise("definition").alias("field"),
                 F.lit("required").alias("requirement"), F.lit(None).cast("string").alias("when")),
        F.struct(F.lit("table").alias("scope"), F.lit("grain").alias("field"),
                 F.when(F.col("c_mktsegment") == "MACHINERY", "required").otherwise("recommended").alias("requirement"), F.lit(None).cast("string").alias("when")),
        F.struct(F.lit("column").alias("scope"), F.lit("units").alias("field"), F.lit("conditional").alias("requirement"),
                 F.when(F.col("c_mktsegment") == "HOUSEHOLD", "often").otherwise("enum").alias("when")))
    return prompts.template_errors(rubric, named.select("template", F.inline(rows)))


@query("clean_scores", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN least(1.0, greatest(0.0, value / 100)) WHEN 4 THEN 1.0 ELSE 0.0 END AS score FROM events""")
def clean_scores(t: Tables) -> DataFrame:
    raw = F.get(F.array((F.col("value") / 100).cast("string"), F.lit("high"), F.lit("NaN"), F.lit(None).cast("string"), F.lit("1.5")),
                (F.col("event_id") % 5).cast("int"))
    return t["events"].select("event_id", scoring.clean_score(raw).alias("score"))


CLEAN = "least(1.0, greatest(0.0, {d}))"
WEIGHTED = "round(" + " + ".join(f"{CLEAN.format(d=d)} * {w}" for d, w in scoring.RUBRIC.items()) + ", 4)"


def score_maps(t: Tables) -> DataFrame:
    pairs = []
    for name in scoring.RUBRIC:
        pairs += [F.lit(name), F.col(name).cast("string")]
    return t["subscores"].withColumn("raw_subscores", F.create_map(*pairs))


@query("rubric_scores", f"SELECT session_id, target, {WEIGHTED} AS overall FROM subscores", ["subscores"])
def rubric_scores(t: Tables) -> DataFrame:
    return score_maps(t).select(
        "session_id", "target", scoring.overall(scoring.clean_subscores(F.col("raw_subscores"))).alias("overall"))


@query("scored_drafts", f"""
SELECT d.session_id, d.target, CASE WHEN s.target IS NULL OR d.status = 'error' THEN d.confidence WHEN s.grounding > 0.9 THEN d.confidence ELSE {WEIGHTED} END AS confidence,
  CASE WHEN s.grounding > 0.9 AND d.status <> 'error' THEN 'error' ELSE d.status END AS status,
  CASE WHEN s.grounding > 0.9 AND d.status <> 'error' THEN concat(CASE WHEN d.rationale IS NULL THEN '' ELSE concat(d.rationale, chr(10)) END, '[judge failed: too long]')
       ELSE d.rationale END AS rationale
FROM drafts d LEFT JOIN subscores s ON d.session_id = s.session_id AND d.target = s.target""", ["drafts", "subscores"])
def scored_drafts(t: Tables) -> DataFrame:
    drafts = t["drafts"].withColumns({"subscores": F.lit(None).cast("map<string,double>"), "issues": F.lit(None).cast("array<string>")})
    asked = drafts.filter("status <> 'error'").select("session_id", "target")
    verdicts = score_maps(t).join(asked, ["session_id", "target"]).select(
        "session_id", "target", "raw_subscores", F.array(F.lit("vague")).alias("raw_issues"),
        F.when(F.col("grounding") > 0.9, "too long").alias("failure"))
    return scoring.score_drafts(drafts, verdicts).select("session_id", "target", "confidence", "status", "rationale")


@query("evidence_sizes", """
SELECT session_id, target, CASE WHEN target = '__table__' THEN 'table' ELSE 'column' END AS kind, target <> '__table__' AS has_profile
FROM drafts WHERE status <> 'error'""", ["drafts"])
def evidence_sizes(t: Tables) -> DataFrame:
    drafts = t["drafts"].withColumn("evidence_refs", F.array().cast("array<string>"))
    columns = t["drafts"].filter("target <> '__table__'").select("table_ref", F.col("target").alias("name"), "ordinal")
    tables = t["sessions"].select(F.concat(F.lit("main.sales.t"), "session_id").alias("table_ref"), "status")
    contexts = notes_of(t, F.concat(F.lit("main.sales.t"), F.col("doc_id") * 4))
    meta = t.spark.createDataFrame([], "table_ref string, schema_meta string")
    rows = scoring.evidence_rows(drafts, tables, columns, meta, contexts, 1000)
    return rows.select("session_id", "target", "kind", F.col("evidence").contains("ordinal").alias("has_profile"))


SIGNALS = """signals AS (
  SELECT p.*, EXISTS (SELECT 1 FROM informs i WHERE i.table_ref = p.table_ref AND i.name = p.name) AS used,
    EXISTS (SELECT 1 FROM declared_fks f WHERE f.table_ref = p.table_ref AND f."column" = p.name) AS fk FROM column_profiles p)"""
SIGNAL_INPUTS = ["column_profiles", "informs", "declared_fks"]


def signals(t: Tables) -> DataFrame:
    snippets = t["informs"].select("table_ref", F.array("name").alias("informs"))
    return gate.hard_signals(t["column_profiles"], snippets, t["declared_fks"])


@query("informed_columns", "SELECT DISTINCT table_ref, name FROM informs", ["informs"])
def informed_columns(t: Tables) -> DataFrame:
    return gate.informed_columns(t["informs"].select("table_ref", F.array("name").alias("informs")))


@query("hard_signals", f"""WITH {SIGNALS} SELECT table_ref, name, length(trim(name, '_')) <= 3 AND NOT used AS ambiguous_name, used AS has_usage_evidence,
  null_fraction > 0.5 AS high_null_fraction, is_enum_candidate AS enum_candidate, used AS has_decode_source,
  cardinality_ratio >= 0.98 AS keylike, fk OR used AS has_key_target FROM signals""", SIGNAL_INPUTS)
def hard_signals(t: Tables) -> DataFrame:
    return signals(t)


TRIPPED = """trips AS (SELECT table_ref, name, concat_ws(',',
    CASE WHEN length(trim(name, '_')) <= 3 AND NOT used AND null_fraction > 0.5 THEN 'ambiguous_unused_high_null' END,
    CASE WHEN is_enum_candidate AND NOT used THEN 'enum_no_decode' END,
    CASE WHEN cardinality_ratio >= 0.98 AND NOT fk AND NOT used THEN 'keylike_no_target' END) AS reasons FROM signals)"""


@query("hard_trips", f"WITH {SIGNALS}, {TRIPPED} SELECT * FROM trips", SIGNAL_INPUTS)
def hard_trips(t: Tables) -> DataFrame:
    return signals(t).select("table_ref", "name", F.array_join(gate.hard_trips(), ",").alias("reasons"))


ROUTED = f"""WITH {SIGNALS}, {TRIPPED},
named AS (SELECT *, CASE target WHEN 'c1' THEN '_id' WHEN 'c2' THEN 'tier' WHEN 'c3' THEN 'ab_' ELSE replace(target, 'c', 'col') END AS name FROM drafts),
routed AS (SELECT d.*, CASE WHEN d.status NOT IN ('draft', 'needs_input', 'low_confidence') THEN ''
    WHEN coalesce(t.reasons, '') <> '' THEN t.reasons WHEN d.confidence IS NULL THEN 'no_confidence'
    WHEN d.confidence < 0.75 THEN 'below_threshold' ELSE '' END AS reasons
  FROM named d LEFT JOIN trips t ON d.table_ref = t.table_ref AND d.name = t.name AND d.target <> '__table__')"""
ROUTE_INPUTS = ["drafts", *SIGNAL_INPUTS]


def named_drafts(t: Tables) -> DataFrame:
    """Drafts whose columns carry the names of the profiled ones."""
    target = F.col("target")
    name = (F.when(target == "c1", "_id").when(target == "c2", "tier").when(target == "c3", "ab_")
            .when(target == "__table__", target).otherwise(F.replace(target, F.lit("c"), F.lit("col"))))
    return t["drafts"].withColumn("target", name)


SHOWN = "CASE WHEN target = '__table__' THEN target ELSE name END"


@query("routed_drafts", f"{ROUTED} SELECT session_id, {SHOWN} AS target, reasons FROM routed", ROUTE_INPUTS)
def routed_drafts(t: Tables) -> DataFrame:
    routed = gate.route(named_drafts(t), signals(t))
    return routed.select("session_id", "target", F.array_join("reasons", ",").alias("reasons"))


@query("gate_questions", f"""{ROUTED},
asked AS (SELECT *, CASE WHEN target = '__table__' THEN 'this table' ELSE concat('column `', name, '`') END AS who,
  row_number() OVER (PARTITION BY session_id ORDER BY ordinal, target) AS n FROM routed WHERE reasons <> '')
SELECT session_id, concat('q', n) AS qid, CASE WHEN target = '__table__' THEN 'table' ELSE 'column' END AS target_kind,
  CASE WHEN target <> '__table__' THEN name END AS target_name,
  CASE WHEN contains(reasons, 'enum_no_decode') THEN concat(who, ' holds coded values with no decode source — what do the codes mean?')
    WHEN contains(reasons, 'keylike_no_target') THEN concat(who, ' looks like a key but no lineage resolves its target — what does it reference?')
    WHEN contains(reasons, 'ambiguous') THEN concat(who, ' has an ambiguous name, no usage history, and is mostly null — what is it for?')
    ELSE concat('What is the business meaning of ', who, '? (low confidence — needs confirmation)') END AS text FROM asked""", ROUTE_INPUTS)
def gate_questions(t: Tables) -> DataFrame:
    return gate.questions(gate.route(named_drafts(t), signals(t))).drop("answered", "suggested_answer")


@query("gate_statuses", f"{ROUTED} SELECT session_id, {SHOWN} AS target, CASE WHEN reasons <> '' THEN 'needs_input' ELSE status END AS status FROM routed", ROUTE_INPUTS)
def gate_statuses(t: Tables) -> DataFrame:
    return gate.settle(gate.route(named_drafts(t), signals(t)), "interactive").select("session_id", "target", "status")


@query("gate_batch", f"""{ROUTED} SELECT session_id, {SHOWN} AS target, CASE WHEN reasons <> '' THEN 'low_confidence' ELSE status END AS status,
  CASE WHEN reasons = '' THEN rationale WHEN rationale IS NULL THEN concat('low confidence: ', replace(reasons, ',', ', '))
    ELSE concat(rationale, chr(10), 'low confidence: ', replace(reasons, ',', ', ')) END AS rationale FROM routed""", ROUTE_INPUTS)
def gate_batch(t: Tables) -> DataFrame:
    return gate.settle(gate.route(named_drafts(t), signals(t)), "batch").select("session_id", "target", "status", "rationale")


@query("session_outcomes", f"""{ROUTED} SELECT session_id, count(*) FILTER (WHERE reasons <> '') AS questions,
  CASE WHEN count(*) FILTER (WHERE reasons <> '') > 0 THEN 'needs_input' ELSE 'ready_for_review' END AS kind,
  CASE WHEN count(*) FILTER (WHERE reasons <> '') > 0 THEN 'awaiting_input' ELSE 'ready_for_review' END AS status
FROM routed GROUP BY session_id""", ROUTE_INPUTS)
def session_outcomes(t: Tables) -> DataFrame:
    return gate.outcomes(gate.route(named_drafts(t), signals(t)), ASKING_MODES[0])


@query("session_phases", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'reasoning' WHEN 1 THEN 'reasoning' WHEN 2 THEN 'applied' ELSE event_type END AS status FROM events""")
def session_phases(t: Tables) -> DataFrame:
    phase = F.get(F.array(F.lit("judging"), F.lit("gating"), F.lit("applied"), F.col("event_type")), (F.col("event_id") % 4).cast("int"))
    return t["events"].select("event_id", gate.session_status(phase).alias("status"))
