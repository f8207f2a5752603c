"""Lineage, query history, context ranking and the comment library."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tablelore.functions.loose_json import result_texts
from tablelore.functions.text import tokens
from tablelore.operators import context, history, library, lineage
from tablelore.session import checkpoint_folder
from tablelore.sources import catalog
from tablelore.streaming.query_log import GrowingLog

from .tables import Tables, query


@query("declared_keys", """
SELECT concat_ws('.', table_catalog, table_schema, table_name) AS table_ref, c.constraint_name, constraint_type,
  column_name AS "column", ordinal_position AS pos
FROM table_constraints c JOIN key_columns k ON c.constraint_catalog = k.constraint_catalog
  AND c.constraint_schema = k.constraint_schema AND c.constraint_name = k.constraint_name""", ["table_constraints", "key_columns"])
def declared_keys(t: Tables) -> DataFrame:
    return catalog.declared_keys(t["table_constraints"], t["key_columns"])


@query("foreign_keys", """
SELECT concat_ws('.', 'main', 'sales', c.table_name) AS table_ref, c.constraint_name, f.column_name AS "column",
  concat_ws('.', 'main', 'sales', p.table_name) AS ref_table, u.column_name AS ref_column, f.ordinal_position AS pos
FROM table_constraints c JOIN key_references r ON c.constraint_name = r.constraint_name
JOIN key_columns f ON f.constraint_name = c.constraint_name
JOIN table_constraints p ON p.constraint_name = r.unique_constraint_name
JOIN key_columns u ON u.constraint_name = p.constraint_name AND u.ordinal_position = f.ordinal_position
WHERE c.constraint_type = 'FOREIGN KEY'""", ["table_constraints", "key_columns", "key_references"])
def foreign_keys(t: Tables) -> DataFrame:
    return catalog.foreign_keys(t["table_constraints"], t["key_columns"], t["key_references"])


@query("catalog_columns", """
SELECT concat('main.sales.', replace(constraint_name, 'pk_', 't')) AS table_ref, column_name AS name,
  ordinal_position AS ordinal, ordinal_position % 2 = 1 AS nullable FROM key_columns
WHERE column_name <> 'c4'""", ["key_columns"])
def catalog_columns(t: Tables) -> DataFrame:
    keys = t["key_columns"]
    listed = keys.select(
        F.lit("main").alias("table_catalog"), F.lit("sales").alias("table_schema"),
        F.replace("constraint_name", F.lit("pk_"), F.lit("t")).alias("table_name"),
        F.when(F.col("column_name") != "c4", F.col("column_name")).alias("column_name"), "ordinal_position",
        F.lit("bigint").alias("data_type"), F.when(F.col("ordinal_position") % 2 == 1, "Yes").otherwise("NO").alias("is_nullable"),
        F.lit(None).cast("string").alias("comment"))
    return catalog.column_rows(listed).select("table_ref", "name", "ordinal", "nullable")


@query("upstream_tables", """
SELECT DISTINCT target_table_full_name AS table_ref, source_table_full_name AS linked FROM edges
WHERE source_table_full_name IS NOT NULL AND target_table_full_name IN (SELECT table_ref FROM edge_targets)""", ["edges", "edge_targets"])
def upstream_tables(t: Tables) -> DataFrame:
    return lineage.upstream(t["edges"], t["edge_targets"])


@query("downstream_tables", """
SELECT DISTINCT source_table_full_name AS table_ref, target_table_full_name AS linked FROM edges
WHERE target_table_full_name IS NOT NULL AND source_table_full_name IN (SELECT table_ref FROM edge_targets)""", ["edges", "edge_targets"])
def downstream_tables(t: Tables) -> DataFrame:
    return lineage.downstream(t["edges"], t["edge_targets"])


@query("column_sources", """
SELECT target_table_full_name AS table_ref, source_table_full_name, source_column_name, target_column_name FROM column_edges
WHERE source_column_name IS NOT NULL AND target_table_full_name IN (SELECT table_ref FROM edge_targets)""", ["column_edges", "edge_targets"])
def column_sources(t: Tables) -> DataFrame:
    return lineage.column_sources(t["column_edges"], t["edge_targets"])


def informs_text(snippets: DataFrame) -> DataFrame:
    return snippets.withColumn("informs", F.array_join("informs", ","))


@query("lineage_snippets", """
WITH links AS (
  SELECT DISTINCT target_table_full_name AS table_ref, source_table_full_name AS linked, 0 AS seq FROM edges
  UNION ALL SELECT DISTINCT source_table_full_name, target_table_full_name, 1 FROM edges),
named AS (SELECT *, row_number() OVER (PARTITION BY table_ref, seq ORDER BY linked) AS n FROM links
  WHERE linked IS NOT NULL AND table_ref IN (SELECT table_ref FROM edge_targets)),
listed AS (SELECT table_ref, seq, string_agg(linked, ', ' ORDER BY linked) AS names FROM named WHERE n <= 10 GROUP BY table_ref, seq)
SELECT table_ref, concat(CASE seq WHEN 0 THEN 'Upstream sources' ELSE 'Downstream consumers' END, ' (lineage): ', names, '.') AS text,
  'uc_lineage' AS source, '' AS informs, CASE seq WHEN 0 THEN 0.7 ELSE 0.55 END AS relevance, seq FROM listed
UNION ALL
SELECT target_table_full_name, concat('Column `', target_column_name, '` derives from `', source_table_full_name, '`.`',
  source_column_name, '` (column lineage → FK/derivation hint).'), 'uc_lineage', target_column_name, 0.8, 2 FROM column_edges
WHERE source_column_name IS NOT NULL AND target_table_full_name IN (SELECT table_ref FROM edge_targets)""",
       ["edges", "column_edges", "edge_targets"], relevance="double")
def lineage_snippets(t: Tables) -> DataFrame:
    return informs_text(lineage.lineage_snippets(t["edges"], t["column_edges"], t["edge_targets"]))


MENTIONED = """mentioned AS (SELECT table_ref, statement_id, start_time, statement_text FROM query_log JOIN log_targets
  ON contains(lower(statement_text), lower(table_ref))),
recent AS (SELECT *, row_number() OVER (PARTITION BY table_ref ORDER BY start_time DESC, statement_id) AS rank FROM mentioned)"""
LOG = ["query_log", "log_targets"]


@query("statement_mentions", f"WITH {MENTIONED} SELECT table_ref, statement_id FROM mentioned", LOG)
def statement_mentions(t: Tables) -> DataFrame:
    return history.mentions(t["query_log"], t["log_targets"]).select("table_ref", "statement_id")


@query("recent_statements", f"WITH {MENTIONED} SELECT table_ref, statement_id, rank, statement_text FROM recent WHERE rank <= 200", LOG, rank="int")
def recent_statements(t: Tables) -> DataFrame:
    return history.recent_mentions(t["query_log"], t["log_targets"]).drop("start_time")


@query("recent_statements_by_increments", f"WITH {MENTIONED} SELECT table_ref, statement_id, rank, statement_text FROM recent WHERE rank <= 200", LOG, rank="int")
def recent_statements_by_increments(t: Tables) -> DataFrame:
    """The log comes in three batches; the newest statements are kept in a store between them."""
    log, folder = t["query_log"], f"{checkpoint_folder(t.spark).rstrip('/')}/growing-log-{uuid.uuid4().hex}"
    kinds = (log.schema[name].dataType.simpleString() for name in ("statement_id", "start_time"))
    kept = GrowingLog(t.spark, folder, kinds=tuple(kinds))
    for number in range(3):
        kept.merge(log.filter(F.pmod(F.xxhash64("statement_id"), F.lit(3)) == number), t["log_targets"], number)
    return kept.recent().drop("start_time")


def counted_sql(pattern: str) -> str:
    return f"""WITH {MENTIONED},
found AS (SELECT table_ref, rank, unnest(regexp_extract_all(statement_text, '{pattern}', 1)) AS raw,
          generate_subscripts(regexp_extract_all(statement_text, '{pattern}', 1), 1) AS spot FROM recent WHERE rank <= 200),
uses AS (SELECT table_ref, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS item, count(*) AS uses, min(rank * 1000 + spot) AS seen
         FROM found GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY table_ref ORDER BY uses DESC, seen) AS place FROM uses)"""


JOIN_PATTERN_SQL = r"(?i)\bON\s+([\w.`]+\s*=\s*[\w.`]+)"
GROUP_PATTERN_SQL = r"(?i)\bGROUP\s+BY\b\s+([\w.`,\s]+?)(?:\bORDER\b|\bLIMIT\b|$)"
JOIN_SQL = counted_sql(JOIN_PATTERN_SQL)
GROUP_SQL = counted_sql(GROUP_PATTERN_SQL)
PLACED = " SELECT table_ref, item, uses, place FROM placed WHERE place <= 5"


@query("join_conditions", JOIN_SQL + PLACED, LOG, place="int")
def join_conditions(t: Tables) -> DataFrame:
    return history.join_conditions(history.recent_mentions(t["query_log"], t["log_targets"]))


@query("grain_hints", GROUP_SQL + PLACED, LOG, place="int")
def grain_hints(t: Tables) -> DataFrame:
    return history.grain_hints(history.recent_mentions(t["query_log"], t["log_targets"]))


@query("usage_snippets", f"""
WITH {MENTIONED}, counts AS (SELECT table_ref, count(*) AS n FROM recent WHERE rank <= 200 GROUP BY table_ref),
joins AS ({JOIN_SQL[JOIN_SQL.index('found AS'):].replace('found AS', 'WITH found AS', 1)}
  SELECT table_ref, string_agg(item, '; ' ORDER BY place) AS listed FROM placed WHERE place <= 5 GROUP BY table_ref),
grain AS ({GROUP_SQL[GROUP_SQL.index('found AS'):].replace('found AS', 'WITH found AS', 1)}
  SELECT table_ref, string_agg(item, '; ' ORDER BY place) AS listed FROM placed WHERE place <= 5 GROUP BY table_ref)
SELECT table_ref, concat('Observed in ', n, ' recent queries referencing this table.') AS text, 0.5 AS relevance, 0 AS seq FROM counts
UNION ALL SELECT table_ref, concat('Common join conditions (query history): ', listed, '.'), 0.75, 1 FROM joins
UNION ALL SELECT table_ref, concat('Common GROUP BY (grain hint): ', listed, '.'), 0.65, 2 FROM grain""", LOG, relevance="double")
def usage_snippets(t: Tables) -> DataFrame:
    return history.usage_snippets(t["query_log"], t["log_targets"]).select("table_ref", "text", "relevance", "seq")


def lists(library_rows: DataFrame) -> DataFrame:
    """The library input with its list and map columns."""
    tags = F.when(F.col("usage_count") > 3, F.array(F.lit("key"), F.lower("approved_by"))).otherwise(F.array().cast("array<string>"))
    return library_rows.withColumn("tags", tags)


LOOKUP = """best AS (SELECT *, row_number() OVER (PARTITION BY match_key ORDER BY usage_count DESC, updated_at DESC, id) AS rank
  FROM library WHERE scope = '{scope}' AND status IN ('approved', 'applied') AND match_key IN ({keys}))"""


@query("library_reuse", "WITH " + LOOKUP.format(scope="column", keys="SELECT concat(p_brand, '.', p_type) FROM part")
       + " SELECT match_key, canonical_comment, usage_count, rank FROM best WHERE rank <= 3", ["library"], rank="int")
def library_reuse(t: Tables) -> DataFrame:
    keys = t["part"].select(F.concat("p_brand", F.lit("."), "p_type").alias("match_key"))
    return library.reusable(lists(t["library"]), "column", keys).drop("tags")


PHRASE = """concat('Previously-approved canonical comment for ', {subject}, ' — REUSE this wording if it fits this table''s evidence; adapt or ignore it if the data differs (do not copy blindly) [approved, used ', usage_count, 'x]: "', trim(canonical_comment), '".', CASE WHEN usage_count > 3 THEN concat(' tags: key, ', lower(approved_by), '.') ELSE '' END)"""


@query("library_snippets", """
WITH asked AS (SELECT DISTINCT concat(p_brand, '.', p_type) AS table_ref, concat(p_brand, '.', p_name) AS name FROM part
  UNION SELECT DISTINCT concat(p_brand, '.', p_type), concat(p_brand, '.', p_type) FROM part), """
       + LOOKUP.format(scope="table", keys="SELECT table_ref FROM asked") + ", "
       + LOOKUP.format(scope="column", keys="SELECT name FROM asked").replace("best AS", "best_columns AS")
       + " SELECT match_key AS table_ref, " + PHRASE.format(subject="'this table'") + """ AS text, '' AS informs, 0.82 AS relevance
  FROM best WHERE rank <= 3 AND trim(canonical_comment) <> ''
UNION ALL SELECT a.table_ref, """ + PHRASE.format(subject="concat('a column named `', match_key, '`')") + """, match_key, 0.85
  FROM best_columns JOIN asked a ON a.name = match_key WHERE rank <= 3 AND trim(canonical_comment) <> ''""", ["library"], relevance="double")
def library_snippets(t: Tables) -> DataFrame:
    own = F.concat("p_brand", F.lit("."), "p_type")
    asked = t["part"].select(own.alias("table_ref"), F.concat("p_brand", F.lit("."), "p_name").alias("name")).unionByName(
        t["part"].select(own.alias("table_ref"), own.alias("name")))
    return informs_text(context.library_snippets(lists(t["library"]), asked)).select("table_ref", "text", "informs", "relevance")


PAYLOAD = """CASE event_id % 8
  WHEN 0 THEN concat('{{"results":[{{"text":"', event_type, '"}},{{"snippet":"s', user_id, '"}},{{"title":1}}]}}')
  WHEN 1 THEN concat('{{"data":{{"content":"', event_type, '"}}}}') WHEN 2 THEN props
  WHEN 3 THEN concat('plain ', event_type) WHEN 4 THEN concat('["', event_type, '","b"]')
  WHEN 5 THEN concat('{{"summary":"', event_type, '"}}') WHEN 6 THEN concat('"', event_type, '"') END"""


def payloads(t: Tables) -> DataFrame:
    return t.spark.sql(f"SELECT event_id, user_id, {PAYLOAD} AS payload FROM {{events}}", events=t["events"])


TEXTS = """
texts AS (
  SELECT event_id, user_id, unnest(CASE event_id % 8
    WHEN 0 THEN [event_type, concat('s', user_id), '{"title":1}'] WHEN 1 THEN [event_type]
    WHEN 2 THEN [replace(props, ' ', '')] WHEN 3 THEN [concat('plain ', event_type)] WHEN 4 THEN [event_type, 'b']
    WHEN 5 THEN [event_type] WHEN 6 THEN [event_type] ELSE [] END) AS text,
    generate_subscripts(CASE event_id % 8 WHEN 0 THEN [1, 2, 3] WHEN 4 THEN [1, 2] WHEN 7 THEN [] ELSE [1] END, 1) AS item FROM events)"""


@query("tool_result_texts", f"WITH {TEXTS} SELECT event_id, item, text FROM texts", item="int")
def tool_result_texts(t: Tables) -> DataFrame:
    return payloads(t).select("event_id", F.posexplode(result_texts(F.col("payload"))).alias("at", "text")).select(
        "event_id", (F.col("at") + 1).alias("item"), "text")


@query("provider_snippets", f"""
WITH {TEXTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id, item) AS seq FROM texts)
SELECT concat('main.u.', user_id) AS table_ref, text, 0.6 AS relevance, seq FROM ranked WHERE seq <= 8""", relevance="double", seq="int")
def provider_snippets(t: Tables) -> DataFrame:
    results = payloads(t).select(
        F.concat(F.lit("main.u."), "user_id").alias("table_ref"), F.lit("wiki").alias("provider"), F.col("event_id").alias("call"), "payload")
    return context.result_snippets(results).select("table_ref", "text", "relevance", "seq")


@query("allowed_tools", "SELECT event_id, event_type AS tool FROM events WHERE event_type IN ('click', 'error')")
def allowed_tools(t: Tables) -> DataFrame:
    return context.allowed_tools(t["events"].select("event_id", F.col("event_type").alias("tool")), ("click", "error"))


@query("search_texts", """
WITH first AS (SELECT l_suppkey, concat('c', l_orderkey, '_', l_linenumber) AS name,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, concat('c', l_orderkey, '_', l_linenumber)) AS n FROM lineitem)
SELECT concat('main.sales.s', l_suppkey) AS table_ref,
  concat('main.sales.s', l_suppkey, ': ', string_agg(name, ', ' ORDER BY n)) AS query FROM first WHERE n <= 25 GROUP BY l_suppkey""")
def search_texts(t: Tables) -> DataFrame:
    return context.search_texts(t["lineitem"].select(
        F.concat(F.lit("main.sales.s"), "l_suppkey").alias("table_ref"), F.col("l_orderkey").alias("ordinal"),
        F.concat(F.lit("c"), "l_orderkey", F.lit("_"), "l_linenumber").alias("name")))


@query("token_costs", """SELECT doc_id, cast(CASE WHEN length(text) = 0 THEN 0
  ELSE greatest(1, round_even(length(text) / 4.0, 0)) END AS int) AS cost FROM documents""")
def token_costs(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", tokens(F.col("text")).alias("cost"))


COSTED = """costed AS (SELECT *, cast(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, round_even(length(text) / 4.0, 0)) END AS bigint) AS cost FROM snippets),
summed AS (SELECT *, sum(cost) OVER w AS used, row_number() OVER w AS place FROM costed
  WINDOW w AS (PARTITION BY table_ref ORDER BY relevance DESC, provider_seq, seq, text, source ROWS UNBOUNDED PRECEDING))"""


def snippet_rows(t: Tables) -> DataFrame:
    return t["snippets"].withColumn("informs", F.array().cast("array<string>"))


@query("context_within_budget", f"WITH {COSTED} SELECT doc_id, table_ref, relevance FROM summed WHERE used <= 4000 OR place = 1", ["snippets"])
def context_within_budget(t: Tables) -> DataFrame:
    return context.within_budget(snippet_rows(t)).select("doc_id", "table_ref", "relevance")


@query("context_small_budget", f"WITH {COSTED} SELECT doc_id, table_ref, relevance FROM summed WHERE used <= 150 OR place = 1", ["snippets"])
def context_small_budget(t: Tables) -> DataFrame:
    return context.within_budget(snippet_rows(t), 150).select("doc_id", "table_ref", "relevance")


def told_sql(pattern: str, head: str, tail: str, relevance: float, seq: int) -> str:
    """One usage snippet per table: its most frequent matches of the pattern."""
    return f"""SELECT table_ref, concat('{head}', string_agg(item, '; ' ORDER BY place), '{tail}') AS text, {relevance} AS relevance, 0 AS provider_seq, {seq} AS seq
  FROM (SELECT *, row_number() OVER (PARTITION BY table_ref ORDER BY uses DESC, seen) AS place FROM
    (SELECT table_ref, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS item, count(*) AS uses, min(rank * 1000 + spot) AS seen FROM
      (SELECT table_ref, rank, unnest(regexp_extract_all(statement_text, '{pattern}', 1)) AS raw,
         generate_subscripts(regexp_extract_all(statement_text, '{pattern}', 1), 1) AS spot FROM recent WHERE rank <= 200) GROUP BY 1, 2))
  WHERE place <= 5 GROUP BY table_ref"""


@query("gathered_context", f"""
WITH {MENTIONED}, counts AS (SELECT table_ref, count(*) AS n FROM recent WHERE rank <= 200 GROUP BY table_ref),
observed AS (SELECT table_ref, concat('Observed in ', n, ' recent queries referencing this table.') AS text, 0.5 AS relevance, 0 AS provider_seq, 0 AS seq FROM counts),
joined AS ({told_sql(JOIN_PATTERN_SQL, 'Common join conditions (query history): ', '.', 0.75, 1)}),
grain AS ({told_sql(GROUP_PATTERN_SQL, 'Common GROUP BY (grain hint): ', '.', 0.65, 2)}),
results AS (SELECT concat('main.sales.t', user_id % 40) AS table_ref, concat('plain ', event_type) AS text, 0.6 AS relevance, 1 AS provider_seq,
  row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS seq FROM events),
costed AS (SELECT *, greatest(1, round_even(length(text) / 4.0, 0)) AS cost FROM
  (SELECT * FROM observed UNION ALL SELECT * FROM joined UNION ALL SELECT * FROM grain UNION ALL SELECT * FROM results WHERE seq <= 8)),
summed AS (SELECT *, sum(cost) OVER w AS used, row_number() OVER w AS place FROM costed
  WINDOW w AS (PARTITION BY table_ref ORDER BY relevance DESC, provider_seq, seq ROWS UNBOUNDED PRECEDING))
SELECT table_ref, text, relevance FROM summed WHERE used <= 60 OR place = 1""", LOG, relevance="double")
def gathered_context(t: Tables) -> DataFrame:
    def counted(targets: DataFrame) -> DataFrame:
        return history.usage_snippets(t["query_log"], targets)

    def noted(targets: DataFrame) -> DataFrame:
        results = t["events"].select(
            F.concat(F.lit("main.sales.t"), F.col("user_id") % 40).alias("table_ref"), F.lit("wiki").alias("provider"),
            F.col("event_id").alias("call"), F.concat(F.lit("plain "), "event_type").alias("payload"))
        return context.result_snippets(results.join(targets, "table_ref", "left_semi"))

    def down(targets: DataFrame) -> DataFrame:
        raise ConnectionError("no answer")

    made = context.gather({"query_history": counted, "wiki": noted, "tickets": down}, t["log_targets"], budget=60)
    return made.snippets.select("table_ref", "text", "relevance")


@query("library_page", """SELECT id, scope, match_key, usage_count, status FROM library WHERE status <> 'sunset' AND scope = 'column'
ORDER BY usage_count DESC, updated_at DESC, id LIMIT 100 OFFSET 20""", ["library"])
def library_page(t: Tables) -> DataFrame:
    return library.page(t["library"], scope="column", limit=100, offset=20).select("id", "scope", "match_key", "usage_count", "status")


@query("library_upsert", """
WITH changes AS (SELECT scope, match_key, arg_max(canonical_comment, {at, seq}) AS canonical_comment, arg_max(status, {at, seq}) AS status,
    arg_max(approved_by, {at, seq}) AS approved_by, max("at") AS moment, sum(bump) AS bumps, arg_min(bump, {at, seq}) AS first_bump
  FROM library_changes GROUP BY scope, match_key)
SELECT coalesce(k.scope, c.scope) AS scope, coalesce(k.match_key, c.match_key) AS match_key,
  coalesce(c.canonical_comment, k.canonical_comment) AS canonical_comment, coalesce(c.status, k.status) AS status,
  coalesce(c.approved_by, k.approved_by) AS approved_by, coalesce(c.moment, k.updated_at) AS updated_at,
  cast(CASE WHEN c.moment IS NULL THEN usage_count WHEN k.id IS NOT NULL THEN usage_count + bumps ELSE 1 + bumps - first_bump END AS bigint) AS usage_count
FROM library_keys k FULL OUTER JOIN changes c ON k.scope = c.scope AND k.match_key = c.match_key""".replace(
    "{at, seq}", "{'a': \"at\", 's': seq}"), ["library", "library_keys", "library_changes"])
def library_upsert(t: Tables) -> DataFrame:
    return library.upsert(t["library_keys"], t["library_changes"]).select(
        "scope", "match_key", "canonical_comment", "status", "approved_by", "updated_at", "usage_count")


@query("library_sunset", """
WITH retired AS (SELECT DISTINCT concat('L', l_partkey) AS id FROM lineitem WHERE l_quantity = 50)
SELECT id, CASE WHEN r.id IS NULL THEN status ELSE 'sunset' END AS status,
  CASE WHEN r.id IS NULL THEN sunset_at ELSE 99 END AS sunset_at, CASE WHEN r.id IS NULL THEN sunset_by ELSE 'owner' END AS sunset_by,
  CASE WHEN r.id IS NULL THEN updated_at ELSE 99 END AS updated_at FROM library LEFT JOIN retired r USING (id)""", ["library"])
def library_sunset(t: Tables) -> DataFrame:
    ids = t["lineitem"].filter("l_quantity = 50").select(F.concat(F.lit("L"), "l_partkey").alias("id"))
    return library.sunset(t["library"], ids, "owner", F.lit(99)).select("id", "status", "sunset_at", "sunset_by", "updated_at")


@query("library_revive", """
WITH revived AS (SELECT DISTINCT concat('L', l_partkey) AS id FROM lineitem WHERE l_quantity = 50)
SELECT id, CASE WHEN r.id IS NULL THEN status ELSE 'approved' END AS status,
  CASE WHEN r.id IS NULL THEN sunset_at END AS sunset_at, CASE WHEN r.id IS NULL THEN sunset_by END AS sunset_by,
  CASE WHEN r.id IS NULL THEN updated_at ELSE 99 END AS updated_at FROM library LEFT JOIN revived r USING (id)""", ["library"])
def library_revive(t: Tables) -> DataFrame:
    ids = t["lineitem"].filter("l_quantity = 50").select(F.concat(F.lit("L"), "l_partkey").alias("id"))
    return library.revive(t["library"], ids, F.lit(99)).select("id", "status", "sunset_at", "sunset_by", "updated_at")


@query("library_keys", """
SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber = 1 THEN concat('main.s', l_suppkey, '.t') ELSE concat('c', l_linenumber) END AS match_key
FROM lineitem""")
def library_keys(t: Tables) -> DataFrame:
    target = F.when(F.col("l_linenumber") == 1, "__table__").otherwise(F.concat(F.lit("c"), "l_linenumber"))
    ref = F.concat(F.lit("main . `s"), "l_suppkey", F.lit("`. t"))
    return t["lineitem"].select("l_orderkey", "l_linenumber", "l_suppkey", library.match_key(target, ref).alias("match_key"))


@query("library_from_reviews", """
SELECT session_id AS source_session_id, table_ref AS source_table_ref, CASE WHEN target = '__table__' THEN 'table' ELSE 'column' END AS scope,
  CASE WHEN target = '__table__' THEN table_ref ELSE target END AS match_key, trim(proposed_comment) AS canonical_comment, 'approved' AS status, 1 AS bump
FROM drafts WHERE status IN ('approved', 'edited') AND trim(proposed_comment) <> ''""", ["drafts"])
def library_from_reviews(t: Tables) -> DataFrame:
    reviewed = t["drafts"].filter(F.col("status").isin("approved", "edited")).withColumns({
        "tags": F.array().cast("array<string>"), "conditional_fields": F.create_map().cast("map<string,string>")})
    return library.entries_from_drafts(reviewed, "me", F.lit(1)).select(
        "source_session_id", "source_table_ref", "scope", "match_key", "canonical_comment", "status", "bump")
