"""The supplied tables, and the inputs derived from them.

A derived input is one SQL text that Spark and the checking engine both run, so that both start from
the same rows. None is cut down: every input is made from whole tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tablelore.session import dealt, tasks_for

# Columns of the supplied tables with their Spark types.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(part.split(" ")) for part in COLUMNS[table].split(", ")]


INPUTS: dict[str, str] = {}

INPUTS["column_drafts"] = """
SELECT cast(l_orderkey AS string) AS session_id,
       concat('main.sales.t', cast(l_orderkey AS string)) AS table_ref,
       concat('c', cast(l_linenumber AS string)) AS target,
       l_linenumber AS ordinal,
       CASE WHEN l_linenumber = 7 THEN cast(NULL AS string)
            WHEN min(l_suppkey) % 2 = 0 THEN 'as supplied'
            ELSE concat('Supplied by ', cast(min(l_suppkey) AS string)) END AS current_comment,
       CASE WHEN max(l_tax) = 0 THEN '  '
            WHEN min(l_suppkey) % 3 = 0 THEN 'as supplied '
            ELSE concat('Part ', cast(min(l_partkey) AS string), '''s quantity in C:', chr(92), 'new', chr(92)) END AS proposed_comment,
       CASE WHEN max(l_discount) > 0.05 THEN 'seen in the profile' END AS rationale,
       max(l_quantity) / 50 AS confidence,
       CASE max(concat(l_returnflag, l_linestatus))
            WHEN 'AF' THEN 'draft' WHEN 'AO' THEN 'approved' WHEN 'NF' THEN 'needs_input'
            WHEN 'NO' THEN 'low_confidence' WHEN 'RF' THEN 'edited' ELSE 'error' END AS status,
       CASE WHEN min(l_returnflag) = 'N' THEN 'applied' ELSE 'not_applied' END AS apply_status
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""

INPUTS["table_drafts"] = """
SELECT cast(o_orderkey AS string) AS session_id,
       concat('main.sales.t', cast(o_orderkey AS string)) AS table_ref,
       '__table__' AS target, 0 AS ordinal,
       CASE WHEN o_custkey % 3 = 0 THEN 'order facts' END AS current_comment,
       CASE WHEN o_custkey % 5 = 0 THEN '' ELSE concat('Orders of priority ', o_orderpriority) END AS proposed_comment,
       cast(NULL AS string) AS rationale,
       CASE WHEN o_orderstatus <> 'P' THEN cast(o_custkey % 101 AS double) / 100 END AS confidence,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'approved' WHEN o_orderpriority = '2-HIGH' THEN 'needs_input'
            WHEN o_orderpriority = '5-LOW' THEN 'edited' ELSE 'draft' END AS status,
       CASE WHEN o_orderstatus = 'F' THEN 'applied' ELSE 'not_applied' END AS apply_status
FROM {orders}
"""

INPUTS["drafts"] = "SELECT * FROM table_drafts UNION ALL SELECT * FROM column_drafts"

INPUTS["live"] = """
SELECT table_ref, target,
       CASE ordinal % 3 WHEN 0 THEN current_comment WHEN 1 THEN concat(coalesce(current_comment, ''), ' ')
            ELSE proposed_comment END AS live
FROM drafts
"""

INPUTS["subscores"] = """
SELECT cast(l_orderkey AS string) AS session_id, concat('c', cast(l_linenumber AS string)) AS target,
       max(l_discount) * 10 AS completeness, max(l_tax) * 10 - 0.1 AS specificity,
       max(l_quantity) / 50 AS grounding, max(l_extendedprice) / 100000 AS template_conformance
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""

INPUTS["snippets"] = """
SELECT doc_id, concat('main.', source, '.', lang) AS table_ref, text, source,
       cast(doc_id % 7 AS double) / 10 AS relevance, cast(doc_id % 3 AS int) AS provider_seq,
       cast(doc_id AS int) AS seq
FROM {documents}
"""

INPUTS["query_log"] = """
SELECT event_id AS statement_id, ts AS start_time,
       concat('SELECT o.', event_type, ' FROM main.sales.T', cast(user_id % 40 AS string),
              ' o JOIN main.crm.customer c ON o.o_custkey =  c.c_custkey',
              CASE WHEN event_id % 3 = 0 THEN ' JOIN main.ref.nation n on c.nk=n.nk' ELSE '' END,
              ' GROUP BY ', event_type,
              CASE WHEN event_id % 2 = 0 THEN ',  user_id ORDER BY 1' ELSE '' END) AS statement_text
FROM {events}
"""

INPUTS["log_targets"] = """
SELECT DISTINCT concat('main.sales.t', cast(user_id % 40 AS string)) AS table_ref FROM {events}
UNION ALL SELECT 'main.crm.customer' UNION ALL SELECT 'main.ref.nation' UNION ALL SELECT 'main.ref.region'
"""

INPUTS["edges"] = """
SELECT CASE WHEN l_linenumber < 7 THEN concat('main.raw.p', cast(l_partkey % 500 AS string)) END AS source_table_full_name,
       concat('main.sales.s', cast(l_suppkey AS string)) AS target_table_full_name
FROM {lineitem}
"""

INPUTS["edge_targets"] = """
SELECT concat('main.sales.s', cast(s_suppkey AS string)) AS table_ref FROM {supplier}
UNION ALL SELECT concat('main.raw.p', cast(p_partkey AS string)) FROM {part}
"""

INPUTS["column_edges"] = """
SELECT concat('main.raw.p', cast(l_partkey AS string)) AS source_table_full_name,
       CASE WHEN l_linenumber > 1 THEN concat('k', cast(l_linenumber AS string)) END AS source_column_name,
       concat('main.sales.s', cast(l_suppkey AS string)) AS target_table_full_name,
       concat('c', cast(l_linenumber AS string)) AS target_column_name
FROM {lineitem}
"""

INPUTS["table_constraints"] = """
SELECT 'main' AS constraint_catalog, 'sales' AS constraint_schema,
       concat('pk_', cast(p_partkey AS string)) AS constraint_name, 'PRIMARY KEY' AS constraint_type,
       'main' AS table_catalog, 'sales' AS table_schema, concat('t', cast(p_partkey AS string)) AS table_name
FROM {part}
UNION ALL
SELECT 'main', 'sales', concat('fk_', cast(p_partkey AS string)), 'FOREIGN KEY',
       'main', 'sales', concat('t', cast(p_partkey AS string)) FROM {part}
"""

INPUTS["key_columns"] = """
SELECT DISTINCT 'main' AS constraint_catalog, 'sales' AS constraint_schema,
       concat('pk_', cast(l_partkey AS string)) AS constraint_name,
       concat('c', cast(l_linenumber AS string)) AS column_name, l_linenumber AS ordinal_position
FROM {lineitem}
UNION ALL
SELECT DISTINCT 'main', 'sales', concat('fk_', cast(l_partkey AS string)),
       concat('f', cast(l_linenumber AS string)), l_linenumber FROM {lineitem}
"""

INPUTS["key_references"] = """
SELECT 'main' AS constraint_catalog, 'sales' AS constraint_schema,
       concat('fk_', cast(p_partkey AS string)) AS constraint_name,
       'main' AS unique_constraint_catalog, 'sales' AS unique_constraint_schema,
       concat('pk_', cast(p_size AS string)) AS unique_constraint_name
FROM {part}
"""

INPUTS["library"] = """
SELECT concat('L', cast(p_partkey AS string)) AS id,
       CASE WHEN p_size % 2 = 0 THEN 'table' ELSE 'column' END AS scope,
       concat(p_brand, '.', p_type) AS match_key,
       CASE WHEN p_size = 7 THEN ' ' ELSE concat(' ', p_name) END AS canonical_comment,
       cast(p_size % 9 AS bigint) AS usage_count,
       CASE p_size % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'applied' WHEN 2 THEN 'sunset' ELSE 'approved' END AS status,
       concat('main.sales.t', cast(p_partkey AS string)) AS source_table_ref,
       concat('u', cast(p_size AS string)) AS approved_by,
       p_partkey AS approved_at, p_partkey AS updated_at,
       CASE WHEN p_size % 4 = 2 THEN p_partkey END AS sunset_at,
       CASE WHEN p_size % 4 = 2 THEN 'steward' END AS sunset_by
FROM {part}
"""

INPUTS["library_changes"] = """
SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'table' ELSE 'column' END AS scope,
       CASE WHEN l_returnflag = 'N' THEN concat(p_brand, '.new') ELSE concat(p_brand, '.', p_type) END AS match_key,
       concat(p_name, ' on order ', cast(l_orderkey AS string)) AS canonical_comment,
       CASE WHEN l_linestatus = 'O' THEN 'approved' ELSE 'applied' END AS status,
       concat('u', cast(l_suppkey AS string)) AS approved_by,
       l_orderkey AS at, l_extendedprice + l_linenumber * 1000000 + l_suppkey * 100000000 AS seq,
       CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS bump
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

INPUTS["library_keys"] = """
SELECT scope, match_key, min(id) AS id, 'first' AS canonical_comment, max(usage_count) AS usage_count,
       'approved' AS status, 'u0' AS approved_by, cast(0 AS bigint) AS approved_at, cast(0 AS bigint) AS updated_at
FROM library GROUP BY scope, match_key
"""

INPUTS["sessions"] = """
SELECT cast(o_orderkey AS string) AS session_id, 'main' AS catalog,
       concat('s', cast(o_custkey % 20 AS string)) AS schema, concat('t', cast(o_orderkey AS string)) AS table,
       CASE WHEN o_custkey % 3 = 0 THEN 'interactive' ELSE 'hands_off' END AS mode,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'ready_for_review' WHEN '2-HIGH' THEN 'awaiting_input'
            WHEN '3-MEDIUM' THEN 'failed' WHEN '5-LOW' THEN 'applied' ELSE 'reasoning' END AS status,
       CASE WHEN o_custkey % 2 = 0 THEN 'default'
            ELSE '123E4567-e89b-12d3-a456-426614174000' END AS template_id,
       concat('u', cast(o_custkey AS string)) AS created_by,
       concat('run', cast(o_custkey % 100 AS string)) AS schema_run_id,
       o_orderdate AS created_at, o_orderdate AS updated_at
FROM {orders}
"""

INPUTS["runs"] = """
SELECT concat('run', cast(c_custkey AS string)) AS id, 'main' AS catalog,
       concat('s', cast(c_nationkey AS string)) AS schema,
       CASE WHEN c_acctbal < 0 THEN 'running' ELSE 'enumerating' END AS status,
       cast(NULL AS int) AS total_tables, cast(NULL AS bigint) AS job_run_id,
       c_mktsegment AS created_by, c_custkey % 1000 AS created_at, c_custkey % 1000 AS updated_at
FROM {customer}
"""

INPUTS["questions"] = """
SELECT session_id, table_ref, concat('q', cast(ordinal AS string)) AS qid,
       CASE WHEN target <> '__table__' THEN target END AS target_name, false AS answered,
       CASE WHEN ordinal = 3 THEN 'kept as it is' END AS suggested_answer
FROM drafts WHERE status = 'needs_input'
"""

INPUTS["answers"] = """
SELECT cast(l_orderkey AS string) AS session_id,
       concat(CASE WHEN l_linestatus = 'O' THEN 'q' ELSE 'p' END, cast(l_linenumber % 7 AS string)) AS qid,
       CASE WHEN l_tax = 0 THEN ' ' ELSE concat(' part ', cast(l_partkey AS string)) END AS answer,
       l_extendedprice + l_suppkey * 1000000 AS seq
FROM {lineitem}
"""

INPUTS["column_profiles"] = """
SELECT concat('main.sales.t', cast(l_orderkey AS string)) AS table_ref,
       CASE l_linenumber WHEN 1 THEN '_id' WHEN 2 THEN 'tier' WHEN 3 THEN 'ab_' ELSE concat('col', cast(l_linenumber AS string)) END AS name,
       l_linenumber AS ordinal, 'bigint' AS data_type, 'integer' AS type_class, max(l_tax) = 0 AS nullable,
       max(l_discount) * 10 AS null_fraction, 1 - min(l_tax) AS cardinality_ratio, max(l_quantity) > 25 AS is_enum_candidate
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""

INPUTS["informs"] = """
SELECT concat('main.sales.t', cast(l_orderkey AS string)) AS table_ref,
       CASE WHEN l_returnflag <> 'A' THEN concat('other', cast(l_linenumber AS string))
            WHEN l_linenumber = 1 THEN '_id' WHEN l_linenumber = 2 THEN 'tier' WHEN l_linenumber = 3 THEN 'ab_'
            ELSE concat('col', cast(l_linenumber AS string)) END AS name
FROM {lineitem}
"""

INPUTS["declared_fks"] = """
SELECT concat('main.sales.t', cast(l_orderkey AS string)) AS table_ref,
       CASE WHEN l_shipdate >= timestamp '1997-01-01 00:00:00' THEN concat('other', cast(l_linenumber AS string))
            WHEN l_linenumber = 1 THEN '_id' WHEN l_linenumber = 2 THEN 'tier' WHEN l_linenumber = 3 THEN 'ab_'
            ELSE concat('col', cast(l_linenumber AS string)) END AS column
FROM {lineitem}
"""

# What each input reads besides the supplied tables, in the order the texts need.
NEEDS = {
    "drafts": ("table_drafts", "column_drafts"),
    "live": ("table_drafts", "column_drafts", "drafts"),
    "questions": ("table_drafts", "column_drafts", "drafts"),
    "library_keys": ("library",),
}
def ctes(names: Iterable[str], once: str = "") -> str:
    """The inputs as leading subqueries; ``once`` is what keeps an engine from running one for each use."""
    ordered: list[str] = []
    for name in names:
        ordered += [n for n in (*NEEDS.get(name, ()), name) if n not in ordered]
    return "WITH " + ",\n".join(f"{n} AS {once}({INPUTS[n].strip()})" for n in ordered) if ordered else ""


def oracle(sql: str, inputs: Iterable[str] = ()) -> str:
    """The SQL for the checking engine: supplied tables by name, inputs as leading subqueries."""
    head = ctes(inputs, once="MATERIALIZED ")
    for table in COLUMNS:
        head = head.replace("{" + table + "}", table)
    text = head.replace("AS table,", 'AS "table",').replace("AS column\n", 'AS "column"\n')
    body = sql.strip()
    if body.upper().startswith("WITH ") and text:
        body = ", " + body[5:]
    return f"{text}\n{body}" if text else body


class Tables:
    """Supplied tables and derived inputs by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self._folder = folder

    @cached_property
    def supplied(self) -> dict[str, DataFrame]:
        return {}

    def __getitem__(self, name: str) -> DataFrame:
        if name in COLUMNS:
            if name not in self.supplied:
                self.supplied[name] = self.spark.read.parquet(f"{self._folder}/{name}.parquet")
            return self.supplied[name]
        text = f"{ctes([name])}\nSELECT * FROM {name}"
        text = text.replace("AS table,", "AS `table`,").replace("AS column\n", "AS `column`\n")
        used = {t: self[t] for t in COLUMNS if "{" + t + "}" in text}
        if "GROUP BY l_orderkey" in text:  # the lines of an order meet in as many tasks as there are lines for
            used["lineitem"] = dealt(used["lineitem"], tasks_for(used["lineitem"]), "l_orderkey")
        return self.spark.sql(text, **used)


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, inputs: Iterable[str] = (), **types: str):
    """Registers a function of the tables under a name, with its SQL.

    ``types`` names result columns whose SQL type has to be stated to be that of the Spark column.
    """
    if sql and types:
        casts = ", ".join(f"cast({c} AS {kind}) AS {c}" for c, kind in types.items())
        sql = f"SELECT * REPLACE ({casts}) FROM (\n{sql}\n)"

    def add(run: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(run, oracle(sql, inputs) if sql else None)
        return run
    return add
