"""Profiles, common values and personal data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tablelore.functions.columns import null_percent, share_label, top_bars, type_class
from tablelore.functions.privacy import classes_by_name, mask, text_hits
from tablelore.functions.text import is_three_part, table_key
from tablelore.operators.profile import (
    ProfileOptions, accept_versions, column_stats, merge_batches, profile_table, profile_tables,
    scan_for_private_values, table_block, without_verbose_fields,
)
from tablelore.operators.parts import measure, merge
from tablelore.sources.sampling import Sample, apply_sample

from .tables import COLUMNS, Tables, columns_of, query

CLASS_OF = {"int": "integer", "bigint": "integer", "double": "decimal", "timestamp_ntz": "temporal",
            "string": "string", "array<float>": "complex"}
EXACT = ProfileOptions(exact=True, mask_range=False)


def shown(stats: DataFrame) -> DataFrame:
    """Statistics with decimal ranges in a form that does not depend on the engine."""
    def side(name: str):
        fixed = F.format_string("%.4f", F.col(name).try_cast("double"))
        return F.when((F.col("type_class") == "decimal") & F.col(name).isNotNull(), fixed).otherwise(F.col(name))

    return stats.select(
        "table_ref", "name", "ordinal", "data_type", "type_class", "null_fraction", "distinct_count",
        "cardinality_ratio", side("min").alias("min_text"), side("max").alias("max_text"), "is_enum_candidate")


def stats_sql(source: str, ref: str, columns: list[tuple[str, str]]) -> str:
    """The statistics one column at a time."""
    parts = []
    for i, (name, kind) in enumerate(columns, start=1):
        cls = CLASS_OF[kind]
        head = f"SELECT '{ref}' AS table_ref, '{name}' AS name, {i} AS ordinal, '{kind}' AS data_type, '{cls}' AS type_class, "
        if cls == "complex":
            parts.append(head + "cast(NULL AS double) AS null_fraction, cast(NULL AS bigint) AS distinct_count, "
                         "cast(NULL AS double) AS cardinality_ratio, cast(NULL AS varchar) AS min_text, "
                         "cast(NULL AS varchar) AS max_text, cast(NULL AS boolean) AS is_enum_candidate")
            continue
        text = {
            "integer": "cast({v} AS varchar)", "decimal": "printf('%.4f', {v})",
            "temporal": r"regexp_replace(strftime({v}, '%Y-%m-%dT%H:%M:%S.%f'), '\.000000$', '')",
            "string": "cast(NULL AS varchar)",
        }[cls]
        low, high = text.format(v=f"min({name})"), text.format(v=f"max({name})")
        parts.append(
            head + f"CASE WHEN count(*) > 0 THEN round(1 - count({name}) / count(*), 6) END AS null_fraction, "
            f"count(DISTINCT {name}) AS distinct_count, "
            f"CASE WHEN count({name}) > 0 THEN round(count(DISTINCT {name}) / count({name}), 6) END AS cardinality_ratio, "
            f"{low} AS min_text, {high} AS max_text, count(DISTINCT {name}) BETWEEN 1 AND 50 AS is_enum_candidate FROM {source}")
    return "\nUNION ALL\n".join(parts)


def values_sql(source: str, ref: str, columns: list[tuple[str, str]]) -> str:
    """Common values of the columns with at most 50 distinct ones."""
    parts = []
    for name, kind in columns:
        if CLASS_OF[kind] == "complex":
            continue
        text = (f"regexp_replace(strftime({name}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '')"
                if kind == "timestamp_ntz" else f"cast({name} AS varchar)")
        parts.append(f"SELECT '{ref}' AS table_ref, '{name}' AS name, {text} AS value, count(*) AS count "
                     f"FROM {source} WHERE {name} IS NOT NULL GROUP BY {name}")
    return "\nUNION ALL\n".join(parts)


RANKED_VALUES = """
WITH counts AS ({counts}),
small AS (SELECT table_ref, name FROM counts GROUP BY table_ref, name HAVING count(*) <= 50)
SELECT table_ref, name, rank, value, count FROM (
  SELECT *, row_number() OVER (PARTITION BY table_ref, name ORDER BY count DESC, value) AS rank
  FROM counts JOIN small USING (table_ref, name)) WHERE rank <= 20
"""


def listed_values(columns: DataFrame) -> DataFrame:
    return columns.filter(F.col("top_k").isNotNull()).select(
        "table_ref", "name", F.posexplode("top_k").alias("at", "item")).select(
        "table_ref", "name", (F.col("at") + 1).alias("rank"), F.col("item.value").alias("value"),
        F.col("item.count").alias("count"))


@query("profile_lineitem", stats_sql("lineitem", "samples.tpch.lineitem", columns_of("lineitem")))
def profile_lineitem(t: Tables) -> DataFrame:
    return shown(column_stats(t["lineitem"], "samples.tpch.lineitem", EXACT))


def beside_exact(found: DataFrame, t: Tables) -> DataFrame:
    """Statistics of lineitem with the exact distinct counts beside them, as ``exact``."""
    exact = column_stats(t["lineitem"], "samples.tpch.lineitem", EXACT).select("name", F.col("distinct_count").alias("exact"))
    return found.join(exact, "name")


LINEITEM_SQL = stats_sql("lineitem", "samples.tpch.lineitem", columns_of("lineitem"))


@query("profile_lineitem_approximate", f"""SELECT name, data_type, null_fraction, min_text, max_text, true AS is_close
FROM ({LINEITEM_SQL})""")
def profile_lineitem_approximate(t: Tables) -> DataFrame:
    """Estimates differ by at most a fifth, four deviations of the sketch."""
    stats = beside_exact(shown(column_stats(t["lineitem"], "samples.tpch.lineitem")), t)
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= 0.2 * F.col("exact")
    return stats.select("name", "data_type", "null_fraction", "min_text", "max_text", near.alias("is_close"))


@query("profile_from_parts", f"""SELECT name, data_type, null_fraction, min_text, max_text, is_enum_candidate, true AS is_close,
(SELECT count(*) FROM lineitem) AS total FROM ({LINEITEM_SQL})""")
def profile_from_parts(t: Tables) -> DataFrame:
    """Measured per return flag and merged: all but the distinct counts is exact, those are within six deviations of a sketch."""
    stats = merge(measure(t["lineitem"], "samples.tpch.lineitem", "l_returnflag"))
    exact = column_stats(t["lineitem"], "samples.tpch.lineitem", EXACT).select("name", F.col("distinct_count").alias("exact"))
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= 0.1 * F.col("exact")
    return shown(stats).join(stats.select("name", "total"), "name").join(exact, "name").select(
        "name", "data_type", "null_fraction", "min_text", "max_text", "is_enum_candidate", near.alias("is_close"), "total")


@query("enum_values_from_parts", RANKED_VALUES.format(
    counts=values_sql("orders", "samples.tpch.orders", columns_of("orders"))), rank="int")
def enum_values_from_parts(t: Tables) -> DataFrame:
    return listed_values(merge(measure(t["orders"], "samples.tpch.orders", "o_orderpriority")))


@query("profile_every_table", "\nUNION ALL\n".join(
    stats_sql(name, f"samples.shop.{name}", columns_of(name)) for name in COLUMNS))
def profile_every_table(t: Tables) -> DataFrame:
    return shown(reduce(DataFrame.unionByName, [
        column_stats(t[name], f"samples.shop.{name}", EXACT) for name in COLUMNS]))


@query("profile_column_subset", "SELECT * FROM (" + stats_sql(
    "orders", "samples.tpch.orders", columns_of("orders")) + ") WHERE name IN ('o_orderstatus', 'o_orderdate')")
def profile_column_subset(t: Tables) -> DataFrame:
    return shown(column_stats(t["orders"], "samples.tpch.orders", EXACT, ["o_orderstatus", "o_orderdate"]))


HALF_EMPTY = """
SELECT l_orderkey, nullif(l_returnflag, 'N') AS flag, nullif(l_returnflag, l_returnflag) AS nothing,
       CASE WHEN l_linenumber < 3 THEN l_shipdate END AS shipped, CASE WHEN l_tax > 0.02 THEN l_tax END AS tax
FROM {lineitem}
"""


@query("profile_null_heavy", "WITH half_empty AS (" + HALF_EMPTY.format(lineitem="lineitem") + ")\n" + stats_sql(
    "half_empty", "samples.tpch.half_empty",
    [("l_orderkey", "bigint"), ("flag", "string"), ("nothing", "string"), ("shipped", "timestamp_ntz"), ("tax", "double")]))
def profile_null_heavy(t: Tables) -> DataFrame:
    view = t.spark.sql(HALF_EMPTY, lineitem=t["lineitem"])
    return shown(column_stats(view, "samples.tpch.half_empty", EXACT))


WIDE = [(f"{name}_{i}", kind) for i in range(6) for name, kind in columns_of("lineitem")]


@query("profile_wide_in_batches", "WITH wide AS (SELECT " + ", ".join(
    f"{n} AS {n}_{i}" for i in range(6) for n, _ in columns_of("lineitem")) + " FROM lineitem)\n" + stats_sql(
    "wide", "samples.tpch.wide", WIDE))
def profile_wide_in_batches(t: Tables) -> DataFrame:
    wide = t["lineitem"].select(*[F.col(n).alias(f"{n}_{i}") for i in range(6) for n, _ in columns_of("lineitem")])
    return shown(column_stats(wide, "samples.tpch.wide", ProfileOptions(exact=True, batch_size=25)))


@query("enum_values_lineitem", RANKED_VALUES.format(
    counts=values_sql("lineitem", "samples.tpch.lineitem", columns_of("lineitem"))), rank="int")
def enum_values_lineitem(t: Tables) -> DataFrame:
    return listed_values(profile_table(t["lineitem"], "samples.tpch.lineitem", EXACT).columns)


@query("enum_values_every_table", RANKED_VALUES.format(counts="\nUNION ALL\n".join(
    values_sql(name, f"samples.shop.{name}", columns_of(name)) for name in COLUMNS)), rank="int")
def enum_values_every_table(t: Tables) -> DataFrame:
    loaders = {f"samples.shop.{name}": (lambda name=name: t[name]) for name in COLUMNS}
    return listed_values(profile_tables(t.spark, loaders, options=EXACT).columns)


@query("table_profiles", "\nUNION ALL\n".join(
    f"SELECT 'samples.shop.{name}' AS table_ref, count(*) AS row_count, {len(columns_of(name))} AS column_count, "
    f"CASE WHEN count(*) = 0 THEN 'empty' ELSE '' END AS warning FROM {name}" for name in COLUMNS)
    + "\nUNION ALL SELECT 'samples.shop.no_orders', count(*), 6, "
      "CASE WHEN count(*) = 0 THEN 'empty' ELSE '' END FROM orders WHERE o_totalprice < 0")
def table_profiles(t: Tables) -> DataFrame:
    frames = {name: t[name] for name in COLUMNS} | {"no_orders": t["orders"].filter("o_totalprice < 0")}
    blocks = [table_block(df, f"samples.shop.{name}", False, len(df.columns)) for name, df in frames.items()]
    first = F.coalesce(F.get("warnings", F.lit(0)), F.lit(""))
    return reduce(DataFrame.unionByName, blocks).select(
        "table_ref", "row_count", "column_count", F.when(first.contains("empty"), "empty").otherwise("").alias("warning"))


@query("merged_batches", """
SELECT 'samples.tpch.orders' AS table_ref, name, batch, 3 AS column_count, 2 AS warning_count FROM (
  SELECT 'o_orderkey' AS name, 0 AS batch UNION ALL SELECT 'o_custkey', 0 UNION ALL SELECT 'o_totalprice', 1)
WHERE (SELECT count(*) FROM orders) > 0""")
def merged_batches(t: Tables) -> DataFrame:
    def batch(number: int, names: list[str]):
        stats = column_stats(t["orders"], "samples.tpch.orders", columns=names)
        block = table_block(t["orders"], "samples.tpch.orders", number == 1, 0)
        return stats.withColumn("batch", F.lit(number)).withColumn("from_batch", F.lit(number)), block.withColumn("batch", F.lit(number))

    (c0, t0), (c1, t1) = batch(0, ["o_orderkey", "o_custkey"]), batch(1, ["o_custkey", "o_totalprice"])
    columns, tables = merge_batches(c0.unionByName(c1), t0.unionByName(t1))
    return columns.join(tables.select("table_ref", "column_count", F.size("warnings").alias("warning_count")), "table_ref").select(
        "table_ref", "name", F.col("from_batch").alias("batch"), "column_count", "warning_count")


# Declared type names as catalogs write them.
DECLARED = ("bigint", "int", "decimal(12,2)", "varchar(20)", "timestamp", "interval", "interval day to second",
            "timestamp_ltz", "array<int>", "struct<a:int>", "map<string,int>", "binary", "boolean", "variant", " DATE ", "real")


@query("type_classes", """
WITH declared AS (
  SELECT p_partkey, CASE p_size % 17 """ + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DECLARED)) + """ END AS data_type FROM part),
based AS (SELECT *, trim(regexp_extract(lower(trim(data_type)), '^[^(<]*')) AS base FROM declared)
SELECT p_partkey, data_type, CASE
  WHEN base IN ('int','integer','bigint','smallint','tinyint','long','byte','short') THEN 'integer'
  WHEN base IN ('double','float','real','decimal','numeric') THEN 'decimal'
  WHEN base IN ('date','timestamp','timestamp_ntz','interval') THEN 'temporal'
  WHEN base = 'boolean' THEN 'boolean' WHEN base = 'binary' THEN 'binary'
  WHEN base IN ('struct','array','map') THEN 'complex' ELSE 'string' END AS type_class FROM based""")
def type_classes(t: Tables) -> DataFrame:
    name = F.get(F.array(*[F.lit(d) for d in DECLARED]), F.col("p_size") % 17)
    return t["part"].select("p_partkey", name.alias("data_type")).withColumn("type_class", type_class(F.col("data_type")))


@query("profile_display", """
WITH stats AS (""" + stats_sql("lineitem", "samples.tpch.lineitem", columns_of("lineitem")) + """),
counts AS (""" + values_sql("lineitem", "samples.tpch.lineitem", columns_of("lineitem")) + """),
bars AS (
  SELECT name, value, count, row_number() OVER (PARTITION BY name ORDER BY count DESC, value) AS rank FROM counts
  WHERE name IN (SELECT name FROM stats WHERE is_enum_candidate)),
top AS (SELECT name, max(count) AS tallest FROM bars GROUP BY name)
SELECT s.name, cast(round(null_fraction * 100) AS int) AS null_percent,
  CASE WHEN cardinality_ratio < 0.1 THEN printf('%.1f', cardinality_ratio * 100 + CASE WHEN cardinality_ratio * 100 % 1 IN (0.25, 0.75) THEN 1e-9 ELSE 0 END)
    ELSE printf('%.0f', cardinality_ratio * 100 + CASE WHEN cardinality_ratio * 100 % 1 = 0.5 THEN 1e-9 ELSE 0 END) END || '% unique' AS unique_label,
  b.rank AS bar, b.value AS label, CASE WHEN b.rank IS NOT NULL THEN round(greatest(2.0, b.count / t.tallest * 100), 6) END AS width
FROM stats s LEFT JOIN bars b ON s.name = b.name AND b.rank <= 6 LEFT JOIN top t ON t.name = s.name""", bar="int")
def profile_display(t: Tables) -> DataFrame:
    columns = profile_table(t["lineitem"], "samples.tpch.lineitem", EXACT).columns
    bars = columns.select(
        "name", null_percent(F.col("null_fraction")).alias("null_percent"),
        share_label(F.col("cardinality_ratio")).alias("unique_label"), F.posexplode_outer(top_bars(F.col("top_k"))).alias("at", "b"))
    return bars.select("name", "null_percent", "unique_label", (F.col("at") + 1).alias("bar"),
                       F.col("b.label").alias("label"), F.round("b.width", 6).alias("width"))


@query("prompt_profile_fields", "SELECT name, ordinal FROM (" + stats_sql(
    "customer", "samples.tpch.customer", columns_of("customer")) + ")")
def prompt_profile_fields(t: Tables) -> DataFrame:
    return without_verbose_fields(profile_table(t["customer"], "samples.tpch.customer", EXACT).columns).select("name", "ordinal")


@query("row_sample", "SELECT least(500, count(*)) AS kept, least(500, count(*)) AS known, least(500, count(*)) AS different FROM orders")
def row_sample(t: Tables) -> DataFrame:
    """How many rows a sample of 500 has, how many of them are rows of the table, and how many differ."""
    kept = apply_sample(t["orders"], Sample("rows", 500)).withColumn("_kept", F.lit(1))
    known = kept.join(t["orders"], t["orders"].columns, "left_semi")
    counted = kept.agg(F.count(F.lit(1)).alias("kept"), F.count_distinct("o_orderkey").alias("different"))
    return counted.withColumn("one", F.lit(1)).join(
        known.agg(F.count(F.lit(1)).alias("known"), F.lit(1).alias("one")), "one").select("kept", "known", "different")


@query("row_sample_shares", """SELECT l_returnflag, l_linenumber, count(*) AS total, true AS is_fair FROM lineitem GROUP BY l_returnflag, l_linenumber""")
def row_sample_shares(t: Tables) -> DataFrame:
    """Whether 3000 rows drawn hold each flag and line number by its share, within five deviations."""
    keys = ["l_returnflag", "l_linenumber"]
    kept = apply_sample(t["lineitem"], Sample("rows", 3000)).groupBy(*keys).agg(F.count(F.lit(1)).alias("kept"))
    total = t["lineitem"].groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    every = total.groupBy().agg(F.sum("total").alias("every"), F.lit(1).alias("one"))
    share = F.col("total") / F.col("every")
    near = F.abs(F.coalesce("kept", F.lit(0)) - 3000 * share) <= 5 * F.sqrt(3000 * share * (1 - share)) + 1
    return total.join(kept, keys, "left").withColumn("one", F.lit(1)).join(every, "one").select(*keys, "total", near.alias("is_fair"))


@query("percent_sample", """SELECT l_returnflag, count(*) AS total, true AS about_a_tenth FROM lineitem GROUP BY l_returnflag""")
def percent_sample(t: Tables) -> DataFrame:
    """Whether a tenth of the rows of each flag is kept, within five deviations."""
    kept = apply_sample(t["lineitem"], Sample("percent", 10)).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("kept"))
    total = t["lineitem"].groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("total"))
    near = F.abs(F.col("kept") - 0.1 * F.col("total")) <= 5 * F.sqrt(0.09 * F.col("total"))
    return total.join(kept, "l_returnflag").select("l_returnflag", "total", near.alias("about_a_tenth"))


@query("profile_of_sample", f"SELECT name, type_class, true AS is_subset, true AS is_estimate FROM ({LINEITEM_SQL})")
def profile_of_sample(t: Tables) -> DataFrame:
    """A sample's profile never has more distinct values than the table, and says that it is an estimate."""
    made = profile_table(t["lineitem"], "samples.tpch.lineitem", EXACT, sample=Sample("percent", 20))
    columns = beside_exact(made.columns.select("table_ref", "name", "type_class", "distinct_count"), t)
    return columns.join(made.tables, "table_ref").select(
        "name", "type_class", (F.col("distinct_count") <= F.col("exact")).alias("is_subset"),
        (F.col("row_count_is_estimate") & F.col("sampled")).alias("is_estimate"))


@query("profile_versions", """
WITH stored AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '1.0' WHEN 1 THEN '1.7' WHEN 2 THEN '2.0' WHEN 3 THEN '0.9'
                WHEN 4 THEN 'x' END AS profile_version FROM events)
SELECT concat('t', event_id) AS table_ref, CASE WHEN profile_version IS NULL THEN 'missing version'
  WHEN profile_version IN ('1.0', '1.7') THEN 'accepted' ELSE 'other major version' END AS verdict FROM stored""")
def profile_versions(t: Tables) -> DataFrame:
    version = F.get(F.array(*[F.lit(v) for v in ("1.0", "1.7", "2.0", "0.9", "x")]), F.col("event_id") % 6)
    stored = t["events"].select(F.concat(F.lit("t"), "event_id").alias("table_ref"), version.alias("profile_version"))
    good, bad = accept_versions(stored)
    return good.select("table_ref", F.lit("accepted").alias("verdict")).unionByName(
        bad.select("table_ref", F.col("message").alias("verdict")))


NAMES = ("e_mail", "Email2", "user_ssn", "classname", "social_security_no", "home_phone", "mobileNo", "credit_card",
         "cc_num", "ip", "ip_addr", "ip_address", "iphone", "zip", "card_number_email", "o_orderkey")
NAME_CASES = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES))


@query("personal_names", f"""
WITH named AS (SELECT c_custkey, CASE c_custkey % 16 {NAME_CASES} END AS name FROM customer)
SELECT c_custkey, name, concat_ws(',',
  CASE WHEN regexp_matches(name, 'credit_?card|card_number|ccnum|cc_num', 'i') THEN 'credit_card' END,
  CASE WHEN regexp_matches(name, 'e[-_]?mail', 'i') THEN 'email' END,
  CASE WHEN regexp_matches(name, '^ip(_?addr(ess)?)?$', 'i') THEN 'ip' END,
  CASE WHEN regexp_matches(name, 'phone|mobile|msisdn', 'i') THEN 'phone' END,
  CASE WHEN regexp_matches(name, 'ssn|social_security', 'i') THEN 'ssn' END) AS classes FROM named""")
def personal_names(t: Tables) -> DataFrame:
    named = t["customer"].select("c_custkey", F.get(F.array(*[F.lit(n) for n in NAMES]), F.col("c_custkey") % 16).alias("name"))
    return named.select("c_custkey", "name", F.array_join(classes_by_name(F.col("name")), ",").alias("classes"))


CONTACTS = """
SELECT concat(lpad(cast(c_nationkey AS string), 3, '0'), '-12-', lpad(cast(c_nationkey * 7 AS string), 4, '0')) AS number,
       concat(c_mktsegment, '@example.org') AS contact, c_mktsegment AS segment,
       concat('41000000000', lpad(cast(c_nationkey AS string), 4, '0')) AS account, c_nationkey AS home_phone,
       CASE WHEN c_nationkey < 9 THEN cast(c_nationkey AS string) END AS short
FROM {customer}
"""
CONTACT_COLUMNS = [("number", "string"), ("contact", "string"), ("segment", "string"), ("account", "string"),
                   ("home_phone", "int"), ("short", "string")]


@query("personal_values", "WITH contacts AS (" + CONTACTS.format(customer="customer") + "),\ncounts AS (" + values_sql(
    "contacts", "samples.crm.contacts", CONTACT_COLUMNS) + """),
ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY count DESC, value) AS rank FROM counts),
flags AS (SELECT name, CASE WHEN name = 'home_phone' THEN 'phone'
            WHEN bool_or(regexp_matches(value, '^[0-9]{3}-[0-9]{2}-[0-9]{4}$')) THEN 'ssn'
            WHEN bool_or(regexp_matches(value, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) THEN 'email'
            WHEN bool_or(regexp_matches(value, '^[0-9]{13,16}$')) THEN 'credit_card' ELSE '' END AS classes
          FROM ranked WHERE rank <= 20 GROUP BY name)
SELECT name, classes, CASE WHEN classes = '' THEN 'none' ELSE 'masked' END AS action, rank,
  CASE WHEN classes = '' THEN value WHEN length(value) <= 2 THEN '••'
       ELSE concat(left(value, 2), repeat('•', greatest(2, length(value) - 2))) END AS value, count
FROM ranked JOIN flags USING (name) WHERE rank <= 20""", rank="int")
def personal_values(t: Tables) -> DataFrame:
    view = t.spark.sql(CONTACTS, customer=t["customer"])
    columns = profile_table(view, "samples.crm.contacts", EXACT).columns
    return columns.select(
        "name", F.array_join("pii.classes", ",").alias("classes"), F.col("pii.action").alias("action"),
        F.posexplode("top_k").alias("at", "v")).select(
        "name", "classes", "action", (F.col("at") + 1).alias("rank"), F.col("v.value").alias("value"), F.col("v.count").alias("count"))


@query("masked_values", """
SELECT c_custkey, CASE WHEN length(c_name) <= 2 THEN '••' ELSE concat(left(c_name, 2), repeat('•', greatest(2, length(c_name) - 2))) END AS name_shown,
  CASE WHEN length(cast(c_nationkey AS varchar)) <= 2 THEN '••' ELSE '' END AS nation_shown FROM customer""")
def masked_values(t: Tables) -> DataFrame:
    return t["customer"].select("c_custkey", mask(F.col("c_name")).alias("name_shown"), mask(F.col("c_nationkey")).alias("nation_shown"))


@query("personal_data_in_documents", r"""
SELECT doc_id, len(regexp_extract_all(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b')) AS ssn,
  len(regexp_extract_all(text, '[^@\s]+@[^@\s]+\.[^@\s]+')) AS email,
  len(regexp_extract_all(text, '\b[0-9]{13,16}\b')) AS credit_card FROM documents""")
def personal_data_in_documents(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", *[hit.cast("long").alias(c) for c, hit in text_hits(F.col("text")).items()])


PRIVATE_COLUMNS = ("number", "contact", "segment", "account", "short")


@query("personal_data_in_columns", "WITH contacts AS (" + CONTACTS.format(customer="customer") + ")\n" + "\nUNION ALL\n".join(
    f"""SELECT 'samples.crm.contacts' AS table_ref, '{c}' AS name,
    count(*) FILTER (WHERE regexp_matches({c}, '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$')) AS ssn_values,
    count(*) FILTER (WHERE regexp_matches({c}, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) AS email_values,
    count(*) FILTER (WHERE regexp_matches({c}, '^[0-9]{{13,16}}$')) AS credit_card_values FROM contacts""" for c in PRIVATE_COLUMNS))
def personal_data_in_columns(t: Tables) -> DataFrame:
    return scan_for_private_values(t.spark.sql(CONTACTS, customer=t["customer"]), "samples.crm.contacts")


@query("table_names", """
WITH refs AS (SELECT l_orderkey, l_linenumber, concat(' `main` . ', CASE WHEN l_linenumber = 3 THEN '' ELSE concat('s', l_suppkey) END,
              '.`t', l_partkey, '`', CASE WHEN l_linenumber = 5 THEN '.x' ELSE '' END) AS ref FROM lineitem)
SELECT l_orderkey, ref, array_to_string(list_transform(string_split(ref, '.'), lambda p: trim(trim(p), '`')), '.') AS table_key,
  l_linenumber NOT IN (3, 5) AS valid FROM refs""")
def table_names(t: Tables) -> DataFrame:
    ref = F.concat(F.lit(" `main` . "), F.when(F.col("l_linenumber") == 3, "").otherwise(F.concat(F.lit("s"), "l_suppkey")),
                   F.lit(".`t"), F.col("l_partkey"), F.lit("`"), F.when(F.col("l_linenumber") == 5, ".x").otherwise(""))
    return t["lineitem"].select("l_orderkey", ref.alias("ref")).select(
        "l_orderkey", "ref", table_key(F.col("ref")).alias("table_key"), is_three_part(F.col("ref")).alias("valid"))
