"""Profiles by parts: each partition of a table is measured once, and the profile of the table is merged from them.

A part is a value of one column of the table, best a partition column, so that measuring new parts reads no others. Per
part and column the statistics are kept in a form that merges: counts, smallest and largest value, a sketch of the
distinct values (HyperLogLog) and one of the common values. Counts, ranges and the values of enumerations merge
exactly; the number of distinct values is within about 2 % (one deviation, ``LG_K``) however many parts are merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import RANGED_CLASSES, STRUCTURE_ONLY_CLASSES, countable, literal, ordered, quoted, type_class_of, value_text
from ..schemas import COLUMN_STATS, PROFILE_VERSION, TABLE_PROFILE, TOP_VALUES
from ..sources.versions import Versions, key_of
from .profile import Profile, ProfileOptions, counted_values, most_common, table_warnings, with_privacy

#: Logarithm of the sketch's size: 4096 registers, a relative deviation of 1.6 %.
LG_K = 12
PART = "parts"
_SKETCHED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType)


def measure(df: DataFrame, ref: str, by: str, options: ProfileOptions = ProfileOptions(), parts: Sequence[str] | None = None) -> DataFrame:
    """One row per part and column, in one pass; ``parts`` are the values of ``by``, as text, to read.

    ``by`` itself is described too. Rows where it is null are the part without a name.
    """
    name, kind = quoted(by), df.schema[by].dataType
    if parts is not None:
        df = df.filter(_among(name, kind, parts))
    aggregates, rows = ["count(1) AS total"], []
    for i, field in enumerate(df.schema.fields, start=1):
        cls, source = type_class_of(field.dataType), quoted(field.name)
        said = {"present": "cast(NULL AS bigint)", "low": "cast(NULL AS string)", "high": "cast(NULL AS string)",
                "distinct": "cast(NULL AS binary)", "listed": f"cast(NULL AS {_LISTED})"}
        if cls not in STRUCTURE_ONLY_CLASSES:
            compared, own = countable(source, field.dataType)
            sketched = compared if isinstance(field.dataType, _SKETCHED) and own != "string" else f"cast({compared} AS string)"
            value, text, most = counted_values(source, field.dataType, options)
            aggregates += [f"count({source}) AS n_{i}", f"hll_sketch_agg({sketched}, {LG_K}) AS d_{i}",
                           f"approx_top_k({value}, {most}, {most}) AS t_{i}"]
            said |= {"present": f"n_{i}", "distinct": f"d_{i}",
                     "listed": f"transform(t_{i}, x -> struct({text} AS value, x.count AS count))"}
            if cls in RANGED_CLASSES and ordered(field.dataType):
                aggregates += [f"min({source}) AS lo_{i}", f"max({source}) AS hi_{i}"]
                said |= {"low": value_text(f"lo_{i}", field.dataType), "high": value_text(f"hi_{i}", field.dataType)}
        comment = (field.metadata or {}).get("comment")
        declared = {"name": literal(field.name), "ordinal": str(i), "data_type": literal(field.dataType.simpleString()),
                    "type_class": literal(cls), "nullable": str(field.nullable).lower(),
                    "existing_comment": "cast(NULL AS string)" if comment is None else literal(comment)}
        rows.append("struct(" + ", ".join(f"{v} AS {k}" for k, v in {**declared, **said}.items()) + ")")
    grouped = df.groupBy(F.expr(f"cast({name} AS string)").alias("part")).agg(*(F.expr(a) for a in aggregates))
    return grouped.selectExpr(f"{literal(ref)} AS table_ref", "part", "total", f"inline(array({', '.join(rows)}))")


_LISTED = "array<struct<value:string,count:bigint>>"


def _among(name: str, kind: T.DataType, parts: Sequence[str | None]) -> str:
    """SQL that names the parts as values of their own type, so that the filter reaches the partitions."""
    named = ", ".join(f"cast({literal(p)} AS {kind.simpleString()})" for p in parts if p is not None)
    told = [f"{name} IN ({named})"] if named else []
    return " OR ".join(told + [f"{name} IS NULL"] * (None in parts)) or "false"


def merge(parts: DataFrame, options: ProfileOptions = ProfileOptions()) -> DataFrame:
    """Statistics per table and column, with ``total`` and ``top_k``, from all parts of some tables.

    Columns are matched by name; what is said about one (type, place, comment) is said by the part with the largest
    name. A column that some parts lack counts as null there. Ranges are compared as values of the column's type; a
    column whose type differs between parts has the range of those that agree with the last one.
    """
    last = F.max(F.struct(F.coalesce("part", F.lit("")).alias("latest"), "ordinal", "data_type", "type_class", "nullable", "existing_comment")).alias("x")
    size = parts.select("table_ref", "part", "total").distinct().groupBy("table_ref").agg(F.sum("total").alias("total"))
    told = parts.groupBy("table_ref", "name").agg(last).select("table_ref", "name", "x.*").drop("latest")
    kinds = [r[0] for r in parts.filter(F.col("type_class").isin(*RANGED_CLASSES) & F.col("low").isNotNull()).select("data_type").distinct().collect()]
    typed = []
    for side, pick in (("low", "min"), ("high", "max")):
        for n, kind in enumerate(sorted(kinds)):
            typed.append(F.expr(f"{pick}(CASE WHEN p.data_type = {literal(kind)} THEN cast({side} AS {kind}) END)").alias(f"{side}_{n}"))
    both = parts.alias("p").join(told.select("table_ref", "name", F.col("data_type").alias("shown")), ["table_ref", "name"])
    described = ~F.col("p.type_class").isin(*STRUCTURE_ONLY_CLASSES)
    merged = both.filter(described).groupBy("table_ref", "name").agg(
        F.sum("present").alias("present"), F.expr("hll_sketch_estimate(hll_union_agg(distinct, true))").alias("found"), *typed)
    values = both.filter(described).select("table_ref", "name", F.inline("listed")).filter("value IS NOT NULL").groupBy(
        "table_ref", "name", "value").agg(F.sum("count").alias("count"))
    # A column that is no enumeration is not listed at all: what its parts counted is cut off there.
    small = values.groupBy("table_ref", "name").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") <= 2 * options.max_cardinality + 2)
    listed = values.join(small, ["table_ref", "name"], "left_semi").groupBy("table_ref", "name").agg(
        F.collect_list(F.struct("value", "count")).alias("listed"))
    rows = told.join(size, "table_ref").join(merged, ["table_ref", "name"], "left").join(listed, ["table_ref", "name"], "left")

    def shown(side: str) -> str:
        texts = [f"WHEN data_type = {literal(kind)} THEN {value_text(f'{side}_{n}', T.DataType.fromDDL(kind))}" for n, kind in enumerate(sorted(kinds))]
        return f"CASE {' '.join(texts)} END" if texts else "cast(NULL AS string)"

    described = f"type_class NOT IN ({', '.join(map(literal, STRUCTURE_ONLY_CLASSES))})"
    few = f"{described} AND found > 0 AND found <= {options.max_cardinality}"
    return rows.selectExpr(
        *[f.name for f in COLUMN_STATS.fields[:7]],
        f"CASE WHEN {described} AND total > 0 THEN round(1 - present / total, 6) END AS null_fraction",
        f"CASE WHEN {described} THEN found END AS distinct_count", f"CASE WHEN {described} THEN true END AS distinct_is_approx",
        "CASE WHEN present > 0 THEN round(found / present, 6) END AS cardinality_ratio",
        f"{shown('low')} AS min", f"{shown('high')} AS max", f"CASE WHEN {described} THEN coalesce({few}, false) END AS is_enum_candidate", "total",
        f"CASE WHEN {few} AND {options.top_k} > 0 THEN {most_common('listed', max(options.top_k, 1))} END AS top_k")


class PartProfiles:
    """The measured parts of tables, in a store that changes as a whole."""

    def __init__(self, spark: SparkSession, folder: str, options: ProfileOptions = ProfileOptions()):
        self.spark, self.options, self.versions = spark, options, Versions(spark, folder)

    def parts(self, ref: str) -> DataFrame | None:
        """What is stored of one table."""
        key = self.spark.range(1).select(key_of(F.lit(ref))).first()[0]
        return self.versions.read(PART, keys=[key])

    def refresh(self, df: DataFrame, ref: str, by: str, again: Sequence[str | None] = ()) -> list[str | None]:
        """Measures the parts that are not stored yet, and those to be measured ``again``; drops those that are gone.

        The values of ``by`` pass through the driver, as its partitions do when Spark plans a scan. Parts that stay are
        not read; their stored rows are.
        """
        there = [r[0] for r in df.select(F.col(quoted(by)).cast("string")).distinct().collect()]
        base = self.versions.snapshot()
        key = self.spark.range(1).select(key_of(F.lit(ref))).first()[0]
        stored = self.versions.read(PART, snapshot=base, keys=[key])
        known = [] if stored is None else [r[0] for r in stored.select("part").distinct().collect()]
        todo = [p for p in there if p not in known or p in again]
        if not todo and set(there) == set(known):
            return []
        rows = measure(df, ref, by, self.options, todo)
        if stored is not None:
            stay = [p for p in there if p in known and p not in todo]
            rows = stored.filter(_among("part", T.StringType(), stay)).unionByName(rows)
        self.versions.commit(base, {PART: self.versions.write(PART, rows, "table_ref") or {key: None}})
        return todo

    def profile(self, ref: str) -> Profile:
        """The profile of the whole table, merged from its stored parts; no row of the table is read."""
        stored = self.parts(ref)
        if stored is None:
            raise ValueError(f"no part of {ref} was measured")
        stats = merge(stored, self.options)
        columns = with_privacy(stats.withColumn("top_k", F.col("top_k").cast(TOP_VALUES)), self.options.mask_range)
        each = stored.groupBy("part").agg(F.max("total").alias("total"), F.collect_set("name").alias("names"))
        row = each.agg(F.sum("total").alias("row_count"),
                       F.size(F.array_distinct(F.flatten(F.collect_set("names")))).alias("column_count"))
        block = row.select(
            F.lit(ref).alias("table_ref"), "row_count", F.lit(False).alias("row_count_is_estimate"), F.lit(False).alias("sampled"),
            "column_count", F.array().cast("array<string>").alias("partition_columns"), F.lit(None).cast("string").alias("existing_comment"),
            F.lit("computed").alias("stats_source"), F.current_timestamp().alias("profiled_at"),
            table_warnings(F.col("row_count"), F.col("column_count"), F.lit(False)).alias("warnings"),
            F.lit(PROFILE_VERSION).alias("profile_version"))
        return Profile(block.select(*[f.name for f in TABLE_PROFILE.fields]), columns)
