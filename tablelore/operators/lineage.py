"""Upstream and downstream tables and column derivations, as context snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import spread, tasks_for
from .skew import slice_of, top_per_key

SOURCE = "uc_lineage"
# Relevance of each kind of lineage snippet, and how many names one lists.
UPSTREAM_RELEVANCE, DOWNSTREAM_RELEVANCE, COLUMN_RELEVANCE = 0.7, 0.55, 0.8
NAMES_LISTED = 10
# Fixed value: up to so many wanted tables Spark may choose to send all of them to every task.
TARGETS_SENT_WHOLE = 100_000
# Columns of an edge: the table itself, the one it is linked with.
UPSTREAM = ("target_table_full_name", "source_table_full_name")
DOWNSTREAM = ("source_table_full_name", "target_table_full_name")
_SLICE = "_slice"


def _pairs(edges: DataFrame, own: str, other: str, tasks: int) -> DataFrame:
    """Distinct (table_ref, linked) pairs, those of one table in slices of their own."""
    pairs = edges.select(F.col(own).alias("table_ref"), F.col(other).alias("linked")).filter(
        F.col("table_ref").isNotNull() & F.col("linked").isNotNull())
    sliced = pairs.withColumn(_SLICE, slice_of(["linked"], spread(edges.sparkSession)))
    return sliced.repartition(tasks, "table_ref", _SLICE).distinct()


def _of_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of the wanted tables. Where these are many, they are hashed, so that the rows need no sorting."""
    wanted = targets.select("table_ref").distinct()
    many = targets.count() > TARGETS_SENT_WHOLE
    return rows.join(wanted.hint("shuffle_hash") if many else wanted, "table_ref", "left_semi")


def _linked(edges: DataFrame, targets: DataFrame, own: str, other: str) -> DataFrame:
    return _of_targets(_pairs(edges, own, other, tasks_for(edges)).drop(_SLICE), targets)


def upstream(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (table_ref, linked) pairs: the tables each target reads from."""
    return _linked(edges, targets, *UPSTREAM)


def downstream(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (table_ref, linked) pairs: the tables that read from each target."""
    return _linked(edges, targets, *DOWNSTREAM)


def column_sources(column_edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Source columns that feed the columns of each target."""
    found = column_edges.filter(F.col("source_column_name").isNotNull()).withColumnRenamed("target_table_full_name", "table_ref")
    return _of_targets(found, targets).select("table_ref", "source_table_full_name", "source_column_name", "target_column_name")


def _listed(pairs: DataFrame, targets: DataFrame, tasks: int, title: str, relevance: float, seq: int, names_listed: int) -> DataFrame:
    """One snippet per table with its first names in alphabetical order.

    Slices are cut down first, so that few rows of a table meet, however many it is linked with.
    """
    within = Window.partitionBy("table_ref", _SLICE).orderBy("linked")
    near = pairs.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= names_listed).drop("rank", _SLICE)
    links = _of_targets(near.repartition(tasks, "table_ref"), targets)
    first = top_per_key(links, ["table_ref"], [F.col("linked")], names_listed, ["linked"], sliced=False)
    names = F.array_join(F.array_sort(F.collect_list("linked")), ", ")
    text = F.concat(F.lit(f"{title} (lineage): "), F.col("names"), F.lit("."))
    return first.groupBy("table_ref").agg(names.alias("names")).select(
        "table_ref", *snippet_fields(text, SOURCE, relevance, seq))


def snippet_fields(text: Column, source: str | Column, relevance: float | Column, seq: int | Column,
                   informs: Column | None = None) -> list[Column]:
    def column(value):
        return value if isinstance(value, Column) else F.lit(value)

    known = F.array().cast("array<string>") if informs is None else informs
    return [
        text.alias("text"), column(source).alias("source"), known.alias("informs"),
        column(relevance).cast("double").alias("relevance"), column(seq).cast("int").alias("seq"),
    ]


def lineage_snippets(edges: DataFrame, column_edges: DataFrame, targets: DataFrame,
                     names_listed: int = NAMES_LISTED) -> DataFrame:
    tasks = tasks_for(edges)
    ups = _listed(_pairs(edges, *UPSTREAM, tasks), targets, tasks, "Upstream sources", UPSTREAM_RELEVANCE, 0, names_listed)
    downs = _listed(_pairs(edges, *DOWNSTREAM, tasks), targets, tasks, "Downstream consumers", DOWNSTREAM_RELEVANCE, 1, names_listed)
    filled = F.coalesce(F.col("target_column_name"), F.lit("")) != ""
    for name in ("source_table_full_name", "source_column_name"):
        filled = filled & (F.coalesce(F.col(name), F.lit("")) != "")
    text = F.format_string(
        "Column `%s` derives from `%s`.`%s` (column lineage → FK/derivation hint).",
        "target_column_name", "source_table_full_name", "source_column_name")
    columns = column_sources(column_edges, targets).filter(filled).select(
        "table_ref",
        *snippet_fields(text, SOURCE, COLUMN_RELEVANCE, 2, F.array("target_column_name")))
    return ups.unionByName(downs).unionByName(columns)
