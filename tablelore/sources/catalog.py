"""Tables, columns and declared keys as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import is_blank, split_table_ref

TABLE_LIST = "table_catalog string, table_schema string, table_name string, table_type string, comment string"
COLUMN_LIST = ("table_ref string, name string, ordinal int, data_type string, nullable boolean, "
               "comment string, is_partition boolean")
DOCUMENTED_TYPES = ("MANAGED", "EXTERNAL")


def read_table(spark: SparkSession, ref: str) -> DataFrame:
    return spark.table(".".join(f"`{part}`" for part in split_table_ref(ref)))


def list_tables(spark: SparkSession, catalog: str, schema: str) -> DataFrame:
    rows = [
        (catalog, schema, t.name, t.tableType, t.description)
        for t in spark.catalog.listTables(f"`{catalog}`.`{schema}`") if not t.isTemporary
    ]
    return spark.createDataFrame(rows, TABLE_LIST)


def list_columns(spark: SparkSession, refs: list[str]) -> DataFrame:
    """Columns of the named tables in declared order; columns without a name are left out."""
    rows = []
    for ref in refs:
        listed = spark.catalog.listColumns(".".join(f"`{p}`" for p in split_table_ref(ref)))
        rows += [
            (ref, c.name, i, c.dataType, c.nullable, c.description, c.isPartition)
            for i, c in enumerate(listed, start=1) if c.name
        ]
    return spark.createDataFrame(rows, COLUMN_LIST)


def column_rows(information_columns: DataFrame) -> DataFrame:
    """The same shape from a supplied ``information_schema.columns`` table."""
    named = F.coalesce(F.col("column_name"), F.lit("")) != ""
    return information_columns.filter(named).select(
        F.concat_ws(".", "table_catalog", "table_schema", "table_name").alias("table_ref"),
        F.col("column_name").alias("name"),
        F.col("ordinal_position").cast("int").alias("ordinal"),
        "data_type",
        (F.upper("is_nullable") == "YES").alias("nullable"),
        "comment",
        F.lit(False).alias("is_partition"),
    )


def tables_to_document(tables: DataFrame, *, include_internal: bool = False, name_like: str | None = None,
                       skip_documented: bool = True, max_tables: int | None = None) -> DataFrame:
    """Base tables of a schema by name; by default those without a comment and not internal."""
    kept = tables.filter(F.col("table_type").isin(*DOCUMENTED_TYPES))
    kept = kept.filter(F.coalesce(F.col("table_name"), F.lit("")) != "")
    if not include_internal:
        kept = kept.filter(F.left("table_name", F.lit(2)) != "__")
    if name_like:
        kept = kept.filter(F.col("table_name").like(name_like))
    if skip_documented:
        kept = kept.filter(is_blank(F.col("comment")))
    kept = kept.orderBy("table_name")
    return kept.limit(int(max_tables)) if max_tables else kept


_CONSTRAINT_ID = ("constraint_catalog", "constraint_schema", "constraint_name")


def _key_columns(table_constraints: DataFrame, key_column_usage: DataFrame) -> DataFrame:
    owners = table_constraints.select(
        *_CONSTRAINT_ID, "constraint_type",
        F.concat_ws(".", "table_catalog", "table_schema", "table_name").alias("table_ref"))
    usage = key_column_usage.select(
        *_CONSTRAINT_ID, F.col("column_name").alias("column"), F.col("ordinal_position").cast("int").alias("pos"))
    return owners.join(usage, list(_CONSTRAINT_ID))


def declared_keys(table_constraints: DataFrame, key_column_usage: DataFrame) -> DataFrame:
    """Columns of each declared constraint with their position in it."""
    return _key_columns(table_constraints, key_column_usage).select(
        "table_ref", "constraint_name", "constraint_type", "column", "pos")


def foreign_keys(table_constraints: DataFrame, key_column_usage: DataFrame,
                 referential_constraints: DataFrame) -> DataFrame:
    """Referencing and referenced column of each foreign key, paired by position."""
    same = [*_CONSTRAINT_ID]
    from_side = _key_columns(table_constraints, key_column_usage)
    to_side = from_side.select(
        *[F.col(c).alias(f"unique_{c}") for c in same], "pos",
        F.col("table_ref").alias("ref_table"), F.col("column").alias("ref_column"))
    return (
        from_side.filter(F.col("constraint_type") == "FOREIGN KEY")
        .join(referential_constraints, same)
        .join(to_side, [*[f"unique_{c}" for c in same], "pos"])
        .select("table_ref", "constraint_name", "column", "ref_table", "ref_column", "pos")
    )


def describe_table(spark: SparkSession, ref: str) -> dict:
    """What the catalog says about a table besides its columns: comment and partition columns."""
    name = ".".join(f"`{part}`" for part in split_table_ref(ref))
    return {
        "comment": spark.catalog.getTable(name).description,
        "partition_columns": [c.name for c in spark.catalog.listColumns(name) if c.isPartition],
    }
