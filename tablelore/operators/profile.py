"""Column and table profiles: statistics and common values from one aggregate pass."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F, types as T

from ..functions.columns import (
    RANGED_CLASSES, STRUCTURE_ONLY_CLASSES, countable, literal, ordered, quoted, type_class_of, value_text,
)
from ..functions.privacy import (
    classes_by_name, classes_by_values, mask, mask_top_values, whole_value_hits,
)
from ..schemas import (
    COLUMN_PROFILE, COLUMN_STATS, PROFILE_ERROR, PROFILE_VERSION, TABLE_PROFILE, TOP_VALUES,
)
from ..session import small_table
from ..sources.sampling import Sample, fixed_sample

# Warning texts carried on a table profile.
WARN_SAMPLED = "sampled: row_count is an estimate"
WARN_NO_COLUMNS = "no columns found (check the table name / SELECT grant)"
WARN_EMPTY = ("table is empty (0 rows): distributions and cardinality are not meaningful")

#: Bytes and columns of the tables that are profiled in one job.
PACK_BYTES, PACK_COLUMNS = 256 << 20, 1000
# When a profile was made says nothing about the table, and would make every prompt a new one.
VOLATILE_FIELDS = ("profiled_at",)
VERBOSE_FIELDS = ("top_k", "sample_values", "pattern_summary", "percentiles")


@dataclass(frozen=True)
class ProfileOptions:
    """``exact`` counts distinct values exactly; ``mask_range`` hides min and max of flagged columns."""

    top_k: int = 20
    max_cardinality: int = 50
    batch_size: int = 50
    exact: bool = False
    mask_range: bool = True

    def __post_init__(self) -> None:
        if self.batch_size < 1:
            raise ValueError("batch_size must be at least 1")


@dataclass(frozen=True)
class Profile:
    tables: DataFrame
    columns: DataFrame


def _wanted(df: DataFrame, columns: Sequence[str] | None) -> list[tuple[int, T.StructField]]:
    numbered = list(enumerate(df.schema.fields, start=1))
    return [(i, f) for i, f in numbered if columns is None or f.name in set(columns)]


def _comment(field: T.StructField) -> str | None:
    return (field.metadata or {}).get("comment")


def column_stats(df: DataFrame, ref: str, options: ProfileOptions = ProfileOptions(),
                 columns: Sequence[str] | None = None, with_total: bool = False, with_values: bool = False) -> DataFrame:
    """One row of statistics per column, from one aggregate per slice of ``batch_size`` columns.

    Each slice reads only its own columns. Complex and binary columns are listed with their
    structure and are not read. ``with_total`` adds the row count as ``total``. ``with_values`` adds ``top_k``, the
    most common values of the enumerations, counted in the same pass.
    """
    wanted = _wanted(df, columns)
    size = options.batch_size
    slices = [wanted[i:i + size] for i in range(0, len(wanted), size)]
    shown = T.StructType([*COLUMN_STATS.fields, *[T.StructField("total", T.LongType())] * with_total,
                          *[T.StructField("top_k", TOP_VALUES)] * with_values])
    if not slices:
        return df.sparkSession.createDataFrame([], shown)
    return reduce(DataFrame.unionByName, [_slice_stats(df, ref, part, options, with_values) for part in slices]).select(shown.names)


def counted_values(source: str, data_type: T.DataType, options: ProfileOptions) -> tuple[str, str, int]:
    """A value to count, SQL for the text of a counted one, and how many values are counted at a time.

    The counts are exact while a column has no more distinct values (and a null) than are counted at a time, and so
    for every enumeration: twice as many are counted as it may have, since the distinct count may be an estimate.
    """
    kinds = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
             T.DateType, T.TimestampType, T.TimestampNTZType)
    plain = isinstance(data_type, kinds)
    return (source if plain else value_text(source, data_type), value_text("x.item", data_type) if plain else "x.item",
            2 * options.max_cardinality + 2)


def most_common(listed: str, k: int) -> str:
    """SQL for the ``k`` most common of counted values (``value``, ``count``), ties by value."""
    ranked = f"array_sort(transform(filter({listed}, x -> x.value IS NOT NULL), x -> struct(-x.count AS n, x.value AS value)))"
    return f"transform(slice({ranked}, 1, {k}), x -> struct(x.value AS value, -x.n AS count))"


def _slice_stats(df: DataFrame, ref: str, part: list[tuple[int, T.StructField]],
                 options: ProfileOptions, with_values: bool) -> DataFrame:
    aggregates, measured = ["count(1) AS total"], []
    for i, field in part:
        kind = type_class_of(field.dataType)
        source = quoted(field.name)
        present, distinct, low, high = "cast(NULL AS bigint)", "cast(NULL AS bigint)", "cast(NULL AS string)", "cast(NULL AS string)"
        listed = "cast(NULL AS array<struct<value:string,count:bigint>>)"
        if kind not in STRUCTURE_ONLY_CLASSES:
            aggregates.append(f"count({source}) AS n_{i}")
            present = f"n_{i}"
            if not options.exact:
                aggregates.append(f"approx_count_distinct({countable(source, field.dataType)[0]}) AS d_{i}")
                distinct = f"d_{i}"
            if with_values and options.top_k > 0:
                value, text, most = counted_values(source, field.dataType, options)
                aggregates.append(f"approx_top_k({value}, {most}, {most}) AS t_{i}")
                listed = f"transform(t_{i}, x -> struct({text} AS value, x.count AS count))"
        if kind in RANGED_CLASSES and ordered(field.dataType):
            aggregates += [f"min({source}) AS lo_{i}", f"max({source}) AS hi_{i}"]
            low, high = value_text(f"lo_{i}", field.dataType), value_text(f"hi_{i}", field.dataType)
        comment = _comment(field)
        declared = {
            "table_ref": literal(ref), "name": literal(field.name), "ordinal": str(i),
            "data_type": literal(field.dataType.simpleString()), "type_class": literal(kind),
            "nullable": str(field.nullable).lower(),
            "existing_comment": "cast(NULL AS string)" if comment is None else literal(comment),
            "present": present, "found": distinct, "low": low, "high": high, "listed": listed}
        measured.append("struct(" + ", ".join(f"{v} AS {k}" for k, v in declared.items()) + ")")
    rows = df.selectExpr(*aggregates).selectExpr("total", f"inline(array({', '.join(measured)}))")
    if options.exact:
        rows = rows.drop("found").join(_exact_distinct(df, part), "ordinal", "left")
    described = f"type_class NOT IN ({', '.join(map(literal, STRUCTURE_ONLY_CLASSES))})"
    counted = rows.selectExpr("*", f"CASE WHEN {described} THEN coalesce(found, 0L) END AS distinct_count")
    return counted.selectExpr(
        *[f.name for f in COLUMN_STATS.fields[:7]],
        "CASE WHEN total > 0 THEN round(1 - present / total, 6) END AS null_fraction",
        "distinct_count",
        f"CASE WHEN {described} THEN {str(not options.exact).lower()} END AS distinct_is_approx",
        "CASE WHEN present > 0 THEN round(distinct_count / present, 6) END AS cardinality_ratio",
        "low AS min", "high AS max",
        f"distinct_count > 0 AND distinct_count <= {options.max_cardinality} AS is_enum_candidate", "total",
        f"CASE WHEN distinct_count > 0 AND distinct_count <= {options.max_cardinality} THEN {most_common('listed', options.top_k)} END AS top_k")


def _exact_distinct(df: DataFrame, part: list[tuple[int, T.StructField]]) -> DataFrame:
    """Exact distinct counts per column.

    Each row becomes one narrow row per column, number and value; the columns of one type are read together, so a
    row to shuffle has one value whatever the table holds. Values repeated within a task are merged before the
    shuffle, whatever their share.
    """
    plain = [(i, f) for i, f in part if type_class_of(f.dataType) not in STRUCTURE_ONLY_CLASSES]
    compared = {i: countable(quoted(f.name), f.dataType) for i, f in plain}
    if not plain:
        return df.sparkSession.createDataFrame([], "ordinal int, found long")

    def values(kind: str) -> DataFrame:
        cells = (f"struct({i} AS ordinal, {source} AS value)" for i, (source, own) in compared.items() if own == kind)
        return df.selectExpr(f"inline(array({', '.join(cells)}))").filter("value IS NOT NULL").distinct().groupBy("ordinal").agg(
            F.count(F.lit(1)).alias("found"))

    return reduce(DataFrame.unionByName, [values(kind) for kind in dict.fromkeys(own for _, own in compared.values())])


def with_privacy(columns: DataFrame, mask_range: bool = True) -> DataFrame:
    """Adds the ``pii`` verdict and masks what a flagged column would show."""
    by_values = F.when(F.col("type_class") == "string", classes_by_values(F.col("top_k")))
    none = F.array().cast("array<string>")
    described = ~F.col("type_class").isin(*STRUCTURE_ONLY_CLASSES)
    classes = F.when(described, F.array_sort(F.array_union(
        classes_by_name(F.col("name")), F.coalesce(by_values, none)))).otherwise(none)
    flagged = F.size("_classes") > 0
    out = columns.withColumn("_classes", classes)
    shown = {"top_k": F.when(flagged, mask_top_values(F.col("top_k"))).otherwise(F.col("top_k"))}
    if mask_range:
        for side in ("min", "max"):
            value = F.col(side)
            shown[side] = F.when(flagged & value.isNotNull(), mask(value)).otherwise(value)
    verdict = F.struct(
        flagged.alias("detected"), F.col("_classes").alias("classes"),
        F.when(flagged, "masked").otherwise("none").alias("action"))
    return out.withColumns({**shown, "pii": verdict}).select(*[f.name for f in COLUMN_PROFILE.fields])


def table_warnings(row_count: Column, column_count: Column, sampled: Column) -> Column:
    return F.array_compact(F.array(
        F.when(sampled, F.lit(WARN_SAMPLED)),
        F.when(column_count == 0, F.lit(WARN_NO_COLUMNS)),
        F.when(row_count == 0, F.lit(WARN_EMPTY)),
    ))


def table_block(df: DataFrame, ref: str, sampled: bool, column_count: int, *, row_count: int | None = None,
                comment: str | None = None, partition_columns: Sequence[str] = ()) -> DataFrame:
    """The table's own row; the rows are counted unless ``row_count`` is known."""
    said = small_table(df.sparkSession, [(ref, row_count, column_count, list(partition_columns), comment)], _BLOCK)
    if row_count is None:
        counted = df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_ref", F.lit(ref))
        said = said.drop("row_count").join(counted, "table_ref")
    return _blocks(said, sampled)


_BLOCK = T.StructType([
    T.StructField("table_ref", T.StringType()), T.StructField("row_count", T.LongType()), T.StructField("column_count", T.IntegerType()),
    T.StructField("partition_columns", T.ArrayType(T.StringType())), T.StructField("existing_comment", T.StringType())])


def _blocks(said: DataFrame, sampled: bool) -> DataFrame:
    """The rows of tables from what is known of each."""
    rows = said.withColumns({
        "row_count_is_estimate": F.lit(sampled), "sampled": F.lit(sampled), "stats_source": F.lit("computed"),
        "profiled_at": F.current_timestamp(), "profile_version": F.lit(PROFILE_VERSION),
        "warnings": table_warnings(F.col("row_count"), F.col("column_count"), F.lit(sampled))})
    return rows.select(*[f.name for f in TABLE_PROFILE.fields])


def profile_table(df: DataFrame, ref: str, options: ProfileOptions = ProfileOptions(), *,
                  sample: Sample = Sample(), columns: Sequence[str] | None = None,
                  comment: str | None = None, partition_columns: Sequence[str] = ()) -> Profile:
    """Profile of one table.

    One pass; its result, one row per column of a schema the driver already holds, is read back, so that the profile's
    two tables do not make the pass twice.
    """
    rows = fixed_sample(df, sample)
    measured = measured_tables([(ref, rows)], options, columns)
    counted = measured[ref][0]["total"] if measured[ref] else None
    block = table_block(rows, ref, sample.active, len(measured[ref]), comment=comment, partition_columns=partition_columns, row_count=counted)
    return Profile(block, _column_rows(df.sparkSession, measured, options))


def measured_tables(tables: Sequence[tuple[str, DataFrame]], options: ProfileOptions,
                    columns: Sequence[str] | None = None) -> dict[str, list[dict]]:
    """Statistics and common values of the columns of some tables, by table, from one job."""
    stats = [column_stats(df, ref, options, columns, with_total=True, with_values=True) for ref, df in tables]
    found: dict[str, list[dict]] = {ref: [] for ref, _ in tables}
    for row in reduce(DataFrame.unionByName, stats).collect():
        found[row.table_ref].append(row.asDict(True))
    return found


def _column_rows(spark: SparkSession, measured: Mapping[str, list[dict]], options: ProfileOptions) -> DataFrame:
    shown = T.StructType([*COLUMN_STATS.fields, T.StructField("top_k", TOP_VALUES)])
    rows = [[r[n] for n in shown.names] for own in measured.values() for r in own]
    return with_privacy(small_table(spark, rows, shown), options.mask_range)


@dataclass(frozen=True)
class CatalogProfile:
    tables: DataFrame
    columns: DataFrame
    errors: DataFrame


@dataclass(frozen=True)
class _Loaded:
    ref: str
    rows: DataFrame
    said: Mapping
    size: int


def _size(df: DataFrame) -> int:
    """Bytes as Spark estimates them before it runs anything; a source that does not know says very many."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _packs(tables: Sequence[_Loaded], together: bool) -> list[list[_Loaded]]:
    """Tables to be profiled in one job each time: of small ones as many as the bounds on bytes and columns allow."""
    packs: list[list[_Loaded]] = []
    size = columns = 0
    for table in sorted(tables, key=lambda t: t.size):
        width = len(table.rows.columns)
        if not together or not width or not packs or size + table.size > PACK_BYTES or columns + width > PACK_COLUMNS:
            packs.append([])
            size = columns = 0
        packs[-1].append(table)
        size, columns = size + table.size, columns + width
    return packs


def _profile_pack(pack: Sequence[_Loaded], options: ProfileOptions, sample: Sample) -> Profile:
    if len(pack) == 1:
        [table] = pack
        return profile_table(table.rows, table.ref, options, sample=sample, **table.said)
    spark = pack[0].rows.sparkSession
    measured = measured_tables([(t.ref, t.rows) for t in pack], options)
    said = [(t.ref, measured[t.ref][0]["total"], len(measured[t.ref]), list(t.said.get("partition_columns", ())), t.said.get("comment")) for t in pack]
    return Profile(_blocks(small_table(spark, said, _BLOCK), False), _column_rows(spark, measured, options))


def profile_tables(spark: SparkSession, tables: Mapping[str, Callable[[], DataFrame]], *,
                   options: ProfileOptions = ProfileOptions(), sample: Sample = Sample(),
                   describe: Callable[[str], dict] | None = None,
                   out: str | None = None, at_once: int = 8) -> CatalogProfile:
    """Profiles of many tables, several at a time; a table that fails becomes an error row.

    Small tables share a job, as many as ``PACK_BYTES`` and ``PACK_COLUMNS`` allow; if it fails, they are profiled one by
    one. ``describe`` gives a table's ``comment`` and ``partition_columns`` where they are known.

    With ``out`` every table's profile is written to its own folder there and read back, so that a
    whole catalog never passes through the driver and a rerun replaces only what it redoes.
    """
    def failed(ref: str, failure: Exception) -> Row:
        code = getattr(failure, "getCondition", lambda: None)() or "provider_error"
        return Row(table_ref=ref, code=code, message=str(failure).splitlines()[0])

    def loaded(item: tuple[str, Callable[[], DataFrame]]):
        ref, load = item
        try:
            rows = load()
            return _Loaded(ref, rows, describe(ref) if describe else {}, _size(rows))
        except Exception as failure:  # one table must not stop the others
            return failed(ref, failure)

    def profiled(pack: list[_Loaded]) -> list:
        try:
            made = _profile_pack(pack, options, sample)
            if out:
                for part, rows in (("tables", made.tables), ("columns", made.columns)):
                    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table_ref").parquet(f"{out}/{part}")
            return [made]
        except Exception as failure:
            return [failed(pack[0].ref, failure)] if len(pack) == 1 else [x for table in pack for x in profiled([table])]

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        found = list(pool.map(loaded, tables.items()))
        packs = _packs([x for x in found if isinstance(x, _Loaded)], not sample.active)
        results = [x for made in pool.map(profiled, packs) for x in made]
    made = [r for r in results if isinstance(r, Profile)]
    missed = [r for r in (*found, *results) if isinstance(r, Row)]
    errors = small_table(spark, [tuple(r) for r in missed], PROFILE_ERROR)
    if out and made:
        gone = {r.table_ref for r in missed}
        named = T.StructType([T.StructField("table_ref", T.StringType())])
        asked = small_table(spark, [(ref,) for ref in tables if ref not in gone], named)

        def stored(part: str, schema: T.StructType) -> DataFrame:
            rows = spark.read.schema(schema).parquet(f"{out}/{part}")
            return rows.join(asked, "table_ref", "left_semi").select(schema.names)

        return CatalogProfile(stored("tables", TABLE_PROFILE), stored("columns", COLUMN_PROFILE), errors)
    return CatalogProfile(
        _union([m.tables for m in made], spark, TABLE_PROFILE),
        _union([m.columns for m in made], spark, COLUMN_PROFILE), errors)


def _union(frames: Iterable[DataFrame], spark: SparkSession, schema: T.StructType) -> DataFrame:
    frames = list(frames)
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


def merge_batches(columns: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Joins profiles made in batches: the first row of each column, the first table block, all warnings.

    Both inputs carry ``batch``. Columns without a name are an error.
    """
    unnamed = F.coalesce(F.col("name"), F.lit("")) == ""
    checked = columns.withColumn("name", F.when(
        unnamed, F.raise_error(F.lit("profile response contains a column without a name"))
    ).otherwise(F.col("name")))
    first_column = Window.partitionBy("table_ref", "name").orderBy("batch", "ordinal")
    kept = checked.withColumn("_n", F.row_number().over(first_column)).filter("_n = 1").drop("_n", "batch")
    counts = kept.groupBy("table_ref").agg(F.count(F.lit(1)).cast("int").alias("_columns"))
    first_table = Window.partitionBy("table_ref").orderBy("batch")
    block = tables.withColumn("_n", F.row_number().over(first_table)).filter("_n = 1").drop("_n", "batch", "warnings")
    warnings = (
        tables.select("table_ref", "batch", F.posexplode("warnings").alias("pos", "warning"))
        .groupBy("table_ref", "warning").agg(F.min(F.struct("batch", "pos")).alias("at"))
        .groupBy("table_ref").agg(F.array_sort(F.collect_list(F.struct("at", "warning"))).alias("w"))
        .select("table_ref", F.transform("w", lambda x: x["warning"]).alias("warnings"))
    )
    merged = (
        block.join(counts, "table_ref", "left").join(warnings, "table_ref", "left")
        .withColumn("column_count", F.coalesce("_columns", F.lit(0)))
        .withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))
        .drop("_columns")
    )
    return kept, merged


def version_error(version: Column, target: str = PROFILE_VERSION, minimum: str = PROFILE_VERSION) -> Column:
    """Why a stored profile is not accepted: NULL if its major is ours and it is not below the minimum."""
    def numbers(text: Column) -> Column:
        parts = F.transform(F.split(text, r"\."), lambda p: p.try_cast("int"))
        return F.when(F.forall(parts, lambda p: p.isNotNull()), parts).otherwise(F.array(F.lit(0)))

    found, ours, floor = numbers(version), numbers(F.lit(target)), numbers(F.lit(minimum))
    return (
        F.when(F.coalesce(version, F.lit("")) == "", "missing version")
        .when(found[0] != ours[0], "other major version")
        .when(found < floor, "below minimum version")
    )


def accept_versions(profiles: DataFrame, minimum: str = PROFILE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Profiles we understand, and the others as error rows."""
    judged = profiles.withColumn("message", version_error(F.col("profile_version"), minimum=minimum))
    good = judged.filter(F.col("message").isNull()).drop("message")
    bad = judged.filter(F.col("message").isNotNull()).select(
        "table_ref", F.lit("unsupported").alias("code"), "message")
    return good, bad


def without_verbose_fields(columns: DataFrame) -> DataFrame:
    return columns.drop(*VERBOSE_FIELDS)


def scan_for_private_values(df: DataFrame, ref: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Every value of every string column against the value patterns, in one pass."""
    fields = [(i, f) for i, f in _wanted(df, columns) if type_class_of(f.dataType) == "string"]
    aggregates, rows = [], []
    for i, field in fields:
        hits = whole_value_hits(F.col(quoted(field.name)))
        aggregates += [hit.alias(f"{name}_{i}") for name, hit in hits.items()]
        rows.append(F.struct(
            F.lit(ref).alias("table_ref"), F.lit(field.name).alias("name"),
            *[F.col(f"{name}_{i}").alias(f"{name}_values") for name in hits]))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))
