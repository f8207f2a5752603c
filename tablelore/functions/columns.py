"""Type classes and display text of profiled columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Declared base type names per class; any other name is a string.
INTEGER_TYPES = ("int", "integer", "bigint", "smallint", "tinyint", "long", "byte", "short")
DECIMAL_TYPES = ("double", "float", "real", "decimal", "numeric")
TEMPORAL_TYPES = ("date", "timestamp", "timestamp_ntz", "interval")
COMPLEX_TYPES = ("struct", "array", "map")

RANGED_CLASSES = ("integer", "decimal", "temporal")
STRUCTURE_ONLY_CLASSES = ("complex", "binary")


def type_class(declared: Column) -> Column:
    """Class of a declared type name such as ``decimal(12,2)``; NULL counts as string."""
    base = F.trim(F.regexp_extract(F.lower(F.trim(declared)), r"^[^(<]*", 0))
    return (
        F.when(base.isin(*INTEGER_TYPES), "integer")
        .when(base.isin(*DECIMAL_TYPES), "decimal")
        .when(base.isin(*TEMPORAL_TYPES), "temporal")
        .when(base == "boolean", "boolean")
        .when(base == "binary", "binary")
        .when(base.isin(*COMPLEX_TYPES), "complex")
        .otherwise("string")
    )


def type_class_of(data_type: T.DataType) -> str:
    """Same classes for a Spark type object, so that a plan can be chosen from a schema."""
    base = data_type.simpleString().split("(")[0].split("<")[0].strip().lower()
    for members, name in (
        (INTEGER_TYPES, "integer"), (DECIMAL_TYPES, "decimal"), (TEMPORAL_TYPES, "temporal"),
        (("boolean",), "boolean"), (("binary",), "binary"), (COMPLEX_TYPES, "complex"),
    ):
        if base in members:
            return name
    return "string"


def quoted(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A string as SQL text."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def countable(source: str, data_type: T.DataType) -> tuple[str, str]:
    """SQL for a value that can be compared for equality, with its type: text for the types that cannot."""
    kind = data_type.simpleString()
    if kind == "variant":
        return f"to_json({source})", "string"
    if kind == "interval":
        return f"cast({source} AS string)", "string"
    return source, kind


def ordered(data_type: T.DataType) -> bool:
    """Whether values of the type have an order; calendar intervals have none."""
    return data_type.simpleString() != "interval"


def value_text(source: str, data_type: T.DataType) -> str:
    """SQL for the text of a value: ISO form for dates and timestamps, a fraction only where there is one."""
    if isinstance(data_type, T.DateType):
        return f"date_format({source}, 'yyyy-MM-dd')"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        full = f"concat(date_format({source}, 'yyyy-MM-dd'), 'T', date_format({source}, 'HH:mm:ss.SSSSSS'))"
        return f"regexp_replace({full}, '[.]000000$', '')"
    return f"cast({countable(source, data_type)[0]} AS string)"


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "mid").otherwise("low")


def share_label(ratio: Column) -> Column:
    """``12% unique`` style label; one decimal below a tenth.

    Rounded by the value a double really has, exact halves up.
    """
    share = ratio * 100
    rest = share % 1
    tenths = F.format_number(F.when(rest.isin(0.25, 0.75), share + 1e-9).otherwise(share), 1)
    whole = F.format_number(F.when(rest == 0.5, share + 1e-9).otherwise(share), 0)
    return F.when(ratio.isNotNull(), F.concat(F.when(ratio < 0.1, tenths).otherwise(whole), F.lit("% unique")))


def null_percent(null_fraction: Column) -> Column:
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), null_fraction))
    return F.when(null_fraction.isNotNull(), F.round(bounded * 100).cast("int"))


def top_bars(top_k: Column, shown: int = 6, floor: float = 2.0) -> Column:
    """The first bars of a value distribution, with widths in percent of the largest shown."""
    kept = F.slice(F.filter(top_k, lambda item: item["count"].isNotNull()), 1, shown)
    tallest = F.greatest(F.lit(1), F.array_max(F.transform(kept, lambda item: item["count"])))
    return F.transform(kept, lambda item: F.struct(
        item["value"].alias("label"),
        item["count"].alias("value"),
        F.greatest(F.lit(floor), item["count"] / tallest * 100).alias("width"),
    ))
