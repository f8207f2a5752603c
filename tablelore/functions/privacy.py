"""Detection and masking of personal data in column names and values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns on the column name, case-insensitive, found anywhere unless anchored.
NAME_PATTERNS = {
    "email": r"e[-_]?mail",
    "ssn": r"ssn|social_security",
    "phone": r"phone|mobile|msisdn",
    "credit_card": r"credit_?card|card_number|ccnum|cc_num",
    "ip": r"^ip(_?addr(ess)?)?$",
}
# Patterns on a whole value.
VALUE_PATTERNS = {
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "credit_card": r"^\d{13,16}$",
}
# The value patterns without anchors, for finding occurrences inside running text.
TEXT_PATTERNS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "email": r"[^@\s]+@[^@\s]+\.[^@\s]+",
    "credit_card": r"\b\d{13,16}\b",
}
MASK = "•"


def classes_by_name(name: Column) -> Column:
    flags = [F.when(name.rlike("(?i)" + p), F.lit(c)) for c, p in NAME_PATTERNS.items()]
    return F.array_sort(F.array_compact(F.array(*flags)))


def classes_by_values(top_k: Column) -> Column:
    """Classes any of the most common values matches."""
    def seen(pattern: str) -> Column:
        return F.exists(top_k, lambda item: item["value"].rlike(pattern))

    flags = [F.when(seen(p), F.lit(c)) for c, p in VALUE_PATTERNS.items()]
    return F.array_sort(F.array_compact(F.array(*flags)))


def mask(value: Column) -> Column:
    """First two characters, the rest as dots; at least two dots, and only dots for short values."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    size = F.length(text)
    dots = F.repeat(F.lit(MASK), F.greatest(F.lit(2), size - 2))
    return F.when(size <= 2, F.lit(MASK * 2)).otherwise(F.concat(F.left(text, F.lit(2)), dots))


def mask_top_values(top_k: Column) -> Column:
    return F.transform(top_k, lambda item: F.struct(
        mask(item["value"]).alias("value"), item["count"].alias("count")))


def whole_value_hits(value: Column) -> dict[str, Column]:
    """Aggregates counting the values of a column that are personal data of each class."""
    return {c: F.count_if(value.rlike(p)) for c, p in VALUE_PATTERNS.items()}


def text_hits(text: Column) -> dict[str, Column]:
    """Occurrences of each class inside one text."""
    return {c: F.regexp_count(text, F.lit(p)) for c, p in TEXT_PATTERNS.items()}
