"""JSON that may be fenced, wrapped, malformed or absent."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

TEXT_LIST = "array<string>"
TEXT_MAP = "map<string,string>"


def text_list(raw: Column) -> Column:
    return F.coalesce(F.from_json(raw, TEXT_LIST), F.array().cast(TEXT_LIST))


def text_map(raw: Column) -> Column:
    empty = F.create_map().cast(TEXT_MAP)
    return F.coalesce(F.from_json(raw, TEXT_MAP), empty)


def json_body(reply: Column) -> Column:
    """The JSON in a model reply: code fence removed, else the outermost braces; NULL if none parses."""
    text = strip(F.coalesce(reply, F.lit("")))
    opened = F.regexp_replace(text, r"^```[^\n]*\n", "")
    opened = F.when(text.contains("\n"), opened).otherwise(F.regexp_replace(text, "^```", ""))
    unfenced = F.when(text.startswith("```"), F.regexp_replace(opened, r"\s*```\s*$", "")).otherwise(text)
    braces = F.regexp_extract(unfenced, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(unfenced).isNotNull(), unfenced).when(
        (braces != "") & F.try_parse_json(braces).isNotNull(), braces)


def is_object(body: Column) -> Column:
    return F.coalesce(strip(body).startswith("{"), F.lit(False))


def _field(value: Column, name: str, as_type: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", as_type)


def _unwrap(value: Column) -> Column:
    inner = [_field(value, name, "variant") for name in ("results", "content", "items", "data")]
    return F.coalesce(*inner, value)


def _stated(value: Column, names: tuple[str, ...]) -> Column:
    """First of the named fields that holds text."""
    return F.coalesce(*[F.nullif(_field(value, n, "string"), F.lit("")) for n in names])


def nesting(payload: Column) -> Column:
    """How deep objects lie in one another in a JSON text; braces inside strings do not count."""
    bare = F.regexp_replace(payload, r'"(?:[^"\\]++|\\.)*+"', "")
    steps = F.transform(F.regexp_extract_all(bare, F.lit(r"[{}]"), F.lit(0)), lambda b: F.when(b == "{", 1).otherwise(-1))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(steps, zero, lambda acc, step: F.struct(
        (acc["now"] + step).alias("now"), F.greatest(acc["most"], acc["now"] + step).alias("most")), lambda acc: acc["most"])


def result_texts(payload: Column) -> Column:
    """Text rows of a tool result: a string, a list, or an object around either, nested at will."""
    parsed = F.try_parse_json(payload)
    # Only objects are unwrapped, each from the inside of another one: as many rounds as they lie deep.
    depth = F.when(F.ltrim(payload).startswith("["), 0).otherwise(nesting(payload))
    core = F.when(depth == 0, parsed).otherwise(
        F.aggregate(F.sequence(F.lit(1), depth), parsed, lambda acc, _: _unwrap(acc)))
    items = F.try_variant_get(core, "$", "array<variant>")
    shape = F.schema_of_variant(core)
    from_items = F.transform(items, lambda item: F.coalesce(
        _stated(item, ("text", "snippet", "content")), item.cast("string"), F.lit("null")))
    own = F.coalesce(*[_field(core, n, "string") for n in ("text", "snippet", "summary")],
                     core.cast("string"))
    none = F.array().cast(TEXT_LIST)
    return (
        F.when(payload.isNull(), none)
        .when(parsed.isNull(), F.array(payload))
        .when(F.is_variant_null(core), none)
        .when(shape.startswith("ARRAY"), from_items)
        .otherwise(F.array(own))
    )
