"""What past statements say about a table: join conditions and grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import ref_part, squeezed
from .lineage import snippet_fields
from .skew import top_per_key

SOURCE = "query_history"
# Patterns, list lengths and relevance of the usage snippets.
JOIN_PATTERN = r"(?i)\bON\s+([\w.`]+\s*=\s*[\w.`]+)"
GROUP_PATTERN = r"(?i)\bGROUP\s+BY\b\s+([\w.`,\s]+?)(?:\bORDER\b|\bLIMIT\b|$)"
RECENT_STATEMENTS = 200
#: Lengths of the beginnings of names that are looked up, and bits of the sieve before that: one megabyte.
BEGINNINGS = (0, 1, 2, 4, 8, 16, 32, 64, 128)
SIEVE_BITS = 1 << 23
LISTED = 5
COUNT_RELEVANCE, JOIN_RELEVANCE, GRAIN_RELEVANCE = 0.5, 0.75, 0.65


def mentions(log: DataFrame, targets: DataFrame) -> DataFrame:
    """(table_ref, statement_id, start_time) for each statement that contains a target's full name.

    Containment of a name ``a.b.c`` means: between two dots of the statement stands exactly ``b``, the text before
    ends in ``a`` and the text after starts with ``c``. So statements are cut at their dots. A target is known by a
    fingerprint of ``b`` and the longest beginning of ``c`` whose length is a power of two; each place of a statement has
    one for every such length. A sieve of the targets' fingerprints, of fixed size, goes to all tasks, and what
    passes it is joined by fingerprint, so that a schema or a name's first letters that most statements share are
    spread like any others. The log is read once.
    """
    named = targets.select("table_ref").distinct().select(
        "table_ref",
        F.lower(ref_part(F.col("table_ref"), 1)).alias("catalog"),
        F.lower(ref_part(F.col("table_ref"), 2)).alias("own_schema"),
        F.lower(ref_part(F.col("table_ref"), 3)).alias("name"))
    known = named.withColumn("length", F.array_max(_beginnings("name"))).withColumn("print", _print("own_schema", "name"))
    cut = F.split(F.lower(F.col("statement_text")), r"\.")
    around = F.transform(
        F.sequence(F.lit(1), F.size("cut") - 2),
        lambda i: F.struct(F.get("cut", i - 1).alias("before"), F.get("cut", i).alias("schema"),
                           F.get("cut", i + 1).alias("after")))
    places = (
        log.select("statement_id", "start_time", cut.alias("cut")).filter(F.size("cut") >= 3)
        .select("statement_id", "start_time", F.inline(around))
        .select("statement_id", "start_time", "before", "schema", "after", F.explode(_beginnings("after")).alias("length"))
        .withColumn("print", _print("schema", "after"))
    )
    likely = places.withColumns(_slot()).join(F.broadcast(_sieve(known)), "slot").filter("(bits & bit) <> 0").drop("slot", "bit", "bits")
    found = likely.join(known.drop("length"), "print").filter(
        (F.col("schema") == F.col("own_schema")) & F.col("after").startswith(F.col("name")) & F.col("before").endswith(F.col("catalog")))
    return found.select("table_ref", "statement_id", "start_time").distinct()


def _beginnings(text: str) -> Column:
    """The lengths of a text's beginnings that a fingerprint may be of."""
    return F.filter(F.array(*(F.lit(n) for n in BEGINNINGS)), lambda n: n <= F.length(text))


def _print(schema: str, text: str) -> Column:
    return F.xxhash64(schema, "length", F.expr(f"left({text}, length)"))


def _slot() -> dict[str, Column]:
    """Where the fingerprint of a row is in the sieve: a word of 64 bits, and the bit there."""
    at = F.pmod(F.col("print"), F.lit(SIEVE_BITS))
    return {"slot": F.floor(at / 64).cast("int"), "bit": F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int"))}


def _sieve(known: DataFrame) -> DataFrame:
    """The fingerprints as bits, at most ``SIEVE_BITS / 64`` rows."""
    return known.select("print").withColumns(_slot()).groupBy("slot").agg(F.bit_or("bit").alias("bits"))


def recent_mentions(log: DataFrame, targets: DataFrame, limit: int = RECENT_STATEMENTS) -> DataFrame:
    """The newest statements per table; their texts are fetched after the cut.

    Only ids are cut and joined by statement, so the log's texts move once; Spark sends the ids to
    every task instead where they turn out to be few.
    """
    newest = [F.col("start_time").desc(), F.col("statement_id")]
    kept = top_per_key(mentions(log, targets), ["table_ref"], newest, limit, ["statement_id"])
    return log.select("statement_id", "statement_text").join(kept, "statement_id").select(
        "table_ref", "statement_id", "start_time", "rank", "statement_text")


def _found(pattern: str) -> Column:
    return F.regexp_extract_all("statement_text", F.lit(pattern), 1)


def _counted(recent: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """Items per table and kind with their uses and first appearance, newest statement first.

    Every kind is read from a statement in the same pass.
    """
    def marked(kind: str, found: Column) -> Column:
        return F.transform(found, lambda raw, at: F.struct(F.lit(kind).alias("kind"), at.alias("at"), raw.alias("raw")))

    items = F.concat(*[marked(kind, found) for kind, found in kinds.items()])
    rows = recent.select("table_ref", "rank", F.inline(items)).withColumn("item", squeezed(F.col("raw")))
    return rows.groupBy("table_ref", "kind", "item").agg(
        F.count(F.lit(1)).alias("uses"), F.min(F.struct("rank", "at")).alias("first_seen"))


def _most_used(counted: DataFrame, listed: int = LISTED) -> DataFrame:
    order = [F.col("uses").desc(), F.col("first_seen")]
    return top_per_key(counted, ["table_ref", "kind"], order, listed, ["item"], rank="place").drop("first_seen")


def join_conditions(recent: DataFrame, listed: int = LISTED) -> DataFrame:
    """The most frequent join conditions per table, ties by first appearance."""
    return _most_used(_counted(recent, {"join": _found(JOIN_PATTERN)}), listed).drop("kind")


def grain_hints(recent: DataFrame, listed: int = LISTED) -> DataFrame:
    """The most frequent GROUP BY lists per table, ties by first appearance."""
    return _most_used(_counted(recent, {"grain": _found(GROUP_PATTERN)}), listed).drop("kind")


def usage_snippets(log: DataFrame, targets: DataFrame, limit: int = RECENT_STATEMENTS, listed: int = LISTED) -> DataFrame:
    """Per table: how many statements use it, their join conditions, and their grain."""
    return snippets_of(recent_mentions(log, targets, limit), listed)


def snippets_of(recent: DataFrame, listed: int = LISTED) -> DataFrame:
    """The same from the newest statements of each table, with their ``rank``."""
    kinds = {"count": F.array(F.lit("")), "join": _found(JOIN_PATTERN), "grain": _found(GROUP_PATTERN)}
    used = _most_used(_counted(recent, kinds), listed)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"])
    told = used.groupBy("table_ref", "kind").agg(F.array_join(ordered, "; ").alias("listed"), F.max("uses").alias("uses"))
    text, relevance, seq = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("int")
    for kind, words, weight, place in (
        ("count", F.format_string("Observed in %d recent queries referencing this table.", "uses"), COUNT_RELEVANCE, 0),
        ("join", F.concat(F.lit("Common join conditions (query history): "), "listed", F.lit(".")), JOIN_RELEVANCE, 1),
        ("grain", F.concat(F.lit("Common GROUP BY (grain hint): "), "listed", F.lit(".")), GRAIN_RELEVANCE, 2),
    ):
        own = F.col("kind") == kind
        text, relevance, seq = (F.when(own, new).otherwise(old) for new, old in ((words, text), (weight, relevance), (place, seq)))
    return told.select("table_ref", *snippet_fields(text, SOURCE, relevance, seq))
