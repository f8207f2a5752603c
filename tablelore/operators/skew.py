"""Per-key steps that stay spread out when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage, spread

_SALT = "_slice"


def slice_of(columns: Sequence[str], slices: int) -> Column:
    """Slice number from row content, so that a recomputed task places its rows as before."""
    return F.pmod(F.xxhash64(*columns), F.lit(slices)).cast("int")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                slice_by: Sequence[str], rank: str = "rank", sliced: bool = True) -> DataFrame:
    """The first ``n`` rows of each key, with their position.

    The filter on ``row_number`` lets Spark cut every task's rows to ``n`` per key before the
    shuffle. Each key is first cut down in slices, so that the last step sees at most ``n`` rows per
    slice however many rows the key has, also after a join on the same keys. A caller whose keys have
    few rows by construction may switch the slices off.
    """
    if sliced:
        within = Window.partitionBy(*keys, _SALT).orderBy(*order)
        df = (
            df.withColumn(_SALT, slice_of(slice_by, spread(df.sparkSession)))
            .withColumn(rank, F.row_number().over(within))
            .filter(F.col(rank) <= n)
            .drop(_SALT, rank)
        )
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= n)


def number_by_ordinal(df: DataFrame, keys: Sequence[str], ordinal: str, order: Sequence[Column],
                      name: str, width: int = 4096) -> DataFrame:
    """Position of each row within its key, by an integer ordinal and then ``order``.

    Ranges of ``width`` ordinals are numbered apart; a range starts after the rows counted in the
    ranges before it. Only those counts, one row per range, are brought together per key. The rows are stored
    first, so that what they come from is read once.
    """
    block = "_block"
    parts = cut_lineage(df.withColumn(block, F.floor(F.coalesce(F.col(ordinal), F.lit(0)) / width)))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        parts.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    inside = Window.partitionBy(*keys, block).orderBy(F.col(ordinal), *order)
    return (
        parts.withColumn("_inside", F.row_number().over(inside))
        .join(starts, [*keys, block])
        .withColumn(name, (F.col("_start") + F.col("_inside")).cast("int"))
        .drop(block, "_inside", "_start")
    )


def prefix_within_budget(df: DataFrame, keys: Sequence[str], place: Sequence[Column], rest: Sequence[Column], cost: str,
                         budget: int, slice_by: Sequence[str]) -> DataFrame:
    """The longest leading run of each key whose costs fit the budget; the first row always stays.

    Rows stand by ``place``, narrow columns, rising, and those of one place by ``rest``. Costs are summed per place, and
    running sums over the places find the one where a key's budget ends. Rows of earlier places stay and later
    ones go as they are, whatever else they hold; only the rows of that one place are looked at singly. Places without
    costs take no part in the sums, and slices of a key drop places behind a full budget of their own before those of
    one key meet, so few more than ``budget`` places per slice do.
    """
    at, salt = "_at", _SALT
    rows = df.withColumn(at, F.struct(*(p.alias(f"p{k}") for k, p in enumerate(place))))
    sums = rows.groupBy(*keys, at).agg(F.sum(cost).alias("_cost"))
    first = sums.groupBy(*keys).agg(F.min(at).alias("_begin"))
    up_to_here = (Window.unboundedPreceding, Window.currentRow)
    sliced = Window.partitionBy(*keys, salt).orderBy(at).rowsBetween(*up_to_here)
    whole = Window.partitionBy(*keys).orderBy(at).rowsBetween(*up_to_here)
    near = (
        sums.filter(F.col("_cost") > 0)
        .withColumn(salt, slice_of([at], spread(df.sparkSession)))
        .withColumn("_before", F.sum("_cost").over(sliced) - F.col("_cost"))
        .filter(F.col("_before") <= budget)
        .withColumn("_before", F.sum("_cost").over(whole) - F.col("_cost"))
    )
    stops = near.filter(F.col("_before") + F.col("_cost") > budget).groupBy(*keys).agg(
        F.min(F.struct(F.col(at).alias("at"), F.col("_before").alias("before"))).alias("_stop"))
    ends = stops.join(first, [*keys]).select(*keys, F.col("_stop.at").alias("_last"), (F.lit(budget) - F.col("_stop.before")).alias("_room"),
                                             (F.col("_stop.at") == F.col("_begin")).alias("_opens"))
    marked = rows.join(ends, [*keys], "left")
    before = marked.filter(F.col("_last").isNull() | (F.col(at) < F.col("_last"))).select(*df.columns)
    edge = marked.filter(F.col(at) == F.col("_last")).drop(at, "_last")
    return before.unionByName(_prefix_of_place(edge, df.columns, keys, rest, cost, slice_by))


def _prefix_of_place(df: DataFrame, fields: Sequence[str], keys: Sequence[str], order: Sequence[Column], cost: str,
                     slice_by: Sequence[str]) -> DataFrame:
    """As above for rows of one place per key, within ``_room``; the first row stays in any case where ``_opens``.

    Equal rows are counted first and given back at the end. A row behind a full budget of its own
    slice is behind a full budget of its key too, so slices drop such rows before rows of one key
    meet; each slice keeps the row that overflows it, so that nothing behind that row gets in.
    """
    counted = df.groupBy(*fields).agg(F.count(F.lit(1)).alias("_copies"), F.first("_room").alias("_room"), F.first("_opens").alias("_opens"))
    counted = counted.withColumn("_cost", F.col(cost) * F.col("_copies"))
    up_to_here = (Window.unboundedPreceding, Window.currentRow)
    sliced = Window.partitionBy(*keys, _SALT).orderBy(*order).rowsBetween(*up_to_here)
    whole = Window.partitionBy(*keys).orderBy(*order)
    running = F.sum("_cost").over(whole.rowsBetween(*up_to_here)) - F.col("_cost")
    near = (
        counted.withColumn(_SALT, slice_of(slice_by, spread(df.sparkSession)))
        .withColumn("_before", F.sum("_cost").over(sliced) - F.col("_cost"))
        .filter(F.col("_before") <= F.col("_room"))
        .withColumn("_before", running)
        .withColumn("_first", (F.row_number().over(whole) == 1) & F.col("_opens"))
    )
    room = F.col("_room") - F.col("_before")
    fitting = (
        F.when(room < 0, 0)
        .when(F.col(cost) == 0, F.col("_copies"))
        .otherwise(F.least(F.col("_copies"), F.floor(room / F.col(cost))))
    )
    kept = F.greatest(fitting, F.when(F.col("_first"), 1).otherwise(0)).cast("long")
    return (
        near.withColumn("_kept", kept).filter(F.col("_kept") > 0)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_kept"))))
        .select(*fields)
    )
