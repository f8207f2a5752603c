"""Quality by robust multivariate outliers, in DataFrame functions only.

Each text gives counts of words, symbols, repeated lines and repeated five-word windows. Texts that pass the base rules
become vectors of transformed statistics, in whole thousandths, so that all sums are exact and in any order the same.
Per language and source a minimum-covariance-determinant estimate is found by concentration steps: keep the given share
of rows nearest to the current centre, and estimate again from them. The first centre is the median. Variances get a
stated floor, so that a statistic that is constant in a group does not reject every other value. A text whose squared
Mahalanobis distance exceeds ``cutoff`` is rejected.

Sources with fewer than ``least`` vectors are pooled per language, and languages with fewer over all; a pool that is
still smaller rejects nothing. Null language and source are values of their own; null text has no words. Groups are
summed within tasks first, and quantiles are counts of bounded whole numbers, so a hot source sends little.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablelore.session import cut_lineage

from .common import SPACES

WINDOW = 5
LEAST_WORDS = 10
REPEATED_PERCENT = 20
#: Share of each group that an estimate is made from, rows a group needs, and concentration steps.
SHARE = 0.75
LEAST_ROWS = 50
STEPS = 3
#: 99.9999 % quantile of chi-squared with four degrees of freedom.
CUTOFF = 33.4
#: Thousandths added to each standard deviation (in squares): log word length, roots of the three shares.
FLOORS = (100, 30, 150, 150)
#: Distances are ranked in this many steps per unit of log(1 + squared distance), up to the last one.
RANKS, LAST_RANK = 256, 256 * 40

AXES = range(len(FLOORS))
PAIRS = [(i, j) for i in AXES for j in range(i + 1)]


def text_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                source: str = "source") -> DataFrame:
    """``doc_id``, ``n_words`` and the four base counts, with ``n_lines``, ``lang`` and ``source``."""
    plain = docs.select(
        docs[doc_id].cast("bigint").alias("doc_id"), docs[lang].alias("lang"), docs[source].alias("source"),
        F.coalesce(docs[text], F.lit("")).alias("text"))
    kept = [F.col(x) for x in ("doc_id", "lang", "source")]
    split = plain.select(
        *kept, F.filter(F.split("text", f"[{SPACES}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACES}]")).alias("lines"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"))
    sizes = split.select(
        *kept, "n_symbols", F.size("words").cast("bigint").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"))
    counts = [*kept, "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    windows = sizes.select(*counts, F.when(F.size("hashes") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("hashes") - WINDOW),
        lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(WINDOW))))).otherwise(
            F.array().cast("array<bigint>")).alias("windows"))
    repeats = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _covered(F.col("windows")))
    return windows.select(*counts, F.coalesce(repeats, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def _covered(windows: Column) -> Column:
    """Words in windows met twice or more. Windows are sorted by hash, so that equal ones are neighbours."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array(F.lit(None).cast("struct<h: bigint, i: int>"))
    before = F.concat(none, F.slice(ordered, 1, F.size(windows) - 1))
    after = F.concat(F.slice(ordered, 2, F.size(windows) - 1), none)
    marked = F.zip_with(ordered, before, lambda x, y: F.struct(x.h.alias("h"), x.i.alias("i"), x.h.eqNullSafe(y.h).alias("d")))
    places = F.zip_with(marked, after, lambda x, y: F.when(x.d | x.h.eqNullSafe(y.h), x.i))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        F.sort_array(F.filter(places, lambda x: x.isNotNull())), start,
        lambda a, i: F.struct((a.n + F.least(F.lit(WINDOW), i - a.last)).alias("n"), i.alias("last")), lambda a: a.n)


def _vector() -> list[Column]:
    """Transformed statistics in thousandths; rows without words are not asked."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    values = (F.log(F.col("word_chars") / F.greatest("n_words", F.lit(1))), share("n_symbols", "word_chars"),
              share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"))
    return [F.round(1000 * x).cast("bigint").alias(f"x{k}") for k, x in zip(AXES, values)]


def _grouped(rows: DataFrame, least: int) -> DataFrame:
    """Adds ``group``: language and source, or the pool they fall in, and whether it is large enough."""
    pools = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.col("n") >= least, F.to_json(F.struct("lang", "source", F.lit("both").alias("by"))))
    of_lang = F.to_json(F.struct("lang", F.lit("lang").alias("by")))
    pools = pools.withColumn("own", own)
    by_lang = pools.filter("own IS NULL").groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("n_lang"))
    pools = pools.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left")
    named = pools.select(
        F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "n",
        F.coalesce("own", F.when(F.col("n_lang") >= least, of_lang), F.lit("{}")).alias("group"))
    totals = named.groupBy("group").agg((F.sum("n") >= least).alias("judged"))
    named = named.join(totals, "group")
    return rows.join(named.drop("n"), F.col("lang").eqNullSafe(F.col("g_lang")) &
                     F.col("source").eqNullSafe(F.col("g_source"))).drop("g_lang", "g_source")


def _spread(rows: DataFrame) -> DataFrame:
    """Per group the mean and the Cholesky factor of the covariance with its floors."""
    sums = rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in AXES),
        *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS))
    return _factored(sums.select(
        "group", *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in AXES),
        *((F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n")
           + F.lit(FLOORS[i] ** 2 if i == j else 0)).alias(f"c{i}{j}") for i, j in PAIRS)))


def _factored(moments: DataFrame) -> DataFrame:
    for i, j in PAIRS:
        inner = reduce(lambda a, b: a + b, (F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        left = F.col(f"c{i}{j}") - inner
        least = F.lit(float(FLOORS[i] ** 2) / 4)
        moments = moments.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, least)) if i == j else left / F.col(f"l{j}{j}"))
    return moments.select("group", *(f"m{i}" for i in AXES), *(f"l{i}{j}" for i, j in PAIRS))


def _with_distance(rows: DataFrame, spread: DataFrame) -> DataFrame:
    """Adds ``d2``, by forward substitution."""
    joined, solved = rows.join(spread, "group"), []
    for i in AXES:
        inner = reduce(lambda a, b: a + b, (F.col(f"l{i}{k}") * solved[k] for k in range(i)), F.lit(0.0))
        joined = joined.withColumn(f"y{i}", (F.col(f"x{i}") - F.col(f"m{i}") - inner) / F.col(f"l{i}{i}"))
        solved.append(F.col(f"y{i}"))
    total = reduce(lambda a, b: a + b, (y * y for y in solved))
    return joined.select(*rows.columns, total.alias("d2"))


def _first_spread(rows: DataFrame) -> DataFrame:
    """Medians, and diagonal covariances from the median distances to them."""
    medians = rows.groupBy("group").agg(*(F.percentile(f"x{i}", F.lit(0.5)).alias(f"m{i}") for i in AXES))
    off = rows.join(medians, "group").groupBy("group").agg(
        *(F.first(f"m{i}").alias(f"m{i}") for i in AXES),
        *(F.percentile(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), F.lit(0.5)).alias(f"d{i}") for i in AXES))
    return _factored(off.select("group", *(f"m{i}" for i in AXES), *(
        (F.pow(F.col(f"d{i}") * 1.4826, 2) + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS)))


def minimum_covariance(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Per ``group`` the mean and factor of the concentrated share of its rows ``x0``, ``x1``, ..."""
    rank = F.least(F.floor(RANKS * F.log1p("d2")), F.lit(LAST_RANK)).cast("int").alias("rank")
    spread = cut_lineage(_first_spread(rows))
    for _ in range(steps):
        ranked = _with_distance(rows, spread).select("*", rank)
        nearest = ranked.groupBy("group").agg(F.percentile("rank", F.lit(share)).alias("most"))
        spread = cut_lineage(_spread(ranked.join(nearest, "group").filter(F.col("rank") <= F.ceil("most"))))
    return spread


def outlying(docs: DataFrame, cutoff: float = CUTOFF, least: int = LEAST_ROWS, **names: str) -> DataFrame:
    """Per row: its counts, ``base_failed``, the squared ``distance`` (null if not judged) and ``kept``."""
    failed = ((F.col("n_words") < LEAST_WORDS)
              | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))).alias("base_failed")
    counts = cut_lineage(text_counts(docs, **names).select("*", failed))
    passed = counts.filter(~F.col("base_failed")).select("*", *_vector())
    rows = cut_lineage(_grouped(passed, least))
    vectors = rows.select("group", *(f"x{i}" for i in AXES))
    judged = _with_distance(rows, minimum_covariance(vectors)).select(
        *counts.columns, F.when(F.col("judged"), F.col("d2")).alias("distance"))
    whole = judged.unionByName(counts.filter("base_failed").withColumn("distance", F.lit(None).cast("double")))
    return whole.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))
