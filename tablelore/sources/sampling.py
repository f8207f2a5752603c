"""Sampling intent of a profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

#: Ranges in which drawn numbers are counted, and numbers that the driver looks at singly.
RANGES, FEW = 1024, 10_000
SAMPLE_MODES = ("auto", "full", "rows", "percent")


@dataclass(frozen=True)
class Sample:
    """``auto`` and ``full`` read everything; a zero value of the other modes does too."""

    mode: str = "auto"
    value: float | None = None
    seed: int = 42

    def __post_init__(self) -> None:
        if self.mode not in SAMPLE_MODES:
            raise ValueError(f"sample mode must be one of {SAMPLE_MODES}, got {self.mode!r}")
        if self.mode in ("rows", "percent") and self.value is None:
            raise ValueError(f"sample mode {self.mode!r} needs a value")
        if self.mode == "percent" and not 0 <= self.value <= 100:
            raise ValueError("a percent sample lies between 0 and 100")

    @property
    def active(self) -> bool:
        return self.mode in ("rows", "percent") and bool(self.value)


def apply_sample(df: DataFrame, sample: Sample) -> DataFrame:
    """The rows to profile: a number of rows drawn from all of them, or a seeded share of all rows."""
    if not sample.active:
        return df
    if sample.mode == "rows":
        return drawn_rows(df, int(sample.value), sample.seed)
    return df.sample(fraction=float(sample.value) / 100, seed=sample.seed)


def drawn_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows, each with the same chance: those with the smallest of the numbers that are drawn for all rows.

    The n-th smallest number is found by counting: the rows are counted per range of numbers, then those of the range that
    holds the n-th one, until few are left. So only counts, and the rows that stay, leave their tasks. As for any
    seeded sample, the same rows are drawn again as long as the table is read in the same pieces.
    """
    total = df.count()
    if n >= total:
        return df
    name = "_drawn"
    while name in df.columns:
        name += "_"
    numbered = df.withColumn(name, F.rand(seed))
    low, high, before = 0.0, 1.0, 0
    while True:
        within = numbered.select(name).filter((F.col(name) >= low) & (F.col(name) < high))
        width = (high - low) / RANGES
        if width <= 1e-15:
            break
        counts = within.groupBy(F.least(F.lit(RANGES - 1), F.floor((F.col(name) - low) / width)).alias("at")).agg(
            F.count(F.lit(1)).alias("n"), F.min(name).alias("least"), F.max(name).alias("most")).orderBy("at").collect()
        for row in counts:
            if before + row.n >= n:
                break
            before += row.n
        if before + row.n == n:  # a range ends with the n-th row
            return numbered.filter(F.col(name) <= row.most).drop(name)
        if row.n <= FEW:
            inside = within.filter((F.col(name) >= row.least) & (F.col(name) <= row.most)).collect()
            last = sorted(r[0] for r in inside)[n - before - 1]
            return numbered.filter(F.col(name) <= last).drop(name)
        low, high = row.least, min(1.0, row.most + 1e-16)
    return numbered.filter(F.col(name) < high).drop(name)


def fixed_sample(df: DataFrame, sample: Sample) -> DataFrame:
    """A sample that every later pass sees unchanged."""
    return cut_lineage(apply_sample(df, sample)) if sample.active else df
