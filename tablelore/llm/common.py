"""Helpers of the text operators: arguments, folds and plain loops over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space of the contracts.
SPACES = r"\x20\x09-\x0D"
HELD_OUT = 2
FOLDS = 4
#: Rows whose texts a task holds as Python strings at once.
AT_ONCE = 256
#: Bits of a sieve: one megabyte.
SIEVE_BITS = 1 << 23


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def pair(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; other columns cannot clash. A null text is empty."""
    return docs.select(docs[doc_id].cast("bigint").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))


def free_name(df: DataFrame, like: str) -> str:
    """A column name that the rows do not have."""
    taken = {name.lower() for name in df.columns}
    while like.lower() in taken:
        like += "_"
    return like


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fold that no model may learn from; a null id is never held out."""
    kept = F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"))
    return F.coalesce(kept % FOLDS == HELD_OUT, F.lit(False))


def finite(vector: Column) -> Column:
    """True for a vector that is not null, has entries, and holds only finite numbers."""
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def sieve(values: DataFrame) -> DataFrame:
    """``slot`` and ``bits``: the CRCs of the one column as a set of bits. What it lacks is not there, what it holds may be."""
    crc = F.crc32(F.col(values.columns[0])) % SIEVE_BITS
    bit = values.select(crc.alias("at")).selectExpr("cast(at div 64 AS int) AS slot", "shiftleft(1L, cast(at % 64 AS int)) AS bit")
    return bit.groupBy("slot").agg(F.bit_or("bit").alias("bits"))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str, at_once: int = AT_ONCE) -> Iterator[tuple]:
    """Rows of Arrow batches as Python values, a slice at a time, so that few texts are held twice."""
    for batch in batches:
        for start in range(0, batch.num_rows, at_once):
            part = batch.slice(start, at_once)
            yield from zip(*(part.column(name).to_pylist() for name in names), strict=True)


def packed_sieve(bits: DataFrame) -> bytes:
    """A sieve as bytes, for tasks: bit ``crc % SIEVE_BITS``, the least of each byte first."""
    table, words = bits.toArrow(), np.zeros(SIEVE_BITS // 64, "<i8")
    words[table.column("slot").to_numpy()] = table.column("bits").to_numpy()
    return words.tobytes()


class Rows:
    """Collects rows into record batches of bounded size: ``add`` a row, yield what ``full`` and ``rest`` give."""

    def __init__(self, schema: pa.Schema, most: int = 4096, most_bytes: int = 8 << 20):
        self.schema, self.most, self.most_bytes = schema, most, most_bytes
        self._columns: list[list] = [[] for _ in schema.names]
        self._bytes = 0

    def add(self, *row, size: int = 0) -> bool:
        for column, value in zip(self._columns, row, strict=True):
            column.append(value)
        self._bytes += size
        return len(self._columns[0]) >= self.most or self._bytes >= self.most_bytes

    def take(self) -> Iterator[pa.RecordBatch]:
        if self._columns[0]:
            arrays = [pa.array(values, kind) for values, kind in zip(self._columns, self.schema.types, strict=True)]
            self._columns, self._bytes = [[] for _ in self.schema.names], 0
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)
