"""Token counts by batch encoding in Arrow functions that return lengths only.

Long texts are cut before single spaces between two other characters, where a token of a byte-level vocabulary always
begins. Segments are gathered into batches of about equal bytes; the fragments of a batch that its task has not met yet
are encoded by the library in one call, and only their lengths are kept. No ids leave a task.

Null and empty texts have no tokens. A text without any space is one fragment, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from .common import Rows, pair, rows_of
from .words import BatchMemo, segments, tokenizer

BATCH_BYTES = 1 << 20
LIMIT = 1024

_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")
_MIXED = re.compile(r"\s \s")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def fragments(segment: str) -> list[str]:
    """A segment cut before its spaces. Where spaces meet other white space only lone spaces are cut."""
    first, *rest = _BETWEEN.split(segment) if _MIXED.search(segment) else segment.split(" ")
    return [first, *(" " + x for x in rest)] if first else [" " + x for x in rest]


@lru_cache(maxsize=2)
def lengths(path: str) -> BatchMemo:
    """The lengths of fragments, one memo per worker process."""
    library = tokenizer(path)
    return BatchMemo(lambda found: [*map(len, library.encode_batch_fast(found, add_special_tokens=False))])


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lengths(path)
        out = Rows(pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())]))
        rows: list[list] = []
        waiting: list[tuple[list, list[str]]] = []
        held = 0

        def encode() -> None:
            known.learn([found for _, found in waiting])
            for row, found in waiting:
                row[2] += sum(map(known.__getitem__, found))
            waiting.clear()

        def done():
            for row in rows:
                if out.add(*row):
                    yield from out.take()
            rows.clear()

        for ident, text in rows_of(batches, "doc_id", "text"):
            row = [ident, len(text.encode()), 0]
            rows.append(row)
            for segment in segments(text, _CUT):
                waiting.append((row, fragments(segment)))
                held += len(segment)
                if held >= BATCH_BYTES:
                    encode()
                    held = 0
            if not waiting:
                yield from done()
        encode()
        yield from done()
        yield from out.take()
    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: bytes, tokens, and whether the tokens exceed ``limit``. ``path`` must exist on every machine."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    counted = pair(docs, doc_id, text).mapInArrow(_lengths(path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
