"""Best-fit packing with a bounded number of open bins.

Texts are encoded in the tasks that read them; only their pieces' lengths and checksums move on. Pieces are dealt by a
hash, ordered within a task by another, and put one by one into the open bin they fill best. Open bins are keyed by
their free space in a bitset, so the best bin is the lowest set bit at or above the length. When all bins are open and
none fits, the fullest is closed. Dealing and order depend on content alone, so a task run again gives the same bins.

Null text is empty; an empty text is one piece that holds only the end id. Repeated rows are packed each.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from .common import Rows, pair, rows_of
from .words import BatchMemo, word_encoder, encoded, packed_ids, tokenizer

CAPACITY = 2048
OPEN_BINS = 1024
END_ID = 0
#: Fixed value: what the last token of a word ends in. Words that the library encodes as one text.
WORD_END, WORDS_AT_ONCE = "</w>", 2048
#: Bytes of one generation of a worker's memo: workers live on while other stages run.
MEMO_BYTES = 56 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class OpenBins:
    """At most ``most`` bins that still have room, as a bitset over free space with a stack of bins per bit."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS):
        self.capacity, self.most = capacity, most
        self.mask, self.count, self.made = 0, 0, 0
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bin_ = self.stacks[free].pop()
        if not self.stacks[free]:
            self.mask &= ~(1 << free)
        self.count -= 1
        return bin_

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the offset there of a piece of 1 to ``capacity`` tokens."""
        fitting = self.mask >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if self.count >= self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
            self.stacks[left].append(bin_)
            self.mask |= 1 << left
            self.count += 1
        return bin_, self.capacity - free


@lru_cache(maxsize=2)
def encoder(path: str) -> BatchMemo:
    """One per worker process, so that later tasks find what earlier ones encoded."""
    library = tokenizer(path)
    return word_encoder(ids_of_words(library), library, MEMO_BYTES)


def ids_of_words(library) -> Callable[[list[str]], list[bytes]]:
    """Packed ids of many words: a line each of one text, cut after the tokens that end a word."""
    ends = np.array([(library.id_to_token(i) or "").endswith(WORD_END) for i in range(library.get_vocab_size(with_added_tokens=True))])

    def singly(words: list[str]) -> list[bytes]:
        return [packed_ids(x.ids) for x in library.encode_batch_fast(words, add_special_tokens=False)]

    def run(words: list[str]) -> list[bytes]:
        found: list[bytes] = []
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at:at + WORDS_AT_ONCE]
            [made] = library.encode_batch_fast(["\n".join(part)], add_special_tokens=False)
            ids = np.array(made.ids, "<u4")
            stops = (4 * np.flatnonzero(ends[ids]) + 4).tolist()
            data = ids.tobytes()
            found += [data[a:b] for a, b in zip([0, *stops], stops)] if len(stops) == len(part) else singly(part)
        return found
    return run


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = packed_ids([end_id])
        out = Rows(pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                              ("length", pa.int64()), ("ids_crc32", pa.int64())]))
        for idents, ids in encoded(rows_of(batches, "doc_id", "text"), encoder(path)):
            for ident, data in zip(idents, ids):
                data = memoryview(data + end)
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    piece = data[at:at + 4 * capacity]
                    if out.add(ident, k, at // 4, len(piece) // 4, zlib.crc32(piece)):
                        yield from out.take()
        yield from out.take()
        encoder(path).rest()
    return run


def _fill(capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, first = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.put(x) for x in batch.column("length").to_pylist()]
            columns = [*batch.columns, pa.array([first + b for b, _ in placed], pa.int64()),
                       pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "sequence_id", "offset"])
    return run


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The encoded texts, each followed by ``end_id``, in pieces of at most ``capacity`` tokens."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    return pair(docs, doc_id, text).mapInArrow(_cut(path, capacity, end_id), PIECES)


def best_fit(items: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds the sequence of each piece and its offset there. Sequences are numbered within their task's own range."""
    dealt = items.repartition(F.xxhash64("doc_id", "piece"))
    order = F.xxhash64("piece", "doc_id", F.lit(1))
    sorted_ = dealt.sortWithinPartitions(order, "doc_id", "piece", "length", "ids_crc32")
    return sorted_.mapInArrow(_fill(capacity, open_bins), PACKED)


def packed(docs: DataFrame, path: str | None = None, **names: str) -> DataFrame:
    """Per piece of every document: its place in a sequence of at most 2048 tokens."""
    return best_fit(pieces(docs, path, **names))
