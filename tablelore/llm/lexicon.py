"""BPE encoding and decoding with a minimal acyclic transducer over frequent words.

Words that make up a stated share of the corpus are compiled, with their ids as outputs, into an automaton whose equal
suffixes are one. Its image is a flat file in the shared folder, sent to every executor as a Spark file and mapped into
memory there, once for all its workers. A word's number is the sum of the counts along its path; ids are stored by
number. Words that the automaton does not hold are merged exactly by the vocabulary's ranks.

``frequent`` bounds the lexicon by its definition: fewer than ``most`` words can each make up more than 1 / ``most`` of
all words, and none has more than ``MOST_LETTERS`` letters. Null and empty texts have no ids and decode to an empty text.
"""

from __future__ import annotations

import heapq
import json
import mmap
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelore.session import cut_lineage, write_shared

from .common import pair, rows_of
from .words import BatchMemo, groups, listed, packed_ids, tokenizer, word_counts, word_encoder

MOST_WORDS = 200_000
#: Letters of a word in the lexicon; longer words are merged when they are met, so that lookups stay narrow.
MOST_LETTERS = 64
#: Symbols from which a word is merged by a heap: the plain way takes time by the square of the length.
LONG_WORD = 200
#: Bytes of the words that are merged side by side, and how many of them at once.
SIDE_BY_SIDE, AT_ONCE = 32, 8192
WORD_END = "</w>"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next unused code point from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merges:
    """Exact merging of one word: always the pair of lowest rank, the leftmost first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.ids, self.symbols = model["vocab"], byte_symbols()
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self._number()

    def _number(self) -> None:
        """The same as arrays: symbols by number, pairs as sorted keys with their ranks, and by rank what a pair becomes."""
        numbers: dict[str, int] = {}

        def number(symbol: str) -> int:
            return numbers.setdefault(symbol, len(numbers))

        self.first = np.array([number(x) for x in self.symbols], np.int32)
        self.last = np.array([number(x + WORD_END) for x in self.symbols], np.int32)
        pairs = np.array([number(a) << 32 | number(b) for a, b in self.ranks] or [-1], np.int64)
        ranks = np.array([*self.ranks.values()] or [0], np.int32)
        self.none = len(pairs) and int(ranks.max()) + 1
        self.becomes = np.full(self.none, -1, np.int32)
        self.becomes[ranks[:len(self.ranks)]] = [number(a + b) for a, b in self.ranks]
        order = np.argsort(pairs)
        self.pairs, self.pair_ranks = pairs[order], ranks[order]
        self.numbered = np.array([self.ids.get(x, -1) for x in numbers], np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``none`` where two symbols are not merged; a number below 0 is no symbol."""
        key = left.astype(np.int64) << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (right >= 0) & (left >= 0), self.pair_ranks[at], self.none)

    def many(self, words: list[str]) -> list[bytes]:
        """The packed ids of each word: words of few bytes are merged side by side, a pair of each at a time."""
        spelled = [x.encode() for x in words]
        short = [k for k, x in enumerate(spelled) if 0 < len(x) <= SIDE_BY_SIDE and b"\0" not in x]
        short.sort(key=lambda k: len(spelled[k]))
        made: list[bytes | None] = [None] * len(words)
        for start in range(0, len(short), AT_ONCE):
            part = short[start:start + AT_ONCE]
            for k, ids in zip(part, self._side_by_side([spelled[k] for k in part]), strict=True):
                made[k] = ids
        return [packed_ids(self(word)) if ids is None else ids for word, ids in zip(words, made)]

    def _side_by_side(self, words: list[bytes]) -> list[bytes]:
        lengths = np.array([len(x) for x in words])
        width = int(lengths.max())
        letters = np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width)
        found = np.where(np.arange(width) < lengths[:, None], self.first[letters], -1).astype(np.int32)
        ends = np.arange(len(words)), lengths - 1
        found[ends] = self.last[letters[ends]]
        rows, now = np.arange(len(words)), found
        ranks = self._ranks(now[:, :-1], now[:, 1:])
        while ranks.shape[1]:
            at = ranks.argmin(1)
            least = ranks[np.arange(len(ranks)), at]
            open_ = least < self.none
            found[rows[~open_], :now.shape[1]] = now[~open_]
            if not open_.any():
                break
            rows, now, ranks, at, least = rows[open_], now[open_], ranks[open_], at[open_], least[open_]
            each = np.arange(len(rows))
            # What lies behind the pair moves up by one; the symbols and ranks of one column less remain.
            found[rows, now.shape[1] - 1] = -1
            keep = np.arange(now.shape[1] - 1)
            behind = keep >= at[:, None]
            now = np.where(behind, now[:, 1:], now[:, :-1])
            now[each, at] = self.becomes[least]
            ranks = np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1])
            if not ranks.shape[1]:
                found[rows, :now.shape[1]] = now
                break
            inner = at > 0
            ranks[each[inner], at[inner] - 1] = self._ranks(now[each[inner], at[inner] - 1], now[each[inner], at[inner]])
            inner = at < ranks.shape[1]
            ranks[each[inner], at[inner]] = self._ranks(now[each[inner], at[inner]], now[each[inner], at[inner] + 1])
        ids = np.where(found >= 0, self.numbered[found], -1)
        held = ids >= 0
        packed, stops = ids[held].astype("<u4").tobytes(), (4 * np.cumsum(held.sum(1))).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops)]

    def __call__(self, word: str) -> list[int]:
        found = [self.symbols[b] for b in word.encode()]
        if not found:
            return []
        found[-1] += WORD_END
        if len(found) > LONG_WORD:
            return [self.ids[x] for x in self._merged_by_heap(found) if x in self.ids]
        none = len(self.ranks)
        ranks = [self.ranks.get(x, none) for x in zip(found, found[1:])]
        while ranks and (least := min(ranks)) < none:
            k = ranks.index(least)
            found[k:k + 2] = [found[k] + found[k + 1]]
            del ranks[k]
            for at in (k - 1, k):
                if 0 <= at < len(ranks):
                    ranks[at] = self.ranks.get((found[at], found[at + 1]), none)
        return [self.ids[x] for x in found if x in self.ids]


    def _merged_by_heap(self, found: list[str]) -> list[str]:
        """The same for a long word: pairs wait in a heap by rank and place, and neighbours are linked."""
        size = len(found)
        before, after = [*range(-1, size - 1)], [*range(1, size + 1)]
        waiting = [(rank, k, found[k], found[k + 1]) for k in range(size - 1) if (rank := self.ranks.get((found[k], found[k + 1]))) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, k, left, right = heapq.heappop(waiting)
            other = after[k]
            if other >= size or found[k] != left or found[other] != right:
                continue  # one of the two has been merged since
            found[k], found[other], after[k] = left + right, "", after[other]
            if after[k] < size:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < size and (rank := self.ranks.get((found[a], found[b]))) is not None:
                    heapq.heappush(waiting, (rank, a, found[a], found[b]))
        return [x for x in found if x]


class _State:
    __slots__ = ("edges", "final")

    def __init__(self) -> None:
        self.edges: dict[int, _State] = {}
        self.final = False

    def signature(self) -> tuple:
        return self.final, tuple((byte, id(state)) for byte, state in self.edges.items())


def compiled(words: Iterable[str], ids_of) -> bytes:
    """The image of the minimal automaton over the words, with the ids of each by its number in byte order."""
    spelled = sorted({word.encode() for word in words if word})
    register: dict[tuple, _State] = {}
    root, path, last, counts = _State(), [], b"", {}

    def close(depth: int) -> None:
        while len(path) > depth:
            above, byte, state = path.pop()
            kept = above.edges[byte] = register.setdefault(state.signature(), state)
            # Closed states are below this one, so their counts are known.
            counts[id(kept)] = kept.final + sum(counts[id(x)] for x in kept.edges.values())

    for word in spelled:
        common = next((k for k, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        close(common)
        state = path[-1][2] if path else root
        for byte in word[common:]:
            below = _State()
            state.edges[byte] = below
            path.append((state, byte, below))
            state = below
        state.final, last = True, word
    close(0)

    numbers, order = {id(root): 0}, [root]
    for state in order:
        for other in state.edges.values():
            if id(other) not in numbers:
                numbers[id(other)] = len(order)
                order.append(other)

    keys, targets, skips = [], [], []
    for state in order:
        before = int(state.final)
        for byte, other in state.edges.items():
            keys.append(numbers[id(state)] << 8 | byte)
            targets.append(numbers[id(other)])
            skips.append(before)
            before += counts[id(other)]
    outputs = [ids_of(word.decode()) for word in spelled]
    blocks = [
        np.array(keys, "<i8"), np.array(targets, "<i8"), np.array(skips, "<i8"),
        np.array([x.final for x in order], "<i8"), np.cumsum([0, *map(len, outputs)], dtype="<i8"),
        np.array([i for x in outputs for i in x], "<i8")]
    head = np.array([max(map(len, spelled), default=0), *map(len, blocks)], "<i8")
    return b"".join(x.tobytes() for x in (head, *blocks))


class Transducer:
    """Looks words up in an image, many at a time."""

    def __init__(self, image):
        values = np.frombuffer(image, "<i8")
        self.longest, *sizes = values[:7].tolist()
        ends = np.cumsum([7, *sizes])
        self.keys, self.targets, self.skips, self.final, self.offsets, self.ids = (
            values[a:b] for a, b in zip(ends, ends[1:]))

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the automaton does not hold it."""
        lengths = np.array([len(x) for x in words], np.int64)
        alive = (lengths > 0) & (lengths <= self.longest)
        found = np.full(len(words), -1, np.int64)
        if not alive.any() or not len(self.keys):
            return found
        letters = np.array([x[:self.longest] for x in words], f"S{self.longest}").view(np.uint8)
        letters = letters.reshape(len(words), self.longest)
        at, state, number = np.flatnonzero(alive), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for k in range(self.longest):
            at = at[lengths[at] > k]
            if not len(at):
                break
            key = state[at] << 8 | letters[at, k]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            held = self.keys[edge] == key
            alive[at[~held]] = False
            at, edge = at[held], edge[held]
            number[at] += self.skips[edge]
            state[at] = self.targets[edge]
        done = alive & (self.final[state] == 1)
        found[done] = number[done]
        return found

    def output(self, number: int) -> np.ndarray:
        return self.ids[self.offsets[number]:self.offsets[number + 1]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in groups(rows_of(batches, "text")):
        found, counts = word_counts([text for text, in group])
        for start in range(0, len(found), 1 << 16):
            yield pa.RecordBatch.from_arrays([found[start:start + (1 << 16)], counts[start:start + (1 << 16)]], ["word", "count"])


def frequent(docs: DataFrame, most: int = MOST_WORDS, doc_id: str = "doc_id", text: str = "text") -> list[str]:
    """The lower-cased words, not overlong, that each make up more than 1 / ``most`` of the words met more than once."""
    found = pair(docs, doc_id, text).select("text").mapInArrow(_count, "word string, count long")
    counts = cut_lineage(found.groupBy("word").agg(F.sum("count").alias("count"))
                         .filter((F.col("count") > 1) & (F.length("word").between(1, MOST_LETTERS))))
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    return [row.word for row in counts.filter(F.col("count") * most > total).select("word").collect()]


def published(spark: SparkSession, image: bytes) -> str:
    """Writes the image into the shared folder and has Spark send it to executors; gives the name of their copy."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(write_shared(spark, name, image))
    return name


@lru_cache(maxsize=1)
def encoder(path: str, name: str) -> BatchMemo:
    """One per worker process, the last asked for: the mapped lexicon first, merging for the words it lacks."""
    lexicon, merges = Transducer.mapped(SparkFiles.get(name)), Merges(path)

    def of_words(words: list[str]) -> list[bytes]:
        numbers = lexicon.numbers([x.encode() for x in words]).tolist()
        others = iter(merges.many([word for word, n in zip(words, numbers) if n < 0]))
        return [packed_ids(lexicon.output(n).tolist()) if n >= 0 else next(others) for n in numbers]

    return word_encoder(of_words, tokenizer(path))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> pa.Array:
    library = tokenizer(path)
    return pa.array([library.id_to_token(i) for i in range(library.get_vocab_size(with_added_tokens=True))], pa.string())


def decoded(ids: pa.ListArray, path: str) -> pa.Array:
    """The tokens of each list, with a space between: what the library's decode gives for a file without a decoder."""
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, vocabulary(path).take(ids.values)), " ")


def _encode(path: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(rows_of(batches, "doc_id", "text")):
            ids = listed([text for _, text in group], encoder(path, name))
            yield pa.RecordBatch.from_arrays([pa.array([ident for ident, _ in group], pa.int64()), ids, decoded(ids, path)],
                                             ["doc_id", "ids", "decoded"])
        encoder(path, name).rest()
    return run


def encode(docs: DataFrame, path: str | None = None, most: int = MOST_WORDS,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``ids`` as the library gives them without special tokens added, and ``decoded``, those ids decoded."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    merges = Merges(path)
    name = published(docs.sparkSession, compiled(frequent(docs, most, doc_id, text), merges))
    return pair(docs, doc_id, text).mapInArrow(_encode(path, name), "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds nothing to ``doc_id`` but ``decoded``, from ``ids``; null ids are empty."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            plain = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *pc.list_value_length(ids).to_pylist()]), pa.int32()),
                                             pc.list_flatten(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), decoded(plain, path)], ["doc_id", "decoded"])
    ids = F.coalesce("ids", F.array().cast("array<int>")).alias("ids")
    return encoded.select("doc_id", ids).mapInArrow(run, "doc_id long, decoded string")
