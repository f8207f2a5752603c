"""How far the sources of a language differ: sparse merges of term counts, one task per pair of groups.

A group is a language and a source. A language keeps the terms found in ``LEAST_DOCS`` of its documents or more; each
kept term has a smoothed share p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)) in every group and in the language as a
whole. Two shares p and q differ by floor((p - q)^2 / (p + q)). Groups are compared with each other over all kept terms,
and with their language term by term. All numbers are whole.

The kept terms of a language are cut into blocks of about ``BLOCK_TERMS`` and numbered within them. In a block a group is
two sorted arrays, term ids and counts. A task co-groups, for one block, two tiles of ``TILE`` groups and merges every
unordered pair of their groups once: the shorter list gallops through the longer one, and terms of both, of one and of
neither are priced apart. Neither a language, nor a term, nor a group with a third of all words is ever in one task:
words are counted where they are read, blocks bound what is merged, and the ranks of a group are cut before its shuffle.

Null text, language or source count as empty. A group without kept terms has only the share of an absent term; where a
language keeps none, pairs have the value 0 and there are no term rows. Repeated rows count as often as they occur.
Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelore.session import cut_lineage, spread

from .common import Rows, rows_of

#: Fixed values of the contract.
LEAST_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Terms of a block on average, groups of a tile, and distinct (group, term) entries a reading task holds at most.
BLOCK_TERMS, TILE, HELD = 1 << 16, 8, 1 << 18
#: Bytes of a text that are cut into terms at once.
SLICE = 1 << 20
#: Steps in which the thousand millions of SCALE are multiplied, so that counts up to 9e15 stay whole in 64 bits.
_STEPS = 3

#: Letters A to Z become small, bytes of other characters than ASCII stay, all else parts terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTS = "lang string, source string, term binary, n long, docs long"
PARTS = "lang string, a int, b int, value long"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded number of bytes at a time, none of them cut."""
    start = 0
    while start < len(text):
        part = text[start:start + SLICE].translate(_FOLD)
        if start + SLICE < len(text):
            end = part.rfind(b" ") + 1
            while not end:  # one long term: go on to its end
                more = text[start + len(part):start + len(part) + SLICE].translate(_FOLD)
                if not more:
                    end = len(part)
                    break
                at = more.find(b" ")
                part, end = part + more, len(part) + at + 1 if at >= 0 else 0
            part = part[:end]
        start += len(part)
        yield part.split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Rows(pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())]))
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in seen.items():
            for term, k in n.items():
                if out.add(lang, source, term, k, docs[term], size=len(term)):
                    yield from out.take()
        yield from out.take()

    for text, lang, source in rows_of(batches, "text", "lang", "source"):
        n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
        held -= len(n)
        own: set[bytes] = set()
        for found in terms_of(text):
            n.update(found)
            own.update(found)
        docs.update(own)
        held += len(n)
        if held > HELD:
            yield from given()
            seen, held = {}, 0
    yield from given()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term`` (UTF-8), ``n`` occurrences and ``docs`` documents, once for each of them."""
    read = docs.select(F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"),
                       F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(docs["source"].cast("string"), F.lit("")).alias("source"))
    return read.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str | Column, total: str | Column, terms: str | Column) -> Column:
    """The smoothed share as a whole number, exact for any counts."""
    n, total, terms = (F.col(x) if isinstance(x, str) else x for x in (n, total, terms))
    wide = lambda x: x.cast("decimal(20,0)")
    return 1 + F.call_function("div", wide(n + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + 2 * terms))


def difference(p: str, q: str) -> Column:
    """How far two shares differ, as a whole number."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """As ``share``, for an array: SCALE is multiplied in three steps of a thousand, as in long division."""
    of, rest, found = np.int64(total + 2 * terms), counts.astype(np.int64) + 2, np.zeros(len(counts), np.int64)
    for _ in range(_STEPS):
        rest = rest * 1000
        digit = rest // of
        rest -= digit * of
        found = found * 1000 + digit
    return found + 1


def differences(p: np.ndarray, q: np.ndarray) -> int:
    return int(((p - q) * (p - q) // (p + q)).sum())


def gallop(probes: np.ndarray, among: np.ndarray) -> np.ndarray:
    """For each of the sorted probes the first place in the sorted list that is not below it.

    Probes go in runs. Each starts where its run starts, doubles its step until it has passed its value, and halves
    it back; all of them step at once.
    """
    if not len(among):
        return np.zeros(len(probes), np.int64)
    low = np.repeat(np.searchsorted(among, probes[::32]), 32)[:len(probes)]
    step, at = np.ones(len(probes), np.int64), np.arange(len(probes))
    while len(at):  # low: all before it is below the probe; low + step: the next place to look at
        ahead = np.minimum(low[at] + step[at], len(among)) - 1
        at = at[(ahead >= low[at]) & (among[np.maximum(ahead, 0)] < probes[at])]
        low[at] = np.minimum(low[at] + step[at], len(among))
        step[at] *= 2
    while (step > 0).any():
        ahead = low + step - 1
        go = (step > 0) & (ahead < len(among))
        go[go] = among[ahead[go]] < probes[go]
        low[go] += step[go]
        step //= 2
    return low


class _Group:
    """A group in one block: sorted term ids, their shares, and the share of a term it lacks."""

    def __init__(self, number: int, ids: np.ndarray, counts: np.ndarray, total: int, terms: int):
        self.number, self.ids = number, ids
        self.shares = shares(counts, total, terms) if terms else counts
        self.absent = shares(np.zeros(1, np.int64), total, terms)[0] if terms else np.int64(1)


def _groups(tile: pa.Table) -> list[_Group]:
    numbers, totals, terms = (tile.column(x).to_pylist() for x in ("number", "total", "terms"))
    lists = tile.column("entries").combine_chunks()
    starts, entries = lists.offsets.to_numpy(), lists.values
    ids, counts = (np.asarray(entries.field(x)) for x in ("id", "n"))
    return [_Group(numbers[k], ids[starts[k]:starts[k + 1]], counts[starts[k]:starts[k + 1]], totals[k], terms[k])
            for k in range(tile.num_rows)]


def merged(one: _Group, two: _Group, terms: int) -> int:
    """The differences of two groups, summed over all ``terms`` of a block."""
    short, long = (one, two) if len(one.ids) <= len(two.ids) else (two, one)
    places = gallop(short.ids, long.ids)
    within = places < len(long.ids)
    both = within.copy()
    both[within] = long.ids[places[within]] == short.ids[within]
    alone = np.ones(len(long.ids), bool)
    alone[places[both]] = False
    neither = terms - len(short.ids) - len(long.ids) + int(both.sum())
    return (differences(short.shares[both], long.shares[places[both]]) + differences(short.shares[~both], long.absent)
            + differences(long.shares[alone], short.absent)
            + neither * differences(np.array([one.absent]), np.array([two.absent])))


def _merge_tiles(first: pa.Table, second: pa.Table) -> pa.Table:
    """The unordered pairs of the groups of two tiles, or of one tile with itself."""
    found: list[tuple] = []
    if first.num_rows and second.num_rows:
        lang, terms, in_block, i, j = (first.column(x)[0].as_py() for x in ("lang", "terms", "block_terms", "i", "j"))
        partners = _groups(second)
        for a in _groups(first):
            found += [(lang, a.number, b.number, merged(a, b, in_block) if terms else 0) for b in partners if i != j or a.number < b.number]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
    columns = zip(*found) if found else [()] * 4
    return pa.table([pa.array(x, kind) for x, kind in zip(columns, kinds)], names=["lang", "a", "b", "value"])


def _ranked(values: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.col("item").cast("binary"))
    made = values.withColumn("rank", F.row_number().over(order))
    if most:
        made = made.filter(F.col("rank") <= most)
    return made.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair, term), ``item``, ``value``, ``rank``. Needs ``text``, ``lang``, ``source``."""
    counted = term_counts(docs).withColumn("term_docs", F.sum("docs").over(Window.partitionBy("lang", "term")))
    counted = cut_lineage(counted.filter(F.col("term_docs") >= least_docs).select("lang", "source", "term", "n"))
    of_lang = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    sizes = of_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = docs.select(*(F.coalesce(docs[x].cast("string"), F.lit("")).alias(x) for x in ("lang", "source"))).distinct()
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = cut_lineage(named.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(
        0, ["total", "terms", "lang_total"]).withColumn("number", number).withColumn(
        "blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / BLOCK_TERMS)).cast("int")).withColumn(
        "last", F.expr(f"cast((count(1) OVER (PARTITION BY lang) - 1) div {TILE} AS int)")))

    # Terms meet the sizes of their language in as many slices as there are tasks, so that no language is in one of them.
    slices = spread(docs.sparkSession)
    blocks = groups.select("lang", "blocks").distinct().withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    dealt = of_lang.withColumn("slice", F.expr(f"cast(pmod(xxhash64(term, 1), {slices}) AS int)")).join(blocks, ["lang", "slice"])
    dealt = dealt.withColumn("block", F.expr("cast(pmod(xxhash64(term), blocks) AS int)"))
    ids = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term"))
    terms = cut_lineage(dealt.select("lang", "term", "lang_n", "block", ids.alias("id")))
    known = cut_lineage(counted.join(terms, ["lang", "term"]).join(
        groups.select("lang", "source", "number", "total", "terms", "lang_total"), ["lang", "source"]))

    p, q = share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q")
    above = known.select("lang", "source", F.col("term").cast("string").alias("item"), p, q).filter("p > q")
    term_part = _ranked(above.select("lang", "source", "item", difference("p", "q").alias("value")), "term", top)

    entries = known.groupBy("lang", "number", "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("entries"))
    in_block = terms.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("block_terms"))
    every = groups.select("lang", "number", "total", "terms", "last", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    lists = every.join(in_block, ["lang", "block"], "left").join(entries, ["lang", "number", "block"], "left").select(
        "lang", "number", "block", "total", "terms", "last", F.coalesce("block_terms", F.lit(0)).cast("bigint").alias("block_terms"),
        F.coalesce("entries", F.expr("cast(array() AS array<struct<id:int,n:bigint>>)")).alias("entries"),
        F.expr(f"number div {TILE}").cast("int").alias("tile"))
    placed = cut_lineage(lists)
    fields = ("lang", "block", "number", "total", "terms", "block_terms", "entries")
    first = placed.select(*fields, F.col("tile").alias("i"), F.explode(F.expr("sequence(tile, last)")).alias("j"))
    second = placed.select(*(F.col(x).alias(f"other_{x}") for x in fields[:2]), *(F.col(x).alias(x) for x in fields[2:]),
                           F.explode(F.expr("sequence(0, tile)")).alias("other_i"), F.col("tile").alias("other_j"))
    first, second = first.groupBy("lang", "block", "i", "j"), second.groupBy("other_lang", "other_block", "other_i", "other_j")
    parts = first.cogroup(second).applyInArrow(_merge_tiles, PARTS)
    values = cut_lineage(parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = values.select("lang", "value", F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    name = groups.select("lang", "number", "source")
    pairs = both.join(name.withColumnRenamed("number", "a"), ["lang", "a"]).join(
        name.select("lang", F.col("number").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    return _ranked(pairs.select("lang", "source", "item", "value"), "pair").union(term_part)
