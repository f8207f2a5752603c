"""Near-duplicates by circulant MinHash.

The set of a text is its distinct word shingles, as 64-bit hashes. One permutation scatters the set over a fixed range,
a second one is shifted by one place per coordinate, and the minimum under each shift is a coordinate of the signature:
two permutations stand for all. Bands of coordinates put texts into buckets; links are confirmed on the full sets.

Texts with equal sets are one class from the start. No pairs of a bucket are listed: first every bucket compares its
members with one pivot, the member that shares most buckets with others, which links a family to its origin. Then, as
long as the members of a bucket lie in several components, it compares ``PIVOTS`` members outside its largest component
with all others, and gives them up. Members that are already connected are not compared again, and no bucket is left
before its members are one component or each pair was compared. A pair just at the threshold shares no bucket with a
chance of 8e-7 at 85 % and 7e-5 at 80 %, less for closer pairs. Two sketches keep pairs that cannot be links from
becoming rows: least values tell unlike long texts apart, and parities bound how many shingles two sets do not share,
so that of a large family just below the threshold hardly a pair is left to confirm.

Null, empty and blank texts have no set and are linked with nothing. A component is named by its smallest id; where no
row of it has an id the name is null. Repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelore.session import cut_lineage

from .common import Rows, free_name, pair, rows_of

BANDS, BAND_ROWS = 24, 5
RANGE = 1 << 20
#: Lowest bits of so many coordinates are a text's sketch. Pairs whose sketches differ in more bits than those of a
#: pair at the threshold, by so many deviations, are not compared.
SKETCH_BITS = 1024
DEVIATIONS = 5.5
#: Members of a bucket that one round compares with all others there, after the first.
PIVOTS = 512

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
SETS = "doc_id long, content binary, n_shingles long, name binary, bands array<long>, sketch array<long>, parities array<long>"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and all shifts of the circulant one as windows of one array."""
    places = np.arange(RANGE, dtype=np.uint64)
    first = np.argsort(mixed(places + _ODD[0]), kind="stable").astype(np.uint32)
    second = np.argsort(mixed(places + _ODD[1]), kind="stable").astype(np.uint32)
    circle = np.concatenate([second, second[:SKETCH_BITS - 1]])
    return first, np.lib.stride_tricks.sliding_window_view(circle, SKETCH_BITS)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``words`` words, A to Z lower-cased; a shorter text is one shingle."""
    spelled = text.encode().lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, spelled), np.uint64, len(spelled))
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    found = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        found = mixed(found * _ODD[0] + hashes[k:len(hashes) - width + 1 + k])
    return np.unique(found)


def signature(shingles: np.ndarray) -> np.ndarray:
    first, shifts = permutations()
    places, least = first[shingles >> np.uint64(44)], np.full(SKETCH_BITS, RANGE, np.uint32)
    for at in range(0, len(places), 512):
        np.minimum(least, shifts[places[at:at + 512]].min(axis=0), out=least)
    return least


def band_hashes(coordinates: np.ndarray) -> np.ndarray:
    rows = coordinates[:BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype(np.uint64)
    found = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        found = mixed(found * _ODD[2] + rows[:, k])
    return found.view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether the number of shingles is odd, for each of ``SKETCH_BITS`` classes of hashes.

    Two sets differ in no more of these bits than there are shingles in only one of them.
    """
    odd = np.bincount((shingles % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(pa.schema([
            ("doc_id", pa.int64()), ("content", pa.binary()), ("n_shingles", pa.int64()), ("name", pa.binary()),
            ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("parities", pa.list_(pa.int64()))]))
        for ident, text, content in rows_of(batches, "doc_id", "text", "content"):
            found = shingle_set(text, words)
            row = (ident, content, 0, None, None, None, None)
            if len(found):
                coordinates = signature(found)
                row = (ident, content, len(found), xxhash.xxh3_128_digest(found.tobytes()), band_hashes(coordinates),
                       np.packbits((coordinates & 1).astype(np.uint8)).view(np.int64), parities(found))
            if out.add(*row):
                yield from out.take()
        yield from out.take()
    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(pa.schema([("class", pa.int64()), ("shingles", pa.list_(pa.int64()))]))
        for name, text in rows_of(batches, "class", "text"):
            found = shingle_set(text, words)
            if out.add(name, found.view(np.int64), size=8 * len(found)):
                yield from out.take()
        yield from out.take()
    return run


#: What is known of an entry of a bucket.
FIELDS = ("class", "n_shingles", "label", "sketch", "parities")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``label``, the least node it can reach, for all nodes of the links.

    Alternates the large-star and small-star steps: a star's edges move from its centre to its least neighbour. Each
    step is an aggregate and a join, so no component is ever in one place.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges, before = cut_lineage(edges, few=True), None
    while True:
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.inline(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        edges = cut_lineage(small.filter("u <> v").distinct(), few=True)
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("label")),
                                         F.struct(F.col("v").alias("node"), F.col("v").alias("label"))))).distinct()


def _differing(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    words = (F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(SKETCH_BITS // 64))
    return reduce(lambda x, y: x + y, words)


def most_differing(percent: int) -> float:
    """Differing bits that a pair at the threshold has at most, but for a chance below 1e-7."""
    chance = (1 - percent / 100) / 2
    return SKETCH_BITS * chance + DEVIATIONS * (SKETCH_BITS * chance * (1 - chance)) ** 0.5


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` of classes whose full sets are similar by at least ``percent``."""
    likely = pairs
    for side in "ab":
        likely = likely.join(sets.select(F.col("class").alias(side), F.col("shingles").alias(f"t{side}")), side)
    common = F.size(F.array_intersect("ta", "tb"))
    counted = likely.select("a", "b", common.alias("common"), (F.size("ta") + F.size("tb")).alias("total"))
    return counted.filter(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b")


def _buckets(classes: DataFrame) -> DataFrame:
    """Entries ``bucket``, ``class``, ``n_shingles``, ``weight`` of all buckets with two classes or more."""
    entries = classes.select("class", "n_shingles", F.explode("bands").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = cut_lineage(entries.join(sizes, "bucket"))
    weights = shared.groupBy("class").agg(F.sum("size").alias("weight"))
    known = weights.join(classes.select("class", "sketch", "parities"), "class")
    return cut_lineage(shared.drop("size").join(known, "class").withColumn("label", F.col("class")))


def _pairs(entries: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of an entry and a pivot of its bucket that differ in label and may be similar by size and sketches."""
    total = F.col("n_shingles") + F.col("p_n_shingles")
    other = pivots.select("bucket", *(F.col(x).alias(f"p_{x}") for x in FIELDS))
    joined = entries.join(other, "bucket").filter(
        (F.col("label") != F.col("p_label"))
        & ((100 + percent) * _differing("parities", "p_parities") <= (100 - percent) * total)
        & (_differing("sketch", "p_sketch") <= most_differing(percent))
        & (100 * F.least("n_shingles", "p_n_shingles") >= percent * F.greatest("n_shingles", "p_n_shingles")))
    return joined.select(F.least("class", "p_class").alias("a"), F.greatest("class", "p_class").alias("b")).distinct()


def _open_entries(entries: DataFrame) -> DataFrame:
    """The entries of buckets with several labels, with the most frequent one as ``major``."""
    parts = entries.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("x"), F.sum("n").alias("size"))
    several = largest.filter(F.col("x.n") < F.col("size")).select("bucket", F.col("x.label").alias("major"))
    return entries.join(several, "bucket")


def _linked(classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``class`` and ``label`` of the classes that are linked with another one."""
    entries = _buckets(classes)
    wanted = entries.select("class").distinct().join(classes.select("class", "content"), "class")
    known = texts.groupBy("content").agg(F.first("text").alias("text")).join(wanted, "content")
    sets = cut_lineage(known.select("class", "text").mapInArrow(_full_sets(words), "class long, shingles array<long>"))
    best = F.max(F.struct("weight", *FIELDS))
    pivots = entries.groupBy("bucket").agg(best.alias("x")).select("bucket", *(f"x.{name}" for name in FIELDS))
    first = Window.partitionBy("bucket").orderBy(F.desc("weight"), "class")
    labels = None
    while True:
        links = confirmed(_pairs(entries, pivots, percent), sets, percent)
        if labels is not None:  # what earlier rounds found, as links to the least node of each component
            links = links.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        labels = components(links)
        named = labels.select(F.col("node").alias("class"), F.col("label").alias("new"))
        spent = pivots.select("bucket", "class")
        rest = entries.join(spent, ["bucket", "class"], "left_anti").join(named, "class", "left").select(
            "bucket", "class", "n_shingles", "sketch", "parities", "weight", F.coalesce("new", "class").alias("label"))
        rest = cut_lineage(_open_entries(rest))
        if rest.isEmpty():
            return labels.select(F.col("node").alias("class"), "label")
        entries = rest.drop("major")
        minor = rest.filter("label <> major").withColumn("k", F.row_number().over(first)).filter(F.col("k") <= PIVOTS)
        pivots = cut_lineage(minor.select("bucket", *FIELDS), few=True)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id reachable) and ``kept``."""
    texts = pair(docs, doc_id, text).withColumn("content", F.unhex(F.md5("text")))
    signed = cut_lineage(texts.mapInArrow(_sign(words), SETS))
    classes = signed.filter("name IS NOT NULL").groupBy("name").agg(
        F.min("doc_id").alias("least_id"), F.min("content").alias("content"), F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        F.first("parities").alias("parities"))
    # Stored before it is used, so the numbers stay what they are.
    classes = cut_lineage(classes.withColumn("class", F.monotonically_increasing_id()))
    labels = _linked(classes, texts.select("content", "text"), words, percent)
    named = classes.select("name", "class", "least_id").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_class = named.join(least, "label").select("name", "component_id")
    rows = signed.select("doc_id", "n_shingles", "name")
    found = rows.filter("name IS NOT NULL").join(of_class, "name").select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("name IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def first_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all columns, whose id names their component. Needs ``doc_id`` and ``text``.

    Rows without id cannot be told apart: all of them stay if a component has no other rows.
    """
    found = near_duplicates(docs, words, percent)
    name = free_name(docs, "_kept")
    kept = found.filter("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col(name)), "left_semi")
