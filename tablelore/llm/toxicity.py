"""Toxic passages by maximum-scoring segments over token log-odds.

A lexicon of words comes from labelled texts: the log-odds of a word between the classes, smoothed by a Dirichlet prior
that is part informative (the word's share of both classes) and part flat. Near-copies among the labelled texts of a
class count once, so that copies of one toxic text do not make all its words toxic. Words whose log-odds are significant
score that value; every other word scores the small loss of not being one of them. A linear scan then finds all maximal
segments, and a segment is a toxic passage if its chance under an extreme-value law is small; the law's constant is
fitted on clean texts. The excess of a text's passages is turned into a probability by logistic calibration on labelled
texts that the lexicon did not see.

``ROWS`` labelled texts at most are learned from, those of smallest id hash; equal texts count once. Scores depend on
text only. Null and empty texts have no words and get the score of no evidence. Conflicting labels of one id count as
toxic, null labels are left out; without any usable label all scores are 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablelore.session import cut_lineage

from . import circulant
from .common import AT_ONCE, Rows, held_out, pair, rows_of

#: Bound of the model: labelled texts to learn from. Its lexicon holds the significant words of these texts.
ROWS = 40_000
#: Prior: weight of the informative part, flat part, and the z-score from which a term counts.
INFORMED, FLAT, LEAST_Z = 1000.0, 0.5, 3.0
#: Chance of a passage under the law of clean texts below which it is significant.
CHANCE = 0.01
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")
RESULT = ("doc_id long, score double, excess double, n_words long, "
          "passages array<struct<start: int, end: int, score: double, chance: double>>")


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    other: float = -0.05
    decay: float = 1.0
    constant: float = 1e-3
    bias: float = -50.0
    slope: float = 0.0


def maximal_segments(hits: list[tuple[int, float]], other: float) -> list[tuple[float, int, int]]:
    """All maximal segments of a sequence given by its positive places; any place between scores ``other``.

    ``hits`` are (place, score) by place. Gives (score, first hit, last hit) by their order; linear in the hits, as
    each candidate keeps a link to the nearest one before it with a smaller sum.
    """
    found: list[tuple[float, float, int, int, int]] = []
    total, last = 0.0, -1
    for k, (place, score) in enumerate(hits):
        total += other * (place - last - 1)
        left, right, first = total, total + score, k
        total, last = right, place
        at = len(found) - 1
        while True:
            while at >= 0 and found[at][0] >= left:
                at = found[at][4]
            if at < 0 or found[at][1] >= right:
                found.append((left, right, first, k, at))
                break
            left, first, link = found[at][0], found[at][2], found[at][4]
            del found[at:]
            at = link
    return [(right - left, first, end) for left, right, first, end, _ in found]


def evidence(text: str, model: Model) -> tuple[int, float, list[tuple[int, int, float, float]]]:
    """Words, excess of the significant passages, and those passages with their place, score and chance."""
    small = text.lower()
    # Where small letters take other places than large ones, words are found in the text itself and made small singly.
    words = _WORD.findall(small) if len(small) == len(text) else [x.lower() for x in _WORD.findall(text)]
    hits = [(k, model.scores[w]) for k, w in enumerate(words) if w in model.scores]
    if not hits:
        return len(words), 0.0, []
    places = [x.span() for x in _WORD.finditer(text)]
    shift = math.log(model.constant * len(words)) if model.constant else 0.0
    passages, excess = [], 0.0
    for score, first, last in maximal_segments(hits, model.other):
        over = model.decay * score - shift
        chance = -math.expm1(-math.exp(-over)) if over > -3 else 1.0
        if chance <= CHANCE:
            excess += over
            passages.append((places[hits[first][0]][0], places[hits[last][0]][1], score, chance))
    return len(words), excess, passages


def probability(excess: float, model: Model) -> float:
    x = model.bias + model.slope * math.log1p(excess)
    return 1 / (1 + math.exp(-x)) if x > -500 else 0.0


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("chance", pa.float64())])
        out = Rows(pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("excess", pa.float64()),
                              ("n_words", pa.int64()), ("passages", pa.list_(passage))]))
        for ident, text in rows_of(batches, "doc_id", "text"):
            n, excess, found = evidence(text, held)
            spans = [dict(zip(("start", "end", "score", "chance"), x)) for x in found]
            if out.add(ident, probability(excess, held), excess, n, spans, size=40 * len(spans)):
                yield from out.take()
        yield from out.take()
    return run


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``score``, the ``excess`` it comes from, ``n_words`` and the toxic ``passages`` (code points)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return pair(docs, doc_id, text).mapInArrow(_scan(sent), RESULT)


def labelled(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """At most ``rows`` distinct labelled texts outside the held-out fold: ``doc_id``, ``text``, ``toxic``, ``fits``."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Only ids whose hash lies below the share that holds the sample but for a chance of 1e-20 are sorted for it.
    share = (rows + 10 * rows ** 0.5 + 100) / max(1, known.count())
    if share < 1:
        known = known.filter(F.xxhash64("doc_id") < F.lit(int(-2**63 + share * 2**64)))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = pair(docs).join(F.broadcast(sample), "doc_id")
    return texts.withColumn("content", F.xxhash64("text")).groupBy("content").agg(
        F.min_by("text", "doc_id").alias("text"), F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")
    ).select("doc_id", "text", "toxic", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) > 0).alias("fits"))


def merged(texts: DataFrame) -> DataFrame:
    """Of each group of near-copies one text per class, and the groups on one side of ``fits``.

    Near-copies of both classes stay apart, as they tell what makes the difference.
    """
    groups = circulant.near_duplicates(texts).select("doc_id", "component_id")
    return texts.join(groups, "doc_id").groupBy("component_id", "toxic").agg(
        F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id")
    ).select("doc_id", "text", "toxic", (F.pmod(F.xxhash64("component_id"), F.lit(4)) > 0).alias("fits"))


def _lexicon(texts: DataFrame) -> tuple[dict[str, float], float, float]:
    """Scores of the significant terms, the score of other words, and the decay of chance under clean texts."""
    words = texts.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word"))
    counts = words.filter("word <> ''").groupBy("word").agg(
        F.sum("toxic").cast("double").alias("y1"), F.sum(1 - F.col("toxic")).cast("double").alias("y0"))
    total = counts.agg(F.coalesce(F.sum("y1"), F.lit(0.0)).alias("n1"), F.coalesce(F.sum("y0"), F.lit(0.0)).alias("n0"),
                       F.count(F.lit(1)).alias("v")).first()
    n1, n0, all_ = total.n1, total.n0, total.n1 + total.n0
    if not n1 or not n0:
        return {}, -0.05, 1.0
    prior = INFORMED * (F.col("y1") + F.col("y0")) / all_ + FLAT
    mass = INFORMED + FLAT * total.v

    def log_odds(y, n):
        return F.log((F.col(y) + prior) / (n + mass - F.col(y) - prior))

    odds = log_odds("y1", n1) - log_odds("y0", n0)
    z = odds / F.sqrt(1 / (F.col("y1") + prior) + 1 / (F.col("y0") + prior))

    terms = counts.select("word", "y1", "y0", odds.alias("odds"), z.alias("z")).filter((F.col("z") >= LEAST_Z) & (F.col("odds") > 0))
    kept = terms.orderBy(F.desc("z"), "word").collect()
    scores = {x.word: x.odds for x in kept}
    share1 = min(0.9, sum(x.y1 for x in kept) / n1)
    share0 = (sum(x.y0 for x in kept) + FLAT) / (n0 + 1)
    other = min(-1e-4, math.log((1 - share1) / (1 - min(share0, share1 / 2))))
    # The decay solves E[exp(decay * score)] = 1 under the word shares of clean texts.
    weights = np.array([(x.y0 + FLAT / len(kept)) / (n0 + 1) for x in kept])
    values = np.array([x.odds for x in kept])
    low, high = 1e-3, 5.0
    for _ in range(60):
        middle = (low + high) / 2
        mean = (weights * np.exp(np.minimum(middle * values, 600))).sum() + (1 - weights.sum()) * math.exp(middle * other)
        low, high = (middle, high) if mean < 1 else (low, middle)
    return scores, other, (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 60) -> tuple[float, float]:
    """Bias and slope by Newton steps, with the targets drawn in from 0 and 1 and a small penalty on the slope."""
    ones, zeros = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    design, w = np.stack([np.ones_like(x), x], 1), np.array([math.log((ones + 1) / (zeros + 1)), 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - target) + penalty * np.array([0, w[1]])
        hessian = design.T @ (design * np.maximum(p * (1 - p), 1e-6)[:, None]) + np.diag([1e-9, penalty])
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """The model from at most ``rows`` labelled texts; three quarters give the lexicon, the rest calibrates it."""
    texts = cut_lineage(merged(cut_lineage(labelled(docs, labels, rows), few=True)), few=True)
    scores, other, decay = _lexicon(texts.filter("fits"))
    model = Model(scores, other, decay)
    rest = texts.filter("NOT fits")
    # With a constant of one word in e^3 every segment counts; what clean texts reach then fits the law's constant.
    probe = Model(scores, other, decay, math.exp(-3))
    seen = scored(rest, probe).join(rest.select("doc_id", "toxic"), "doc_id").select("toxic", "n_words", F.transform(
        "passages", lambda x: x.score).alias("found")).collect()
    clean = [(x.n_words, max(x.found, default=0.0)) for x in seen if not x.toxic and x.n_words]
    if not clean or len(clean) == len(seen):
        return Model(scores, other, decay)
    model.constant = len(clean) / sum(n * math.exp(-decay * s) for n, s in clean)

    def excess(row) -> float:
        shift = math.log(model.constant * max(1, row.n_words))
        over = [decay * s - shift for s in row.found]
        return sum(x for x in over if -math.expm1(-math.exp(-max(x, -3))) <= CHANCE)

    x = np.array([math.log1p(excess(row)) for row in seen])
    model.bias, model.slope = _logistic(x, np.array([float(row.toxic) for row in seen]))
    return model


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """Every row scored by a model of the labels; ``held_out`` rows were not learned from."""
    made = scored(docs, fit(docs, labels, rows))
    return made.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                       F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "n_words", "passages")


def _keep(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                texts = part.column("text").to_pylist()
                yield part.filter(pa.array([probability(evidence(x or "", held)[1], held) < THRESHOLD for x in texts], pa.bool_()))
    return run


def not_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, whose ``text`` scores below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(sent), docs.schema)
