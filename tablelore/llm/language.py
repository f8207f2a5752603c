"""Language by sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters, over lower-cased letters with one space for anything else, are hashed into a fixed
number of features. Document frequencies are counted over all texts that may be learned from. Weights are fitted with
the follow-the-regularised-leader update and elastic-net penalties on at most ``PER_LANG`` texts of each language, those
of smallest id hash; a fifth of them sets the temperature instead. Predictions depend on the text alone.

A null text, or one without a letter, is ``und`` with score 0. Null languages are not learned. Without any language to
learn every text is ``und``. Repeated ids are learned from once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Rows, held_out, rows_of

FEATURES = 1 << 15
PER_LANG = 1500
EPOCHS = 2
#: Follow-the-regularised-leader: rate, its offset, and the two penalties.
RATE, OFFSET, L1, L2 = 0.5, 1.0, 0.02, 0.02
UNKNOWN = "und"

_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_SMALL = 0x250
_IS_LETTER = np.array([chr(c).isalpha() for c in range(_SMALL)])


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0


def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where((codes >= _SMALL) | _IS_LETTER[np.minimum(codes, _SMALL - 1)], codes, np.uint32(32))
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]]).astype(np.uint32)
    codes = codes[~((codes == 32) & (np.roll(codes, 1) == 32) & (np.arange(len(codes)) > 0))]
    shift, counts, value = np.uint32(32 - FEATURES.bit_length() + 1), np.zeros(FEATURES, np.int64), np.zeros(len(codes), np.uint32)
    for n, factor in enumerate(_MULTIPLIERS):
        value = (value[:len(codes) - n] + codes[n:] + np.uint32(n)) * factor
        value ^= value >> np.uint32(15)
        counts += np.bincount((value * _MULTIPLIERS[0]) >> shift, minlength=FEATURES)
    found = np.flatnonzero(counts)
    return found, counts[found]


def weighed(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features with sublinear TF-IDF weights of unit length."""
    found, counts = hashed(text)
    values = (1 + np.log(counts)) * idf[found]
    return found, values / (np.linalg.norm(values) or 1.0)


def softmax(scores: np.ndarray) -> np.ndarray:
    odds = np.exp(scores - scores.max())
    return odds / odds.sum()


def fitted(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases after ``EPOCHS`` passes in the given order; the bias is a feature without penalties."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))
    l1, l2 = np.full((FEATURES + 1, 1), L1), np.full((FEATURES + 1, 1), L2)
    l1[-1] = l2[-1] = 0

    def solved(at) -> np.ndarray:
        size = np.maximum(np.abs(z[at]) - l1[at], 0) * -np.sign(z[at])
        return size / ((OFFSET + np.sqrt(n[at])) / RATE + l2[at])

    for _ in range(EPOCHS):
        for found, values, label in examples:
            at, x = np.append(found, FEATURES), np.append(values, 1.0)
            w = solved(at)
            wrong = softmax(x @ w)
            wrong[label] -= 1
            slope = x[:, None] * wrong
            step = (np.sqrt(n[at] + slope**2) - np.sqrt(n[at])) / RATE
            z[at] += slope - step * w
            n[at] += slope**2
    w = solved(slice(None))
    return w[:-1], w[-1]


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, from a fine grid."""
    best, least = 1.0, math.inf
    for t in np.exp(np.linspace(-3, 3, 121)):
        x = scores / t
        loss = (np.logaddexp.reduce(x, axis=1) - x[np.arange(len(labels)), labels]).mean()
        if loss < least:
            best, least = float(t), loss
    return best


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, texts = np.zeros(FEATURES, np.int64), 0
    for (text,) in rows_of(batches, "text"):
        counts[hashed(text)[0]] += 1
        texts += 1
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(counts[found], texts))], ["feature", "n"])


def _train(idf: np.ndarray, langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(*weighed(text, idf), langs.index(lang)) for text, lang in rows_of(batches, "text", "lang")]
        held = rows[::5] if len(rows) >= 20 else []
        weights, bias = fitted([x for k, x in enumerate(rows) if k % 5 or not held], len(langs))
        t = 1.0
        if held:
            scores = np.array([x @ weights[at] + bias for at, x, _ in held])
            t = temperature(scores, np.array([label for _, _, label in held]))
        columns = [[*langs, None], [*weights.T.astype(np.float32).tolist(), []], [*bias.tolist(), t]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.list_(pa.float32())), pa.array(columns[2])],
                                         ["lang", "weights", "bias"])
    return run


def fit(docs: DataFrame, per_lang: int = PER_LANG, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model from all rows outside the held-out fold that have a text and a language."""
    known = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"), docs[lang].cast("string").alias("lang"))
    known = known.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id"))
    counts = known.select("text").mapInArrow(_document_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    frequency = {x.feature: x.n for x in counts.collect()}
    idf = np.ones(FEATURES)
    total = frequency.pop(-1, 0)
    idf[list(frequency)] = [math.log((1 + total) / (1 + n)) + 1 for n in frequency.values()]

    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    ids = known.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    sample = ids.withColumn("place", F.xxhash64("doc_id")).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_lang)
    chosen = known.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "lang", "place")), "doc_id").groupBy(
        "doc_id", "lang", "place").agg(F.min("text").alias("text"))
    langs = sorted(x.lang for x in sample.select("lang").distinct().collect())
    if not langs:
        return Model([], idf, np.zeros((FEATURES, 0)), np.zeros(0))
    one = chosen.repartition(1).sortWithinPartitions("place", "doc_id").select("text", "lang")
    made = {x.lang: x for x in one.mapInArrow(_train(idf, langs), "lang string, weights array<float>, bias double").collect()}
    weights = np.array([made[x].weights for x in langs], np.float64).T
    return Model(langs, idf, weights, np.array([made[x].bias for x in langs]), made[None].bias)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        out = Rows(pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())]))
        for ident, text in rows_of(batches, "doc_id", "text"):
            pred, score = UNKNOWN, 0.0
            if text and held.langs and any(map(str.isalpha, text)):
                found, values = weighed(text, held.idf)
                chances = softmax((values @ held.weights[found] + held.bias) / held.temperature)
                best = int(chances.argmax())
                pred, score = held.langs[best], float(chances[best])
            if out.add(ident, pred, score):
                yield from out.take()
        yield from out.take()
    return run


def predicted(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``held_out``, the language predicted and its calibrated probability."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    made = plain.mapInArrow(_predict(sent), "doc_id long, lang_pred string, score double")
    return made.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
