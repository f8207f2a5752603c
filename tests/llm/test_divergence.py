import random
import re
from collections import Counter

import numpy as np
import pytest

from odd_rows import ODD, by_row, frame
from tablelore.llm import divergence

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def plain(rows, least=10, top=10):
    """The same by its definition, in Python numbers."""
    rows = [((t or ""), (lang or ""), (s or "")) for t, lang, s in rows]
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    found = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)), lang, s) for t, lang, s in rows]
    out = []
    for lang in {x[1] for x in found}:
        docs = Counter(w for words, own, _ in found if own == lang for w in set(words))
        kept = [w for w, n in docs.items() if n >= least]
        counts = {s: Counter() for _, own, s in found if own == lang}
        for words, own, s in found:
            if own == lang:
                counts[s].update(w for w in words if docs[w] >= least)
        whole = sum(counts.values(), Counter())

        def share(c, w):
            return 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))

        def value(p, q):
            return (p - q) ** 2 // (p + q)
        for s, c in counts.items():
            pairs = [(o, sum(value(share(c, w), share(d, w)) for w in kept)) for o, d in counts.items() if o != s]
            terms = [(w, value(share(c, w), share(whole, w))) for w in kept if c[w] and share(c, w) > share(whole, w)]
            for part, values, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                values.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(values[:most])]
    return sorted(out, key=repr)


def table(spark, rows):
    made = [(t, lang, s, k, "x", 1) for k, (t, lang, s) in enumerate(rows)]
    return spark.createDataFrame(made, "text string, lang string, source string, n long, term string, number int")


def some(source, n, words):
    langs, sources = ["en", "de", None, "ÄÖ"], ["a", "b", "B", "é", "", None, "s7", "s8", "s9", "s10", "s11"]
    return [(" ".join(source.choices(words, k=source.randrange(12))), source.choice(langs), source.choice(sources)) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_against_the_definition(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    monkeypatch.setattr(divergence, "TILE", 3)
    source = random.Random(block)
    words = [f"w{chr(97 + k)}" for k in range(20)] + ["Über", "über", "don't", "a1b", "中文", "x\x85y", "İ", "_z_"]
    rows = some(source, 400, words) + [(None, "fr", "empty"), ("", "fr", "other"), (None, None, None), ("lonely words", "it", "one")]
    assert by_row(divergence.divergence(table(spark, rows)), *COLUMNS) == plain(rows)


def test_odd_rows_and_no_rows(spark):
    rows = ODD * 11
    triples = [(t, "en" if i else None, "s1" if i and i % 2 else None) for i, t in rows]
    assert by_row(divergence.divergence(frame(spark, rows)), *COLUMNS) == plain(triples)
    assert divergence.divergence(frame(spark, [])).count() == 0


def test_a_source_with_most_rows_and_ties(spark):
    rows = [("tie one two", "en", "hot")] * 300 + [("tie one two", "en", s) for s in "bcd"] + [("tie three", "en", "e")] * 12
    assert by_row(divergence.divergence(table(spark, rows)), *COLUMNS) == plain(rows)


def test_terms_in_slices_are_whole(monkeypatch):
    text = ("Ab c " + "x" * 70 + " déjà 中文-中 " + "y" * 40).encode()
    whole = [w for part in divergence.terms_of(text) for w in part]
    for size in (1, 7, 64):
        monkeypatch.setattr(divergence, "SLICE", size)
        assert [w for part in divergence.terms_of(text) for w in part] == whole


def test_gallop_and_shares_of_large_numbers():
    made = np.random.default_rng(3)
    for _ in range(200):
        among = np.unique(made.integers(0, 500, made.integers(0, 300)))
        probes = np.unique(made.integers(-5, 510, made.integers(0, 120)))
        assert (divergence.gallop(probes, among) == np.searchsorted(among, probes)).all()
    counts = [0, 1, 10**12, 9 * 10**14]
    total, terms = sum(counts) + 7, 10**7
    expected = [1 + 10**9 * (c + 2) // (total + 2 * terms) for c in counts]
    assert divergence.shares(np.array(counts), total, terms).tolist() == expected


def test_shares_in_sql_match(spark):
    rows = [(0, 5, 3), (10**15, 10**15 + 9, 11), (4 * 10**14, 9 * 10**14, 10**9)]
    found = spark.createDataFrame(rows, "n long, total long, terms long").select("n", divergence.share("n", "total", "terms").alias("p"))
    assert dict(by_row(found, "n", "p")) == {n: 1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in rows}
