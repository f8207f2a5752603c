import random

from hypothesis import given, settings, strategies as st

from odd_rows import ODD, frame
from tablelore.llm import toxicity


def plain_segments(scores):
    """Ruzzo and Tompa's maximal segments by their definition: every proper part scores less, and none can grow."""
    n = len(scores)
    total = lambda a, b: sum(scores[a:b])

    def own(a, b):
        sums = [total(a, k) for k in range(a, b + 1)]
        return total(a, b) > 0 and all(sums[0] < s for s in sums[1:]) and all(sums[-1] > s for s in sums[:-1])

    good = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if own(a, b)]
    return [(a, b) for a, b in good if not any((c, d) != (a, b) and c <= a and b <= d for c, d in good)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 6)), max_size=8))
def test_segments_match_their_definition(steps):
    other, scores, hits, place = -1, [], [], -1
    for gap, score in steps:
        place += gap
        scores += [other] * (gap - 1) + [score]
        hits.append((place, float(score)))
    found = [(hits[a][0], hits[b][0] + 1, s) for s, a, b in toxicity.maximal_segments(hits, other)]
    assert [(a, b) for a, b, _ in found] == plain_segments(scores)
    assert all(abs(s - sum(scores[a:b])) < 1e-9 for a, b, s in found)


def corpus(n=1200):
    source = random.Random(3)
    neutral, bad = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)], ["grobl", "snarf", "pleck"]
    docs, labels = [], []
    for i in range(n):
        words = source.choices(neutral, k=source.randint(5, 120))
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            words.insert(source.randrange(len(words)), source.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_texts_and_their_passages(spark):
    docs, labels = corpus()
    labels += [(None, 1, 1), (5, 1, None), (10**9, 1, 1)]
    made = toxicity.toxicity(frame(spark, docs + ODD[2:5]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = made.collect()
    assert len(rows) == len(docs) + 3 and any(r.held_out for r in rows)
    texts, truth = dict(docs), {i: t for i, _, t in labels}
    for r in rows:
        if r.doc_id in texts and (text := texts[r.doc_id]) and len(text) > 5:
            assert r.predicted == truth[r.doc_id] or r.doc_id in (5, 3, 4)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
            for p in r.passages:
                assert any(w in text[p.start:p.end] for w in ("grobl", "snarf", "pleck"))


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(frame(spark), none).collect()
    assert len(rows) == len(ODD) and all(r.predicted == 0 and r.score < 1e-9 for r in rows)
    assert toxicity.toxicity(frame(spark, []), none).count() == 0


def test_rows_that_are_not_toxic_keep_their_columns(spark):
    docs = frame(spark)
    model = toxicity.Model({"lazy": 8.0}, constant=1e-3, bias=-5.0, slope=10.0)
    kept = toxicity.not_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(ODD) - 2


def phrases(n):
    """One text in five is toxic; the word stands in half of those and in one clean text of 40, after four words only."""
    source, neutral = random.Random(7), [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows = []
    for i in range(n):
        words, toxic = source.choices(neutral, k=20), int(i % 5 == 0)
        if i % 10 == 0 or i % 50 == 1:
            words += [("oh", "you", "the", "old")[i // 10 % 4], "grobl"]
        rows.append((i, " ".join(words), toxic))
    return rows


def test_words_of_fixed_phrases_stay_as_labels_grow(spark):
    odds = [toxicity._lexicon(spark.createDataFrame(phrases(n), "doc_id long, text string, toxic int"))[0].get("grobl") for n in (300, 3000)]
    assert all(odds) and odds[1] > 0.9 * odds[0]


def test_near_copies_of_a_class_count_once(spark):
    text = " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(100))
    rows = [(k, f"{text} end{chr(97 + k)}", int(k % 2 == 0), True) for k in range(20)] + [(50, "others stay", 1, True), (51, "", 0, True)]
    made = toxicity.merged(spark.createDataFrame(rows, "doc_id long, text string, toxic int, fits boolean")).collect()
    assert sorted((r.doc_id, r.toxic) for r in made) == [(0, 1), (1, 0), (50, 1), (51, 0)]
    assert len({r.fits for r in made if r.doc_id < 2}) == 1


def test_places_where_small_letters_take_more_room():
    model = toxicity.Model({"bad": 9.0, "words": 9.0}, -0.5, 1.0, 1e-6)
    text = "İstanbul İzmir bad words here"
    _, _, found = toxicity.evidence(text, model)
    assert [text[a:b] for a, b, _, _ in found] == ["bad words"]
