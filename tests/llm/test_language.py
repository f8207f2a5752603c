import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from odd_rows import ODD, frame
from tablelore.llm import language

SF = "/root/testdata/sf0.01"


def plain_features(text):
    """The same n-grams by plain loops over Python integers."""
    clean = "".join(c if ord(c) >= language._SMALL or c.isalpha() else " " for c in text.lower())
    codes = [ord(c) for c in " " + " ".join(clean.split(" ")) + " "]
    codes = [c for k, c in enumerate(codes) if not (k and c == 32 and codes[k - 1] == 32)]
    found = {}
    for k in range(len(codes)):
        value = 0
        for n, factor in enumerate(language._MULTIPLIERS):
            if k + n >= len(codes):
                break
            value = (value + codes[k + n] + n) * int(factor) & 0xFFFFFFFF
            value ^= value >> 15
            bucket = (value * int(language._MULTIPLIERS[0]) & 0xFFFFFFFF) >> (33 - language.FEATURES.bit_length())
            found[bucket] = found.get(bucket, 0) + 1
    return found


@settings(max_examples=200, deadline=None)
@given(st.text("abÉé .中1", max_size=20))
def test_features_match_plain_loops(text):
    assert dict(zip(*(x.tolist() for x in language.hashed(text)))) == plain_features(text)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.predicted(docs, language.fit(docs, per_lang=200)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows_and_no_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs, per_lang=20)
    rows = language.predicted(frame(spark), model).collect()
    texts = {}
    for i, t in ODD:
        texts.setdefault(i, t)
    assert len(rows) == len(ODD)
    for r in rows:
        if r.doc_id in (3, 4, 5):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in model.langs
    none = language.fit(frame(spark, [(3, None), (4, "")]).withColumn("lang", F.lit(None).cast("string")))
    assert not none.langs and {r.lang_pred for r in language.predicted(frame(spark), none).collect()} == {"und"}
    assert language.predicted(frame(spark, []), model).count() == 0


def test_temperature_lowers_the_loss_of_sharp_scores():
    scores, labels = np.array([[9.0, 0.0], [8.0, 0.0], [7.0, 0.0], [9.0, 0.0]]), np.array([0, 0, 1, 0])
    assert language.temperature(scores, labels) > 2


def test_numerals_are_no_letters(spark):
    rows = [(k, "der die das und nicht wir" if k % 2 else "the and of not we are", "de" if k % 2 else "en") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    odd = spark.createDataFrame([(1, "² ½"), (2, "Ⅷ ③ _"), (3, "½ die"), (4, "中")], "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in language.predicted(odd, model).collect()}
    assert found[1] == found[2] == "und" and found[3] == "de" and found[4] in ("de", "en")
