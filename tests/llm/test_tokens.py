import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from odd_rows import ODD, by_row, frame
from tablelore.llm import lexicon, packing, tokens, words

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
CHARACTERS = st.text(st.sampled_from("aAbtsédÉ'’ \t\n\x1c\x85  0①.,!<|>ſİ中é"), max_size=40)


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def ids_of(library, path, text):
    return library[path].encode(text or "", add_special_tokens=False).ids


@settings(max_examples=1000, deadline=None)
@given(st.one_of(CHARACTERS, st.text(max_size=30)))
def test_fragments_count_like_the_whole(text):
    whole = words.tokenizer(BYTES)
    found = [x for s in words.segments(text, tokens._CUT, 7) for x in tokens.fragments(s)]
    assert "".join(found) == text or not text
    assert sum(len(whole.encode(x, add_special_tokens=False)) for x in found) == len(whole.encode(text, add_special_tokens=False))


@settings(max_examples=1000, deadline=None)
@given(st.one_of(CHARACTERS, st.text(max_size=30)))
def test_chunks_encode_like_the_whole(text):
    library = words.tokenizer(WORDS)
    (_, (ids,)), = words.encoded(iter([(1, text)]), packing.encoder(WORDS))
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_counts(spark, library):
    expected = sorted(((i, len((t or "").encode()), len(n := ids_of(library, BYTES, t)), len(n) > 1024) for i, t in ODD), key=repr)
    assert by_row(tokens.token_counts(frame(spark)), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    assert tokens.token_counts(frame(spark, [])).count() == 0


def test_a_memo_forgets_but_still_answers():
    memo = words.BatchMemo(lambda keys: [len(k) for k in keys], most=3)
    memo.learn([["a", "bb"], ["ccc", "dddd", "eeeee"]])
    assert [memo[k] for k in ("a", "bb", "ccc", "dddd", "eeeee", "ffffff")] == [1, 2, 3, 4, 5, 6]
    assert len(memo) <= 3 and len(memo.old) <= 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 4))
def test_open_bins_match_a_plain_best_fit(lengths, most):
    bins, open_, made = packing.OpenBins(20, most), {}, 0
    for length in lengths:
        fitting = [(free, b) for b, free in open_.items() if free >= length]
        found, offset = bins.put(length)
        if fitting:
            assert open_[found] == min(fitting)[0] and offset == 20 - open_[found]
            free = open_.pop(found)
        else:
            assert found == made and offset == 0
            free, made = 20, made + 1
        if free - length:
            if len(open_) >= most:
                least = min(open_.values())
                gone = [b for b in open_ if b not in {x for s in bins.stacks for x in s} and open_[b] == least]
                del open_[gone[0]]
            open_[found] = free - length
        assert sorted(open_.items()) == sorted((b, free) for free, s in enumerate(bins.stacks) for b in s)


def test_pieces_and_places(spark, library):
    rows = ODD + [(100 + k, "word " * (k * 37 % 900)) for k in range(60)]
    found = packing.packed(frame(spark, rows)).collect()
    expected = []
    for ident, text in rows:
        ids = np.array([*ids_of(library, WORDS, text), 0], "<u4")
        expected += [(ident, k, s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr) == sorted(expected, key=repr)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(frame(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=6), max_size=30), st.lists(st.text("abcé", max_size=8), max_size=20))
def test_automaton_numbers_words_in_order(held, asked):
    automaton = lexicon.Transducer(lexicon.compiled(held, lambda w: list(w.encode())))
    order = {w: k for k, w in enumerate(sorted(held, key=str.encode))}
    probe = [*held, *asked]
    numbers = automaton.numbers([w.encode() for w in probe]).tolist()
    assert numbers == [order.get(w, -1) for w in probe]
    assert all(automaton.output(order[w]).tolist() == list(w.encode()) for w in held)


def test_automaton_shares_suffixes():
    image = lexicon.Transducer(lexicon.compiled(["reading", "leading", "heading"], lambda w: [1]))
    assert len(image.final) == 8 and len(image.keys) == 9


def test_encode_and_decode(spark, library):
    rows = ODD + [(50 + k, f"common words and rare{k} ones, common words again") for k in range(30)]
    made = lexicon.encode(frame(spark, rows), most=40)
    expected = [(i, n := ids_of(library, WORDS, t), library[WORDS].decode(n, skip_special_tokens=False)) for i, t in rows]
    assert by_row(made, "doc_id", "ids", "decoded") == sorted(((i, n, d) for i, n, d in expected), key=repr)
    again = lexicon.decode(made.select("doc_id", "ids", "decoded"))
    assert by_row(again, "doc_id", "decoded") == sorted(((i, d) for i, _, d in expected), key=repr)
    assert lexicon.encode(frame(spark, [])).count() == 0


def test_merges(library):
    merges, source = lexicon.Merges(WORDS), random.Random(1)
    spelled = ["".join(source.choices("abcdeoilnrsté", k=source.randint(1, 14))) for _ in range(2000)] + ["", "aaaaaaa", "x" * 99]
    assert [merges(w) for w in spelled] == [ids_of(library, WORDS, w) for w in spelled]


def test_long_words_compile_and_encode(spark, library):
    held = ["x" * 30000, "x" * 29999 + "y", "y"]
    automaton = lexicon.Transducer(lexicon.compiled(held, lambda w: [len(w)]))
    assert automaton.numbers([w.encode() for w in held]).tolist() == [0, 1, 2]
    rows = ODD + [(90, "x" * 30000), (91, "ab" * 300), (92, "ab" * 300)]
    made = lexicon.encode(frame(spark, rows), most=40)
    assert by_row(made, "doc_id", "ids") == sorted(((i, ids_of(library, WORDS, t)) for i, t in rows), key=repr)
    assert max(map(len, lexicon.frequent(frame(spark, rows)))) <= lexicon.MOST_LETTERS


def test_long_words_are_merged_as_short_ones_are(monkeypatch):
    import random
    import time

    source, merges = random.Random(3), lexicon.Merges(public_tokenizers.path("word_bpe_49k.json"))
    words = ["".join(source.choices("aeinrst-é", k=source.randrange(1, 150))) for _ in range(300)] + ["a" * 120, "ab" * 70, "-" * 99]
    plain = [merges(x) for x in words]
    monkeypatch.setattr(lexicon, "LONG_WORD", 0)
    assert [merges(x) for x in words] == plain
    began = time.process_time()
    merges("".join(source.choices("aeinrst", k=200_000)))
    assert time.process_time() - began < 20


def test_a_memo_is_bounded_in_bytes():
    memo = words.Memo(lambda key: key.encode(), most_bytes=5000)
    for k in range(300):
        assert memo[f"{k}" * 30] == (f"{k}" * 30).encode()
    assert len(memo) + len(memo.old) < 60
    memo.rest()
    assert not memo.old


def test_words_encoded_as_lines_are_those_encoded_singly():
    library = words.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    source = random.Random(5)
    made = ["".join(source.choices("abcdefgéßñ", k=source.randrange(1, 12))) for _ in range(3000)] + ["'s", "!!", "...", "7", "–", "q" * 300]
    expected = [words.packed_ids(library.encode(x, add_special_tokens=False).ids) for x in made]
    assert packing.ids_of_words(library)(made) == expected
    assert packing.ids_of_words(library)(["two words", "one"]) == [
        words.packed_ids(library.encode(x, add_special_tokens=False).ids) for x in ("two words", "one")]
    assert packing.ids_of_words(library)([]) == []


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.one_of(CHARACTERS, st.text(st.sampled_from("'aAsSrevEmlLdt!9 \n×÷İé|<"), max_size=20), st.text(max_size=30)), max_size=4))
def test_texts_cut_as_arrays_encode_like_the_whole(texts):
    library = words.tokenizer(WORDS)
    found = words.listed([*texts, ""], packing.encoder(WORDS)).to_pylist()
    assert found == [library.encode(x, add_special_tokens=False).ids for x in texts] + [[]]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(CHARACTERS, st.text("aÉ×÷İĲſ'8 ", max_size=12), st.text(max_size=30)), max_size=4))
def test_words_are_counted_as_a_plain_loop_does(texts):
    found, counts = words.word_counts(texts)
    expected = Counter(x for text in texts for x in re.findall(f"[{words.LETTERS}]+", text.lower()))
    assert dict(zip(found.to_pylist(), counts.to_pylist(), strict=True)) == expected


def test_frequent_words_are_those_of_a_plain_loop(spark):
    rows = ODD + [(50 + k, f"Common words and rare{k} ones, common ×words÷ again İt's") for k in range(30)]
    counts = Counter(x for _, text in rows for x in re.findall(f"[{words.LETTERS}]+", (text or "").lower()))
    counts = {x: n for x, n in counts.items() if n > 1 and len(x) <= lexicon.MOST_LETTERS}
    for most in (40, 5000, 10**9):
        expected = sorted(x for x, n in counts.items() if n * most > sum(counts.values()))
        assert sorted(lexicon.frequent(frame(spark, rows), most)) == expected


def test_words_merged_side_by_side_are_those_merged_singly():
    merges, source = lexicon.Merges(WORDS), random.Random(7)
    made = ["".join(source.choices("aeinrstdlo-é!", k=source.randint(1, 40))) for _ in range(5000)]
    made += ["", "a", "é", "!!", "\0", "a\0", "a" * 32, "a" * 33, "x" * 300, "the", "'s"]
    assert merges.many(made) == [words.packed_ids(merges(x)) for x in made]
    assert merges.many([]) == [] and merges.many(["a"]) == [words.packed_ids(merges("a"))]


def test_encoding_looks_up_and_merges_many_words_at_once():
    merges, source = lexicon.Merges(WORDS), random.Random(9)
    made = ["".join(source.choices("aeinrstdlo", k=source.randint(5, 12))) for _ in range(20_000)]
    texts = [" ".join(source.choices(made, k=400)) for _ in range(1500)]

    def seconds(run):
        began = time.process_time()
        run()
        return time.process_time() - began

    assert seconds(lambda: merges.many(made)) < 0.7 * seconds(lambda: [merges(x) for x in made])
    singly = packing.encoder(WORDS)
    singly.learn([made])
    words.listed(texts[:1], singly)  # loads what Arrow needs
    assert seconds(lambda: words.listed(texts, singly)) < 0.7 * seconds(lambda: list(words.encoded(enumerate(texts), singly)))
