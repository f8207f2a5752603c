import hashlib
import re
from collections import defaultdict

from hypothesis import given, settings, strategies as st

from odd_rows import ODD, by_row, frame
from tablelore.llm import tries


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=8), st.integers(0, 9))))
def test_trie_merges_equal_keys_and_spills_whole_subtrees(items):
    trie, expected = tries.Trie(), {}
    for key, ident in items:
        trie.insert(key.encode(), [ident, 1])
        low, n = expected.get(key, (ident, 0))
        expected[key] = min(low, ident), n + 1
    assert {k.decode(): tuple(v) for k, v in trie.items()} == expected
    spilled = {k.decode(): tuple(v) for k, v in trie.spill()}
    assert spilled | {k.decode(): tuple(v) for k, v in trie.items()} == expected
    assert trie.size == sum(_labels(trie.root))


def _labels(node):
    yield len(node.label)
    for child in node.children.values():
        yield from _labels(child)


def expected_rows(rows):
    groups = defaultdict(list)
    for ident, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(ident)
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            yield i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_odd_rows(spark):
    assert by_row(tries.exact_duplicates(frame(spark)), *COLUMNS) == sorted(expected_rows(ODD), key=repr)


def test_no_rows(spark):
    assert tries.exact_duplicates(frame(spark, [])).count() == 0


def test_one_text_fills_a_third(spark, monkeypatch):
    rows = [(i, "copy of  one text" if i % 3 == 0 else f"text {i // 2}") for i in range(900)]
    monkeypatch.setattr(tries, "TRIE_BYTES", 64)
    assert by_row(tries.exact_duplicates(frame(spark, rows)), *COLUMNS) == sorted(expected_rows(rows), key=repr)


def test_first_of_each_keeps_all_columns(spark):
    docs = frame(spark)
    kept = tries.first_of_each(docs)
    assert kept.columns == docs.columns
    expected = [(i, t) for i, t in ODD if (i, t) not in {(2, ODD[1][1]), (9, ODD[11][1])} and i != 4]
    expected = [(i, t) for i, t in expected if i is not None]
    assert by_row(kept, "doc_id", "text") == sorted(expected, key=repr)


def test_columns_with_the_names_of_helpers(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 5), (2, "a  b", "y", 6), (3, None, "z", 7)], "doc_id long, text string, _digest string, _KEEP_ID int")
    kept = tries.first_of_each(docs)
    assert kept.columns == docs.columns and by_row(kept, "doc_id", "_digest") == [(1, "x"), (3, "z")]
