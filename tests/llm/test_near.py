import random

from odd_rows import ODD, by_row, frame
from tablelore.llm import circulant


def plain(rows, words, percent):
    """Components by comparing all pairs of sets of word tuples."""
    def shingles(text):
        spelled = (text or "").encode().lower().split()
        width = min(words, len(spelled))
        return {tuple(spelled[k:k + width]) for k in range(len(spelled) - width + 1)} if spelled else set()

    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                label[root(a)] = root(b)
    for k, (ident, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None]
        own = min(ids, default=None) if sets[k] else ident
        yield ident, len(sets[k]), own, ident == own


COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def family(source, n, base_id, edits):
    base = [f"w{source.randrange(10**6)}" for _ in range(100)]
    rows = []
    for k in range(n):
        words = list(base)
        for _ in range(source.randrange(edits)):
            words[source.randrange(len(words))] = f"e{source.randrange(10**6)}"
        rows.append((base_id + k, " ".join(words)))
    return rows


def test_families_chains_and_odd_rows(spark):
    source = random.Random(1)
    rows = ODD + family(source, 30, 100, 8) + family(source, 12, 200, 14)
    words = [f"c{k}" for k in range(100)]
    for k in range(12):  # a chain: each text is like the next, the ends are not alike
        rows.append((400 - k, " ".join(words)))
        words[5 * k:5 * k + 3] = [f"d{k}a", f"d{k}b", f"d{k}c"]
    rows += [(500 + k, " ".join(f"r{source.randrange(10**6)}" for _ in range(60))) for k in range(40)]
    for width, percent in ((3, 85), (5, 80)):
        found = circulant.near_duplicates(frame(spark, rows), width, percent)
        assert by_row(found, *COLUMNS) == sorted(plain(rows, width, percent), key=repr)


def test_rounds_end_exactly_when_pivots_link_little(spark, monkeypatch):
    monkeypatch.setattr(circulant, "PIVOTS", 2)
    rows = family(random.Random(2), 25, 0, 16)
    found = circulant.near_duplicates(frame(spark, rows), 3, 85)
    assert by_row(found, *COLUMNS) == sorted(plain(rows, 3, 85), key=repr)


def test_a_family_just_below_the_threshold_leaves_few_pairs_to_confirm(spark, monkeypatch):
    source, asked, confirm = random.Random(3), [], circulant.confirmed
    base = [f"w{source.randrange(10**6)}" for _ in range(150)]
    rows = []
    for k in range(80):  # two of them share some 85 % of their shingles
        words = list(base)
        for at in source.sample(range(1, 149), 2):
            words[at] = f"e{source.randrange(10**6)}"
        rows.append((k, " ".join(words)))

    def counted(pairs, sets, percent):
        asked.append(pairs.count())
        return confirm(pairs, sets, percent)
    monkeypatch.setattr(circulant, "confirmed", counted)
    found = circulant.near_duplicates(frame(spark, rows), 3, 91)
    assert by_row(found, *COLUMNS) == sorted(plain(rows, 3, 91), key=repr)
    assert sum(asked) < 400  # of 3160


def test_parities_never_differ_more_than_the_sets(spark):
    source = random.Random(5)
    for _ in range(200):
        words = [f"w{source.randrange(3000)}" for _ in range(source.randrange(1, 3000))]
        other = [w if source.random() < 0.9 else f"x{source.randrange(3000)}" for w in words]
        a, b = (circulant.shingle_set(" ".join(x), 3) for x in (words, other))
        bits = sum(int(x).bit_count() for x in (circulant.parities(a) ^ circulant.parities(b)).view("u8"))
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components_match_union_find(spark):
    source = random.Random(4)
    pairs = [(source.randrange(120), source.randrange(120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 240)]
    label = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    found = dict(by_row(circulant.components(spark.createDataFrame(pairs, "a int, b int")), "node", "label"))
    assert all(found.get(x, x) == y for x, y in label.items())


def test_no_rows_and_kept_rows(spark):
    assert circulant.near_duplicates(frame(spark, [])).count() == 0
    docs = frame(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, "")])
    kept = circulant.first_of_each(docs)
    assert kept.columns == docs.columns and by_row(kept, "doc_id") == [(1,), (3,), (4,)]


def test_a_column_with_the_name_of_a_helper(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y")], "doc_id long, text string, _kept string")
    kept = circulant.first_of_each(docs)
    assert kept.columns == docs.columns and by_row(kept, "doc_id", "_kept") == [(1, "x")]
