import random

import numpy as np
import pytest

from odd_rows import by_row
from tablelore.llm import flatgraph

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, node long, shard string, kind int, found long"
COLUMNS = ("vec_id", "n_links", "component_id", "kept")


def table(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [c if c is None else float(c) for c in v], y, "c", 1, "s", 2, 3) for i, v, y in rows], SCHEMA)


def plain(rows, least=0.98):
    """All pairs of one label by their cosine."""
    def unit(v):
        if v is None or not len(v) or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            return None
        v = np.array(v, np.float32).astype(float)
        return v / np.sqrt(v @ v)
    made = [unit(v) for _, v, _ in rows]
    above, links = list(range(len(rows))), [0] * len(rows)

    def root(k):
        while above[k] != k:
            k = above[k]
        return k
    for a in range(len(rows)):
        for b in range(a):
            same = rows[a][2] is not None and rows[a][2] == rows[b][2] and made[a] is not None and made[b] is not None
            if same and len(made[a]) == len(made[b]) and made[a] @ made[b] >= least:
                links[a] += 1
                links[b] += 1
                above[root(a)] = root(b)
    for k, (ident, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None]
        yield ident, links[k], min(ids, default=None), ident == min(ids, default=None)


def planted(seed, sizes, d=16, labels=3, noise=0.11):
    made, source = np.random.default_rng(seed), random.Random(seed)
    rows = []
    for size in sizes:
        centre, label = made.normal(size=d), source.randrange(labels)
        centre /= np.sqrt(centre @ centre)
        for _ in range(size):
            rows.append((len(rows), (centre + noise * made.normal(size=d) / np.sqrt(d)).tolist(), label))
    source.shuffle(rows)
    return rows


def small(monkeypatch):
    for name, value in (("CAP", 64), ("TARGET", 32), ("SAMPLE", 48), ("ASSIGNED", 50), ("QUERIES", 40), ("AT_ONCE", 16)):
        monkeypatch.setattr(flatgraph, name, value)


def test_families_over_many_shards(spark, monkeypatch):
    small(monkeypatch)
    rows = planted(1, [1] * 250 + [2] * 30 + [9] * 8 + [150])
    assert by_row(flatgraph.near_duplicates(table(spark, rows)), *COLUMNS) == sorted(plain(rows), key=repr)


def test_a_family_that_clusters_cannot_part(spark, monkeypatch):
    small(monkeypatch)
    monkeypatch.setattr(flatgraph, "LEVELS", 0)
    rows = planted(2, [200, 3, 1, 1], labels=1)
    assert by_row(flatgraph.near_duplicates(table(spark, rows)), *COLUMNS) == sorted(plain(rows), key=repr)


def test_odd_rows(spark):
    one, nan, inf = [1, 0, 0], float("nan"), float("inf")
    rows = [(1, one, 1), (2, one, 1), (2, one, 1), (3, [2, 0, 0], 1), (4, one, None), (5, one, 2), (6, None, 1), (7, [], 1),
            (8, [0, 0, 0], 1), (9, [None, 1, 0], 1), (10, [nan, 1, 0], 1), (11, [inf, 1, 0], 1), (12, [1, 0], 1),
            (None, [1, 0.01, 0], 1), (None, [0, 0, 1], 3), (None, [0, 0, -1], 3), (13, [1, -0.0, 0], 1), (14, [1e30, 0, 0], 1),
            (15, [0, 1e-30, 0], 2), (16, [0, 1, 0], 2)]
    assert by_row(flatgraph.near_duplicates(table(spark, rows)), *COLUMNS) == sorted(plain(rows), key=repr)
    assert flatgraph.near_duplicates(table(spark, [])).count() == 0
    assert by_row(flatgraph.near_duplicates(table(spark, rows[6:9])), *COLUMNS) == [(6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True)]


def test_a_chain_and_a_threshold(spark):
    turn = [(k, [np.cos(0.19 * k), np.sin(0.19 * k)], 1) for k in range(12)]
    assert by_row(flatgraph.near_duplicates(table(spark, turn)), *COLUMNS) == sorted(plain(turn), key=repr)
    assert by_row(flatgraph.near_duplicates(table(spark, turn), least=0.999), "n_links") == [(0,)] * 12


@pytest.mark.parametrize("least", [0.98, 0.9])
def test_walks_reach_what_is_in_range(least):
    made = np.random.default_rng(4)
    rows = np.array([v for _, v, _ in planted(4, [1] * 300 + [40] * 5 + [3] * 60, d=32)])
    rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    rows = rows[made.permutation(len(rows))]
    shard = flatgraph.Shard(rows, flatgraph.graph(rows))
    true = rows @ rows.T >= least
    found = shard.search(rows, np.full((len(rows), 1), -1), least)  # from the medoid alone
    assert not (found & ~true).any() and (found & true).sum() >= 0.99 * true.sum()


def test_pruning_keeps_the_nearest_of_a_direction():
    rows = np.array([[1, 0, 0], [1, 0.1, 0], [1, 0.2, 0], [1, 0, 0.15], [1, 0, 0.4]], float)
    rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    pool = np.array([[0, 1, 2, 3, 4, 1]])
    near = (rows @ rows[0])[pool]
    near[0, 0] = -np.inf
    assert [k for k in flatgraph._pruned(rows, pool, near)[0] if k >= 0] == [1, 3]


def test_the_audit_counts_what_was_missed(spark):
    rows = spark.createDataFrame([(0, "a", 1, [1.0, 0.0]), (1, "a", 2, [1.0, 0.05]), (2, "b", 1, [1.0, 0.0])],
                                 "node long, cell string, weight long, vector array<double>")
    found = spark.createDataFrame([(0, 2)], "node long, found long")
    assert flatgraph.recall(rows, found) == pytest.approx(2 / 3)
