"""Near-duplicate embeddings by a robust-pruned flat graph.

Vectors are compared when their labels are equal and not null. Rows with equal label and vector are one node from the
start. The nodes of a label are cut by k-means, level by level, into shards of at most ``CAP``; each node has one home and
is a guest in the next nearest clusters, so shards overlap. In every shard a task links each node to others of its
neighbourhood and to some far ones by robust pruning: of candidates that lie in the same direction the nearest one stays.
The lists of a node from all its shards together are its list in the flat graph.

Every node is searched in all shards it belongs to: a greedy walk from the shard's medoid and from the node itself, then,
as long as nodes within the widened range turn up, the walk goes on from each of them. What is found is verified by its
cosine in double precision and counted at the shard where it is at home; a search that meets a guest goes on at the
guest's home in the next round, until no search is left. A task returns counts and one edge per node to its component
within the task, never pairs. At the end a sample of ``AUDIT`` nodes is compared with all others exactly; if less than
``RECALL`` of their links was found, everything is built again with one more overlapping cluster.

A label with a third of all rows is only more shards. A cluster that k-means does not separate is dealt into shards of
``CAP`` by hash, and its members are searched in all of them. Searches of a shard go in groups of ``QUERIES``, each with
its own copy of the shard.

Vectors that are null, empty, zero, or hold null or non-finite components are linked with nothing, as are rows without
label; vectors of different lengths are not linked. A component is named by its smallest id, null where no row of it has
one. Repeated rows are linked with each other. No rows give none.
"""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablelore.session import cut_lineage, scratch, spread

from .circulant import components
from .common import finite

LEAST = 0.98
#: Nodes of a shard at most and about; clusters a cell is cut into at once; levels; nodes k-means learns from; rows a task assigns.
CAP, TARGET, FAN, LEVELS, SAMPLE, ASSIGNED = 1024, 512, 16, 8, 1024, 8192
#: Clusters that a node belongs to at first and at most.
OVERLAP, MOST_OVERLAP = 2, 4
#: Near and far candidates of a node, its neighbours in a shard, and how much shorter a detour must be to stand for an edge.
NEAR, FAR, DEGREE, ALPHA = 64, 32, 32, 1.2
#: Nodes a walk keeps, the range (in angles) in which it goes on from every node, searches of a task and those stepped at once.
BEAM, WIDER, QUERIES, AT_ONCE = 8, 1.5, 4096, 256
AUDIT, RECALL = 512, 0.99
ITERATIONS = 8
#: Distances between candidates that are held at once.
PRUNED = 1 << 21
FOUND = "kind int, node long, other long, shard string"
_COUNT, _EDGE, _FORWARD = 0, 1, 2


def units(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows of length one, in double precision."""
    lists = column.combine_chunks()
    rows = np.asarray(lists.flatten(), float).reshape(len(lists), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _dots(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows ``a`` of one matrix and ``b`` of the other, pair by pair."""
    found = np.empty(len(a))
    for at in range(0, len(a), 1 << 14):
        part = slice(at, at + (1 << 14))
        found[part] = np.einsum("ij,ij->i", left[a[part]], right[b[part]])
    return found


def _centres(key: tuple, table: pa.Table) -> pa.Table:
    """Centres of the sampled nodes of one cell, by spherical k-means from nodes far from each other."""
    order = np.argsort(table.column("node").to_numpy())
    rows = units(table.column("vector"))[order]
    many = min(len(rows), table.column("parts")[0].as_py())
    chosen, nearest = [0], rows @ rows[0]
    for _ in range(many - 1):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    centres = rows[chosen]
    for _ in range(ITERATIONS):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return pa.table({"in_cell": pa.array([key[0].as_py()]), "centres": pa.array([centres.ravel().tolist()], pa.list_(pa.float64()))})


def _assigned(overlap: int, names: list[str]):
    def run(members: pa.Table, centres: pa.Table) -> pa.Table:
        if not members.num_rows:
            return members.select(names)
        rows = units(members.column("vector"))
        near = rows @ np.array(centres.column("centres")[0].as_py()).reshape(-1, rows.shape[1]).T
        order = np.argsort(-near, axis=1, kind="stable")[:, :overlap]
        home = members.column("home").to_numpy()
        cell, made = members.column("cell")[0].as_py(), []
        for k in range(order.shape[1]):  # guests go one way, homes leave a guest behind in each further cluster
            taken = np.flatnonzero(home if k else np.ones(len(home), bool))
            part = members.take(pa.array(taken))
            part = part.set_column(part.schema.get_field_index("cell"), "cell", pa.array([f"{cell}.{c}" for c in order[taken, k]], pa.string()))
            made.append(part.set_column(part.schema.get_field_index("home"), "home", pa.array(home[taken] & (k == 0))).select(names))
        return pa.concat_tables(made)
    return run


def sharded(nodes: DataFrame, overlap: int) -> DataFrame:
    """``node``, ``cell``, ``home``, ``vector``, ``shard``: all memberships."""
    members = nodes.select("node", "cell", F.lit(True).alias("home"), "vector")
    schema, names = ", ".join(f"{name} {kind}" for name, kind in members.dtypes), members.columns
    deals = spread(nodes.sparkSession)
    for _ in range(LEVELS):
        large = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CAP)
        large = cut_lineage(large.select("cell", "n", F.ceil(F.col("n") / ASSIGNED).cast("int").alias("slices"),
                                         F.least(F.lit(FAN), F.ceil(F.col("n") / TARGET)).cast("int").alias("parts")))
        if large.isEmpty():
            break
        # A cell meets its size in as many tasks as there are, and only few rows more than the sample are ranked.
        known = large.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
        marked = cut_lineage(members.withColumn("deal", F.expr(f"cast(pmod(xxhash64(node, 4), {deals}) AS int)")).join(known, ["cell", "deal"], "left"))
        split = marked.filter("n IS NOT NULL")
        first = Window.partitionBy("cell").orderBy(F.xxhash64("node"), "node")
        likely = split.filter(F.expr(f"pmod(xxhash64(node), {1 << 30}) * cast(n AS double) <= {4 * SAMPLE << 30}"))
        sample = likely.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= SAMPLE)
        centres = cut_lineage(sample.select("cell", "node", "vector", "parts").groupBy("cell").applyInArrow(
            _centres, "in_cell string, centres array<double>"))
        dealt = split.select(*names, F.expr("cast(pmod(xxhash64(node, 1), slices) AS int)").alias("slice"))
        sent = centres.join(large.select(F.col("cell").alias("in_cell"), "slices"), "in_cell").select(
            "in_cell", "centres", F.explode(F.expr("sequence(0, slices - 1)")).alias("in_slice"))
        moved = dealt.groupBy("cell", "slice").cogroup(sent.groupBy("in_cell", "in_slice")).applyInArrow(_assigned(overlap, names), schema)
        members = cut_lineage(marked.filter("n IS NULL").select(names).union(moved))
    sizes = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CAP).cast("int").alias("slices"))
    shard = F.concat_ws("#", "cell", F.expr("pmod(xxhash64(node, 2), slices)").cast("string"))
    return members.join(sizes, "cell").select(*names, "slices", shard.alias("shard"))


def _pruned(rows: np.ndarray, pool: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Robust pruning for many nodes at once: the neighbours kept of each pool, -1 where fewer. ``near``: their cosines."""
    order = np.argsort(-near, axis=1, kind="stable")
    pool, near = np.take_along_axis(pool, order, 1), np.take_along_axis(near, order, 1)
    found = rows[np.maximum(pool, 0)]
    # Squares of distances, halved: a detour is worth an edge if ALPHA times its length is not above the edge's.
    between = ALPHA ** 2 * (1 - found @ found.transpose(0, 2, 1))
    alive, each = np.isfinite(near), np.arange(len(pool))
    away = 1 - np.where(alive, near, 0)
    kept = np.full((len(pool), DEGREE), -1)
    for k in range(DEGREE):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = alive.argmax(axis=1)
        kept[some, k] = pool[some, pick[some]]
        alive &= between[each, pick] > away
        alive[each, pick] = False
    return kept


def graph(rows: np.ndarray) -> np.ndarray:
    """The neighbours of every row of one shard, -1 where fewer than ``DEGREE``."""
    size, made = len(rows), np.random.default_rng(len(rows))
    wide = min(NEAR, size - 1)
    kept = np.full((size, DEGREE), -1)
    if not wide:
        return kept
    for at in range(0, size, AT_ONCE // 2):
        own = np.arange(at, min(at + AT_ONCE // 2, size))
        near = rows[own] @ rows.T
        near[np.arange(len(own)), own] = -np.inf
        pool = np.concatenate([np.argpartition(-near, wide - 1, axis=1)[:, :wide], made.integers(0, size, (len(own), FAR))], axis=1)
        kept[own] = _pruned(rows, pool, np.take_along_axis(near, pool, 1))
    a, b = np.repeat(np.arange(size), DEGREE), kept.ravel()
    a, b = np.concatenate([a[b >= 0], b[b >= 0]]), np.concatenate([b[b >= 0], a[b >= 0]])
    edges = np.unique(a * size + b)  # both ways, so that what is found from one side is found from the other
    a, b = edges // size, edges % size
    starts = np.searchsorted(a, np.arange(size + 1))
    many = np.diff(starts)
    rank = np.arange(len(a)) - starts[a]
    few = many[a] <= DEGREE
    kept[:] = -1
    kept[a[few], rank[few]] = b[few]
    more = np.flatnonzero(many > DEGREE)
    more = more[np.argsort(many[more], kind="stable")]
    while len(more):  # pools of like size at once, so many that their distances fit
        wide = int(many[more[min(len(more), AT_ONCE // 2) - 1]])
        own, more = np.split(more, [max(1, min(AT_ONCE // 2, PRUNED // wide ** 2))])
        wide = int(many[own[-1]])
        at = starts[own][:, None] + np.arange(wide)
        there = np.arange(wide) < many[own][:, None]
        pool = np.where(there, b[np.minimum(at, len(b) - 1)], -1)
        near = np.einsum("ijk,ik->ij", rows[np.maximum(pool, 0)], rows[own])
        kept[own] = _pruned(rows, pool, np.where(there, near, -np.inf))
    return kept


def _neighbours(table: pa.Table) -> pa.Table:
    table = table.sort_by("node")
    ids = table.column("node").to_numpy()
    kept = graph(units(table.column("vector")))
    return pa.table({"node": ids, "neighbours": pa.array([ids[k[k >= 0]].tolist() for k in kept], pa.list_(pa.int64()))})


class Shard:
    """Members of a shard with their lists, and walks through them."""

    def __init__(self, rows: np.ndarray, near: np.ndarray):
        self.rows, self.near = rows, near
        self.medoid = int((rows @ rows.sum(axis=0)).argmax())

    def search(self, asked: np.ndarray, starts: np.ndarray, least: float) -> np.ndarray:
        """For each asked vector the rows within the range that its walk met, as a matrix of flags."""
        many, size = len(asked), len(self.rows)
        each = np.arange(many)
        wide = np.cos(min(WIDER * np.arccos(least), np.pi))
        met, within, linked = (np.zeros((many, size), bool) for _ in range(3))

        def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            near = _dots(asked, self.rows, a, b)
            met[a, b] = True
            within[a, b] |= near >= wide
            linked[a, b] |= near >= least
            return near

        beam, score = np.full((many, BEAM), -1), np.full((many, BEAM), -np.inf)
        done = np.ones((many, BEAM), bool)
        begin = np.concatenate([np.full((many, 1), self.medoid), starts], axis=1)
        for k in range(begin.shape[1]):
            fresh = (begin[:, k] >= 0) & ~met[each, begin[:, k]]
            beam[fresh, k], done[fresh, k] = begin[fresh, k], False
            score[fresh, k] = meet(each[fresh], begin[fresh, k])
        while True:
            best = np.where(done, -np.inf, score).argmax(axis=1)
            go = np.flatnonzero(~done[each, best])
            if not len(go):
                break
            done[go, best[go]] = True
            onward = self.near[beam[go, best[go]]]
            a, k = np.nonzero((onward >= 0) & ~met[go[:, None], onward])
            b = onward[a, k]
            more = np.full(onward.shape, -np.inf)
            more[a, k] = meet(go[a], b)
            scores, ids = np.concatenate([score[go], more], axis=1), np.concatenate([beam[go], onward], axis=1)
            spent = np.concatenate([done[go], np.isneginf(more)], axis=1)
            top = np.argpartition(-scores, BEAM - 1, axis=1)[:, :BEAM]
            beam[go], score[go], done[go] = (np.take_along_axis(x, top, 1) for x in (ids, scores, spent))
        gone = np.zeros((many, size), bool)
        while True:
            a, b = np.nonzero(within & ~gone)
            if not len(a):
                return linked
            gone[a, b] = True
            ahead = np.zeros((many, size + 1), bool)
            for at in range(0, len(a), 1 << 15):
                part = slice(at, at + (1 << 15))
                ahead[a[part, None], self.near[b[part]]] = True  # -1: the column that is cut off
            meet(*np.nonzero(ahead[:, :size] & ~met))


class _Parts:
    """Components of numbers that are joined a set at a time."""

    def __init__(self, size: int):
        self.above = np.arange(size)

    def root(self, of: np.ndarray) -> np.ndarray:
        while True:
            up = self.above[of]
            if (up == of).all():
                return of
            of = up

    def join(self, of: np.ndarray) -> None:
        roots = self.root(of)
        self.above[roots] = self.above[of] = roots.min()


def _searched(least: float):
    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if index.num_rows and asked.num_rows:
            index = index.sort_by("node")
            ids, at_home = index.column("node").to_numpy(), index.column("home").to_numpy()
            weights, homes = index.column("weight").to_numpy(), index.column("home_shard").to_pylist()
            lists = index.column("neighbours").combine_chunks()
            starts, listed = lists.offsets.to_numpy(), np.asarray(lists.values)
            places = np.minimum(np.searchsorted(ids, listed), len(ids) - 1)
            here = ids[places] == listed
            owner = np.repeat(np.arange(len(ids)), np.diff(starts))[here]
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
            near = np.full((len(ids), int(rank.max(initial=0)) + 1), -1)
            near[owner, rank] = places[here]
            shard = Shard(units(index.column("vector")), near)
            names, codes = np.unique(np.array(homes, object).astype(str), return_inverse=True)

            def place(values: np.ndarray) -> np.ndarray:
                at = np.minimum(np.searchsorted(ids, values), len(ids) - 1)
                return np.where(ids[at] == values, at, -1)

            asked = asked.sort_by("node")
            nodes, rows = asked.column("node").to_numpy(), units(asked.column("vector"))
            own, entry = place(nodes), place(asked.column("entry").to_numpy())
            parts, every = _Parts(len(ids) + len(nodes)), np.concatenate([ids, nodes])
            for at in range(0, len(nodes), AT_ONCE):
                part = np.arange(at, min(at + AT_ONCE, len(nodes)))
                linked = shard.search(rows[part], np.stack([own[part], entry[part]], axis=1), least)
                known = own[part] >= 0
                linked[np.flatnonzero(known), own[part][known]] = False
                found = (linked & at_home) @ weights
                out += [(_COUNT, int(nodes[q]), int(n), None) for q, n in zip(part, found) if n]
                for k in np.flatnonzero(linked.any(axis=1)):
                    same = [len(ids) + part[k]] + ([own[part[k]]] if known[k] else [])
                    parts.join(np.concatenate([np.flatnonzero(linked[k]), same]))
                a, b = np.nonzero(linked & ~at_home)
                _, first = np.unique(a * len(names) + codes[b], return_index=True)
                out += [(_FORWARD, int(nodes[part[a[k]]]), int(ids[b[k]]), str(names[codes[b[k]]])) for k in first]
            root = parts.root(np.arange(len(every)))
            out += [(_EDGE, int(every[k]), int(every[root[k]]), None) for k in np.flatnonzero(every != every[root])]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out) if out else [()] * 4, kinds)], names=["kind", "node", "other", "shard"])
    return run


def _search(nodes: DataFrame, members: DataFrame, least: float, folder: str) -> tuple[DataFrame, DataFrame]:
    """Per node the ``found`` links with other nodes, and edges ``a``, ``b`` that hold their components together."""
    spark = nodes.sparkSession
    members.write.parquet(f"{folder}/members")
    members = spark.read.parquet(f"{folder}/members")
    lists = members.groupBy("shard").applyInArrow(_neighbours, "node long, neighbours array<long>")
    flat = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))
    homes = members.filter("home").select("node", F.col("shard").alias("home_shard"))
    members.join(flat.join(homes, "node").join(nodes.select("node", "weight"), "node"), "node").select(
        "shard", "node", "home", "vector", "home_shard", "weight", "neighbours").write.parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")

    own = members.select("cell", "node", "vector", F.lit(-1).cast("bigint").alias("entry"),
                         F.explode(F.expr("sequence(0, slices - 1)")).alias("k"))
    pending = own.select(F.concat_ws("#", "cell", F.col("k").cast("string")).alias("asked"), "node", "vector", "entry")
    seen, results = pending.select("asked", "node"), []
    while True:
        sizes = pending.groupBy("asked").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("slices"))
        dealt = pending.join(sizes, "asked").withColumn("asked_slice", F.expr("cast(pmod(xxhash64(node, 3), slices) AS int)")).drop("slices")
        copies = index.join(sizes.withColumnRenamed("asked", "shard"), "shard").withColumn(
            "slice", F.explode(F.expr("sequence(0, slices - 1)"))).drop("slices")
        found = cut_lineage(copies.groupBy("shard", "slice").cogroup(dealt.groupBy("asked", "asked_slice")).applyInArrow(_searched(least), FOUND))
        results.append(found)
        onward = found.filter(F.col("kind") == _FORWARD).groupBy(F.col("shard").alias("asked"), "node").agg(F.min("other").alias("entry"))
        onward = cut_lineage(onward.join(seen, ["asked", "node"], "left_anti"))
        if onward.isEmpty():
            break
        seen = seen.union(onward.select("asked", "node"))
        pending = onward.join(nodes.select("node", "vector"), "node").select("asked", "node", "vector", "entry")
    every = reduce(DataFrame.union, results)
    counts = every.filter(F.col("kind") == _COUNT).groupBy("node").agg(F.sum("other").alias("found"))
    return cut_lineage(counts), every.filter(F.col("kind") == _EDGE).select(F.col("node").alias("a"), F.col("other").alias("b"))


def _exact(cells: list[str], asked: np.ndarray, least: float):
    """Per task the number of rows linked with each asked vector of the same cell."""
    def run(batches):
        found = np.zeros(len(cells), np.int64)
        own = np.array(cells, object)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = pa.Table.from_batches([batch.slice(at, 1024)])
                sizes, there = part.column("size").to_numpy(), np.array(part.column("cell").to_pylist(), object)
                for size in np.unique(sizes):
                    same = np.flatnonzero(sizes == size)
                    mine = np.flatnonzero([len(v) == size for v in asked])
                    if len(mine):
                        rows = units(part.column("vector").take(pa.array(same)))
                        near = np.stack([asked[k] for k in mine]) @ rows.T
                        linked = (near >= least) & (own[mine][:, None] == there[same])
                        found[mine] += linked @ part.column("weight").to_numpy()[same]
        yield pa.RecordBatch.from_arrays([pa.array([found.tolist()])], names=["found"])
    return run


def recall(nodes: DataFrame, counts: DataFrame, least: float = LEAST, sample: int = AUDIT) -> float:
    """The share of the links of a sample of nodes, of bounded size, that was found; all nodes are compared with it."""
    taken = nodes.orderBy(F.xxhash64("node"), "node").limit(sample).join(counts, "node", "left").select(
        "node", "cell", "vector", "weight", F.coalesce("found", F.lit(0)).alias("found")).collect()
    if not taken:
        return 1.0
    asked = [units(pa.chunked_array([pa.array([row.vector], pa.list_(pa.float64()))]))[0] for row in taken]
    parts = nodes.select("cell", "vector", "weight", F.size("vector").alias("size")).mapInArrow(
        _exact([row.cell for row in taken], asked, least), "found array<long>")
    summed = parts.select(F.posexplode("found").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    there = {row["at"]: row.n for row in summed}
    true = [there.get(k, 0) - row.weight for k, row in enumerate(taken)]
    return sum(min(row.found, n) for row, n in zip(taken, true)) / sum(true) if sum(true) else 1.0


def near_duplicates(table: DataFrame, least: float = LEAST, vec_id: str = "vec_id", vector: str = "embedding",
                    label: str = "label") -> DataFrame:
    """Per row: ``vec_id``, ``n_links`` (other rows linked with it), ``component_id`` and ``kept``."""
    fine = finite(table[vector]) & F.coalesce(F.exists(table[vector], lambda c: c != 0), F.lit(False)) & table[label].isNotNull()
    cell = F.concat_ws("/", table[label].cast("string"), F.size(table[vector]).cast("string"))
    rows = table.select(table[vec_id].cast("bigint").alias("vec_id"), F.when(fine, cell).alias("cell"), table[vector].alias("vector"))
    usable = rows.filter("cell IS NOT NULL")
    nodes = usable.groupBy("cell", "vector").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least_id"))
    nodes = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id()))
    for overlap in range(OVERLAP, MOST_OVERLAP + 1):
        with scratch(table.sparkSession, "flat-graph") as folder:
            counts, edges = _search(nodes, sharded(nodes, overlap), least, folder)
        share = recall(nodes, counts, least)
        if share >= RECALL:
            break
    else:
        warnings.warn(f"only {share:.3f} of the links of the audited vectors were found", stacklevel=2)
    labels = components(edges).withColumnRenamed("label", "part")
    named = nodes.join(labels, "node", "left").join(counts, "node", "left").select(
        "cell", "vector", "least_id", F.coalesce("part", "node").alias("part"), (F.coalesce("found", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    least_ids = named.groupBy("part").agg(F.min("least_id").alias("component_id"))
    known = named.join(least_ids, "part").select("cell", "vector", "n_links", "component_id")
    found = usable.join(known, ["cell", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("cell IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
