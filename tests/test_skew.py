"""One key holds most rows; the spread-out steps must give what a plain loop gives."""

import random

from pyspark.sql import functions as F

from tablelore.operators import history, lineage
from tablelore.operators.skew import number_by_ordinal, prefix_within_budget, top_per_key
from tablelore.session import spread, tasks_for


def key_of(i):
    return "hot" if i % 3 else f"k{i % 50}"


def test_top_per_key(spark):
    rows = [(key_of(i), (i * 7919) % 1000, i) for i in range(6000)]
    frame = spark.createDataFrame(rows, "k string, v int, id int").repartition(8)
    for n in (3, 40):
        got = {(r.k, r["rank"]): r.id for r in top_per_key(frame, ["k"], [F.col("v").desc(), F.col("id")], n, ["id"]).collect()}
        expected = {}
        for k in {r[0] for r in rows}:
            for place, row in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))[:n], start=1):
                expected[(k, place)] = row[2]
        assert got == expected


def test_numbering(spark):
    rows = [(key_of(i), i // 4, f"n{i}") for i in range(5000)]
    frame = spark.createDataFrame(rows, "k string, o int, name string").repartition(8)
    got = {(r.k, r.name): r.n for r in number_by_ordinal(frame, ["k"], "o", [F.col("name")], "n", width=64).collect()}
    expected = {}
    for k in {r[0] for r in rows}:
        for place, row in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])), start=1):
            expected[(k, row[2])] = place
    assert got == expected


def test_budget_prefix_equals_the_loop(spark):
    rng = random.Random(7)
    rows = []
    for i in range(4000):
        k = key_of(i) if i % 4 else f"small{i % 400}"
        rows.append((k, rng.choice([0.1, 0.5, 0.9]), rng.choice([0, 0, 1, 3, 8, 40, 200]), rng.choice(["same", f"t{i}"])))
    frame = spark.createDataFrame(rows, "k string, r double, cost int, text string").repartition(8)
    for budget in (0, 10, 60):
        got = sorted(tuple(r) for r in prefix_within_budget(
            frame, ["k"], [-F.col("r")], [F.col("text"), F.col("cost")], "cost", budget, ["text"]).collect())
        expected = []
        for k in {r[0] for r in rows}:
            used, kept = 0, []
            for row in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[3], r[2])):
                if used + row[2] > budget and kept:
                    break
                kept.append(row)
                used += row[2]
            expected += kept
        assert got == sorted(expected)


def test_mentions_equal_containment(spark):
    names = ["a.b." + "n" * 130, "a.b." + "n" * 140, "a.b.", "a.b.c", "a.b.cd", "xa.b.c", "a.bb.c", "main.s.t1", "main.s.t12", "a.b.c_d", "A.B.E"]
    pieces = ["a.b.c", "xa.b.cd e", "(A.b.C)", "main.s.t12.col", "a.b", ".b.", "a . b.c", "a.b.c.d.b.c", "q.a.b.cd", "a.bb.c", "a.b.e", "a.b." + "n" * 133]
    rng = random.Random(3)
    log = [(i, i, " ".join(rng.choices(pieces, k=rng.randint(0, 4)))) for i in range(300)]
    frame = spark.createDataFrame(log, "statement_id int, start_time int, statement_text string")
    targets = spark.createDataFrame([(n,) for n in names], "table_ref string")
    got = {(r.table_ref, r.statement_id) for r in history.mentions(frame, targets).collect()}
    assert got == {(n, i) for i, _, text in log for n in names if n.lower() in text.lower()}


def test_recent_statements_of_a_hot_table(spark):
    log = spark.createDataFrame([(i, i % 50, f"SELECT 1 FROM a.b.{key_of(i)}") for i in range(900)],
                                "statement_id int, start_time int, statement_text string")
    targets = spark.createDataFrame([("a.b.hot",), ("a.b.k3",)], "table_ref string")
    rows = sorted(tuple(r) for r in history.recent_mentions(log, targets, 20).collect())
    expected = []
    for ref in ("a.b.hot", "a.b.k3"):
        hits = sorted((i for i in range(900) if f"a.b.{key_of(i)}".startswith(ref)), key=lambda i: (-(i % 50), i))[:20]
        expected += [(ref, i, i % 50, place, f"SELECT 1 FROM a.b.{key_of(i)}") for place, i in enumerate(hits, start=1)]
    assert rows == sorted(expected)


def test_a_hub_table_lists_its_first_names(spark):
    edges = spark.createDataFrame([(f"c.s.n{i % 700:03d}", "c.s.hub" if i % 100 else "c.s.other") for i in range(1400)],
                                  "source_table_full_name string, target_table_full_name string")
    columns = spark.createDataFrame([], "source_table_full_name string, source_column_name string, "
                                        "target_table_full_name string, target_column_name string")
    targets = spark.createDataFrame([("c.s.hub",)], "table_ref string")
    text = lineage.lineage_snippets(edges, columns, targets, names_listed=3).first().text
    assert text == "Upstream sources (lineage): c.s.n001, c.s.n002, c.s.n003."


def test_linked_tables_take_more_tasks_when_there_are_more_edges(spark, monkeypatch):
    assert tasks_for(spark.range(1000), 10) == 100 and tasks_for(spark.range(1), 10) == spread(spark)
    edges = spark.createDataFrame([(f"c.s.n{i % 300:03d}", "c.s.hub" if i % 10 else None) for i in range(900)],
                                  "source_table_full_name string, target_table_full_name string")
    targets = spark.createDataFrame([("c.s.hub",), (None,)], "table_ref string")
    monkeypatch.setattr(lineage, "tasks_for", lambda rows: 37)
    monkeypatch.setattr(lineage, "TARGETS_SENT_WHOLE", 0)
    found = lineage.upstream(edges, targets)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert ", 37)" in plan and "ShuffledHashJoin" in plan
    assert sorted(tuple(r) for r in found.collect()) == [("c.s.hub", f"c.s.n{i:03d}") for i in range(300) if i % 10]


def test_rows_that_cost_nothing_do_not_meet(spark):
    rows = spark.range(1_000_000).select(
        F.lit("hot").alias("k"), F.col("id").alias("seq"), F.expr("IF(id % 100000 = 99999, 4, 0)").cast("int").alias("cost"),
        F.lit("text").alias("text"))
    kept = prefix_within_budget(rows, ["k"], [F.col("seq")], [F.col("text")], "cost", 10, ["text"])
    found = kept.agg(F.count(F.lit(1)), F.max("seq"), F.sum("cost")).first()
    assert tuple(found) == (299_999, 299_998, 8)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("Window")[1:]:  # what is summed up holds no text
        assert "text#" not in line.split("\n")[0]


def test_the_log_is_read_once(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.range(2000).select(F.col("id").alias("statement_id"), F.col("id").alias("start_time"),
                             F.concat(F.lit("SELECT 1 FROM main.hot.t"), F.col("id") % 700).alias("statement_text")).write.parquet(path)
    targets = spark.createDataFrame([(f"main.hot.t{k}",) for k in range(0, 700, 7)], "table_ref string")
    found = history.mentions(spark.read.parquet(path), targets)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    expected = {(f"main.hot.t{k}", i) for i in range(2000) for k in range(0, 700, 7) if f"t{i % 700}".startswith(f"t{k}")}
    assert {(r.table_ref, r.statement_id) for r in found.collect()} == expected
