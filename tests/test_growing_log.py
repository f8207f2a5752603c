import datetime

from pyspark.sql import functions as F

from tablelore.operators import history, runs
from tablelore.streaming.query_log import GrowingLog

FIELDS = ("table_ref", "statement_id", "rank", "statement_text")


def log(spark, first, last):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 37)
    text = F.format_string("SELECT x FROM a.b.t%d t JOIN a.b.u ON t.k = u.k GROUP BY x", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 40))
    return spark.range(first, last).select(F.col("id").cast("string").alias("statement_id"), at.alias("start_time"), text.alias("statement_text"))


def rows(df):
    return sorted(tuple(r[f] for f in FIELDS) for r in df.collect())


def test_increments_equal_one_batch_and_read_only_what_is_new(spark, tmp_path):
    folder = str(tmp_path / "log")
    targets = spark.createDataFrame([(f"a.b.t{k}",) for k in range(0, 40, 3)] + [("a.b.u",), ("a.b.never",)], "table_ref string")
    kept = GrowingLog(spark, str(tmp_path / "kept"), limit=20)
    log(spark, 0, 300).write.mode("append").parquet(folder)
    assert kept.advance(folder, targets) == 300 and kept.advance(folder, targets) == 0
    assert rows(kept.recent()) == rows(history.recent_mentions(spark.read.parquet(folder), targets, 20))
    log(spark, 300, 420).repartition(3).write.mode("append").parquet(folder)
    assert kept.advance(folder, targets, files_per_batch=1) == 120
    whole = spark.read.parquet(folder)
    assert rows(kept.recent()) == rows(history.recent_mentions(whole, targets, 20))
    told = sorted(tuple(r) for r in kept.usage_snippets().select("table_ref", "text", "seq").collect())
    assert told == sorted(tuple(r) for r in history.usage_snippets(whole, targets, 20).select("table_ref", "text", "seq").collect())


def test_a_batch_run_again_counts_once(spark, tmp_path):
    targets = spark.createDataFrame([("a.b.t0",)], "table_ref string")
    kept = GrowingLog(spark, str(tmp_path / "kept"), limit=5)
    kept.merge(log(spark, 0, 50), targets, 0)
    before, version = rows(kept.recent()), kept.versions.snapshot().version
    kept.merge(log(spark, 50, 90), targets, 0)
    assert rows(kept.recent()) == before and kept.versions.snapshot().version == version
    kept.merge(log(spark, 50, 90).filter("false"), targets, 1)
    assert rows(kept.recent()) == before and kept.versions.snapshot().version == version + 1
    again = kept.recent().first()
    assert isinstance(again.start_time, datetime.datetime) and again["rank"] == 1


def test_rollups_merge(spark):
    outcomes = spark.createDataFrame([("r", "ready_for_review"), ("r", "odd"), ("s", "skipped"), ("r", "needs_input")], "schema_run_id string, kind string")
    parts = runs.rollup(outcomes.limit(2)), runs.rollup(outcomes.subtract(outcomes.limit(2)))
    assert sorted(map(tuple, runs.merged_rollups(*parts).collect())) == sorted(map(tuple, runs.rollup(outcomes).collect()))
