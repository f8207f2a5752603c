"""The newest statements of each table, kept up while the query log grows.

A run reads the files of the log that came since the last one, in micro-batches, and merges the statements that
mention a table with the newest ones already kept. Tables lie in ``GROUPS`` groups by hash; only groups that a batch
touches are written anew. Rows and the number of the batch they came from change together, so a batch that is run
again after a failure counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators import history
from ..operators.skew import top_per_key
from ..session import cut_lineage
from ..sources.versions import Versions, key_of

GROUPS = 64
RECENT, PROGRESS = "recent", "progress"


def newest(rows: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` newest statements of each table, each once."""
    order = [F.col("start_time").desc(), F.col("statement_id")]
    ids = rows.select("table_ref", "statement_id", "start_time").distinct()
    kept = top_per_key(ids, ["table_ref"], order, limit, ["statement_id"])
    texts = rows.groupBy("table_ref", "statement_id").agg(F.min("statement_text").alias("statement_text"))
    return kept.join(texts, ["table_ref", "statement_id"]).select("table_ref", "statement_id", "start_time", "rank", "statement_text")


class GrowingLog:
    """The newest statements per table of ``targets``, in a store; ``log`` is a folder of Parquet files that grows.

    The log has ``statement_id``, ``start_time`` and ``statement_text``; ``kinds`` are the types of the first two. Tables that
    become targets later are known from then on; for their past the store has to be begun anew.
    """

    def __init__(self, spark: SparkSession, folder: str, limit: int = history.RECENT_STATEMENTS, kinds: tuple[str, str] = ("string", "timestamp")):
        self.spark, self.folder, self.limit = spark, folder.rstrip("/"), limit
        self.versions = Versions(spark, f"{self.folder}/state")
        self.schema = T.StructType.fromDDL(f"table_ref string, statement_id {kinds[0]}, start_time {kinds[1]}, statement_text string")

    def _group(self) -> Column:
        return F.pmod(F.xxhash64("table_ref"), F.lit(GROUPS)).cast("string")

    def advance(self, log: str, targets: DataFrame, files_per_batch: int | None = None) -> int:
        """Reads what is new in the log and gives the number of rows read."""
        reader = self.spark.readStream.schema(T.StructType([f for f in self.schema.fields if f.name != "table_ref"]))
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        query = (
            reader.parquet(log).writeStream.foreachBatch(lambda rows, number: self.merge(rows, targets, number))
            .option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).start())
        query.awaitTermination()
        return sum(int(step["numInputRows"]) for step in query.recentProgress)

    def merge(self, rows: DataFrame, targets: DataFrame, number: int) -> None:
        """One batch of the log into the store; a batch that is there already changes nothing."""
        base = self.versions.snapshot()
        done = base.parts.get(PROGRESS, {}).get("batch")
        if done is not None and int(done) >= number:
            return
        rows = rows.persist()  # read for the names, and for the texts of the statements that have some
        named = history.mentions(rows, targets).select("table_ref", "statement_id")
        fresh = cut_lineage(rows.join(named, "statement_id").select(*self.schema.names))
        rows.unpersist()
        keys = [row[0] for row in fresh.select(key_of(self._group())).distinct().collect()]
        changes = {PROGRESS: {"batch": str(number)}}
        if keys:
            kept = self.versions.read(RECENT, self.schema, base, keys).unionByName(fresh)
            merged = newest(kept, self.limit).drop("rank").withColumn("in_group", self._group())
            changes[RECENT] = self.versions.write(RECENT, merged, "in_group")
        self.versions.commit(base, changes)

    def recent(self) -> DataFrame:
        """As ``history.recent_mentions`` gives it for the whole log so far."""
        return newest(self.versions.read(RECENT, self.schema), self.limit)

    def usage_snippets(self, listed: int = history.LISTED) -> DataFrame:
        return history.snippets_of(self.recent(), listed)
