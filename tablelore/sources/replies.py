"""Replies of a model, kept as they come.

A writer asks the model inside its tasks and puts the replies into the folder a few at a time, each file whole before
it has its name. A run that breaks off, even in the middle of a task, keeps what it has paid for; the run after it asks
only what is missing, and so does a task that Spark runs again. Files lie in folders by the first digits of the call's key, so that looking up some calls reads
some of the folders.

Failed calls are noted with the attempt they belong to and are asked again by the next one. A call asked twice, by
tasks that ran twice, counts as it was answered first.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import cut_lineage, ship_package

Model = Callable[[list[dict[str, str]]], str]

#: Digits of a key that name its folder; calls and seconds after which a task puts its replies away.
DIGITS, KEEP_EVERY, KEEP_SECONDS = 2, 16, 20.0
_KEPT = pa.schema([("call_id", pa.string()), ("reply", pa.string()), ("failure", pa.string()), ("attempt", pa.string()), ("at", pa.float64())])
KEPT = T.StructType([T.StructField(name, kind) for name, kind in zip(
    _KEPT.names, (T.StringType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType()))])


def _place(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address if "://" in address else f"file://{address}")


@dataclass
class Kept(WriterCommitMessage):
    """What one task has put away."""

    files: list[str] = field(default_factory=list)
    replies: int = 0
    failures: int = 0


class AskingWriter(DataSourceArrowWriter):
    """Asks the model for every row (``call_id``, ``messages``) and keeps what it says under ``folder``."""

    def __init__(self, folder: str, model: Model, attempt: str, keep_every: int):
        self.folder, self.model, self.attempt, self.keep_every = folder, model, attempt, keep_every

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Kept:
        kept, waiting, began = Kept(), [], time.monotonic()
        task = TaskContext.get()
        done = self._put_away() if task and task.attemptNumber() else set()
        for batch in iterator:
            for call_id, messages in zip(batch.column("call_id").to_pylist(), batch.column("messages").to_pylist()):
                if call_id in done:
                    continue
                late = time.monotonic() - began > KEEP_SECONDS
                if waiting and (late or len(waiting) >= self.keep_every or waiting[0][0][:DIGITS] != call_id[:DIGITS]):
                    self._keep(waiting, kept)
                    waiting, began = [], time.monotonic()
                reply = failure = None
                try:
                    reply = self.model(json.loads(messages))
                except Exception as problem:  # one failed call must not fail the others
                    failure = str(problem) or type(problem).__name__
                waiting.append((call_id, reply, failure, self.attempt, time.time()))
        if waiting:
            self._keep(waiting, kept)
        return kept

    def _own(self) -> str:
        task = TaskContext.get()
        return f"{self.attempt}-{task.partitionId() if task else 0}-"

    def _put_away(self) -> set[str]:
        """Calls that this task was answered before it had to run again."""
        store, root = _place(self.folder)
        done: set[str] = set()
        for file in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if file.base_name.startswith(self._own()):
                rows = pq.read_table(file.path, columns=["call_id", "failure"], filesystem=store, partitioning=None).to_pylist()
                done.update(row["call_id"] for row in rows if row["failure"] is None)
        return done

    def _keep(self, rows: list[tuple], kept: Kept) -> None:
        """One more file. Names are new each time, so a task that runs again overwrites nothing."""
        store, root = _place(self.folder)
        name = f"{self._own()}{uuid.uuid4().hex}.parquet"
        into = f"{root}/digits={rows[0][0][:DIGITS]}"
        table = pa.table([pa.array(x, kind) for x, kind in zip(zip(*rows), _KEPT.types)], schema=_KEPT)
        store.create_dir(into, recursive=True)
        with store.open_output_stream(f"{into}/_{name}") as file:  # readers pass over names that begin so
            pq.write_table(table, file)
        store.move(f"{into}/_{name}", f"{into}/{name}")
        kept.files.append(f"digits={rows[0][0][:DIGITS]}/{name}")
        kept.replies += sum(row[2] is None for row in rows)
        kept.failures += sum(row[2] is not None for row in rows)

    def _note(self, messages: list[Kept | None], whole: bool) -> None:
        done = [m for m in messages if m is not None]
        note = {"attempt": self.attempt, "whole": whole, "replies": sum(m.replies for m in done),
                "failures": sum(m.failures for m in done), "files": sorted(f for m in done for f in m.files)}
        store, root = _place(self.folder)
        store.create_dir(f"{root}/_attempts", recursive=True)
        with store.open_output_stream(f"{root}/_attempts/{self.attempt}.json") as file:
            file.write(json.dumps(note).encode())

    def commit(self, messages: list[Kept | None]) -> None:
        self._note(messages, True)

    def abort(self, messages: list[Kept | None]) -> None:
        """What tasks have kept stays; the note says that the attempt is not whole."""
        self._note(messages, False)


def _source(called: str, sink: AskingWriter) -> type[DataSource]:
    class Asking(DataSource):
        @classmethod
        def name(cls) -> str:
            return called

        def writer(self, schema: T.StructType, overwrite: bool) -> AskingWriter:
            return sink
    return Asking


class Replies:
    """The replies kept in one folder, by ``call_id``: a hexadecimal key."""

    def __init__(self, spark: SparkSession, folder: str, keep_every: int = KEEP_EVERY):
        self.spark, self.folder, self.keep_every = spark, folder.rstrip("/"), keep_every

    def _rows(self, calls: DataFrame) -> DataFrame:
        """What is kept of some calls, read from their folders only; at most 16 ** DIGITS names pass the driver."""
        digits = F.substring("call_id", 1, DIGITS)
        asked = [row[0] for row in calls.select(digits).distinct().collect()]
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not asked or not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], KEPT)
        stored = self.spark.read.schema(T.StructType([*KEPT.fields, T.StructField("digits", T.StringType())])).parquet(self.folder)
        return stored.filter(F.col("digits").isin(asked)).join(calls.select("call_id").distinct(), "call_id", "left_semi").select(KEPT.names)

    def known(self, calls: DataFrame) -> DataFrame:
        """``call_id`` and ``reply`` of the calls that were answered, each once."""
        rows = self._rows(calls).filter("failure IS NULL")
        return rows.groupBy("call_id").agg(F.min_by("reply", F.struct("at", "attempt", "reply")).alias("reply"))

    def ask(self, prompts: DataFrame, model: Model, partitions: int | None = None) -> DataFrame:
        """``call_id``, ``reply``, ``failure`` of all prompts (``call_id``, ``messages``), asking for those not yet known."""
        ship_package(self.spark)
        prompts = prompts.select("call_id", "messages")
        todo = cut_lineage(prompts.join(self.known(prompts).select("call_id"), "call_id", "left_anti").dropDuplicates(["call_id"]))
        attempt = uuid.uuid4().hex
        if not todo.isEmpty():
            called = f"asking_{attempt}"
            self.spark.dataSource.register(_source(called, AskingWriter(self.folder, model, attempt, self.keep_every)))
            dealt = todo.repartitionByRange(partitions or self.spark.sparkContext.defaultParallelism, "call_id")
            dealt.sortWithinPartitions("call_id").write.format(called).mode("append").save()
        rows = self._rows(prompts).withColumn("answered", F.col("failure").isNull()).filter(
            F.col("answered") | (F.col("attempt") == attempt))
        first = F.min(F.struct((~F.col("answered")).alias("failed"), "at", "attempt", "reply", "failure")).alias("x")
        return cut_lineage(rows.groupBy("call_id").agg(first).select("call_id", "x.reply", "x.failure"))
