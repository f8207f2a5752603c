"""Session settings and lineage cutting shared by the operators."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema


# Fixed value: rows of a shuffled table that one task takes.
ROWS_PER_TASK = 500_000
# Fixed value: sessions or tables, each with its columns, that one task takes.
TABLES_PER_TASK = 50_000
# Fixed value: up to so many keys to look up Spark may choose to send all of them to every task.
KEYS_SENT_WHOLE = 100_000

#: Applications whose tasks have this package.
_SHIPPED: set[str] = set()


def build_session(app: str = "tablelore", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(spark: SparkSession) -> int:
    """Number of slices a hot key is cut into: as many as there are shuffle partitions."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tasks_for(rows: DataFrame, each: int = ROWS_PER_TASK, number: int | None = None) -> int:
    """Number of shuffle partitions that gives a task about ``each`` of these rows, at least those of the session.

    For rows that nearly all get shuffled: with a fixed number the memory of a task would grow with them. It counts them unless
    their ``number`` is given, so they should be cheap to count, as a selection from a stored table is.
    """
    return max(spread(rows.sparkSession), -(-(rows.count() if number is None else number) // each))


def dealt(rows: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """Rows dealt by key over more tasks than the session has shuffle partitions; otherwise as they are."""
    return rows.repartition(tasks, *keys) if tasks > spread(rows.sparkSession) else rows


def gathered(rows: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """Rows dealt by key in any case, for steps that group and join them by more columns or several times: none deals them again."""
    return rows.repartition(tasks, *keys) if tasks > spread(rows.sparkSession) else rows.repartition(*keys)


def hashed(keys: DataFrame, number: int) -> DataFrame:
    """Keys to look rows up in, of about that number: many are hashed, so that the rows need no sorting; few are left to Spark."""
    return keys.hint("shuffle_hash") if number > KEYS_SENT_WHOLE else keys


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tablelore-checkpoint-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def write_shared(spark: SparkSession, name: str, content: bytes) -> str:
    """Writes a small file into the shared folder and gives its address."""
    folder = checkpoint_folder(spark).rstrip("/")
    store, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as file:
        file.write(content)
    return f"{folder}/{name}"


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder in the shared one, gone at the end: for tables that nothing reads later."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Lets the tasks of this session import this package, also where it is not installed on the executors."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(write_shared(spark, f"tablelore-{uuid.uuid4().hex}.zip", packed.getvalue()))


def cut_lineage(df: DataFrame, few: bool = False) -> DataFrame:
    """Reliable checkpoint in the shared folder.

    With ``few`` it has at most two files per core: for rows that many steps write anew, where a file per shuffle partition
    would be most of the work, and whose partitioning no later step needs.
    """
    checkpoint_folder(df.sparkSession)
    if few:
        df = df.coalesce(max(1, 2 * df.sparkSession.sparkContext.defaultParallelism))
    return df.checkpoint(eager=True)


def small_table(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType) -> DataFrame:
    """A few rows from the driver as a local relation, which Spark can plan with without a job."""
    named = [dict(zip(schema.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(named, to_arrow_schema(schema)), schema)
