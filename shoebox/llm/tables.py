"""Reading input tables and cutting lineage through tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Only Spark's reader touches the path, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or what the context was given.

    Only a local master, where driver and executors are one process, may fall back to a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Rows of text in one Arrow batch. A worker holds a batch's texts and what it makes of them at once.
TEXT_ROWS = 1_000


def short_batches(spark: SparkSession) -> None:
    """Let the session hand whole texts to Python workers in batches of at most TEXT_ROWS rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    The returned frame starts from files: a lost executor costs a re-read, not a re-run of what came before. The shuffle
    files of the work that made the table are of no more use and are deleted with its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shoebox-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    for made in _made.get():
        made.append(table)
    return table


#: Where the tables lie that `materialize` wrote.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


#: The lists that collect what is materialized inside of `collecting`.
_made: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("made", default=())


@contextmanager
def collecting() -> Iterator[list[DataFrame]]:
    """A list of all tables that are materialized inside, so that they can go when a result made from them is written."""
    made: list[DataFrame] = []
    before = _made.set((*_made.get(), made))
    try:
        yield made
    finally:
        _made.reset(before)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` returned. What is still to be read, later or by a returned frame, must stay."""
    for table in tables:
        spark, path = table.sparkSession, _paths.pop(table, None)
        if path is None:  # gone already
            continue
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Rows of a few numbers that may be sent to all executors at once.
SENT = 500_000


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `df` whose keys a table `gone` (nothing but its distinct keys, all numbers) does not hold.

    Few such rows are sent to where `df` is read, so that its other columns, perhaps whole texts, are not shuffled.
    """
    return df.join(F.broadcast(gone) if gone.count() <= SENT else gone, keys, "left_anti")


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each lengthened until `df` has no such column in any case: for columns an operator adds on its way."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
