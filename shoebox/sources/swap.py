"""Whole tables put in the place of others."""

from __future__ import annotations

from pyspark.sql import SparkSession


def put_in_place(spark: SparkSession, new: str, path: str) -> None:
    """Make the finished folder `new` the one at `path`, whose old rows stay until then.

    The old folder is put aside as `path.old`, and deleted once the new one is in its place. A reader that comes between
    the two renames finds no table, never part of one. A crash there leaves both folders whole: `restore` puts the old
    one back, and every call begins with it. Only one writer may be at work on a path.
    """
    path, old = path.rstrip("/"), f"{path.rstrip('/')}.old"
    restore(spark, path)
    at = {p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (new, path, old)}
    store = at[path].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at[new]):
        raise FileNotFoundError(new)
    if store.exists(at[path]):
        store.delete(at[old], True)
        if not store.rename(at[path], at[old]):
            raise OSError(f"could not put {path} aside")
    try:
        done = store.rename(at[new], at[path])
    finally:
        restore(spark, path)
    if not done:
        raise OSError(f"could not put {new} in its place")
    store.delete(at[old], True)


def restore(spark: SparkSession, path: str) -> bool:
    """Put back what a crash left aside; whether there was something to put back."""
    path = path.rstrip("/")
    own, old = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.old"))
    store = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not store.exists(own) and store.exists(old) and store.rename(old, own)
