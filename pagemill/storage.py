"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Tables of cut() that still stand, by scope; the first scope is the driver process's own.
_SCOPES: list[list[DataFrame]] = [[]]


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where it is unset, a session whose only process is the driver (tests, benches) gets a new folder of its own; on a
    cluster that is an error, as executors can't read each other's local folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends here, and a lost executor costs only
    a reread. The table stands until drop(), or until the innermost scratch() around this call ends."""
    path = f"{shared_folder(df.sparkSession)}/pagemill-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    _SCOPES[-1].append(out)
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes tables of cut() that nothing reads any more; other frames are let be."""
    for df in frames:
        if path := getattr(df, "cut_path", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
            for scope in _SCOPES:
                scope[:] = [x for x in scope if getattr(x, "cut_path", None) != path]


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables cut within are dropped when the block ends. What is appended to the list that it gives stays, and goes over
    to the scope outside."""
    made, kept = [], []
    _SCOPES.append(made)
    try:
        yield kept
    finally:
        _SCOPES.remove(made)
        stay = {getattr(x, "cut_path", None) for x in kept}
        _SCOPES[-1].extend(x for x in made if x.cut_path in stay)
        drop(*[x for x in made if x.cut_path not in stay])


@atexit.register
def release() -> None:
    """Drops all tables that still stand: for the one who has read a query's result, and at the driver's end."""
    for scope in _SCOPES:
        for df in list(scope):
            with contextlib.suppress(Exception):  # the session may have ended before
                drop(df)
        scope.clear()
