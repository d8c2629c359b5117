"""Session helpers: where intermediate tables go, and how a small side is broadcast."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHIPPED: set[str] = set()
#: Paths of the intermediate tables of the query that runs in this context.
WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='pixelmill-')}/pixelmill", "zip", package.parent, package.name)
    sc.addPyFile(archive)
    SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may run without one; it then gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="pixelmill-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def written() -> list[str]:
    """The paths of this context; each thread has its own outside a scope."""
    paths = WRITTEN.get()
    if paths is None:
        WRITTEN.set(paths := [])
    return paths


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    written().append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_threads(work: Callable, items: Sequence, threads: int = 6) -> list:
    """``work`` of each item, a few at a time, so that small jobs share the cluster; the intermediate tables that they
    write belong to the scope of the caller."""
    written()
    contexts = [copy_context() for _ in items]
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(lambda context, item: context.run(work, item), contexts, items))


def sized(df: DataFrame, name: str) -> DataFrame:
    """An aggregate to join back, written once and read again: Spark then knows its bytes and broadcasts it only
    under ``spark.sql.autoBroadcastJoinThreshold``, else both sides are shuffled; it is computed once besides."""
    return work_table(df, name)


@contextmanager
def work_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Intermediate tables written inside belong to this scope and are deleted at its end, so store the results
    before it ends. Queries outside, also those of other threads, keep theirs."""
    token = WRITTEN.set([])
    try:
        yield written()
    finally:
        clear_work_tables(spark)
        WRITTEN.reset(token)


def clear_work_tables(spark: SparkSession) -> int:
    """Delete the intermediate tables of the present scope, once the results that read them are stored."""
    conf, paths = spark._jsc.hadoopConfiguration(), written()
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(conf).delete(hadoop, True)
    n = len(paths)
    paths.clear()
    return n


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Hint a broadcast when the counted rows fit ``limit``, else a sort-merge join: Spark would go by the bytes of the
    written files, and places of cells are compressed to a fifth of a byte each."""
    return F.broadcast(df) if rows <= limit else df.hint("merge")
