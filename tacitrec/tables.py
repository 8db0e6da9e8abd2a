"""Intermediate tables in the shared folder that the cluster names.

The loops of this package (k-core passes, training half-steps) cut their lineage by
writing a table and reading it back. A written table outlives the executors that
produced it, and its schema is known, so reading it back starts no job.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import cache
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType
from pyspark.util import inheritable_thread_target

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing: WeakKeyDictionary[SparkSession, tuple[int, str]] = WeakKeyDictionary()  # writers, setting before them
_writing_lock = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`.

    Without that setting, a local master gets a temporary folder of this process, which goes
    when the process ends; the session is left as it is.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + _own_dir()


@cache
def _own_dir() -> str:
    folder = tempfile.mkdtemp(prefix="tacitrec-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/tacitrec/{app}/{name}-{uuid.uuid4().hex}"


def together(spark: SparkSession, *jobs: Callable[[], object]) -> list:
    """Run independent jobs at the same time, so that short stages share the cluster."""
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inherit(job)) for job in jobs]
        return [job.result() for job in running]


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs that begin in here delete their shuffle files when they end.

    Otherwise the files stay until the driver happens to collect its garbage, and a loop fills the disks.
    The session's setting is as before when the last of the writers has left.
    """
    with _writing_lock:
        writers, before = _writing.get(spark, (0, ""))
        before = before if writers else spark.conf.get(CLEAN_UP, "false")
        _writing[spark] = writers + 1, before
        spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        with _writing_lock:
            writers, before = _writing[spark]
            _writing[spark] = writers - 1, before
            if writers == 1:
                spark.conf.set(CLEAN_UP, before)


def write_table(df: DataFrame, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Write `df` and return the written table, or only some of its columns."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    schema = StructType([df.schema[column] for column in columns]) if columns else df.schema
    table = spark.read.schema(schema).parquet(path)
    _paths[table] = path
    return table


def hand_over(table: DataFrame, frame: DataFrame) -> None:
    """From now on `drop_table` of `frame`, which reads `table`, deletes its files."""
    _paths[frame] = _paths.pop(table)


def drop_table(table: DataFrame) -> None:
    """Delete the files of a frame that `write_table` returned and nobody reads any more.

    Other frames are left alone.
    """
    path = _paths.pop(table, None)
    if path is not None:
        context = table.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def _file_system(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where there is no such folder."""
    files, folder = _file_system(spark, path)
    return sorted(status.getPath().getName() for status in files.listStatus(folder)) if files.exists(folder) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that is there whole or not at all."""
    files, target = _file_system(spark, path)
    _, hidden = _file_system(spark, f"{path.rsplit('/', 1)[0]}/_writing-{uuid.uuid4().hex}")
    out = files.create(hidden, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.rename(hidden, target):
        raise OSError(f"could not write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    files, target = _file_system(spark, path)
    stream = files.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    files, target = _file_system(spark, path)
    files.delete(target, True)
