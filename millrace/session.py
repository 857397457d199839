"""Session settings and durable intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

#: Settings the engine relies on; sizes are left to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", name: str = "millrace", **extra: str) -> SparkSession:
    """A session on this machine, for tests and benches."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(name)
    conf = DEFAULTS | {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"}
    for k, v in (conf | extra).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's `spark.checkpoint.dir`, which all executors share.

    Only on a local master, where no such folder is named, a temporary one is made.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="millrace-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def within_seconds(spark: SparkSession, seconds: float, run: Callable[[], T]) -> T:
    """What `run` returns. Beyond so many seconds its jobs are cancelled and TimeoutError is raised; 0 or less is no limit."""
    if seconds <= 0:
        return run()
    tag = f"millrace-{uuid.uuid4().hex}"

    def tagged() -> T:
        spark.addTag(tag)
        return run()

    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(tagged).result(seconds)
    except FutureTimeout:
        spark.interruptTag(tag)
        raise TimeoutError(f"no answer within {seconds} seconds") from None
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


_written: list[str] = []


def durable(df: DataFrame, what: str = "stage") -> DataFrame:
    """`df`, written to the shared folder and read again.

    It cuts the lineage, survives the loss of executors, and is computed once however often it is read.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder's path within the shared one, removed as the durable tables are."""
    path = f"{shared_folder(spark).rstrip('/')}/millrace-{what}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean, spark)
    _written.append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes on leaving what was written within: for a query whose result is used up inside. Without it tables last as long as the process."""
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            _remove(spark, path)
        del _written[before:]


def drop(df: DataFrame) -> None:
    """Removes a durable table that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean(spark: SparkSession) -> None:
    try:
        for path in _written:
            _remove(spark, path)
    except Exception:  # the session has ended; the cluster's own cleaning takes over
        pass
