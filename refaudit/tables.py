"""Intermediate tables where all executors see them."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables written, and whether they outlive a `temporary` block.
_tables: list[tuple[SparkSession, str, bool]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local master gets a temporary one; on a cluster that is
    an error, as a folder of one machine would lose rows."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="refaudit-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, outlive: bool = False) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read back. Lost executors cost only their tasks.

    The table stays as long as a result may still read it: until the surrounding `temporary` block ends (one that is to
    outlive it: until the block around that ends), without one until `release` or exit.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/refaudit-{uuid.uuid4().hex}"
    _tables.append((spark, path, outlive))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark deletes the shuffle files of what is written or given up; else they
    stay on the executors' disks until its heap happens to fill.

    What Python has given up, py4j lets go of in a thread that may sleep for a second; until then the driver's heap holds it. So
    what that thread has yet to do is done here first."""
    gc.collect()
    pending = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    while pending:
        try:
            task = pending.pop()
        except IndexError:  # the thread was faster
            break
        if not isinstance(task, tuple):  # the sign to end, which is for that thread
            pending.append(task)
            break
        client, target = task
        client.garbage_collect_object(target, False)
    spark._jvm.System.gc()


def in_slices(n: int, keys: list[str], step: Callable[[Callable[[DataFrame], DataFrame]], DataFrame]) -> DataFrame:
    """The union of n written tables: step of each slice. It is given a function that keeps a table's rows of the slice, by a hash
    of `keys`. What a slice shuffles is deleted before the next."""
    done = []
    for i in range(n):
        done.append(written(step(lambda df, i=i: df.where(F.pmod(F.xxhash64(*keys), F.lit(n)) == i) if n > 1 else df), outlive=True))
        # The first sweep doesn't reach what was shuffled for the table just written, the second does.
        for _ in range(2):
            swept(done[0].sparkSession)
    return reduce(DataFrame.union, done)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    except Exception:  # noqa: BLE001  at exit the session may be gone; the folder is the caller's to empty then
        pass


@contextmanager
def temporary() -> Iterator[None]:
    """Deletes the tables written inside the block when it ends, but for those that are to outlive it. Operators use it for what
    their result doesn't read."""
    mark = len(_tables)
    try:
        yield
    finally:
        inside = _tables[mark:]
        _tables[mark:] = [(spark, path, False) for spark, path, outlive in inside if outlive]
        for spark, path, outlive in inside:
            if not outlive:
                _delete(spark, path)


@atexit.register
def release() -> None:
    """Deletes all tables written so far; results that still read them are void."""
    while _tables:
        _delete(*_tables.pop()[:2])
