"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch handed to a Python worker.  Documents may be very long, so both are small.
ARROW_ROWS = 512
ARROW_BYTES = 16 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches sent to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


#: What workers keep from task to task, by the module that keeps it: dropped when a task of another module begins.
_kept: dict[str, Callable[[], None]] = {}


def keeps(module: str, drop: Callable[[], None]) -> None:
    """Tells that a module keeps memory in the worker between its tasks, and how to drop it."""
    _kept[module] = drop


#: Tasks of each module that ended in this worker.
_ended: dict[str, int] = {}


def _collect(module: str) -> None:
    """Collects garbage.  What is left after the first two tasks of a module, above all imported code, is left out of later
    collections: looking through it took over 0.1 s a task.  Pickled by name, so that it sees the worker's own ``_ended``."""
    gc.collect()
    _ended[module] = _ended.get(module, 0) + 1
    if _ended[module] <= 2:
        gc.freeze()


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches after which the worker gives its free memory back: workers live on from stage to stage."""

    def wrapped(batches: Iterator) -> Iterator:
        for module, drop in _kept.items():
            if module != run.__module__:
                drop()
        try:
            yield from run(batches)
        finally:
            _collect(run.__module__)
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


#: Where the tables made by ``materialize`` are, and the names of those that the catalog knows.
_stored: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_named: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Drops the shuffle files of a job as soon as its table is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a local master gets a temporary folder; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="webquarry-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage; the copy survives the loss of any executor.  The job's shuffle files go once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webquarry/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[out] = path
    return out


def bucketed(df: DataFrame, name: str, column: str, buckets: int, dealt: bool = False) -> DataFrame:
    """Like ``materialize``, as a table in buckets of a column: later joins and aggregates by it don't shuffle this side.

    ``dealt``: the rows are dealt to ``buckets`` partitions by the column already.
    """
    spark = df.sparkSession
    table = f"webquarry_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/webquarry/{table}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        rows = df if dealt else df.repartition(buckets, column)
        rows.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, column).saveAsTable(table)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.table(table)
    _stored[out], _named[out] = path, table
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` once no later plan reads them."""
    for df in tables:
        path, table = _stored.pop(df, None), _named.pop(df, None)
        if table:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
