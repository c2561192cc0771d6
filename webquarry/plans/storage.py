"""Tables that several plans read, written once to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one with a local master only."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="webquarry-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Where the tables made by ``stored`` are.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: its plan is run once, and plans over it begin at a scan."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webquarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes tables made by ``stored`` once no later plan reads them."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
