"""Stage tables: materialize an intermediate result that later steps read
more than once.

The intermediate is written as parquet to the shared checkpoint folder
(``spark.checkpoint.dir``): that cuts the lineage, survives the loss of the
executors that computed it, and is read back with real statistics for the
planner. Every call writes its own folder, so a later call always computes
from the input as it then is. Without a stage, a DataFrame used twice is
planned and computed twice, and nested reuse multiplies.

A folder stays until the scope it was written in ends (``scope``). A job
that has written its own result can so give back its stages; without a
scope they stay with the checkpoint folder.
"""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from hushwin.session import checkpoint_root

_OPEN = threading.local()


def stage(df: DataFrame, name: str, folder: str = "stage", keep: bool = False, by: str | None = None) -> DataFrame:
    """``df``, written once for several readers. ``keep``: the folder
    belongs to the scope around the present one. ``by``: the column whose
    values the files are parted by, for readers of one value."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{folder}/{name}-{uuid.uuid4().hex}"
    scopes = getattr(_OPEN, "scopes", [])
    if len(scopes) > keep:
        scopes[-1 - keep].append(path)
    write = df.write.mode("overwrite")
    (write.partitionBy(by) if by else write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Folders staged inside, but those to ``keep``, are deleted at the end,
    by the file system that holds them. Nothing read from them may be used
    after that."""
    scopes = _OPEN.scopes = getattr(_OPEN, "scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
