"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Custom state (``transformWithState``) needs the RocksDB state store; it also
# keeps large window state off the JVM heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Settings every job relies on. Times are epoch milliseconds in UTC, so the
# session zone must be UTC; AQE re-plans joins and coalesces partitions at
# runtime; Arrow carries batches to the few pandas steps.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "hushwin", extra: dict | None = None) -> SparkSession:
    """Return a session configured for this package.

    On a cluster, pass ``master=None`` and let the deployer decide; tests
    use ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    # getOrCreate may hand back an existing session: re-apply the SQL confs.
    for k, v in conf.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and streaming state.

    Read from ``spark.checkpoint.dir`` (the cluster names it); only when it
    is unset, as in local tests, create a private scratch folder and
    register it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="hushwin-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """The checkpoint folder of the streaming query ``name``: the same name
    resumes from the same offsets and state."""
    root = checkpoint_root(spark)
    if "://" not in root:
        os.makedirs(os.path.join(root, "streams"), exist_ok=True)
    return f"{root.rstrip('/')}/streams/{name}"
