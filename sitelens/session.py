"""Spark session helpers.

The engine never hard-codes cluster paths.  Shared locations (checkpoints,
streaming state, written tables) are derived from ``spark.checkpoint.dir`` as
the cluster sets it; only when that setting is absent (local tests) do we pick
a fresh scratch folder ourselves.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for correctness (UTC, LAST_WIN maps) and for scale
# (AQE coalescing, skew-join splitting, runtime broadcast conversion).
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # call sites recorded for every Column call cost several times the call itself
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
# Settings whose absence would change results.
MUST_HOLD = ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy")


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "sitelens") -> SparkSession:
    """Local session for tests, bench and the driver contract."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for k, v in ENGINE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply engine settings to an existing session (e.g. the driver's)."""
    for k, v in ENGINE_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static or locked conf on a managed cluster
            if k in MUST_HOLD:
                raise
    for k in MUST_HOLD:
        if spark.conf.get(k, None) != ENGINE_CONF[k]:
            raise RuntimeError(f"{k} must be {ENGINE_CONF[k]}; results depend on it")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sitelens`` importable in Python workers (pandas UDFs, applyInPandas).

    The package is zipped on the driver and distributed by Spark itself
    (``addPyFile``), once per SparkContext; executors never read a driver path.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the package must be installed on the cluster
        return
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    import shutil

    pkg = os.path.dirname(os.path.abspath(__file__))
    staging = tempfile.mkdtemp(prefix="sitelens-pyfiles-")  # driver-side staging for Spark's file server
    archive = shutil.make_archive(os.path.join(staging, "sitelens"), "zip", os.path.dirname(pkg), "sitelens")
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and streaming state.

    Reads ``spark.checkpoint.dir`` from the session.  Where it is unset, a scratch
    folder serves in local mode only: on a cluster executors do not share one, so
    its absence is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="sitelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    try:
        spark.sparkContext.setCheckpointDir(path)
    except Exception:  # Spark Connect has no SparkContext
        pass
    return path


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A location under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), *parts)
