"""Session helpers: sane defaults for the library and a checkpoint folder rule.

The library never creates its own scratch space on a cluster.  Iterative
operators cut lineage with ``DataFrame.checkpoint()``, which writes into the
folder the cluster names in ``spark.checkpoint.dir``.  Only a local session
(tests, bench) gets a fresh folder of its own when that setting is unset.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "flowlake", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = "8g"  # local mode: the driver is the executor
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on (safe on a shared session).

    Timestamps without zone are turned into epoch seconds through the session
    zone; UTC keeps that arithmetic equal to the wall clock in the data.
    The package is shipped to the Python workers once per context.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """``addPyFile`` a zip of this package so that pandas UDFs and
    ``mapInPandas`` functions unpickle on every worker.  The zip is copied into
    the checkpoint folder through the cluster's file system, local or remote; without
    such a folder Spark serves the driver's copy."""
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    fd, made = tempfile.mkstemp(suffix=".zip", prefix="flowlake-")      # the driver's own copy
    os.close(fd)
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    _SHIPPED.add(key)
    try:
        base = ensure_checkpoint_dir(spark)
    except RuntimeError:                # no shared folder: Spark serves the driver's copy
        sc.addPyFile(os.path.realpath(made))
        return
    path = sc._jvm.org.apache.hadoop.fs.Path
    target = path(f"{base}/flowlake-{key}.zip")
    target.getFileSystem(sc._jsc.hadoopConfiguration()).copyFromLocalFile(True, True, path(f"file://{os.path.realpath(made)}"), target)
    sc.addPyFile(target.toString())


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting it on the context if needed.

    Order: a folder already set on the context, then ``spark.checkpoint.dir``
    from the session conf (the cluster's shared folder).  Only a local master
    may fall back to a fresh folder under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; iterative operators need a shared "
            "checkpoint folder on a cluster")
    path = tempfile.mkdtemp(prefix="flowlake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()
