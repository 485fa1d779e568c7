"""Session defaults for local runs; on a cluster the session is the caller's."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, app: str = "meridex", **conf: str) -> SparkSession:
    """A local session with adaptive execution and UTC, as tests and the bench use it."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, with its scheme. A local session without one gets a
    temporary one; on a cluster there must be one, as executors don't share the driver's disk."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='meridex-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if whole.startswith("file:/") and not whole.startswith("file://"):
        whole = f"file://{whole[5:]}"
    return whole.rstrip("/")
