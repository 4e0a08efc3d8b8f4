"""Sessions and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings that hold at any scale; sizes (partitions, memory) belong to the cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # The JVM does not compile methods above 8000 bytes; past that Spark's split code is faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Recording a Python call site for every column costs more than building the plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app: str = "changeflow", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    """A session with the library's defaults, overridden by ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session, where driver and executors share one disk, may fall back to a
    temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder all executors share")
        root = tempfile.mkdtemp(prefix="changeflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; every run gets its own."""
    return f"{shared_root(spark)}/changeflow/{name}-{uuid.uuid4().hex}"
