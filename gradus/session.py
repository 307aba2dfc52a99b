"""SparkSession defaults for gradus jobs.

Settings that the deployment has made (spark-defaults, spark-submit) stay: the builder only
fills in what is unset. A shared ``spark.checkpoint.dir`` is required off local masters.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_heap_gb() -> int:
    """Heap of a local session: three eighths of the machine's memory, so that Python workers have room; 1 to 16 GB."""
    return max(1, min(16, os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") * 3 // (8 << 30)))


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "gradus", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    given = SparkConf()  # what the deployment has set
    fill = dict(DEFAULTS)
    if (master or given.get("spark.master", "local")).startswith("local"):
        fill["spark.driver.memory"] = os.environ.get("GRADUS_DRIVER_MEMORY", f"{local_heap_gb()}g")
    for k, v in fill.items():
        if not given.contains(k):
            b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a local one only on a local master (tests)."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="gradus-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir for written intermediate tables."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/gradus-{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``gradus`` importable in the Python workers (Arrow UDFs, mapInPandas,
    applyInPandas reference its functions): zip the package once per SparkContext and
    distribute it with ``addPyFile``."""
    import os
    import zipfile

    sc = spark.sparkContext
    key = id(sc)
    if key in _SHIPPED:
        return
    import gradus

    root = os.path.dirname(os.path.abspath(gradus.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="gradus-pkg-"), "gradus.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
