"""Session helpers: sane defaults for local tests, never overriding a cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ZIP = "episodeflow_package.zip"
# Defaults applied only when the key is not already set on the session.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpointed rank inputs are removed once their DataFrames are garbage collected.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "episodeflow") -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's shared checkpoint folder.

    A cluster names a shared folder in ``spark.checkpoint.dir``; it is read
    from the session and never replaced. Only when it is unset in local mode
    (tests) a scratch folder is created and set; a cluster session without
    the setting is an error, since a folder of the driver is not shared.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # a Spark Connect session: the server owns the checkpoint folder
        return current or ""
    if not current:
        current = sc.getCheckpointDir()
    if not current:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="episodeflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the session was started.

    Nothing to do when the package's folder is on ``PYTHONPATH`` or is the
    working folder. Otherwise Spark distributes a zip of it, once a session.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root:
        return
    sc = spark.sparkContext
    if any(os.path.basename(p) == _ZIP for p in getattr(sc, "_python_includes", [])):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="episodeflow-zip-"), _ZIP)  # the driver's copy; Spark serves it
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "episodeflow")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder for landed tables."""
    return os.path.join(ensure_checkpoint_dir(spark), name)
