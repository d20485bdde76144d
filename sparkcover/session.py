"""Session helpers: a local session for tests and the bench, and the checkpoint folder.

Iterative jobs cut their lineage with ``DataFrame.checkpoint()``, which writes to
the folder named by ``spark.checkpoint.dir``. On a cluster that folder must be
shared storage (HDFS, S3, ...) so a lost executor never takes a round's state
with it. We read the setting from the session and only pick a folder ourselves
when it is unset *and* the master is local (tests, laptops).
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import warnings
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(
    cores: int = 8,
    shuffle_partitions: int | None = None,
    app_name: str = "sparkcover",
    driver_memory: str = "16g",
) -> SparkSession:
    """A local[cores] session with the UI off, AQE on and few shuffle partitions."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting one only where none is configured.

    Order: the folder already set on the SparkContext, then ``spark.checkpoint.dir``
    from the Spark or session configuration, then (local master only) a fresh
    temporary folder. On a cluster without a configured folder this raises, because
    a machine-local folder would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        if configured.startswith("file:") and not sc.master.startswith("local"):
            warnings.warn(
                f"spark.checkpoint.dir is {configured}: on a cluster this must be a shared mount, "
                "or state is lost with the machine that wrote it",
                stacklevel=2,
            )
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: point it at a shared folder "
            "(hdfs://, s3a://, ...) before running iterative graph jobs"
        )
    folder = tempfile.mkdtemp(prefix="sparkcover-ckpt-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own under the checkpoint folder, in whatever store it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package by Spark's own file server, once per application.

    A driver that finds the package through its working folder or ``sys.path`` doesn't
    pass those on to the executors.
    """
    sc = spark.sparkContext
    if getattr(sc, "_sparkcover_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sparkcover-code-")  # the driver serves it while it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "sparkcover.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._sparkcover_shipped = True


@contextmanager
def held_settings(spark: SparkSession, settings: dict[str, str]):
    """Session settings for what is planned inside; restored after."""
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40, "p": 1 << 50}


def parse_bytes(text: str) -> int:
    """A Spark size string (``10485760``, ``64MB``, ``100m``, ``1g``, ``-1``) in bytes."""
    m = re.fullmatch(r"\s*(-?\d+)\s*([bkmgtp]?)(?:i?b)?\s*", str(text).lower())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) * _UNITS[m[2]]


def broadcast_limit_bytes(spark: SparkSession, default: int = 10 * 1024 * 1024) -> int:
    """Byte budget for an explicit broadcast; follows autoBroadcastJoinThreshold."""
    return max(0, parse_bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", str(default))))
