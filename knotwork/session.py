"""Session helpers: a local session for tests, and cutting lineage in shared storage."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Largest side, in bytes of Spark's own size estimate, that an operator may broadcast.
BROADCAST_LIMIT = 64 << 20


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("knotwork")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints. On a cluster it is what ``spark.checkpoint.dir`` names and is left as it is; a
    temporary folder is used only with a local master and nothing set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", "")
    if named:
        sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor shares")
    made = tempfile.mkdtemp(prefix="knotwork-checkpoint-")
    sc.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back: its plan is then a plain scan, and a lost executor costs
    nothing that was computed before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> bool:
    """Whether the rows of ``df``, which should be cheap to count, take at most ``limit`` bytes: the check before a
    broadcast."""
    most = limit // row_bytes
    return df.limit(most + 1).count() <= most


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join by sort and merge at any size. What is small enough for a broadcast when it runs passes
    through the driver and stays there; where a plan has dozens of joins of like size, that adds up."""
    return df.hint("merge")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, so that functions run in Python find it wherever the
    driver imported it from."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="knotwork-"), "knotwork.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("knotwork", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
