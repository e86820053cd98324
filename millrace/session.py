"""Session defaults that the engine's semantics rest on, and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What the semantics need: overflow and bad casts are errors, one time zone, run-time re-planning.
DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_own_shared: list[str] = []


def local_session(cores: int | str = 4, partitions: int = 8, **extra: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("millrace")
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (settings | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable_by_workers(spark: SparkSession) -> None:
    """Let Python workers import this package even if it is only on the driver's sys.path.

    On a cluster the package is installed on the workers or sent with ``--py-files``; this only adds
    the checkout's folder to the workers' search path.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``.

    Only where that setting is absent and the session runs in a single process is a temporary folder
    of this machine used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_shared:
            _own_shared.append(tempfile.mkdtemp(prefix="millrace-"))
        base = f"file://{_own_shared[0]}"
    return f"{base.rstrip('/')}/millrace/{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "table", folder: str | None = None) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back: cuts lineage and survives lost executors.

    `folder`: one of ``shared_folder``, from which the caller takes the table away (``drop_written``).
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{label}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, folder: str, *labels: str) -> None:
    """Delete tables that ``written`` made in `folder`, once nothing reads them any more."""
    for label in labels:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{label}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
