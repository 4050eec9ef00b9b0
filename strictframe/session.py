"""Settings the engine relies on, for a session of its own or one that is handed in."""

from __future__ import annotations

import atexit
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Exact decimals, checked arithmetic, UTC; shuffle partitions are left to adaptive execution.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.decimalOperations.allowPrecisionLoss": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set what results depend on; settings of size and speed are the cluster's."""
    for k, v in SETTINGS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def create(app: str = "strictframe", master: str | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return configure(b.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is this machine alone, as in tests,
    a temporary folder takes its place; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "strictframe-shared")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write an intermediate that is read more than once to the shared folder and cut its lineage there.

    Spark removes the files with the last reference to them where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder within the shared one, for tables that are written and read again; removed when this process ends."""
    folder = f"{shared_folder(spark)}/strictframe-{os.urandom(6).hex()}"
    atexit.register(_forget, spark, folder)
    return folder


def _forget(spark: SparkSession, folder: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended before; its shared folder goes with the cluster
        pass
