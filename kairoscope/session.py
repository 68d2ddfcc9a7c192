"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Spark's own value and ours of the settings for batches between the JVM and Python.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "2097152")}


def get_session(app: str = "kairoscope", master: str = "local[8]", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench use; on a cluster pass your own session."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``; only a local session gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith(("local[", "local")) or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="kairoscope-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)


def cut(frame: DataFrame, forget: bool = False) -> DataFrame:
    """Write ``frame`` to the shared checkpoint folder and read it from there, so that its lineage ends.

    A checkpoint remembers by which columns its rows are dealt and what is known of their values; in a loop of joins that multiplies from round to round until planning takes longer
    than the work.  With ``forget`` the frame is written as a table there, which remembers nothing and goes with the session.
    """
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    if not forget:
        return frame.checkpoint(eager=True)
    path = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(frame.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once a session, wherever the driver imported it from.

    Batches between the JVM and Python are cut small, for texts of any length make them large; a setting that the caller has changed stays.
    """
    context = spark.sparkContext
    for key, (default, value) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)
    if getattr(context, "_kairoscope_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="kairoscope-ship-")  # the driver serves the archive to the workers from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "kairoscope_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._kairoscope_shipped = True
