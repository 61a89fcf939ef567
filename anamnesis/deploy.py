"""Give Python workers this package, wherever they run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


#: Whether Spark deletes an action's shuffles when it is done, and not only when the driver's memory runs low.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: How many bytes of rows, about, go to Python at once; rows alone don't say, as files and texts may be large.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's sources to the workers, once per application.

    Spark serves the archive from the driver, so no folder has to be shared. What several actions use is
    checkpointed, so shuffles aren't kept beyond an action. Batches for Python are bounded by their bytes; a session
    that has its own bound keeps it.
    """
    context = spark.sparkContext
    spark.conf.set(CLEAN_UP, "true")
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        folder = Path(tempfile.mkdtemp(prefix="anamnesis-"))  # code alone, and Spark serves it
        with zipfile.ZipFile(folder / "anamnesis.zip", "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, f"anamnesis/{file.relative_to(root)}")
        context.addPyFile(str(folder / "anamnesis.zip"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _shipped.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. On one machine
    (``local`` masters, as in tests) a session without it gets a folder below its warehouse; on a
    cluster it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
