"""Session helpers: where reliable checkpoints and scratch tables go."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (``spark.checkpoint.dir``).

    Only a local-mode session without one gets a temporary folder of its own: on a cluster a
    machine-local folder would be lost with the machine, so a missing setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="tallyward-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through a reliable checkpoint."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: path -> (JVM, Hadoop settings), which outlive a stopped session
_scratch: dict[str, tuple] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for stream state and written tables.

    It lasts until :func:`clear_scratch` or the end of the program, whichever comes first.
    """
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _scratch[path] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    return path


def clear_scratch() -> int:
    """Delete every path that :func:`scratch_path` gave out; call it once the results that read them are stored.

    Returns the number of paths. Nothing else in the shared folder is touched.
    """
    count = len(_scratch)
    while _scratch:
        path, (jvm, settings) = _scratch.popitem()
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(settings).delete(place, True)
    return count


@atexit.register
def _clear_at_exit() -> None:
    try:
        clear_scratch()
    except Exception:  # noqa: BLE001 - the JVM may be gone; the folder is then left to its owner
        _scratch.clear()


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a frame that several plans share to the shared folder and read it back.

    Unlike a cache it survives lost executors, and its known size guides the joins that use it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
