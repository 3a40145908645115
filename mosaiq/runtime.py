"""What Python functions on executors need from the driver."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that functions there can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_mosaiq_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "mosaiq.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("mosaiq", os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._mosaiq_shipped = True


def shared_base(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); on one machine a temporary folder may take its place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    return base.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one, removed when the driver's JVM ends."""
    path = f"{shared_base(spark)}/mosaiq-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(root)
    return path


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As :func:`saved`, but a Parquet table: smaller, and read by columns."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
