"""Session and lineage helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster passes its own session to the operators instead."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` into the folder that all executors share.

    The folder comes from ``spark.checkpoint.dir``; only where that setting is absent and the master is local (tests, one
    machine) a temporary folder is set. The copy survives the loss of any executor.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared_base(spark))
    return df.checkpoint(eager=True)


def _shared_base(spark: SparkSession) -> str:
    """The folder that all executors share; on a cluster that names none there is no safe place to write to."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="claimweft-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for what streams write and read again, below the folder that all executors share."""
    return f"{_shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable on every executor, wherever the driver found it. Once for each context."""
    sc = spark.sparkContext
    if not getattr(sc, "_claimweft_shipped", False):
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="claimweft-")) / "claimweft.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(root.rglob("*")):
                if file.is_file() and "__pycache__" not in file.parts:
                    z.write(file, os.path.join(root.name, file.relative_to(root)))
        sc.addPyFile(str(target))
        sc._claimweft_shipped = True
    return spark
