"""Session settings that the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: JSON objects with repeated keys are legal and the last value counts, as in the format's usual parsers.
SETTINGS = {"spark.sql.variant.allowDuplicateKeys": "true", "spark.sql.session.timeZone": "UTC"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors share; a temporary one only for a local master where none is set."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")
