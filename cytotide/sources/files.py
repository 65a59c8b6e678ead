"""File listings through Hadoop's file systems, so that any scheme works (local, hdfs, s3a, ...)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def has_files(spark: SparkSession, folder: str, glob: str) -> bool:
    """True if ``folder`` directly holds a file whose name matches ``glob``."""
    p, fs = _path(spark, folder.rstrip("/") + "/" + glob)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0
