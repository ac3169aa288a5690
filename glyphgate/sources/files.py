"""Folders of written tables: which are finished, and removal of the superseded.

Spark has no public call to list or delete folders, so Hadoop's file system is asked through the
session; it knows every store that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def finished(spark: SparkSession, pattern: str) -> list[str]:
    """Folders of a glob pattern whose writer has finished, in ascending order."""
    fs, where = _at(spark, f"{pattern}/_SUCCESS")
    return sorted(str(s.getPath().getParent()) for s in fs.globStatus(where) or [])


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders of a glob pattern, in ascending order."""
    fs, where = _at(spark, pattern)
    return sorted(str(s.getPath()) for s in fs.globStatus(where) or [] if s.isDirectory())


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        fs, where = _at(spark, folder)
        fs.delete(where, True)
