"""Small files on any file system that Spark knows, handled from the driver through its own file-system layer."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it names it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    system, place = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file whole or not at all: under another name first, which then takes its place."""
    system, place = file_system(spark, path)
    fresh = place.suffix(f".{uuid.uuid4().hex}")
    out = system.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    if system.exists(place):
        system.delete(place, False)
    if not system.rename(fresh, place):
        raise OSError(f"can't write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
