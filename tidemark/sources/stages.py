"""Intermediate tables of iterative operators, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.files import file_system

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder, but only in a local session, whose one machine sees it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tidemark-stages-"))
    return _own[0]


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table that is read back: the lineage ends there and lost executors cost nothing. It goes when the driver ends, if not before."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, place = file_system(df.sparkSession, path)
    system.deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table of written() that nothing will read again."""
    base = folder(df.sparkSession).removeprefix("file://")
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if base in parent:
            system, place = file_system(df.sparkSession, parent)
            system.delete(place, True)
