"""Cutting lineage in a folder that every executor shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_tables: dict[str, list[str]] = {}  # by application, in the order in which they were made


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where the session names none, a session on one machine gets a temporary one; on a cluster that is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tidelog-")
            atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: a lost executor costs no recomputation of what came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """df as compressed Parquet in the shared folder, for results too large to keep as checkpointed rows; gone when the session ends, or when it is dropped."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    files, place = _store(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    """Hadoop's view of a path: only through it every store that Spark writes to can be reached."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def tables(spark: SparkSession) -> list[str]:
    """The tables that this session has made and not dropped."""
    return list(_tables.get(spark.sparkContext.applicationId, []))


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing reads any more."""
    own = _tables.get(spark.sparkContext.applicationId, [])
    for path in paths:
        files, place = _store(spark, path)
        files.delete(place, True)
        if path in own:
            own.remove(path)
