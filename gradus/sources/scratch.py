"""Intermediate tables in the shared scratch folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from gradus.session import scratch_path

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: computed once, survives lost executors. The shuffle files of the
    write go with its end, as nothing reads them any more."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # a new frame, as a frame keeps the setting it was made with
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    keep(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(path: str) -> str:
    """Names a scratch path that goes with the table set around it, if there is one."""
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch_tables() -> Iterator[list[str]]:
    """The scratch paths that are made inside, for ``drop``; sets may lie in one another, a table is of the innermost one."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


def drop(spark: SparkSession, paths: Iterable[str]) -> None:
    """Removes scratch tables that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def put(uri: str, name: str, data: bytes) -> None:
    fs, base = open_folder(uri)
    fs.create_dir(base, recursive=True)
    tmp = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp) as out:
        out.write(data)
    fs.move(tmp, f"{base}/{name}")
