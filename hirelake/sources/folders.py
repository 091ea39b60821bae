"""Folders and small files of any file system that Spark reads, from the driver."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or a whole folder; nothing happens where there is none."""
    _system(spark, path).delete(_path(spark, path), True)


def children(spark: SparkSession, folder: str) -> dict[str, float]:
    """Names in a folder with the times of their last change, in seconds; none where there is no folder."""
    if not exists(spark, folder):
        return {}
    found = _system(spark, folder).listStatus(_path(spark, folder))
    return {s.getPath().getName(): s.getModificationTime() / 1000 for s in found}


def read_text(spark: SparkSession, file: str) -> str:
    stream = _system(spark, file).open(_path(spark, file))
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, file: str, text: str) -> None:
    """A new file in a folder that is made if there is none."""
    stream = _system(spark, file).create(_path(spark, file), False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def move_new(spark: SparkSession, source: str, target: str) -> bool:
    """Move a file or folder to a place where nothing is yet, in one step; False where something is.

    The step is as good as the file system's rename: one of two writers wins where rename is atomic.
    """
    jvm = spark.sparkContext._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _path(spark, target).toUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    try:
        context.rename(_path(spark, source), _path(spark, target), options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def replace_folder(df: DataFrame, folder: str, write: Callable[[DataFrame, str], None]) -> None:
    """Write `df` beside a folder and put it in its place once it is complete.

    A write that fails leaves the folder as it was; the marker `_SUCCESS` is in it from the moment it
    is there. Between the two renames there is no folder; if the second one fails, the first is undone.
    """
    spark = df.sparkSession
    parent, name = folder.rstrip("/").rsplit("/", 1)
    new, old = (f"{parent}/.{name}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    try:
        write(df, new)
        if exists(spark, folder):
            move_new(spark, folder, old)
        try:
            if not move_new(spark, new, folder):
                raise FileExistsError(f"{folder} was written by another run meanwhile")
        except Exception:
            if exists(spark, old):
                move_new(spark, old, folder)
            raise
        remove(spark, old)
    finally:
        remove(spark, new)
