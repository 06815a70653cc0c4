"""Folders of any Hadoop file system, seen from the driver: names, and the contents of small control files."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    """The file system of a path and the path in it; PySpark reaches Hadoop's API through its gateway only."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return fs.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.delete(place, True)


def partition_folders(spark: SparkSession, path: str, by: str) -> dict[str, str]:
    """Folder of each partition value (as text) right below ``path``; one listing."""
    fs, place = _place(spark, path)
    if not fs.exists(place):
        return {}
    found = [s.getPath() for s in fs.listStatus(place) if s.isDirectory()]
    return {unquote(p.getName()[len(by) + 1:]): p.toString() for p in found if p.getName().startswith(f"{by}=")}


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it is not there."""
    fs, place = _place(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _place(spark, path)
    stream = fs.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that appears whole or not at all; False if the name is taken, which is left as it is."""
    jvm = spark._jvm
    fs, place = _place(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(place).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # none: a taken name is an error
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(place), options)
        return True
    except Py4JJavaError as error:
        if not fs.exists(place):
            raise
        if "FileAlreadyExists" not in str(error.java_exception):
            raise
        return False
    finally:
        fs.delete(draft, False)
