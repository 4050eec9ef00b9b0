"""Small files through Hadoop's file systems, so that a folder may lie wherever the cluster reads and writes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def changed(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """Change time and length of a file or folder; none for a pattern or where nothing is."""
    if any(c in path for c in "*?[{"):
        return None
    fs, at = _at(spark, path)
    if not fs.exists(at):
        return None
    status = fs.getFileStatus(at)
    return status.getModificationTime(), status.getLen()


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file with its folders; an error if the file exists."""
    fs, at = _at(spark, path)
    stream = fs.create(at, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
