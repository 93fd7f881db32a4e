"""Versions of a table in shared storage: one small file each, written after the data files it names.

A reader takes the newest version and reads what it names, so it sees one state of the table however long it takes, and a writer
that dies leaves nothing but files that no version names. A version is published by creating its file, which only one
writer can do. Files are reached through Hadoop's file system, so any storage that Spark reads will do.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

FOLDER = "_versions"


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions, newest first."""
    files, folder = _at(spark, f"{path}/{FOLDER}")
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), reverse=True)


def _content(spark: SparkSession, path: str, number: int) -> dict | None:
    """What a version says; None for one that is still being written, or gone."""
    files, place = _at(spark, f"{path}/{FOLDER}/{number}.json")
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def newest(spark: SparkSession, path: str) -> tuple[int, dict] | None:
    """Number and content of the newest version that is whole."""
    for number in _numbers(spark, path):
        content = _content(spark, path, number)
        if content is not None:
            return number, content
    return None


def next_number(spark: SparkSession, path: str) -> int:
    """A number that no version has, whole or not."""
    return max(_numbers(spark, path), default=0) + 1


def publish(spark: SparkSession, path: str, number: int, content: dict) -> bool:
    """Make a version known; False if another writer was first."""
    files, place = _at(spark, f"{path}/{FOLDER}/{number}.json")
    if files.exists(place):
        return False
    try:
        out = files.create(place, False)
    except Exception as error:
        if "already exists" in str(error) or "FileAlreadyExists" in str(error):
            return False
        raise
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    return True


def forget(spark: SparkSession, path: str, upto: int) -> None:
    """Delete the files of the versions up to a number."""
    for number in _numbers(spark, path):
        if number <= upto:
            remove(spark, f"{path}/{FOLDER}/{number}.json")


def remove(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, path)
    files.delete(place, True)
