"""Immutable snapshots behind pointer files: a stored table is replaced by one atomic rename.

Whatever is stored under a name is first written whole to a folder of its own, ``snapshots/<name>/<id>``. A pointer
file, ``current/<name>.json``, then names the folder and the version of the training table it was made from; it is
written beside its place and renamed over the old one. A reader looks the pointer up once and reads files that never
change, so it sees the old table or the new one, with its version, and never a mix; a writer that dies leaves the old
one in place. The snapshot before the last stays for readers that still hold it; older ones are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from foldstack.sources.scratch import exists


@dataclass(frozen=True)
class Snapshot:
    """Where a stored table lies, and the version of the training table it was made from."""

    path: str
    version: str | None


def pointer_path(base: str, what: str) -> str:
    return f"{base}/current/{what}.json"


def new_folder(base: str, what: str) -> str:
    return f"{base}/snapshots/{what}/{uuid.uuid4().hex}"


def _system(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _pointer(spark: SparkSession, base: str, what: str) -> dict | None:
    uri = pointer_path(base, what)
    if not exists(spark, uri):
        return None
    system, path = _system(spark, uri)
    stream = system.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _switch(spark: SparkSession, base: str, what: str, record: dict) -> None:
    """Write the pointer beside its place and rename it over the old one."""
    target = pointer_path(base, what)
    system, place = _system(spark, target)
    fresh = spark._jvm.org.apache.hadoop.fs.Path(f"{target}.{uuid.uuid4().hex}.tmp")
    out = system.create(fresh, True)
    out.write(bytearray(json.dumps(record).encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    try:
        context = hadoop.FileContext.getFileContext(system.makeQualified(place).toUri(), spark._jsc.hadoopConfiguration())
        context.rename(system.makeQualified(fresh), system.makeQualified(place), options)
    except Py4JJavaError as problem:
        if "UnsupportedFileSystem" not in str(problem.java_exception):
            raise
        out = system.create(place, True)  # an object store: one put of one small object
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        system.delete(fresh, False)


def remove(spark: SparkSession, uri: str) -> None:
    system, path = _system(spark, uri)
    system.delete(path, True)


def current(spark: SparkSession, base: str, what: str) -> Snapshot | None:
    found = _pointer(spark, base, what)
    return None if found is None else Snapshot(f"{base}/{found['path']}", found["version"])


def point(spark: SparkSession, base: str, what: str, folder: str, version: str | None = None) -> None:
    """Make a written folder under ``base`` the current one."""
    before = _pointer(spark, base, what)
    record = {"path": folder.removeprefix(f"{base}/"), "version": version, "previous": before and before["path"]}
    _switch(spark, base, what, record)
    if before and before["previous"]:
        remove(spark, f"{base}/{before['previous']}")


def publish(spark: SparkSession, base: str, what: str, write: Callable[[str], None], version: str | None = None) -> None:
    """Write a snapshot by ``write(folder)`` and make it the current one; a failed write leaves nothing."""
    folder = new_folder(base, what)
    try:
        write(folder)
    except BaseException:
        remove(spark, folder)
        raise
    point(spark, base, what, folder, version)
