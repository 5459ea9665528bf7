"""Numbered states of a folder, each committed once: what several writers agree on."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed this number."""


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where it does not exist."""
    fs, p = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return bool(fs.delete(p, True))


def commit(spark: SparkSession, path: str, number: int, state: dict) -> None:
    """Makes ``state`` the folder's state of that number, unless it has one: then :class:`Conflict`.

    A local file is written aside and linked to its name, elsewhere the file system creates the name exclusively; readers pass over a state that is not whole yet.
    """
    fs, folder = file_system(spark, path)
    fs.mkdirs(folder)
    text, name = json.dumps(state), f"{number:012d}.json"
    url = urlparse(folder.toString())
    if url.scheme == "file":
        local = unquote(url.path)
        aside = os.path.join(local, f".{uuid.uuid4().hex}")
        with open(aside, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(aside, os.path.join(local, name))
        except FileExistsError as e:
            raise Conflict(f"state {number} of {path} has been committed by another writer") from e
        finally:
            os.unlink(aside)
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(folder, name)
    try:
        out = fs.create(target, False)
    except Exception as e:
        if fs.exists(target):
            raise Conflict(f"state {number} of {path} has been committed by another writer") from e
        raise
    out.write(bytearray(text, "utf-8"))
    out.close()


def latest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(number, state) that was committed last; (0, {}) before the first."""
    for name in reversed([n for n in names(spark, path) if n.endswith(".json") and n[:-5].isdigit()]):
        rows = spark.read.text(f"{path}/{name}", wholetext=True).collect()
        try:
            return int(name[:-5]), json.loads(rows[0]["value"])
        except (ValueError, IndexError):  # being written
            continue
    return 0, {}


def forget_before(spark: SparkSession, path: str, number: int) -> None:
    """Deletes the states before a number."""
    for name in names(spark, path):
        if name.endswith(".json") and name[:-5].isdigit() and int(name[:-5]) < number:
            delete(spark, f"{path}/{name}")
