"""Where writers put a file: on a path of this machine directly, in any other store through Hadoop's file systems."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_path(path: str) -> str | None:
    """The path without ``file:``; None for another scheme."""
    path = re.sub(r"^file:(//(?=/))?", "", path)
    return None if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path) else path


@contextmanager
def replaced(spark: SparkSession, *paths: str, keep: bool = False) -> Iterator[list[str]]:
    """Names to write new files under, which take the places of ``paths`` when all is written.

    With ``keep`` they hold the old files' bytes at first.  After an error the
    old files stay.
    """
    local = [local_path(p) for p in paths]
    folder = tempfile.mkdtemp(prefix="geoloom-") if None in local else None
    made = [f"{p}.new" if p else f"{folder}/{i}" for i, p in enumerate(local)]
    try:
        for path, target, name in zip(paths, local, made, strict=True):
            if os.path.exists(name):
                os.remove(name)
            if keep and target and os.path.exists(target):
                shutil.copyfile(target, name)
            elif keep and not target:
                fs, place = _file_system(spark, path)
                if fs.exists(place(path)):
                    fs.copyToLocalFile(False, place(path), place(f"file://{name}"), True)
        yield made
        for path, target, name in zip(paths, local, made, strict=True):
            if target:
                os.replace(name, target)
                continue
            fs, place = _file_system(spark, path)
            fs.copyFromLocalFile(False, True, place(f"file://{name}"), place(f"{path}.new"))
            fs.delete(place(path), False)
            if not fs.rename(place(f"{path}.new"), place(path)):
                raise OSError(f"cannot write {path}")
    finally:
        for name in made:
            if os.path.exists(name):
                os.remove(name)
        if folder:
            os.rmdir(folder)


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share; where none is set, on one machine, in a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    # Executors of local-cluster have temporary folders of their own, as those of any cluster.
    if not folder and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        folder = tempfile.gettempdir()
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = f"{folder.rstrip('/')}/geoloom-{uuid.uuid4().hex}"
    local = local_path(made)
    if local:
        os.makedirs(local)
    return local or made


def machine_path(spark: SparkSession, path: str) -> str | None:
    """The path that every machine opens by itself; None in another store."""
    fs, place = _file_system(spark, path)
    found = fs.makeQualified(place(path)).toUri()
    return found.getPath() if found.getScheme() == "file" else None


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _file_system(spark, path)
    return fs.exists(place(path))


@contextmanager
def on_driver(spark: SparkSession, *paths: str) -> Iterator[list[str]]:
    """Names of the files on this machine; those of another store are copied here meanwhile."""
    with tempfile.TemporaryDirectory(prefix="geoloom-") as folder:
        found = []
        for i, path in enumerate(paths):
            name = machine_path(spark, path)
            if name is None:
                if not exists(spark, path):
                    raise FileNotFoundError(path)
                name = os.path.abspath(f"{folder}/{i}")
                fs, place = _file_system(spark, path)
                fs.copyToLocalFile(False, place(path), place(f"file://{name}"), True)
            found.append(name)
        yield found


def staged(spark: SparkSession, contents: Iterator[bytes]) -> str:
    """A shared folder with a file of each content; it is deleted when the session's file systems are closed."""
    folder = shared_folder(spark)
    fs, place = _file_system(spark, folder)
    fs.mkdirs(place(folder))
    fs.deleteOnExit(place(folder))
    with tempfile.TemporaryDirectory(prefix="geoloom-") as here:
        name = os.path.abspath(f"{here}/piece")
        for i, content in enumerate(contents):
            with open(name, "wb") as out:
                out.write(content)
            fs.copyFromLocalFile(False, True, place(f"file://{name}"), place(f"{folder}/{i:06d}"))
    return folder


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark._jsc.hadoopConfiguration()), place
