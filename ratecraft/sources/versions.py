"""Versioned folders: a save never touches what readers see until it is whole.

Each save writes a folder of its own, ``<root>/version=<number>-<random>``. When
it is complete an empty marker of the same name appears in ``<root>/_commits``:
creating a file is one step on every store, and the name says it all. Readers
take the folder that the last marker names, so a save that dies half-way leaves
the former version in place, and a reader that began with an older folder goes on
reading it. Of two saves that end together one is last, by name. A root without
markers is read as a plain folder. A plain Spark read of the root sees all
committed versions with a ``version`` column.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _store(spark: SparkSession, root: str):
    """The file system of ``root`` and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(root).getFileSystem(spark._jsc.hadoopConfiguration()), make


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the committed versions, oldest first."""
    root = root.rstrip("/")
    fs, path = _store(spark, root)
    if not fs.exists(path(f"{root}/_commits")):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(path(f"{root}/_commits")))


def current(spark: SparkSession, root: str) -> str:
    """The folder to read: of the last commit, or the root itself."""
    names = versions(spark, root)
    return f"{root.rstrip('/')}/version={names[-1]}" if names else root


def publish(spark: SparkSession, root: str, write: Callable[[str], None], label: str = "") -> str:
    """``write(folder)`` a new version, then commit it; returns its folder. The
    ``label`` becomes the middle part of the version's name."""
    root = root.rstrip("/")
    fs, path = _store(spark, root)
    names = versions(spark, root)
    name = f"{int(names[-1].split('-')[0]) + 1 if names else 1:012d}-{label + "-" if label else ""}{uuid.uuid4().hex[:8]}"
    folder = f"{root}/version={name}"
    write(folder)
    fs.create(path(f"{root}/_commits/{name}"), False).close()
    return folder


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete all but the last ``keep`` committed versions, markers first; returns
    their names. Folders without a marker may still be being written: they stay."""
    if keep < 1:
        raise ValueError("at least one version must stay")
    root = root.rstrip("/")
    fs, path = _store(spark, root)
    old = versions(spark, root)[:-keep]
    for name in old:
        fs.delete(path(f"{root}/_commits/{name}"), False)
        fs.delete(path(f"{root}/version={name}"), True)
    return old
