"""Versioned folders behind one pointer: written aside, checked, then swapped in one step.

A store is a folder with a file ``CURRENT`` that names the version in force.
A write goes to a folder of its own; only when it is complete and has passed
its check does the pointer move, by a rename that replaces.  So readers see
the old rows or the new ones, and a write that fails leaves the old.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.sources.tables import content_hash, from_backup

POINTER, MANIFEST = "CURRENT", "MANIFEST.json"


class Stale(ValueError):
    """What is stored is of another version than what was asked for, or parts of it are gone."""


def _at(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def read_file(spark: SparkSession, path: str) -> str | None:
    """A small file's text; null where there is none."""
    where, fs = _at(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file in one step: readers find the old text or the new one, never a part."""
    jvm = spark._jvm
    aside, fs = _at(spark, f"{path}.{uuid.uuid4().hex}")
    fs.mkdirs(aside.getParent())
    stream = fs.create(aside)
    stream.write(bytearray(text.encode()))
    stream.close()
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    ways = spark.sparkContext._gateway.new_array(options, 1)
    ways[0] = options.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration()) if aside.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    context.rename(aside, jvm.org.apache.hadoop.fs.Path(path), ways)


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name below the path, bytes, time of change) of every file at or below a path, hidden ones left out, by name."""
    where, fs = _at(spark, path)
    if not fs.exists(where):
        return []
    root, found, walk = fs.resolvePath(where).toUri().getPath(), [], fs.listFiles(where, True)
    while walk.hasNext():
        f = walk.next()
        name = f.getPath().toUri().getPath().removeprefix(root).lstrip("/")
        if not f.getPath().getName().startswith((".", "_")):
            found.append((name, f.getLen(), f.getModificationTime()))
    return sorted(found)


def version_of(spark: SparkSession, paths: list[str], rule: str) -> str:
    """Names the contents of input files by their names, sizes and times, and the rule by which they are used."""
    return hashlib.sha256(json.dumps([rule, [files_of(spark, p) for p in paths]]).encode()).hexdigest()[:32]


def current(spark: SparkSession, root: str) -> str | None:
    """The folder that the pointer names; null where nothing is stored."""
    name = read_file(spark, f"{root}/{POINTER}")
    return f"{root}/{name.strip()}" if name else None


def publish(spark: SparkSession, root: str, write: Callable[[str], None], check: Callable[[str], None] | None = None, version: str = "v") -> str:
    """Writes a new version aside, checks it and moves the pointer to it; returns its folder.

    ``write`` and ``check`` get the new folder.  If either raises, the pointer
    stays.  The files that were written are listed with their sizes, so that a
    reader can tell whether all are still there.
    """
    name = f"{version}-{uuid.uuid4().hex[:8]}"
    folder = f"{root}/{name}"
    write(folder)
    if check is not None:
        check(folder)
    replace_file(spark, f"{folder}/{MANIFEST}", json.dumps({"version": version, "files": [f[:2] for f in files_of(spark, folder)]}))
    replace_file(spark, f"{root}/{POINTER}", name)
    return folder


def require(spark: SparkSession, root: str, version: str) -> str:
    """The folder in force; raises ``Stale`` if it is of another version, or if one of its files is gone or cut short."""
    folder = current(spark, root)
    manifest = json.loads(read_file(spark, f"{folder}/{MANIFEST}") or "{}") if folder else {}
    if manifest.get("version") != version:
        raise Stale(f"{root} holds version {manifest.get('version')}, wanted {version}")
    held = [list(f[:2]) for f in files_of(spark, folder) if f[0] != MANIFEST]
    if held != [f for f in manifest["files"] if f[0] != MANIFEST]:
        raise Stale(f"{folder} lacks files that were written")
    return folder


def restore(spark: SparkSession, backup: DataFrame, root: str, tables: dict[str, dict[str, str]]) -> str:
    """Restores tables from a backup (table, columns, row) in one step, or not at all.

    All tables are read back, written aside and compared with the backup's
    rows, by count and content, before the pointer moves.  A backup with a
    column that a table lacks, without one of the tables' names, or with rows
    that can't be read raises ``ValueError``, and the old tables stay.
    """
    named = {r["table"] for r in backup.select("table").distinct().collect()}
    if strange := sorted(named - tables.keys()):
        raise ValueError(f"the backup has a table {strange[0]!r}")
    rows = {name: from_backup(backup, name, schema) for name, schema in tables.items()}

    def write(folder: str) -> None:
        for name, df in rows.items():
            df.write.parquet(f"{folder}/{name}")

    def check(folder: str) -> None:
        for name, schema in tables.items():
            typed = ", ".join(f"`{c}` {t}" for c, t in schema.items())
            mine = backup.where(F.col("table") == name)
            broken = mine.where(F.from_json("row", f"{typed}, `_broken` string", {"columnNameOfCorruptRecord": "_broken"})["_broken"].isNotNull() | F.col("row").isNull())
            if not broken.isEmpty():
                raise ValueError(f"{name} has rows that can't be read")
            if content_hash(spark.read.schema(typed).parquet(f"{folder}/{name}")).first() != content_hash(rows[name]).first():
                raise ValueError(f"{name} was not written as it is in the backup")

    return publish(spark, root, write, check)


def table(spark: SparkSession, root: str, name: str, schema: dict[str, str]) -> DataFrame:
    """A table of the version in force."""
    return spark.read.schema(", ".join(f"`{c}` {t}" for c, t in schema.items())).parquet(f"{current(spark, root)}/{name}")
