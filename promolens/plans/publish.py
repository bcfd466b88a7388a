"""All-or-nothing writes of a set of tables (what ``CREATE TABLE AS`` gives for one).

Every table is first written below a staging folder of the target. Only when all of them are complete are
they swapped in by renames, and ``manifest.json`` names the published set and its layout. A job that fails while
writing leaves the published tables and the manifest as they were; a swap that fails halfway is undone.
Renames go through the Hadoop file system of the target, so they work wherever Spark writes (on an object store
a rename is a copy: not a single step there, but the manifest still names complete sets only).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

MANIFEST = "manifest.json"


class _Files:
    """The few file operations needed, on the Hadoop file system of ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def rename(self, old: str, new: str) -> None:
        target = self._path(new)
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(self._path(old), target):
            raise OSError(f"rename failed: {old} -> {new}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def write(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


def publish(spark: SparkSession, root: str, writes: dict[str, Callable[[str], None]], layout: dict | None = None,
            mode: str = "overwrite", parallel: int = 4) -> dict[str, str]:
    """Run ``writes`` (name -> function of the path to write) and swap the results in under ``root``; name -> path.

    The writes are independent jobs; up to ``parallel`` of them are submitted at once from driver threads.
    """
    root = root.rstrip("/")
    files, ident = _Files(spark, root), uuid.uuid4().hex
    final = {name: f"{root}/{name}" for name in writes}
    staging, old = f"{root}/_staging-{ident}", f"{root}/_replaced-{ident}"
    if mode != "overwrite":
        there = [p for p in final.values() if files.exists(p)]
        if there:
            raise FileExistsError(", ".join(there))
    try:
        with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
            for f in [pool.submit(write, f"{staging}/{name}") for name, write in writes.items()]:
                f.result()
    except BaseException:
        files.delete(staging)
        raise
    moved: list[str] = []
    try:
        for name, path in final.items():
            if files.exists(path):
                files.rename(path, f"{old}/{name}")
            moved.append(name)
            files.rename(f"{staging}/{name}", path)
        text = json.dumps({"id": ident, "tables": sorted(writes), "layout": layout or {}}, indent=1)
        files.write(f"{staging}/{MANIFEST}", text)
        if files.exists(f"{root}/{MANIFEST}"):
            files.rename(f"{root}/{MANIFEST}", f"{old}/{MANIFEST}")
        files.rename(f"{staging}/{MANIFEST}", f"{root}/{MANIFEST}")
    except BaseException:
        for name in [*reversed(moved), MANIFEST]:                # put back what was there
            if files.exists(f"{old}/{name}"):
                if files.exists(f"{root}/{name}"):
                    files.delete(f"{root}/{name}")
                files.rename(f"{old}/{name}", f"{root}/{name}")
            elif name in moved and files.exists(f"{root}/{name}"):
                files.delete(f"{root}/{name}")
        files.delete(staging)
        files.delete(old)
        raise
    files.delete(staging)
    files.delete(old)
    return final


def published(spark: SparkSession, root: str) -> dict | None:
    """The manifest of the set under ``root``; None if nothing was published there."""
    path = f"{root.rstrip('/')}/{MANIFEST}"
    if not _Files(spark, root).exists(path):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
