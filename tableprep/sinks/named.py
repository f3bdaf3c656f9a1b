"""Outputs under names the caller chooses, one file each (K5, K7, K8).

Two phases.  First Spark writes everything below a hidden folder next to the outputs, one
directory and one file a name; its own commit protocol lets in one attempt of each task, so a
failed or speculative attempt leaves nothing.  Then, with the job committed, the driver gives the
files their names -- a rename each, no data moves on file systems that rename -- and removes the folder.
Readers skip the folder by its name; a run that dies before the second phase has published
nothing, and one that dies within it leaves its folder, by which ``leftovers`` finds it.

A name is one file, so one task writes it: rows are dealt out by name and sorted inside the task.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from ..errors import TablePrepError
from .writers import write

MAX_FILES = 100_000
RENAMES = 16  # at a time
STAGING = ".staging-"


class NamedOutput:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.staging = f"{self.path}/{STAGING}{uuid.uuid4().hex}"
        self.steps: list[tuple[str, list[str], Callable[..., str]]] = []

    def _at(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm_path

    def add(self, df: DataFrame, fmt: str, keys: Sequence[str], order: Sequence[str], name: Callable[..., str], **options) -> None:
        """Stage ``df``: one file for each value of the whole-number columns ``keys``, its rows by
        ``order``.  ``name(*values)`` is its name up to the suffix of the format."""
        at, keys = f"{self.staging}/{len(self.steps)}", list(keys)
        rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
        write(rows, at, fmt, partition_by=keys, **options)
        self.steps.append((at, keys, name))

    def _staged(self) -> dict[str, str]:
        """{published name: staged file}"""
        out: dict[str, str] = {}
        for at, keys, name in self.steps:
            fs, top = self._at(at)
            top = fs.makeQualified(top).toString()
            walk = fs.listFiles(self._at(at)[1], True)
            while walk.hasNext():
                file = walk.next().getPath()
                if file.getName().startswith(("_", ".")):
                    continue
                folders = file.getParent().toString()[len(top) + 1:].split("/")
                values = [int(f.partition("=")[2]) for f in folders]
                suffix = "." + file.getName().partition(".c000.")[2]
                target = name(*values) + suffix
                if "/" in target or target in out:
                    raise TablePrepError(f"two files would be named {target}" if target in out else f"{target!r} is no file name")
                out[target] = file.toString()
                if len(out) > MAX_FILES:
                    raise TablePrepError(f"more than {MAX_FILES} named files; write a partitioned dataset instead")
        return out

    def publish(self, overwrite: bool = False) -> list[str]:
        """Give the staged files their names; returns them."""
        staged = self._staged()
        fs, _ = self._at(self.path)
        there = [n for n in staged if fs.exists(self._at(f"{self.path}/{n}")[1])]
        if there and not overwrite:
            self.drop()
            raise TablePrepError(f"already there: {sorted(there)[:5]}")

        def move(item: tuple[str, str]) -> None:
            target = self._at(f"{self.path}/{item[0]}")[1]
            if item[0] in there:
                fs.delete(target, False)
            if not fs.rename(self._at(item[1])[1], target):
                raise TablePrepError(f"could not publish {item[0]}")

        with ThreadPoolExecutor(RENAMES) as pool:
            list(pool.map(move, staged.items()))
        self.drop()
        return sorted(staged)

    def drop(self) -> None:
        """Remove what was staged."""
        fs, path = self._at(self.staging)
        fs.delete(path, True)

    def __enter__(self) -> NamedOutput:
        return self

    def __exit__(self, failed, *_) -> None:
        if failed is not None:
            self.drop()


def leftovers(spark: SparkSession, path: str) -> list[str]:
    """Staging folders of runs that died under ``path``."""
    out = NamedOutput(spark, path)
    fs, top = out._at(out.path)
    return [s.getPath().toString() for s in fs.listStatus(top) if s.getPath().getName().startswith(STAGING)] if fs.exists(top) else []
