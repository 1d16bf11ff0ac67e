"""A workspace: an append-only log of versioned changes and the state that is its fold.

Commits are Parquet folders of unique names under ``log/``; a commit exists when its manifest file
exists. That file names the folder and is created atomically and never overwritten, so of two writers
of one version one fails, without touching what the other wrote. A base snapshot with its version
bounds what a read folds.
"""

from __future__ import annotations

import re
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelog.functions.values import FACT, FACTS
from sievelog.operators.facts import effective, fold

LOG = f"version long, seq int, op string, {FACTS}, actor string, at timestamp"
_WORKSPACE = re.compile(r"[a-z0-9][a-z0-9-]{0,63}")


class Conflict(RuntimeError):
    """Another writer took the version."""


class Warehouse:
    def __init__(self, spark: SparkSession, root: str, workspace: str = "main", retain: int | None = None):
        if not _WORKSPACE.fullmatch(workspace):
            raise ValueError(f"not a workspace id: {workspace}")
        self.spark, self.root, self.retain = spark, f"{root.rstrip('/')}/{workspace}", retain
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._known: dict[tuple[int, int], str] = {}
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for name in ("log", "commits", "base"):
            self._fs.mkdirs(self._path(f"{self.root}/{name}"))

    def _listed(self, folder: str) -> list[int]:
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if x.getPath().getName().isdigit())

    def _folders(self) -> dict[int, str]:
        """The log folder of each commit, from its manifest; manifests never change, so each is read once.

        One that is still empty belongs to a writer that has not finished.
        """
        out = {}
        for status in self._fs.listStatus(self._path(f"{self.root}/commits")):
            if (name := status.getPath().getName()).isdigit() and status.getLen():
                key = (int(name), status.getModificationTime())
                if key not in self._known:
                    stream = self._fs.open(status.getPath())
                    try:
                        self._known[key] = stream.readUTF()
                    finally:
                        stream.close()
                out[key[0]] = self._known[key]
        return dict(sorted(out.items()))

    @property
    def version(self) -> int:
        return max([self.floor, *self._folders()])

    @property
    def floor(self) -> int:
        """Changes up to this version are only in the base snapshot."""
        return max([0, *(v for v in self._listed("base") if self._fs.exists(self._path(f"{self.root}/base/{v}/_SUCCESS")))])

    def _paths(self, after: int = 0, upto: int | None = None) -> list[str]:
        return [f"{self.root}/log/{f}" for v, f in self._folders().items() if v > after and (upto is None or v <= upto)]

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def log(self, after: int = 0, upto: int | None = None) -> DataFrame:
        return self._read(self._paths(after, upto))

    def entries_since(self, version: int) -> DataFrame | None:
        """Changes after a version; None if they are no longer all there."""
        return None if version < self.floor else self.log(version)

    def facts(self, version: int | None = None) -> DataFrame:
        """The state at a version, the latest by default."""
        floor = self.floor
        if version is not None and version < floor:
            raise ValueError("that version is no longer kept")
        paths = self._paths(floor, version)
        base = self.spark.read.schema(FACTS).parquet(f"{self.root}/base/{floor}") if floor else None
        changes = self._read(paths).select("version", "seq", "op", *FACT)
        # a snapshot holds each fact once, and so does a commit: alone, either is the state without a fold
        if floor and not paths:
            return base
        if not floor and len(paths) == 1:
            return changes.where("op = '+'").select(*FACT)
        if floor:
            base = base.select(F.lit(floor).cast("long").alias("version"), F.lit(0).alias("seq"), F.lit("+").alias("op"), *FACT)
            changes = base.unionByName(changes)
        return fold(changes)

    def snapshot(self) -> tuple[int, DataFrame]:
        version = self.version
        return version, self.facts(version)

    def apply(self, delta: DataFrame, actor: str | None = None) -> int | None:
        """Logs the changes (op, fact) that change anything as the next version; None if none do."""
        version = self.version
        changes = effective(self.facts(version), delta.select("op", *FACT))
        # removals come before additions; within one commit a fact has one operation
        rows = changes.select(F.lit(version + 1).cast("long").alias("version"), F.when(F.col("op") == "-", 0).otherwise(1).alias("seq"), "op", *FACT, F.lit(actor).cast("string").alias("actor"), F.current_timestamp().alias("at"))
        folder = f"{version + 1}-{uuid.uuid4().hex}"
        path = self._path(f"{self.root}/log/{folder}")
        rows.write.parquet(path.toString())
        if self.spark.read.schema(LOG).parquet(path.toString()).isEmpty():
            self._fs.delete(path, True)
            return None
        try:
            manifest = self._fs.create(self._path(f"{self.root}/commits/{version + 1}"), False)
        except Exception as e:
            self._fs.delete(path, True)
            raise Conflict(f"version {version + 1} was taken") from e
        manifest.writeUTF(folder)
        manifest.close()
        if self.retain and (version + 1 - self.floor) >= 2 * self.retain:
            self.compact(version + 1 - self.retain)
        return version + 1

    def compact(self, upto: int) -> None:
        """Folds the log up to a version into the base and drops those changes."""
        if upto <= self.floor:
            return
        old = self._folders()
        self.facts(upto).write.mode("overwrite").parquet(f"{self.root}/base/{upto}")
        for v, folder in old.items():
            if v <= upto:
                self._fs.delete(self._path(f"{self.root}/commits/{v}"), False)
                self._fs.delete(self._path(f"{self.root}/log/{folder}"), True)

    def reset(self) -> None:
        """Drops everything of this workspace."""
        self._fs.delete(self._path(self.root), True)
        for name in ("log", "commits", "base"):
            self._fs.mkdirs(self._path(f"{self.root}/{name}"))

    def info(self) -> dict[str, Any]:
        from sievelog.operators.facts import entity_counts

        return {"version": self.version, "floor": self.floor, "rows": {r.entity: r.n for r in entity_counts(self.facts()).collect()}}
