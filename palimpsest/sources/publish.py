"""Tables published by generation: a reader sees one whole generation or another, never a mixture."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_MANIFEST = "generation long, status string, reason string, tables array<string>, folder string"


class Stale(RuntimeError):
    """The base generation is no longer the current one."""


@dataclass
class Store:
    """A folder with the tables of each generation, and a manifest: a file `N.json` for each published generation N and others that only change its status.

    Each writer writes under a name of its own; the generation exists when its manifest is renamed into place, which
    fails for all but the first writer. A pinned store goes on reading the generation that it was pinned to.
    """

    spark: SparkSession
    root: str
    pinned: dict | None = None

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _manifest(self) -> DataFrame | None:
        path = self._path("manifest")
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return self.spark.read.json(f"{self.root}/manifest/*.json", schema=_MANIFEST) if system.exists(path) else None

    def state(self) -> dict:
        if self.pinned:
            return self.pinned
        m = self._manifest()
        row = None if m is None else m.orderBy(F.desc("generation"), F.desc("status")).first()
        return {"generation": 0, "status": "empty", "reason": None, "tables": [], "folder": None} if row is None else row.asDict()

    def pin(self) -> Store:
        """This store at the generation that is current now."""
        return Store(self.spark, self.root, self.state())

    def _commit(self, name: str, row: dict) -> bool:
        """Puts a manifest file in place, whole or not at all; false if one of that name is there."""
        jvm = self.spark.sparkContext._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("manifest").toUri() if "://" in self.root or self.root.startswith("file:") else jvm.java.net.URI("file:///"), self.spark.sparkContext._jsc.hadoopConfiguration())
        system = self._path("manifest").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(self._path("manifest"))
        temp = self._path(f"manifest/_{uuid.uuid4().hex}")
        out = system.create(temp, False)
        out.write(bytearray(json.dumps(row).encode()))
        out.close()
        final, options = system.makeQualified(self._path(f"manifest/{name}.json")), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(system.makeQualified(temp), final, options)
        except Exception as e:
            if not system.exists(final):
                raise
            system.delete(temp, False)
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    def publish(self, tables: dict[str, DataFrame], base: int) -> int:
        """Writes all tables as the next generation, then commits it, if `base` is still current."""
        if self.state()["generation"] != base:
            raise Stale(f"expected generation {base}, found {self.state()['generation']}")
        n, folder = base + 1, f"gen={base + 1}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        if not self._commit(str(n), {"generation": n, "status": "ready", "reason": None, "tables": sorted(tables), "folder": folder}):
            raise Stale(f"generation {base} was superseded")
        return n

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.state()['folder']}/{name}")

    def mark_stale(self, reason: str) -> None:
        s = self.state()
        self._commit(f"{s['generation']}-stale-{uuid.uuid4().hex}", s | {"status": "stale", "reason": reason})


def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """(rel_path, change) by digest: added, removed or changed."""
    b, n = before.select("rel_path", F.col("sha256").alias("_b")), now.select("rel_path", F.col("sha256").alias("_n"))
    both = b.join(n, "rel_path", "full")
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_b") != F.col("_n"), "changed")
    return both.select("rel_path", kind.alias("change")).where("change is not null")


def refresh(current: DataFrame, changed: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """current with the rows of changed keys replaced by new ones."""
    return current.join(changed.select(key).distinct(), key, "left_anti").unionByName(new)


def affected(changed: DataFrame, symbols_before: DataFrame, symbols_after: DataFrame, refs: DataFrame) -> DataFrame:
    """References to be resolved anew: those in changed files, or to names that changed files define or defined."""
    names = symbols_before.join(changed, "file_id", "left_semi").select("name").union(symbols_after.join(changed, "file_id", "left_semi").select("name")).distinct()
    own = refs.join(changed, "file_id", "left_semi")
    return own.unionByName(refs.join(changed, "file_id", "left_anti").join(names.select(F.col("name").alias("ref_name")), "ref_name", "left_semi").select(*refs.columns))
