"""A graph store on parquet: append-only logs of vertex and edge versions, committed together.

A commit is one small file that names the folders it added, written last; readers see whole commits only. The state is the last
version of every id. Compaction writes the state to a new folder and commits it as a new base, so no folder that a
running query reads is ever changed. One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.model import EDGE, VERTEX
from factloom.sources.graph import Graph

KINDS = {"vertices": VERTEX, "edges": EDGE}


class GraphStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs, self._Path = self._open()

    def _open(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def initialize(self) -> bool:
        """Creates the store if it is missing; whether it was."""
        commits = self._Path(f"{self.root}/_commits")
        if self._fs.exists(commits):
            return False
        self._fs.mkdirs(commits)
        return True

    def healthy(self) -> bool:
        try:
            return self.spark.range(1).count() == 1 and self._fs.exists(self._Path(f"{self.root}/_commits"))
        except Exception:
            return False

    def _commits(self) -> list[dict]:
        path = self._Path(f"{self.root}/_commits")
        if not self._fs.exists(path):
            return []
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(path))
        out = []
        for n in names:
            if n.endswith(".json"):
                stream = self._fs.open(self._Path(f"{self.root}/_commits/{n}"))
                try:
                    out.append(json.loads(bytes(stream.readAllBytes()).decode()))
                finally:
                    stream.close()
        return out

    @property
    def version(self) -> int:
        commits = self._commits()
        return commits[-1]["version"] if commits else 0

    def _put(self, commit: dict) -> None:
        name = f"{self.root}/_commits/{commit['version']:010d}"
        stream = self._fs.create(self._Path(name + ".tmp"), True)
        stream.write(bytearray(json.dumps(commit).encode()))
        stream.close()
        if not self._fs.rename(self._Path(name + ".tmp"), self._Path(name + ".json")):
            raise RuntimeError("another writer committed this version")

    def append(self, vertices: DataFrame | None = None, edges: DataFrame | None = None, base: bool = False, note: dict | None = None) -> int:
        """Appends versions of vertices and edges as one commit; its number."""
        version, added = self.version + 1, {}
        for kind, df in (("vertices", vertices), ("edges", edges)):
            if df is not None:
                added[kind] = f"{kind}/version={version}"
                schema = self.spark.createDataFrame([], KINDS[kind]).schema
                df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema)).write.partitionBy("label").parquet(f"{self.root}/{added[kind]}")
        self._put({"version": version, "base": base, **added, **({"note": note} if note else {})})
        return version

    def _log(self, kind: str, as_of: int | None) -> DataFrame:
        commits = [c for c in self._commits() if as_of is None or c["version"] <= as_of]
        start = max((k for k, c in enumerate(commits) if c["base"]), default=0)
        folders = [f"{self.root}/{c[kind]}" for c in commits[start:] if kind in c]
        schema = f"{KINDS[kind]}, version int"
        if not folders:
            return self.spark.createDataFrame([], schema)
        # one scan of all commits; version and label are partition columns
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*folders)

    def _state(self, kind: str, as_of: int | None) -> DataFrame:
        """The last version of each id. Filters on id and label reach the scan, columns that nothing asks for aren't read."""
        log = self._log(kind, as_of)
        columns = [c for c in log.columns if c not in ("version", "id", "label")]
        return log.groupBy("id", "label").agg(*(F.max_by(c, "version").alias(c) for c in columns))

    def graph(self, as_of: int | None = None) -> Graph:
        """The state after the last commit, or after commit `as_of`."""
        return Graph(self._state("vertices", as_of), self._state("edges", as_of))

    def notes(self) -> list[dict]:
        return [c["note"] for c in self._commits() if "note" in c]

    def compact(self) -> int:
        g = self.graph()
        return self.append(g.vertices, g.edges, base=True)
