"""Session, shared scratch folder, written intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side is only broadcast when it is proven to hold at most this many rows.
BROADCAST_ROWS = 50_000

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_scratch_roots: set[str] = set()


def build_session(master: str = "local[8]", app: str = "factloom", **conf: str) -> SparkSession:
    """A session with the settings the engine is tested with; a cluster's own settings are better made at submit time."""
    cpus = "".join(c for c in master if c.isdigit()) or "8"
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": cpus,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    spark = SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches: `spark.checkpoint.dir` of the session.

    Only where the session names none and runs inside one process is a temporary folder made, which ends with the process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{_local_dirs[app]}/rdd")
    return f"file://{_local_dirs[app]}"


def ship(spark: SparkSession) -> None:
    """Hands this package to the Python workers of the session, once; operators with Python stages call it."""
    app, root = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if app not in _shipped and root.is_dir():
        folder = tempfile.mkdtemp(prefix="factloom-ship-")  # on the driver only, which serves the file to all executors
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for p in root.rglob("*.py"):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(f"{folder}/{root.name}.zip")
        _shipped.add(app)


def ship_file(spark: SparkSession, path: str) -> str:
    """Hands a file that the driver can read to all executors; the name by which `shipped` finds it there."""
    spark.sparkContext.addFile(path)
    return path.rstrip("/").rsplit("/", 1)[-1]


def shipped(name: str) -> str:
    """Where a task finds a file of `ship_file`."""
    return SparkFiles.get(name)


def _delete_at_exit(spark: SparkSession, folder: str) -> None:
    """Deletes the application's scratch folder when the driver ends; results that are still read then are none."""

    def delete():
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:
            pass  # the session is gone; the folder is left to whoever looks after the shared one

    if folder not in _scratch_roots:
        _scratch_roots.add(folder)
        atexit.register(delete)


class Files:
    """Small files and folders of the file system that a folder is on."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self.root, self._path = root.rstrip("/"), jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(self.path(name)))

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(self.path(name)))

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, in order; none if there is no such folder."""
        at = self._path(self.path(name))
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.path(name)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Writes a file that is seen whole or not at all; False if it was there already."""
        stream = self._fs.create(self._path(self.path(name) + ".tmp"), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        return not self.exists(name) and self._fs.rename(self._path(self.path(name) + ".tmp"), self._path(self.path(name)))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.path(name)), True)


class Scratch:
    """Tables written to the shared folder. They cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        top = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
        _delete_at_exit(spark, top)
        self.root = f"{top}/{label}-{uuid.uuid4().hex}"
        self._count = 0

    def write(self, df: DataFrame, label: str = "t", by: list[str] | None = None) -> DataFrame:
        """Write `df` once and return it as read back; `.scratch_path` keeps its path, `.scratch_rows` the rows counted while writing.

        A stage that is run again may count rows twice, so the number is an upper bound.
        """
        self._count += 1
        path, seen = f"{self.root}/{self._count:03d}-{label}", Observation()
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("error").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.scratch_path, back.scratch_rows = path, seen.get.get("rows") or 0
        return back

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete written tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            if t is not None and getattr(t, "scratch_path", None):
                path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """`df` with a broadcast hint if it holds at most `limit` rows, known or counted here; else unchanged, so that it is shuffled."""
    rows = getattr(df, "scratch_rows", None) if rows is None else rows
    return F.broadcast(df) if (df.limit(limit + 1).count() if rows is None else rows) <= limit else df
