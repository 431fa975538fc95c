"""Session builder and the scratch tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", name: str = "weftline", **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.master(master).appName(name)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests, local runs) a
    temporary folder of this machine is made, and removed at exit.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    global _LOCAL
    if _LOCAL is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, _LOCAL, ignore_errors=True)
    return f"file://{_LOCAL}"


_LOCAL: str | None = None


_ROOTS: list[str] = []


def release(spark: SparkSession) -> None:
    """Remove all scratch tables of this process, once its results have been written or shown.

    DataFrames that were made before and still read scratch tables cannot be run afterwards.
    """
    while _ROOTS:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_ROOTS.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def put_bytes(uri: str, data: bytes) -> None:
    """Write a file of the shared folder from a task; a task that runs twice replaces it whole."""
    fs, path = FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0])
    part = f"{path}.{uuid.uuid4().hex[:12]}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def get_bytes(uri: str) -> bytes:
    fs, path = FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


class Scratch:
    """Intermediate tables written once to the shared folder.

    A written table has no lineage behind it, so the loss of an executor costs a re-read and never
    a recomputation of earlier rounds. ``drop`` removes a table that a later round has replaced,
    ``release`` all that are left.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._paths: list[str] = []
        _ROOTS.append(self.root)

    def write_counted(self, df: DataFrame, condition: Column, name: str = "t") -> tuple[DataFrame, int]:
        """``write``, and the number of rows that meet the condition, counted by the job that writes them."""
        seen = Observation()
        out = self.write(df.observe(seen, F.count_if(condition).alias("n")), name)
        return out, seen.get["n"]

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{name}-{self._n}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weftline_path = path
        self._paths.append(path)
        return out

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def uri(self) -> str:
        """The folder as tasks name it in ``put_bytes`` and ``get_bytes``."""
        fs, p = self._fs(self.root)
        at = fs.makeQualified(p).toString()
        return f"file://{at[5:]}" if at.startswith("file:/") and not at.startswith("file://") else at

    def delete(self, name: str) -> None:
        """Remove what tasks have put under ``name``."""
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)

    def intact(self) -> bool:
        """Whether every table written so far, and not dropped, is still there."""
        return all(fs.exists(p) for fs, p in map(self._fs, self._paths))

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            path = getattr(t, "_weftline_path", None)
            if path in self._paths:
                fs, p = self._fs(path)
                fs.delete(p, True)
                self._paths.remove(path)
