"""Reading the tables, and cutting lineage with tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and all runs in this process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="lodestar-")
    return _own["dir"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What one Arrow batch may hold: texts are long, and a task keeps several batches at once on both sides.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes; smaller settings stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(name).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


class Staged:
    """Tables written during one query; `drop` removes those no later plan reads."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/lodestar-{name}-{uuid.uuid4().hex}", 0
        _roots.append((spark, self.root))

    def put(self, df: DataFrame) -> DataFrame:
        """Writes the rows and returns a plan that starts from the files: a lost executor costs no recomputation.

        The shuffle files of the plan go once its rows are written, as nothing reads them again.
        """
        self.n += 1
        path = f"{self.root}/{self.n}"
        was = self.spark.conf.get(_CLEAN)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.parquet(path, compression="zstd")
        finally:
            self.spark.conf.set(_CLEAN, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.staged_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        _remove(self.spark, df.staged_path)


_roots: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, root in _roots:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, root)
        except Exception:  # the JVM may be gone; the folder is scratch space
            pass
    if "dir" in _own:
        import shutil

        shutil.rmtree(_own["dir"].removeprefix("file://"), ignore_errors=True)
