"""Work tables in the folder that a cluster shares, and small helpers for scans."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_MADE: dict[int, str] = {}
#: After so many work tables the driver gives memory back.
EVERY = 16


def work_folder(spark: SparkSession) -> str:
    """A folder for work tables below ``spark.checkpoint.dir``, which the cluster shares.

    Where the setting is absent a local session gets a temporary folder; any other
    master is refused, since its executors could not read such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        key = id(spark.sparkContext)
        if key not in _MADE:
            folder = tempfile.TemporaryDirectory(prefix="tessella-")
            atexit.register(folder.cleanup)
            _MADE[key] = folder.name
        base = f"file://{_MADE[key]}"
    return f"{base.rstrip('/')}/tessella-{uuid.uuid4().hex}"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """``key`` set to ``value`` for as long as the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Send at most ``rows`` rows at once to Python workers, unless the session has its own setting.

    Documents are long: Spark's 10,000 rows of them are tens of megabytes in every worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
    return spark


def release_driver(spark: SparkSession) -> bool:
    """Give the driver's freed memory back to the machine; False where its JVM can only shrink the heap.

    A query of many work tables compiles and plans hundreds of times. What threads have freed
    meanwhile stays with the C allocator of the JVM until it is told to return it.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    try:
        # by the interface's own method: the class of the server is not open to calls by name
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # another system, or a JVM without the command
        return False
    return True


class Workspace:
    """Work tables of one query: written once, read back, and so cut off from their lineage."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, work_folder(spark), 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` as Parquet in the shared folder and return it read back.

        Spark deletes the shuffle files of the write as soon as it ends: nothing reads them again.
        """
        self.count += 1
        path = f"{self.folder}/{self.count:03d}-{name}"
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessella_path = path
        if self.count % EVERY == 0:
            release_driver(self.spark)
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that :meth:`keep` made and that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._tessella_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Delete all tables of this workspace; for callers that have read the result."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *, most_bytes: int = 128 << 20) -> DataFrame:
    """``df`` dealt to all cores where its files are too few or too small for that.

    A Parquet row group is one task, however many cores there are. Inputs of more than
    ``most_bytes`` a core stay as they are: they have row groups enough, and moving them costs more.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if cores > 1 and size < most_bytes * cores else df
