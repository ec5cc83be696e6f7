"""Shared-folder helpers: where intermediate tables live on a cluster."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: The driver's heap is collected between tables once more than this share of its limit is taken from the system.
HEAP_SHARE = 0.5
_CONF = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset on a local master (in
    tests) a temporary folder of this machine is made and set; elsewhere its absence is an error.
    """
    folder = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{_CONF} must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="linkforge-")
        spark.conf.set(_CONF, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str = "t") -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def relieve(spark: SparkSession) -> None:
    """Give the driver's unused memory back to the system.

    Plans leave garbage in a heap that grows rather than being collected, and what compilers and buffers have
    freed stays with the C library; where the JVM or the C library cannot trim that, it stays there.
    """
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        gc.collect()  # the JVM keeps what Python's objects still name
        jvm.System.gc()
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        call = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods()
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        next(m for m in call if m.getName() == "invoke").invoke(server, given)
    except Py4JError:  # another kind of JVM
        pass
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends at reliable storage, so a lost executor costs no recomputation, the planner
    sees the true size (small tables are broadcast, large ones are not), and later uses read the
    columns they need. Once the table is written nothing reads its shuffle files, so they go at once,
    and so does what planning it has left in the driver's memory.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    relieve(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by ``cut`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if parent.startswith(shared_dir(spark)) or f"/{spark.sparkContext.applicationId}/" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)
