"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import threading
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from cellforge.lineage import checkpoint_folder, cut, passing  # noqa: F401  operators take cut from here

#: Words of every contract: runs of anything but the ASCII white space \x20 \x09-\x0D.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths of the tables written in each open settled() of a thread, the innermost last.
_open = threading.local()
#: Shuffle files of a query are deleted when it has ended, not when the driver happens to collect what points to them.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the checkpoint folder: columnar, compressed, read by column. The table is deleted
    when the application ends, or at the end of the settled() around it. It gets no _SUCCESS file, as nobody else reads it.
    For that file and for each folder that it makes, a local file system would start a process in the driver, which counts with all
    of the driver's memory until its program is loaded; so there the folders are made first. The shuffle files of the query
    are deleted at once, and free memory of the driver goes back to the system.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(passing(spark, path))
    if at.getFileSystem(sc._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
        sc._jvm.java.io.File(f"{at.toUri().getPath()}/_temporary/0").mkdirs()
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        # the plan is made anew, as a plan keeps the setting that it was made under
        df.select("*").write.mode("append").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    give_back(spark)
    if getattr(_open, "paths", None):
        _open.paths[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of make() as a written table, after which the tables that were written on the way are deleted.

    What make() returns must be all that is used of them. Calls may be nested; an error leaves the tables to the end of the
    application.
    """
    if not hasattr(_open, "paths"):
        _open.paths = []
    _open.paths.append([])
    try:
        out = written(make())
    finally:
        *passed, last = _open.paths.pop() or [None]
    sc = spark.sparkContext
    for path in passed:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    if _open.paths:
        _open.paths[-1].append(last)
    return out


def give_back(spark: SparkSession) -> None:
    """Returns memory that the driver's two processes have freed, but their allocators hold, to the system.

    Compiling and planning many joins leaves some 200 MB of that in the JVM beside its heap, fitting a language model 60 MB in
    Python. Where the JVM or the C library has no such call, nothing happens.
    """
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
    gateway, jvm = spark.sparkContext._gateway, spark._jvm
    array = lambda kind, *x: _filled(gateway.new_array(kind, len(x)), x)
    named = jvm.java.lang.Class.forName
    try:
        # by reflection on the interface, as the server's own class is not open to calls
        kinds = array(jvm.java.lang.Class, *map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        invoke = named("javax.management.MBeanServer").getMethod("invoke", kinds)
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        call = array(jvm.java.lang.Object, bean, "systemTrimNativeHeap", array(jvm.java.lang.Object), array(jvm.java.lang.String))
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JError:
        pass


def _filled(array, values: tuple):
    for i, x in enumerate(values):
        array[i] = x
    return array


def small_batches(df: DataFrame, rows: int = 512) -> DataFrame:
    """The same table, after the session's Arrow batches are held to `rows` rows: whole texts go to Python, and Spark's
    10,000 rows at once would need memory without bound where texts are long. A lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def fresh(taken: list[str], name: str) -> str:
    """A column name like `name` that clashes with none of `taken` (Spark compares names without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
