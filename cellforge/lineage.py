"""Cutting of lineages with reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a session whose executors are threads of this
    process may do without: it gets a folder of this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="cellforge-ckpt-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def passing(spark: SparkSession, path: str) -> str:
    """The path, marked to be deleted when the application ends; its file system may be any that Spark writes to."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: Rows of narrow tables that one file of a checkpoint may hold where their number is known.
FILE_ROWS = 250_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The same rows, written to the checkpoint folder, so that lost executors cost no recomputation from the start.

    Where the caller knows that there are `rows` rows at most, a small table goes to few files, not to one for each
    partition of the last shuffle; a large one keeps its partitions.
    """
    checkpoint_folder(df.sparkSession)
    if rows is not None:
        files = rows // FILE_ROWS + 1
        if files < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(files)
    return _plain_size(df.checkpoint(eager=True))


def _plain_size(df: DataFrame) -> DataFrame:
    """The same checkpoint, with the size that Spark takes for unknown ones where its estimate is larger still.

    A checkpoint keeps the size that its plan was estimated at, and a join multiplies those of its sides. In a loop of joins
    the number's digits double with each round, until it alone fills the driver's memory.
    """
    plan, spark = df._jdf.queryExecution().analyzed(), df.sparkSession
    try:
        if plan.stats().sizeInBytes() < 1 << 63:
            return df
    except ValueError:  # so many digits that Python refuses them
        pass
    jvm, none = spark._jvm, spark._jvm.scala.Option.empty()
    plain = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, spark._jsparkSession, none, none)
    return type(df)(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plain), spark)
