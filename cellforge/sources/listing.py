"""Listing of input models and resuming of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.operators.metadata import base_name


def list_models(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """(path, name, length) of the models with an extension below a folder; an error if there is none.

    A model is a file, or a folder with the extension, such as a table that Spark wrote: then one row stands for all the
    files in it, whatever their names, with the sum of their lengths. Hidden files (names that begin with _ or .) do not count.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at)
    above = len(at.toString().rstrip("/").split("/"))
    parts = F.split("path", "/")
    # the first name below the folder that has the extension; a folder that is a file itself is judged by its own name
    ends = F.filter(F.sequence(F.least(F.lit(above + 1), F.size(parts)), F.size(parts)), lambda n: F.endswith(F.get(parts, n - 1), F.lit(f".{extension}")))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    models = files.withColumn("path", F.array_join(F.slice(parts, F.lit(1), F.get(ends, F.lit(0))), "/")).where("path is not null")
    models = models.groupBy("path").agg(F.sum("length").alias("length")).select("path", base_name(F.col("path")).alias("name"), "length")
    if models.isEmpty():
        raise FileNotFoundError(f"no .{extension} file below {folder}")
    return models


def resume_after(models: DataFrame, name: str, column: str = "name") -> DataFrame:
    """Models from a name on, in order of the name."""
    return models.where(F.col(column) >= name)
