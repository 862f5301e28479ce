"""Binary formats as data sources: parts by records, writers that commit or leave nothing."""

import glob
import os
import struct

import pytest
from pyspark.sql import functions as F

from cellforge.plans.fixtures import mesh
from cellforge.sources.binary import encode_binm
from cellforge.sources.formats import FORMATS, register


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    register(spark)


def files(path):
    return sorted(os.path.basename(f) for f in glob.glob(f"{path}/**", recursive=True) if os.path.isfile(f) and not f.endswith(".crc"))


@pytest.mark.parametrize("part", [64, 1 << 20])
def test_parts_give_every_record_once(spark, tmp_path, part):
    rows = spark.range(1000).select((F.col("id") % 7).cast("int").alias("value"), (F.col("id") * 3 + 1).alias("length"))
    at = str(tmp_path / "runs")
    rows.coalesce(1).write.format("cellforge_rle").option("dims", "8,9,10").mode("append").save(at)
    assert len(files(at)) == 1 and open(glob.glob(f"{at}/*.rle")[0], "rb").read(12) == struct.pack("<3I", 8, 9, 10)
    back = spark.read.format("cellforge_rle").option("partBytes", part).load(at)
    assert [tuple(r) for r in back.orderBy("record").select("record", "value", "length").collect()] == [(i, i % 7, i * 3 + 1) for i in range(1000)]
    assert back.rdd.getNumPartitions() == (94 if part == 64 else 1)


def test_points_overwritten_and_split_into_files(spark, tmp_path):
    at = str(tmp_path / "points")
    rows = spark.range(500, numPartitions=2).select((F.col("id") / 4).alias("x"), F.lit(1.5).alias("y"), (-F.col("id")).cast("double").alias("z"))
    rows.write.format("cellforge_ply").option("partBytes", 1200).mode("append").save(at)
    assert len(files(at)) >= 2
    rows.limit(3).write.format("cellforge_ply").mode("overwrite").save(at)
    got = spark.read.format("cellforge_ply").load(at).orderBy("x").select("x", "y", "z").collect()
    assert [tuple(r) for r in got] == [(0.0, 1.5, 0.0), (0.25, 1.5, -1.0), (0.5, 1.5, -2.0)] and len(files(at)) == 1
    rows.limit(0).write.format("cellforge_ply").mode("append").save(at)
    assert len(files(at)) == 1


def test_meshes_are_read_by_ranges(spark, sf, tmp_path):
    v, f = mesh(spark, sf)
    for r in encode_binm(v, f, count_bytes=8).collect():
        (tmp_path / f"{r.mesh_id}.binm").write_bytes(bytes(r.content))
    for name, whole, columns in (("vertices", v.select("mesh_id", F.col("vertex_id").alias("record"), "x", "y", "z"), ["x", "y", "z"]), ("faces", f.select("mesh_id", F.col("face_id").alias("record"), "v0", "v1", "v2"), ["v0", "v1", "v2"])):
        got = spark.read.format(f"cellforge_binm_{name}").option("partBytes", 4000).load(str(tmp_path))
        got = got.withColumn("mesh_id", F.regexp_extract("path", r"(\d+)\.binm$", 1).cast("long"))
        want = {tuple(r) for r in whole.collect()}
        rows = got.select("mesh_id", "record", *columns).collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_a_write_that_fails_leaves_no_file(spark, tmp_path):
    at = str(tmp_path / "raw")
    good = spark.range(300, numPartitions=3).select((F.col("id") % 5).cast("int").alias("value"))
    bad = good.withColumn("value", F.when(F.col("value") == 4, F.lit(None).cast("int")).otherwise(F.col("value")))
    for rows in (bad, good.withColumn("value", F.col("value") + 70_000), good.withColumn("value", F.raise_error(F.lit("gone")).cast("int"))):
        with pytest.raises(Exception):
            rows.write.format("cellforge_raw").mode("append").save(at)
        assert files(at) == [] and not glob.glob(f"{at}/_writing*")
    good.write.format("cellforge_raw").mode("append").save(at)
    assert spark.read.format("cellforge_raw").load(at).count() == 300


def test_what_is_no_file_of_the_format_is_an_error(spark, tmp_path):
    (tmp_path / "cut.rle").write_bytes(struct.pack("<3I", 1, 1, 1) + b"12345")
    (tmp_path / "no.ply").write_bytes(b"ply\nformat ascii 1.0\nend_header\n")
    for kind in ("cellforge_rle", "cellforge_ply"):
        with pytest.raises(Exception):
            spark.read.format(kind).load(str(tmp_path)).collect()
    with pytest.raises(Exception):
        spark.range(3).write.format("cellforge_binm_faces").mode("append").save(str(tmp_path / "x"))
    with pytest.raises(Exception):
        spark.range(3).selectExpr("1 as value", "2L as length").write.format("cellforge_rle").mode("append").save(str(tmp_path / "y"))
    assert set(FORMATS) == {"cellforge_rle", "cellforge_raw", "cellforge_ply", "cellforge_binm_vertices", "cellforge_binm_faces"}
