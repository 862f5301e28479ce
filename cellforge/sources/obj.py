"""Wavefront OBJ text: parsed with DataFrame functions, written as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.lineage import cut
from cellforge.operators.metadata import base_name
from cellforge.operators.scan import carried_scan


def parse_obj(lines: DataFrame, marks: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) from (mesh, line_no, line).

    v, vt, vn and f are read; faces of more corners become fans; indices count from 1, or from the end if negative,
    and come out counted from 0. vertices: (mesh, vertex_id, x, y, z); faces: (mesh, face_id, v0, v1, v2 and the
    texture and normal indices t0.., n0.., null where absent). With `marks` faces also have `object`, `group` and `material`: the names
    that the last o, g and usemtl line before them gives, null before the first.

    Numbers and names come from one scan by ranges of lines (see scan.carried_scan), so a file may be larger than a task.
    """
    names = {"o": "object", "g": "group", "usemtl": "material"}
    parts = lines.select("mesh", "line_no", F.trim("line").alias("line")).withColumn("p", F.split("line", r"\s+")).withColumn("kind", F.element_at("p", 1))
    parts = parts.where(F.col("kind").isin("v", "vt", "vn", "f", *(names if marks else ())))
    fan = F.when((F.col("kind") == "f") & (F.size("p") >= 4), F.size("p") - 3).otherwise(0)
    one = lambda k: F.when(F.col("kind") == k, 1).otherwise(0).cast("long")
    counted = parts.select("mesh", "line_no", "kind", "p", fan.alias("fan"), fan.cast("long").alias("n_f"), *[one(k).alias(f"n_{k}") for k in ("v", "vt", "vn")], *[F.when(F.col("kind") == k, F.trim(F.expr(f"substring(line, {len(k) + 1})"))).alias(c) for k, c in names.items() if marks])
    counted = cut(carried_scan(counted, "mesh", ["line_no"], ["n_f", "n_v", "n_vt", "n_vn"], list(names.values()) if marks else []))
    v = counted.where("kind = 'v'").select("mesh", (F.col("n_v") - 1).alias("vertex_id"), *[F.get("p", F.lit(k)).cast("double").alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))])
    corner = F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))
    more = list(names.values()) if marks else []
    tri = counted.where("fan > 0").withColumn("c", corner).select("mesh", "n_f", "fan", "n_v", "n_vt", "n_vn", "c", *more, F.explode(F.sequence(F.lit(1), F.col("fan"))).alias("k"))

    def index(at, field: int, total: str):
        raw = F.nullif(F.get(F.split(F.get("c", at), "/"), F.lit(field)), F.lit("")).cast("long")
        return F.when(raw < 0, F.col(total) + raw).otherwise(raw - 1)

    places = [F.lit(0), F.col("k"), F.col("k") + 1]
    f = tri.select("mesh", (F.col("n_f") - F.col("fan") + F.col("k") - 1).alias("face_id"), *[index(at, i, t).alias(f"{n}{j}") for i, (n, t) in enumerate((("v", "n_v"), ("t", "n_vt"), ("n", "n_vn"))) for j, at in enumerate(places)], *more)
    return v, f


def parse_mtl(lines: DataFrame) -> DataFrame:
    """(mesh, material, key, value) from (mesh, line_no, line) of material libraries: each statement of each newmtl block, in its
    last form if it is repeated; comments and what stands before the first block are left out."""
    text = lines.select("mesh", "line_no", F.trim("line").alias("line")).where("line <> '' and not startswith(line, '#')")
    named = text.select("mesh", "line_no", F.regexp_extract("line", r"^(\S+)", 1).alias("key"), F.regexp_replace("line", r"^\S+\s*", "").alias("value"))
    named = carried_scan(named.withColumn("material", F.when(F.col("key") == "newmtl", F.col("value"))), "mesh", ["line_no"], lasts=["material"])
    return named.where("key <> 'newmtl' and material is not null").groupBy("mesh", "material", "key").agg(F.max_by("value", "line_no").alias("value"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(mesh, line_no, line) of the text files at a path; a file is a mesh, named without folder and extension. Large files are read
    by ranges of bytes; line_no is where a line's range begins and its place after that, which orders the lines."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("n"), "value")
    return text.select(base_name(F.col("file")).alias("mesh"), F.struct("range", "n").alias("line_no"), F.col("value").alias("line"))


def read_obj(spark: SparkSession, path: str, marks: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of the OBJ files at a path (see parse_obj and text_lines)."""
    return parse_obj(text_lines(spark, path), marks)


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, part, n, line): OBJ text lines, vertices before faces; ids count from 0 and come out from 1."""
    v = vertices.select("mesh_id", F.lit(0).alias("part"), F.col("vertex_id").alias("n"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("line"))
    f = faces.select("mesh_id", F.lit(1).alias("part"), F.col("face_id").alias("n"), F.concat_ws(" ", F.lit("f"), *[(F.col(c) + 1).cast("string") for c in ("v0", "v1", "v2")]).alias("line"))
    return v.union(f)


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """One folder mesh_id=... of OBJ text for each mesh."""
    obj_lines(vertices, faces).repartition("mesh_id").sortWithinPartitions("mesh_id", "part", "n").select("mesh_id", "line").write.partitionBy("mesh_id").mode("overwrite").text(path)
