"""Schemas of the tables that operators exchange."""

from pyspark.sql import types as T

VEC = "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>"


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


VOXELS = _schema("grid_id LONG, x INT, y INT, z INT, value INT")
GRIDS = _schema(f"grid_id LONG, dx INT, dy INT, dz INT, lo {VEC}, cell {VEC}")
SEEDS = _schema("grid_id LONG, seed_id INT, sx INT, sy INT, sz INT")
VERTICES = _schema(f"mesh_id LONG, vertex_id LONG, position {VEC}, normal {VEC}, uv STRUCT<u: DOUBLE, v: DOUBLE>")
FACES = _schema("mesh_id LONG, face_id LONG, v0 LONG, v1 LONG, v2 LONG")
POINTS = _schema("cloud_id LONG, point_id LONG, x DOUBLE, y DOUBLE, z DOUBLE, cluster INT")
RAYS = _schema("ray_id LONG, ox DOUBLE, oy DOUBLE, oz DOUBLE, dx DOUBLE, dy DOUBLE, dz DOUBLE")
