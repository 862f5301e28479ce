"""Binary grids, meshes and point clouds: run-length grids, raw grids, vox, binm and PLY."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.operators.encode import run_lengths, to_cube, vox_records
from cellforge.operators.grid import densify
from cellforge.functions.cells import cell_index
from cellforge.operators.grid import AT
from cellforge.operators.metadata import base_name

#: Little-endian records of the formats.
RLE_HEADER, RLE_RUN = "<III", "<HI"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(base_name(F.col("path")).alias("name"), "content")


def _per_grid(grids: DataFrame, make, columns: list[str]) -> DataFrame:
    """(grid_id, content): bytes that `make` builds of a grid's rows."""
    return grids.groupBy("grid_id").applyInPandas(lambda key, rows: pd.DataFrame({"grid_id": [key[0]], "content": [make(rows[columns])]}), "grid_id long, content binary")


# run-length grids


def decode_rle(content: bytes) -> tuple[tuple[int, int, int], np.ndarray, np.ndarray]:
    """Dims, run values and run lengths."""
    dims = struct.unpack_from(RLE_HEADER, content)
    runs = np.frombuffer(content, np.dtype([("value", "<u2"), ("length", "<u4")]), offset=struct.calcsize(RLE_HEADER))
    if int(runs["length"].sum()) != dims[0] * dims[1] * dims[2]:
        raise ValueError("the runs do not fill the grid")
    return dims, runs["value"].astype(np.int64), runs["length"].astype(np.int64)


def read_rle(spark: SparkSession, path: str, flip_y: bool = True, pad: str | None = None) -> DataFrame:
    """Cells of the run-length files at a path; see rle_cells()."""
    return rle_cells(_files(spark, path), flip_y, pad)


def rle_cells(files: DataFrame, flip_y: bool = True, pad: str | None = None) -> DataFrame:
    """(name, x, y, z, value) of the non-empty cells of run-length grids; y is mirrored as in the published data set.

    pad "end" or "center" places the cells in the cube of the longest side. Runs are expanded by Spark, not in Python.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                (dx, dy, dz), value, length = decode_rle(bytes(content))
                start = np.cumsum(length) - length
                ok = value != 0
                yield pd.DataFrame({"name": name, "dx": dx, "dy": dy, "dz": dz, "start": start[ok], "length": length[ok], "value": value[ok]})

    runs = files.mapInPandas(run, "name string, dx int, dy int, dz int, start long, length long, value int")
    cells = runs.select("name", "dx", "dy", "dz", "value", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("i"))
    plane = F.col("dy") * F.col("dz")
    x, y, z = F.floor(F.col("i") / plane).cast("int"), F.floor(F.col("i") % plane / F.col("dz")).cast("int"), (F.col("i") % F.col("dz")).cast("int")
    y = F.col("dy") - 1 - y if flip_y else y
    side = F.greatest("dx", "dy", "dz")
    shift = [F.floor((side - F.col(d)) / 2).cast("int") if pad == "center" else F.lit(0) for d in ("dx", "dy", "dz")]
    return cells.select("name", *[(c + s).alias(k) for c, s, k in zip((x, y, z), shift, "xyz")], "value")


def encode_rle(voxels: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """(grid_id, content): each grid as a run-length file."""

    def make(rows: pd.DataFrame) -> bytes:
        rows = rows.sort_values("start")
        out = np.zeros(len(rows), np.dtype([("value", "<u2"), ("length", "<u4")]))
        out["value"], out["length"] = rows["value"], rows["length"]
        return struct.pack(RLE_HEADER, *dims) + out.tobytes()

    return _per_grid(run_lengths(voxels, dims), make, ["start", "value", "length"])


# raw grids and vox


def encode_raw(voxels: DataFrame, dims: tuple[int, int, int], squared: bool = True) -> DataFrame:
    """(grid_id, content): all cells as 16-bit values in linear order, in the centred cube with squared."""
    if squared:
        voxels, dims = to_cube(voxels, dims), (max(dims),) * 3
    dense = densify(voxels, dims).withColumn("i", cell_index(AT, dims))

    def make(rows: pd.DataFrame) -> bytes:
        return rows.sort_values("i")["value"].to_numpy().astype("<u2").tobytes()

    return _per_grid(dense, make, ["i", "value"])


def read_raw(spark: SparkSession, path: str, dims: tuple[int, int, int]) -> DataFrame:
    """Cells of the raw files at a path; see raw_cells()."""
    return raw_cells(_files(spark, path), dims)


def raw_cells(files: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """(name, x, y, z, value) of the non-empty cells of raw 16-bit grids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                grid = np.frombuffer(content, "<u2").reshape(dims)
                x, y, z = np.nonzero(grid)
                yield pd.DataFrame({"name": name, "x": x.astype(np.int32), "y": y.astype(np.int32), "z": z.astype(np.int32), "value": grid[x, y, z].astype(np.int32)})

    return files.mapInPandas(run, "name string, x int, y int, z int, value int")


def encode_vox(voxels: DataFrame, dims: tuple[int, int, int], squared: bool = False) -> DataFrame:
    """(grid_id, content): each grid as a vox file of one model; at most 256 cells an axis."""
    if squared:
        voxels, dims = to_cube(voxels, dims), (max(dims),) * 3

    def chunk(kind: bytes, body: bytes, children: bytes = b"") -> bytes:
        return kind + struct.pack("<II", len(body), len(children)) + body + children

    def make(rows: pd.DataFrame) -> bytes:
        xyzi = rows.sort_values(["x", "y", "z"])[["x", "y", "z", "color"]].to_numpy().astype(np.uint8)
        model = chunk(b"SIZE", struct.pack("<III", dims[0], dims[2], dims[1])) + chunk(b"XYZI", struct.pack("<I", len(xyzi)) + xyzi.tobytes())
        return b"VOX " + struct.pack("<I", 150) + chunk(b"MAIN", b"", model)

    return _per_grid(vox_records(voxels, squared), make, ["x", "y", "z", "color"])


def vox_cells(files: DataFrame) -> DataFrame:
    """(name, x, y, z, value) of the cells of vox files with one model; axes and colours as they stand in the file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                content = bytes(content)
                at = content.index(b"XYZI") + 12
                n = struct.unpack_from("<I", content, at)[0]
                rows = np.frombuffer(content, np.uint8, 4 * n, at + 4).reshape(n, 4).astype(np.int32)
                yield pd.DataFrame({"name": name, **{k: rows[:, i] for i, k in enumerate(("x", "y", "z", "value"))}})

    return files.mapInPandas(run, "name string, x int, y int, z int, value int")


# meshes


def decode_binm(content: bytes, count_bytes: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Positions and faces of a mesh: a count, 16 floats a vertex, a count, four integers a face. Counts take 4 or 8 bytes."""
    n = struct.unpack_from("<I", content)[0]
    at = count_bytes
    vertices = np.frombuffer(content, "<f4", n * 16, at).reshape(n, 16)[:, :3]
    at += n * 64
    m = struct.unpack_from("<I", content, at)[0]
    faces = np.frombuffer(content, "<u4", m * 4, at + count_bytes).reshape(m, 4)[:, :3]
    return vertices, faces


def read_binm(spark: SparkSession, path: str, count_bytes: int = 8, flip_y: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of the binary meshes at a path; see binm_mesh()."""
    return binm_mesh(_files(spark, path), count_bytes, flip_y)


def binm_mesh(files: DataFrame, count_bytes: int = 8, flip_y: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vertices (name, vertex_id, x, y, z) and faces (name, face_id, v0, v1, v2) of binary meshes; y is negated."""

    def vertices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                v, _ = decode_binm(bytes(content), count_bytes)
                yield pd.DataFrame({"name": name, "vertex_id": np.arange(len(v)), "x": v[:, 0].astype(float), "y": v[:, 1].astype(float) * (-1 if flip_y else 1), "z": v[:, 2].astype(float)})

    def faces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                _, f = decode_binm(bytes(content), count_bytes)
                yield pd.DataFrame({"name": name, "face_id": np.arange(len(f)), **{f"v{k}": f[:, k].astype(np.int64) for k in range(3)}})

    return files.mapInPandas(vertices, "name string, vertex_id long, x double, y double, z double"), files.mapInPandas(faces, "name string, face_id long, v0 long, v1 long, v2 long")


def encode_binm(vertices: DataFrame, faces: DataFrame, count_bytes: int = 4) -> DataFrame:
    """(mesh_id, content): each mesh in the binary form; ids count from 0. Attributes beyond the position are zero."""

    def run(key: tuple, v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        v, f = v.sort_values("vertex_id"), f.sort_values("face_id")
        rows = np.zeros((len(v), 16), "<f4")
        rows[:, :3] = v[["x", "y", "z"]].to_numpy()
        four = np.zeros((len(f), 4), "<u4")
        four[:, :3] = f[["v0", "v1", "v2"]].to_numpy()
        count = lambda n: struct.pack("<I", n) + b"\0" * (count_bytes - 4)
        return pd.DataFrame({"mesh_id": [key[0]], "content": [count(len(v)) + rows.tobytes() + count(len(f)) + four.tobytes()]})

    v = vertices.select(F.col("mesh_id").alias("mesh_id"), "vertex_id", "x", "y", "z")
    f = faces.select(F.col("mesh_id").alias("mesh_id"), "face_id", "v0", "v1", "v2")
    return v.groupBy("mesh_id").cogroup(f.groupBy("mesh_id")).applyInPandas(run, "mesh_id long, content binary")


# point clouds


PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def decode_ply(content: bytes) -> dict[str, dict[str, np.ndarray | list]]:
    """Elements of a PLY file, text or binary, each as its properties; lists come as lists of arrays."""
    end = content.index(b"end_header")
    body = content.index(b"\n", end) + 1
    form, elements = "ascii", []
    for line in content[:end].decode("ascii").split("\n")[1:]:
        w = line.split()
        if not w or w[0] in ("comment", "obj_info"):
            continue
        if w[0] == "format":
            form = w[1]
        elif w[0] == "element":
            elements.append((w[1], int(w[2]), []))
        elif w[0] == "property":
            elements[-1][2].append((w[-1], w[2:4] if w[1] == "list" else w[1]))
    out: dict = {}
    order = ">" if form == "binary_big_endian" else "<"
    words = iter(content[body:].split()) if form == "ascii" else None
    at = body
    for name, n, properties in elements:
        flat = all(isinstance(t, str) for _, t in properties)
        if words is None and flat:
            kind = np.dtype([(p, order + PLY_TYPES[t]) for p, t in properties])
            rows = np.frombuffer(content, kind, n, at)
            at += n * kind.itemsize
            out[name] = {p: rows[p] for p, _ in properties}
            continue
        columns: dict[str, list] = {p: [] for p, _ in properties}
        for _ in range(n):
            for p, t in properties:
                if words is not None:
                    k = int(next(words)) if not isinstance(t, str) else 1
                    v = [float(next(words)) for _ in range(k)]
                    columns[p].append(np.array(v) if not isinstance(t, str) else v[0])
                elif isinstance(t, str):
                    columns[p].append(np.frombuffer(content, order + PLY_TYPES[t], 1, at)[0])
                    at += np.dtype(PLY_TYPES[t]).itemsize
                else:
                    k = int(np.frombuffer(content, order + PLY_TYPES[t[0]], 1, at)[0])
                    at += np.dtype(PLY_TYPES[t[0]]).itemsize
                    columns[p].append(np.frombuffer(content, order + PLY_TYPES[t[1]], k, at))
                    at += k * np.dtype(PLY_TYPES[t[1]]).itemsize
        out[name] = columns
    return out


def read_ply(spark: SparkSession, path: str, data_set_axes: bool = False) -> DataFrame:
    """Points of the PLY files at a path; see ply_points()."""
    return ply_points(_files(spark, path), data_set_axes)


def ply_points(files: DataFrame, data_set_axes: bool = False) -> DataFrame:
    """(name, point_id, x, y, z) of the vertices of PLY files; with data_set_axes the published (x, z, -y) turn."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                v = decode_ply(bytes(content))["vertex"]
                yield pd.DataFrame({"name": name, "point_id": np.arange(len(v["x"])), **{k: np.asarray(v[k], float) for k in "xyz"}})

    points = files.mapInPandas(run, "name string, point_id long, x double, y double, z double")
    return points.select("name", "point_id", "x", F.col("z").alias("y"), (-F.col("y")).alias("z")) if data_set_axes else points


def encode_ply(points: DataFrame, swap: bool = True) -> DataFrame:
    """(cloud_id, content): each cloud as binary PLY, axes x, z, y with swap."""
    order = ["x", "z", "y"] if swap else ["x", "y", "z"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point_id")
        head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(rows)}\n" + "".join(f"property float {c}\n" for c in "xyz") + "end_header\n"
        return pd.DataFrame({"cloud_id": [key[0]], "content": [head.encode() + rows[order].to_numpy().astype("<f4").tobytes()]})

    return points.groupBy("cloud_id").applyInPandas(run, "cloud_id long, content binary")


def encode_xyz(points: DataFrame) -> DataFrame:
    """(cloud_id, content): each cloud as text, a point a line."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point_id")
        text = "".join(f"{x!r} {y!r} {z!r}\n" for x, y, z in rows[["x", "y", "z"]].to_numpy(float).tolist())
        return pd.DataFrame({"cloud_id": [key[0]], "content": [text.encode()]})

    return points.select("cloud_id", "point_id", "x", "y", "z").groupBy("cloud_id").applyInPandas(run, "cloud_id long, content binary")


def xyz_points(files: DataFrame) -> DataFrame:
    """(name, point_id, x, y, z) of text clouds."""
    lines = files.select("name", F.posexplode(F.split(F.trim(F.col("content").cast("string")), "\n")).alias("at", "line")).where("line <> ''")
    p = F.split(F.trim("line"), r"\s+")
    return lines.select("name", F.col("at").cast("long").alias("point_id"), *[F.get(p, F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")])


#: Bits an axis of a compressed cloud.
CLOUD_BITS = 16


def _interleaved(q: np.ndarray, bits: int) -> np.ndarray:
    code = np.zeros(len(q), np.uint64)
    for b in range(bits):
        for k in range(3):
            code |= ((q[:, k] >> np.uint64(b)) & np.uint64(1)) << np.uint64(3 * b + 2 - k)
    return code


def encode_cloud(points: DataFrame, bits: int = CLOUD_BITS) -> DataFrame:
    """(cloud_id, content): each cloud in octree order: its box, cut `bits` times an axis, and the steps between the places
    of its points along the octree's cells, compressed. Points come back as the centres of their cells."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at = rows[["x", "y", "z"]].to_numpy(float)
        lo, hi = at.min(axis=0), at.max(axis=0)
        step = (hi - lo) / (1 << bits)  # none along an axis that all points share
        code = np.sort(_interleaved(np.clip(np.floor((at - lo) / np.where(step > 0, step, 1.0)), 0, (1 << bits) - 1).astype(np.uint64), bits))
        body = zlib.compress(np.diff(code, prepend=np.uint64(0)).astype("<u8").tobytes(), 9)
        return pd.DataFrame({"cloud_id": [key[0]], "content": [struct.pack("<IQ6d", bits, len(code), *lo, *step) + body]})

    return points.select("cloud_id", "x", "y", "z").groupBy("cloud_id").applyInPandas(run, "cloud_id long, content binary")


def cloud_points(files: DataFrame) -> DataFrame:
    """(name, point_id, x, y, z) of compressed clouds; ids follow the octree order."""
    head = struct.calcsize("<IQ6d")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                content = bytes(content)
                bits, n, *box = struct.unpack_from("<IQ6d", content)
                code = np.cumsum(np.frombuffer(zlib.decompress(content[head:]), "<u8"), dtype=np.uint64)
                q = np.zeros((n, 3), np.uint64)
                for b in range(bits):
                    for k in range(3):
                        q[:, k] |= ((code >> np.uint64(3 * b + 2 - k)) & np.uint64(1)) << np.uint64(b)
                at = np.array(box[:3]) + (q + 0.5) * np.array(box[3:])
                yield pd.DataFrame({"name": name, "point_id": np.arange(n), **{c: at[:, k] for k, c in enumerate("xyz")}})

    return files.mapInPandas(run, "name string, point_id long, x double, y double, z double")


#: Point formats by name: (encoder, extension).
POINT_FORMATS = {"ply": (encode_ply, "ply"), "xyz": (encode_xyz, "xyz"), "octree": (encode_cloud, "oct")}


def encode_points(points: DataFrame, kind: str) -> DataFrame:
    """(cloud_id, content) in a format by name."""
    if kind not in POINT_FORMATS:
        raise ValueError(f"no point format {kind!r}; there are {sorted(POINT_FORMATS)}")
    return POINT_FORMATS[kind][0](points)


def write_xyz(points: DataFrame, path: str) -> None:
    """Points as text, one folder cloud_id=... each."""
    points.select("cloud_id", "x", "y", "z").write.partitionBy("cloud_id").mode("overwrite").option("sep", " ").csv(path)


def zipped(files: DataFrame, key: str, extension: str) -> DataFrame:
    """(name, content): each file as a zip archive of <key>.<extension>."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["name"], batch["content"]):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(zipfile.ZipInfo(f"{name}.{extension}"), bytes(content), zipfile.ZIP_DEFLATED)
                out.append(held.getvalue())
            yield pd.DataFrame({"name": batch["name"], "content": out})

    return files.select(F.col(key).cast("string").alias("name"), "content").mapInPandas(run, "name string, content binary")


def unzipped(archives: DataFrame) -> DataFrame:
    """(name, content) of all files in zip archives (content); names without extension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for n in z.namelist():
                        yield pd.DataFrame({"name": [n.rpartition(".")[0] or n], "content": [z.read(n)]})

    return archives.select("content").mapInPandas(run, "name string, content binary")


def write_contents(files: DataFrame, path: str, key: str, extension: str) -> None:
    """Writes (key, content) rows to <path>/<key>.<extension> from the executors; the folder must be one that all share."""
    import os

    def save(rows) -> None:
        os.makedirs(path, exist_ok=True)
        for r in rows:
            with open(f"{path}/{r[key]}.{extension}", "wb") as out:
                out.write(r["content"])

    files.foreachPartition(save)


#: Grid formats by name: (encoder, extension).
GRID_FORMATS = {"rle": (encode_rle, "rle"), "raw": (encode_raw, "bin"), "vox": (encode_vox, "vox")}


def encode_grids(voxels: DataFrame, dims: tuple[int, int, int], kind: str) -> DataFrame:
    """(grid_id, content) in a format by name; "parquet" is the cell table itself and needs no encoding."""
    if kind not in GRID_FORMATS:
        raise ValueError(f"no grid format {kind!r}; there are {sorted(GRID_FORMATS)}")
    return GRID_FORMATS[kind][0](voxels, dims)


def write_grids(voxels: DataFrame, dims: tuple[int, int, int], path: str, kind: str = "rle", plain_files: bool = False) -> None:
    """Grids below a path: a table of (grid_id, content), or plain files where the folder is shared by all executors."""
    files = encode_grids(voxels, dims, kind)
    if plain_files:
        write_contents(files, path, "grid_id", GRID_FORMATS[kind][1])
    else:
        files.write.mode("overwrite").parquet(path)
