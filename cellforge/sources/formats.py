"""Binary formats as Spark data sources: spark.read.format("cellforge_rle"), df.write.format("cellforge_ply") and so on.

A file is a header and records of one size, so a file of any size is read in parts by ranges of records. All formats stand in
one registry, FORMATS; register() makes them known to a session.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .binary import PLY_TYPES

#: Bytes of a file that a task reads, and that a writer puts in one file of a format whose files may be many; bytes in which a header must end.
PART_BYTES, HEAD_BYTES = 32 << 20, 1 << 16
#: Rows of a batch that a reader hands on.
BATCH_ROWS = 1 << 16


@dataclass(frozen=True)
class RecordFormat:
    """`head(first bytes, size, options)` gives where the records begin, how many there are and their dtype; `make_head(n, options)`
    the header of n records, or is None where a format is only read. `columns` are the names and types of a row after path and
    record; `fields` the records' fields they are. `one_file`: the records of a task belong in one file."""

    suffix: str
    columns: tuple[tuple[str, str], ...]
    fields: tuple[str, ...]
    head: Callable[[bytes, int, dict], tuple[int, int, np.dtype]]
    make_head: Callable[[int, dict], bytes] | None = None
    record: np.dtype | None = None
    one_file: bool = False

    def ddl(self) -> str:
        return "path string, record long, " + ", ".join(f"{c} {k}" for c, k in self.columns)


def _whole(size: int, offset: int, dtype: np.dtype) -> tuple[int, int, np.dtype]:
    """All records from `offset` to the end of a file."""
    if size < offset or (size - offset) % dtype.itemsize:
        raise ValueError(f"a file of {size} bytes ends within a record")
    return offset, (size - offset) // dtype.itemsize, dtype


RUN = np.dtype([("value", "<u2"), ("length", "<u4")])
CELL = np.dtype([("value", "<u2")])
POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4")])


def _rle_head(n: int, options: dict) -> bytes:
    dims = [int(x) for x in options.get("dims", "").split(",") if x]
    if len(dims) != 3:
        raise ValueError('a run-length file needs the option dims, such as "32,32,32"')
    return struct.pack("<3I", *dims)


def _ply_head(first: bytes, size: int, options: dict) -> tuple[int, int, np.dtype]:
    """A binary PLY file whose first element is the vertices, with properties of one size each."""
    text, mark, _ = first.partition(b"end_header\n")
    lines = [x.split() for x in text.decode("ascii", "replace").splitlines()]
    if not mark or lines[:1] != [["ply"]] or ["format", "binary_little_endian", "1.0"] not in lines:
        raise ValueError("no header of a little-endian binary PLY file")
    elements = [i for i, x in enumerate(lines) if x[:1] == ["element"]]
    own = lines[elements[0] + 1 : elements[1] if len(elements) > 1 else None]
    if lines[elements[0]][1] != "vertex" or any(x[1] == "list" for x in own if x[:1] == ["property"]):
        raise ValueError("the first element of the PLY file is not a plain vertex")
    dtype = np.dtype([(x[2], "<" + PLY_TYPES[x[1]]) for x in own if x[:1] == ["property"]])
    n, at = int(lines[elements[0]][2]), len(text) + len(mark)
    if size < at + n * dtype.itemsize:
        raise ValueError(f"a PLY file of {size} bytes is too short for {n} vertices")
    return at, n, dtype


def _ply_make(n: int, options: dict) -> bytes:
    return f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nend_header\n".encode()


def _binm(part: str) -> Callable[[bytes, int, dict], tuple[int, int, np.dtype]]:
    """Vertices of 16 floats or faces of four integers, each after a count of count_bytes bytes (8, or the option)."""

    def head(first: bytes, size: int, options: dict) -> tuple[int, int, np.dtype]:
        wide = int(options.get("count_bytes", 8))
        n = struct.unpack_from("<I", first)[0]
        if part == "vertices":
            return wide, n, np.dtype({"names": ["x", "y", "z"], "formats": ["<f4"] * 3, "offsets": [0, 4, 8], "itemsize": 64})
        at = wide + 64 * n + wide
        dtype = np.dtype({"names": ["v0", "v1", "v2"], "formats": ["<u4"] * 3, "offsets": [0, 4, 8], "itemsize": 16})
        return _whole(size, at, dtype)

    return head


#: The formats by name.
FORMATS: dict[str, RecordFormat] = {
    "cellforge_rle": RecordFormat("rle", (("value", "int"), ("length", "long")), ("value", "length"), lambda first, size, o: _whole(size, 12, RUN), _rle_head, RUN, one_file=True),
    "cellforge_raw": RecordFormat("bin", (("value", "int"),), ("value",), lambda first, size, o: _whole(size, 0, CELL), lambda n, o: b"", CELL, one_file=True),
    "cellforge_ply": RecordFormat("ply", (("x", "double"), ("y", "double"), ("z", "double")), ("x", "y", "z"), _ply_head, _ply_make, POINT),
    "cellforge_binm_vertices": RecordFormat("binm", (("x", "double"), ("y", "double"), ("z", "double")), ("x", "y", "z"), _binm("vertices")),
    "cellforge_binm_faces": RecordFormat("binm", (("v0", "long"), ("v1", "long"), ("v2", "long")), ("v0", "v1", "v2"), _binm("faces")),
}
ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or of a path that all machines share."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


@dataclass
class FilePart(InputPartition):
    path: str
    size: int
    part: int


class RecordReader(DataSourceReader):
    """Reads files in parts of partbytes bytes; a part is found from its number once the header is read, by the task that has it."""

    def __init__(self, kind: RecordFormat, options: dict):
        self.kind, self.options = kind, options
        self.bytes = int(options.get("partbytes", PART_BYTES))

    def partitions(self) -> list[FilePart]:
        fs, path = _file_system(self.options["path"])
        found = fs.get_file_info(path)
        if found.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(f"there is no {path}")
        if found.type != pyarrow.fs.FileType.File:
            below = fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
            hidden = lambda f: any(p[:1] in "_." for p in f.path.removeprefix(path).split("/") if p)
            files = sorted((f for f in below if f.type == pyarrow.fs.FileType.File and f.path.endswith("." + self.kind.suffix) and not hidden(f)), key=lambda f: f.path)
        else:
            files = [found]
        return [FilePart(f.path, f.size, k) for f in files for k in range(max(1, -(-f.size // self.bytes)))]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(self.options["path"])
        with fs.open_input_file(partition.path) as f:
            at, n, dtype = self.kind.head(f.read_at(min(HEAD_BYTES, partition.size), 0), partition.size, self.options)
            each = -(-self.bytes // dtype.itemsize)  # rounded up, so that the parts of the size hold all records
            for lo in range(partition.part * each, min(n, (partition.part + 1) * each), BATCH_ROWS):
                rows = min(BATCH_ROWS, min(n, (partition.part + 1) * each) - lo)
                got = np.frombuffer(f.read_at(rows * dtype.itemsize, at + lo * dtype.itemsize), dtype)
                columns = [pa.array([partition.path]).take(pa.array(np.zeros(rows, np.int64))), pa.array(np.arange(lo, lo + rows))]
                columns += [pa.array(np.ascontiguousarray(got[c])).cast(ARROW[k]) for c, (_, k) in zip(self.kind.fields, self.kind.columns)]
                yield pa.RecordBatch.from_arrays(columns, ["path", "record", *(c for c, _ in self.kind.columns)])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class RecordWriter(DataSourceArrowWriter):
    """Each task writes its rows, in their order, to files of its own below a hidden folder; the commit moves them into place,
    an abort deletes the folder, so a write that fails leaves no file. With overwrite the files before go with the commit."""

    def __init__(self, kind: RecordFormat, options: dict, overwrite: bool):
        self.kind, self.options, self.overwrite = kind, options, overwrite
        self.job = uuid.uuid4().hex
        kind.make_head(0, options)  # options that are missing show here

    def _folders(self) -> tuple[pyarrow.fs.FileSystem, str, str]:
        fs, path = _file_system(self.options["path"])
        return fs, path, posixpath.join(path, f"_writing-{self.job}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, _, folder = self._folders()
        task, files = TaskContext.get(), []
        fs.create_dir(folder)

        def put(parts: list[np.ndarray]) -> None:
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(files)}.{self.kind.suffix}"
            with fs.open_output_stream(posixpath.join(folder, name)) as f:
                f.write(self.kind.make_head(sum(map(len, parts)), self.options))
                for p in parts:
                    f.write(p.tobytes())
            files.append(name)

        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.empty(batch.num_rows, self.kind.record)
            for c, (name, _) in zip(self.kind.fields, self.kind.columns):
                column = batch.column(batch.schema.get_field_index(name))
                if column.null_count:
                    raise ValueError(f"column {name} has nulls, which the format cannot hold")
                values = column.to_numpy(zero_copy_only=False)
                low, high = (0, np.iinfo(rows.dtype[c]).max) if rows.dtype[c].kind == "u" else (-np.inf, np.inf)
                if len(values) and not (low <= values.min() and values.max() <= high):
                    raise ValueError(f"column {name} has values beyond {rows.dtype[c]}")
                rows[c] = values
            held.append(rows)
            if not self.kind.one_file and sum(p.nbytes for p in held) >= int(self.options.get("partbytes", PART_BYTES)):
                put(held)
                held = []
        if sum(map(len, held)):
            put(held)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path, folder = self._folders()
        before = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True)) if f.path.endswith("." + self.kind.suffix)] if self.overwrite else []
        for m in messages:
            for name in m.files if m else []:
                fs.move(posixpath.join(folder, name), posixpath.join(path, f"{self.job[:8]}-{name}"))
        for old in before:
            fs.delete_file(old)
        self._drop(fs, folder)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _, folder = self._folders()
        self._drop(fs, folder)

    @staticmethod
    def _drop(fs: pyarrow.fs.FileSystem, folder: str) -> None:
        if fs.get_file_info(folder).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(folder)


class RecordSource(DataSource):
    """One of FORMATS; subclasses say which."""

    format_name = ""

    @classmethod
    def name(cls) -> str:
        return cls.format_name

    def _options(self) -> dict:
        out = {k.lower(): v for k, v in self.options.items()}
        if "path" not in out:
            raise ValueError(f"{self.format_name} needs a path")
        return out

    def schema(self) -> str:
        return FORMATS[self.format_name].ddl()

    def reader(self, schema) -> RecordReader:
        return RecordReader(FORMATS[self.format_name], self._options())

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        kind = FORMATS[self.format_name]
        if kind.make_head is None:
            raise ValueError(f"{self.format_name} is only read")
        lacking = [c for c, _ in kind.columns if c not in schema.names]
        if lacking:
            raise ValueError(f"{self.format_name} needs the columns {lacking}")
        return RecordWriter(kind, self._options(), overwrite)


def register(spark: SparkSession) -> None:
    """Makes all of FORMATS known to the session."""
    for name in FORMATS:
        spark.dataSource.register(type(f"Source_{name}", (RecordSource,), {"format_name": name}))
