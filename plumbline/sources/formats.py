"""Data sources of point files: formats "ply" (vertices) and "npz" (points, to read and to write). A file is read by several tasks, each a byte range."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from .binary import _PLY_TYPES, parse_ply, ply_elements


def filesystem(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    path = re.sub(r"^file:/(?!//)", "file:///", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files with the suffix at or below each of the paths (several by commas). Metadata only: no file is opened."""
    from pyarrow import fs

    out = []
    for one in path.split(","):
        store, at = filesystem(one)
        info = store.get_file_info(at)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(at, recursive=True))
        prefix = one[: len(one) - len(at)] if one.endswith(at) else ""
        out += [(prefix + f.path, f.size) for f in found if f.is_file and f.path.endswith(suffix)]
    return sorted(out)


def opened(path: str):
    store, at = filesystem(path)
    return store.open_input_file(at)


@dataclass
class FileRange:
    """Bytes low to high of a file. ``first`` tells the range at the file's beginning, which takes what can't be cut."""

    path: str
    low: int
    high: int

    @property
    def first(self) -> bool:
        return self.low == 0


@dataclass
class Ranges(InputPartition):
    ranges: list[FileRange]


class RangeReader(DataSourceReader):
    """Cuts files into ranges of about bytesPerPartition bytes by their sizes alone, and puts small ranges together (a file counts as a 32nd of a
    partition at least); a subclass reads the records that begin in a range."""

    suffix = ""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.schema, self.step = options["path"], schema, int(options.get("bytesPerPartition", 32 << 20))
        self.options = dict(options)

    def partitions(self) -> list[Ranges]:
        out, cost = [Ranges([])], 0
        for path, size in listed(self.path, self.suffix):
            for low in range(0, max(1, size), self.step):
                one = FileRange(path, low, min(size, low + self.step))
                mine = max(one.high - one.low, self.step // 32)
                if cost and cost + mine > self.step:
                    out.append(Ranges([]))
                    cost = 0
                out[-1].ranges.append(one)
                cost += mine
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for one in partition.ranges:
            yield from self.read_range(one)

    def read_range(self, part: FileRange) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def batches(self, path: str, first: int, columns: dict[str, np.ndarray | str], rows: int = 65_536) -> Iterator[pa.RecordBatch]:
        """Record batches of the schema's columns; those that a file lacks are null, and a text stands for all rows."""
        n, shape = len(next(v for v in columns.values() if not isinstance(v, str))), to_arrow_schema(self.schema)
        for at in range(0, n, rows):
            size, arrays = min(rows, n - at), []
            for f in shape:
                v = columns.get(f.name)
                arrays.append(pa.nulls(size, f.type) if v is None else pa.array([v] * size, f.type) if isinstance(v, str) else pa.array(v[at : at + size]).cast(f.type))
            yield pa.RecordBatch.from_arrays(arrays, schema=shape)


def records(low: int, high: int, start: int, width: int, n: int) -> tuple[int, int]:
    """Of n records of ``width`` bytes from ``start`` on, the first and the end of those that begin at bytes low to high."""
    number = lambda b: min(n, max(0, -(-(b - start) // width)))
    return number(low), number(high)


class PlyReader(RangeReader):
    suffix = ".ply"

    def read_range(self, part: FileRange) -> Iterator[pa.RecordBatch]:
        with opened(part.path) as f:
            head = b""
            while b"end_header\n" not in head and (more := f.read(1 << 14)):
                head += more
            start = head.index(b"end_header\n") + len(b"end_header\n") if b"end_header\n" in head else 0
            form, elements = ply_elements(head[:start])
            name, n, props = elements[0] if elements else ("", 0, [])
            if form == "ascii" or name != "vertex" or any(not isinstance(k, str) for _, k in props):
                if not part.first:
                    return
                f.seek(0)
                columns, _ = parse_ply(f.read(), with_faces=False)
                low = 0
            else:
                wanted = {c.name for c in self.schema}
                kind = np.dtype([(p, (">" if form.endswith("big_endian") else "<") + _PLY_TYPES[k]) for p, k in props])
                # the range that holds the header also has the vertices that begin in it
                low, high = records(part.low, part.high, start, kind.itemsize, n)
                f.seek(start + low * kind.itemsize)
                raw = f.read((high - low) * kind.itemsize)
                if len(raw) != (high - low) * kind.itemsize:
                    raise EOFError(f"{part.path} ends within its vertices")
                rows = np.frombuffer(raw, kind)
                columns = {p: rows[p].astype(kind[p].newbyteorder("=")) for p in kind.names if p in wanted or p == kind.names[0]}
            count = len(next(iter(columns.values()), []))
            if count:
                yield from self.batches(part.path, low, {**columns, "path": part.path, "vertex_idx": np.arange(low, low + count)})


class PlySource(DataSource):
    """Format "ply": vertices of the files at option path, (path, vertex_idx, x, y, z, red, green, blue). Of a binary file each task reads its own
    vertices; an ASCII file is one task. A given schema with fewer columns, or other properties of the vertices, is kept to."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return "path string, vertex_idx int, x float, y float, z float, red int, green int, blue int"

    def reader(self, schema: T.StructType) -> PlyReader:
        return PlyReader(self.options, schema)


def object_name(path: str) -> str:
    return re.sub(r"\.npz$", "", path.rsplit("/", 1)[-1])


class NpzReader(RangeReader):
    suffix = ".npz"

    def read_range(self, part: FileRange) -> Iterator[pa.RecordBatch]:
        with opened(part.path) as f, zipfile.ZipFile(f) as z:
            info = z.getinfo(self.options.get("key", "points") + ".npy")
            if info.compress_type != zipfile.ZIP_STORED:
                if not part.first:
                    return
                v, low = np.lib.format.read_array(io.BytesIO(z.read(info))), 0
            else:
                f.seek(info.header_offset + 26)
                sizes = f.read(4)  # of the member's name and of its further fields, which stand before its bytes
                begin = info.header_offset + 30 + int.from_bytes(sizes[:2], "little") + int.from_bytes(sizes[2:], "little")
                f.seek(begin)
                head = io.BytesIO(f.read(min(info.file_size, 1 << 16)))
                major, _ = np.lib.format.read_magic(head)
                shape, columnwise, kind = (np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0)(head)
                if columnwise or len(shape) != 2:
                    if not part.first:
                        return
                    v, low = np.lib.format.read_array(io.BytesIO(z.read(info))), 0
                else:
                    start, width = begin + head.tell(), kind.itemsize * shape[1]
                    low, high = records(part.low, part.high, start, width, shape[0])
                    f.seek(start + low * width)
                    raw = f.read((high - low) * width)
                    if len(raw) != (high - low) * width:
                        raise EOFError(f"{part.path} ends within its points")
                    v = np.frombuffer(raw, kind).reshape(-1, shape[1])
            if len(v):
                named = {k: np.ascontiguousarray(v[:, i]).astype(np.float64) for i, k in enumerate("xyz")}
                yield from self.batches(part.path, low, {**named, "object_id": object_name(part.path), "pt_idx": np.arange(low, low + len(v))})


class NpzWriter(DataSourceArrowWriter):
    """Writes (object_id, pt_idx, x, y, z) as files <object_id>.npz with an (n, 3) array of 32-bit floats.

    A task writes its objects into a folder of its own under _temporary of the run; commit moves them to their place and abort removes the folder,
    so what a failed task or run has written is never seen. All rows of an object must come to one task, one object after the other (see write_npz_points).
    """

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.key, self.overwrite = options["path"].rstrip("/"), options.get("key", "points"), overwrite
        self.compressed = options.get("compressed", "true").lower() == "true"
        self.staging = f"{self.path}/_temporary/{uuid.uuid4().hex}"
        if missing := {"object_id", "pt_idx", "x", "y", "z"} - set(schema.names):
            raise ValueError(f"columns {sorted(missing)} are missing")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> NpzFiles:
        store, staging = filesystem(self.staging)
        folder, done, now, held = f"{staging}/{uuid.uuid4().hex}", [], None, []
        store.create_dir(folder, recursive=True)

        def flush() -> None:
            if now is None:
                return
            if now in seen:
                raise ValueError(f"the rows of {now} don't stand together")
            seen.add(now)
            v = pa.Table.from_batches(held).sort_by("pt_idx")
            points = np.column_stack([v[k].to_numpy().astype(np.float32) for k in "xyz"])
            with store.open_output_stream(f"{folder}/{now}.npz") as f:
                raw = io.BytesIO()
                (np.savez_compressed if self.compressed else np.savez)(raw, **{self.key: points})
                f.write(raw.getvalue())
            done.append(f"{folder}/{now}.npz")

        seen: set[str] = set()
        for x in iterator:
            ids = x.column(x.schema.get_field_index("object_id")).to_pylist()
            if None in ids:
                raise ValueError("a point has no object_id")
            edges = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]] + [len(ids)]
            for low, high in zip(edges, edges[1:]):
                if ids[low] != now:
                    flush()
                    now, held = ids[low], []
                held.append(x.slice(low, high - low))
        flush()
        return NpzFiles(done)

    def commit(self, messages: list[NpzFiles | None]) -> None:
        from pyarrow import fs

        store, to = filesystem(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [f.rsplit("/", 1)[-1] for f in files]
        if len(set(names)) != len(names):
            self.abort(messages)
            raise ValueError("the rows of an object came to several tasks")
        if self.overwrite:
            fresh = set(names)
            for old in store.get_file_info(fs.FileSelector(to)):
                if old.is_file and old.path.endswith(".npz") and old.base_name not in fresh:
                    store.delete_file(old.path)
        for f, name in zip(files, names, strict=True):
            store.move(f, f"{to}/{name}")
        self.abort(messages)

    def abort(self, messages: list[NpzFiles | None]) -> None:
        from pyarrow import fs

        store, staging = filesystem(self.staging)
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)
        above = staging.rsplit("/", 1)[0]
        if store.get_file_info(above).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(above)):
            store.delete_dir(above)


@dataclass
class NpzFiles(WriterCommitMessage):
    files: list[str]


class NpzSource(DataSource):
    """Format "npz": points of the files <object_id>.npz at option path, (object_id, pt_idx, x, y, z), from the (n, 3) array under option key ("points").

    Of an array that is stored as it is each task reads its own rows; a compressed one is one task. Written by NpzWriter.
    """

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "object_id string, pt_idx int, x float, y float, z float"

    def reader(self, schema: T.StructType) -> NpzReader:
        return NpzReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> NpzWriter:
        return NpzWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the formats known to spark.read and write."""
    for source in (PlySource, NpzSource):
        spark.dataSource.register(source)


def read_ply_vertices(spark: SparkSession, path: str, bytes_per_partition: int = 32 << 20, columns: str | None = None) -> DataFrame:
    """(path, vertex_idx, x, y, z, red, green, blue), colours null where a file has none; or the columns of a given schema."""
    register(spark)
    reader = spark.read.format("ply").option("path", path).option("bytesPerPartition", bytes_per_partition)
    return (reader.schema(columns) if columns else reader).load()


def read_npz_points(spark: SparkSession, path: str, key: str = "points", bytes_per_partition: int = 32 << 20) -> DataFrame:
    """(object_id, pt_idx, x, y, z) of files <object_id>.npz, each with an (n, 3) array."""
    register(spark)
    return spark.read.format("npz").option("path", path).option("key", key).option("bytesPerPartition", bytes_per_partition).load()


def write_npz_points(points: DataFrame, path: str, key: str = "points", compressed: bool = True, mode: str = "append") -> None:
    """A file <object_id>.npz for each object, its points in order of pt_idx. An object's points are held by one task, as its file is one array."""
    register(points.sparkSession)
    placed = points.select("object_id", "pt_idx", "x", "y", "z").repartition("object_id").sortWithinPartitions("object_id", "pt_idx")
    placed.write.format("npz").option("path", path).option("key", key).option("compressed", str(compressed).lower()).mode(mode).save()
