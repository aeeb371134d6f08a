"""Binary sources: PLY meshes and SENS frame streams. Parsers work on bytes; Spark reads the files, or byte ranges of them. Vertices and NPZ points are in ``formats``."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shared import materialize

# ---- PLY ----

_PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def _equal_lists(body: bytes, at: int, n: int, count_kind: str, kind: str) -> np.ndarray | None:
    """The n lists of a binary element from byte ``at`` as one record array, if all are as long as the first; else None."""
    if not n:
        return None
    size = int(np.frombuffer(body, count_kind, 1, at)[0])
    record = np.dtype([("size", count_kind), ("values", kind, (size,))])
    if at + n * record.itemsize > len(body):
        return None
    rows = np.frombuffer(body, record, n, at)
    return rows if (rows["size"] == size).all() else None


def ply_elements(head: bytes) -> tuple[str, list[tuple[str, int, list]]]:
    """Format and elements (name, count, properties) of a PLY header; a list property has two types."""
    lines = [ln.split() for ln in head.decode("ascii", "replace").splitlines()]
    if not lines or lines[0] != ["ply"] or lines[-1] != ["end_header"]:
        raise ValueError("not a PLY file")
    form, elements = "", []
    for ln in lines:
        if ln[:1] == ["format"]:
            form = ln[1]
        elif ln[:1] == ["element"]:
            elements.append((ln[1], int(ln[2]), []))
        elif ln[:1] == ["property"]:
            elements[-1][2].append((ln[-1], ln[2:4] if ln[1] == "list" else ln[1]))
    return form, elements


def parse_ply(raw: bytes, with_faces: bool = True) -> tuple[dict[str, np.ndarray], list[list[int]]]:
    """Vertex properties by name and faces as vertex numbers, of an ASCII or binary PLY file; other elements are skipped.

    Without faces, nothing behind the vertices is read.
    """
    head, mark, body = raw.partition(b"end_header\n")
    form, elements = ply_elements(head + mark)
    vertices: dict[str, np.ndarray] = {}
    faces: list[list[int]] = []
    tokens, at, order = (iter(body.split()) if form == "ascii" else None), 0, ">" if form.endswith("big_endian") else "<"
    for name, n, props in elements:
        if all(isinstance(k, str) for _, k in props):
            if tokens is not None:
                table = np.array([float(next(tokens)) for _ in range(n * len(props))]).reshape(n, len(props))
                columns = {p: table[:, i].astype(_PLY_TYPES[k]) for i, (p, k) in enumerate(props)}
            else:
                rows = np.frombuffer(body, np.dtype([(p, order + _PLY_TYPES[k]) for p, k in props]), n, at)
                at += rows.nbytes
                columns = {p: rows[p] for p, _ in props}
            if name == "vertex":
                vertices = columns
                if not with_faces:
                    break
            continue
        if tokens is None and len(props) == 1:
            count_kind, kind = (order + _PLY_TYPES[k] for k in props[0][1])
            same = _equal_lists(body, at, n, count_kind, kind)
            if same is not None:
                at += same.nbytes
                if name == "face":
                    faces += same["values"].astype(np.int64).tolist()
                continue
        for _ in range(n):
            for p, k in props:
                count_kind, kind = k if not isinstance(k, str) else (None, k)
                if tokens is not None:
                    size = int(next(tokens)) if count_kind else 1
                    values = [float(next(tokens)) for _ in range(size)]
                else:
                    size = 1
                    if count_kind:
                        size = int(np.frombuffer(body, order + _PLY_TYPES[count_kind], 1, at)[0])
                        at += np.dtype(_PLY_TYPES[count_kind]).itemsize
                    values = np.frombuffer(body, order + _PLY_TYPES[kind], size, at).tolist()
                    at += size * np.dtype(_PLY_TYPES[kind]).itemsize
                if name == "face" and count_kind:
                    faces.append([int(v) for v in values])
    return vertices, faces


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(F.regexp_replace("path", "^file:(//)?(?=/)", "").alias("path"), "content")


def read_ply_faces(spark: SparkSession, path: str, rows: int = 100_000) -> DataFrame:
    """(path, face_idx, vertices)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, raw in zip(b["path"], b["content"], strict=True):
                _, faces = parse_ply(raw)
                for at in range(0, len(faces), rows):
                    part = faces[at : at + rows]
                    yield pd.DataFrame({"path": p, "face_idx": np.arange(at, at + len(part)), "vertices": part})

    return _files(spark, path, "*.ply").mapInPandas(parse, "path string, face_idx int, vertices array<int>")


def triangles(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces as fans of triangles, each with the mean colour of its corners."""
    from ..functions.geometry import fan_triangles

    t = faces.select("path", "face_idx", F.posexplode(fan_triangles("vertices")).alias("part", "corners"))
    each = t.select("path", "face_idx", "part", "corners", F.explode("corners").alias("vertex_idx")).join(vertices, ["path", "vertex_idx"])
    return each.groupBy("path", "face_idx", "part", "corners").agg(*[F.avg(c).alias(c) for c in ("red", "green", "blue")])


# ---- SENS ----

# Fixed values of the format: codec names by code.
COLOR_CODECS = {-1: "unknown", 0: "raw", 1: "png", 2: "jpeg"}
DEPTH_CODECS = {-1: "unknown", 0: "raw_ushort", 1: "zlib_ushort", 2: "occi_ushort"}

#: Of each frame: 16 floats (pose), four 64-bit numbers (two stamps, two sizes), then the two payloads.
_FRAME = struct.Struct("<16f4Q")


def read_sens_header(f) -> dict:
    """Header fields of an open .sens file; the file is left at the first frame."""

    def take(form: str):
        s = struct.Struct("<" + form)
        raw = f.read(s.size)
        if len(raw) != s.size:
            raise EOFError("file ends within the header")
        return s.unpack(raw)

    version, n = take("IQ")
    out = {"version": version, "sensor": f.read(n).decode("utf-8", "ignore")}
    for name in ("intrinsic_color", "extrinsic_color", "intrinsic_depth", "extrinsic_depth"):
        out[name] = list(take("16f"))
    color, depth = take("2i")
    out |= {"color_codec": COLOR_CODECS.get(color, f"unknown_{color}"), "depth_codec": DEPTH_CODECS.get(depth, f"unknown_{depth}")}
    out |= dict(zip(("color_width", "color_height", "depth_width", "depth_height"), take("4I"), strict=True))
    out["depth_shift"], out["num_frames"] = take("fQ")
    return out


def _open(path: str):
    from pyarrow import fs

    if re.match(r"file:/(?!//)", path):
        path = "file://" + path[5:]
    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(at)


def index_sens(f, frames: int) -> Iterator[tuple[int, int]]:
    """(frame number, offset) of each frame; payloads are skipped."""
    for i in range(frames):
        at = f.tell()
        raw = f.read(_FRAME.size)
        if len(raw) != _FRAME.size:
            raise EOFError(f"file ends within frame {i}")
        sizes = _FRAME.unpack(raw)[-2:]
        yield i, at
        f.seek(at + _FRAME.size + sum(sizes))


def frame_head(f) -> tuple:
    """Pose, colour and depth stamps, and sizes of the two payloads of the frame at which f stands."""
    *pose, t_color, t_depth, n_color, n_depth = _FRAME.unpack(f.read(_FRAME.size))
    return pose, t_color, t_depth, n_color, n_depth


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class SensReader(DataSourceReader):
    """Frame heads, a task a file: each task walks its file from head to head. The driver opens nothing."""

    def __init__(self, options: dict):
        self.paths = options["path"].split(",")

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File):
        with _open(partition.path) as f:
            header = read_sens_header(f)
            for i, at in index_sens(f, header["num_frames"]):
                f.seek(at)
                yield (partition.path, i, at, *frame_head(f), header["depth_codec"], header["depth_width"], header["depth_height"])


_HEAD = "path string, frame_idx int, pose array<float>, ts_color long, ts_depth long, color_bytes long, depth_bytes long"


class SensHeads(DataSource):
    """Format "sens": heads of the frames of the files in option path (several by commas), with their offsets; no payload is read."""

    @classmethod
    def name(cls) -> str:
        return "sens"

    def schema(self) -> str:
        return _HEAD.replace("frame_idx int,", "frame_idx int, offset long,") + ", depth_codec string, depth_width int, depth_height int"

    def reader(self, schema) -> SensReader:
        return SensReader(self.options)


def sens_ranges(heads: DataFrame, frames_per_partition: int = 200) -> DataFrame:
    """(path, first, offset, count, depth_codec, depth_width, depth_height): byte ranges of so many frames each."""
    part = F.expr(f"frame_idx div {frames_per_partition}")
    same = [F.first(c).alias(c) for c in ("depth_codec", "depth_width", "depth_height")]
    return heads.groupBy("path", part.alias("_part")).agg(F.min("frame_idx").alias("first"), F.min("offset").alias("offset"), F.count("*").alias("count"), *same).drop("_part")


def read_sens(spark: SparkSession, paths: list[str], index_only: bool = False, frames_per_partition: int = 200) -> DataFrame:
    """Frames of .sens files, in two steps: a task a file writes a table of byte ranges from the frame heads, then a task a range reads its frames.

    index_only reads poses, stamps and sizes and no payload, in the first step alone.
    """
    spark.dataSource.register(SensHeads)
    heads = spark.read.format("sens").option("path", ",".join(paths)).load()
    if index_only:
        return heads.select("path", "frame_idx", "pose", "ts_color", "ts_depth", "color_bytes", "depth_bytes")
    ranges = materialize(sens_ranges(heads, frames_per_partition), "sens-ranges")

    def frames(batches: Iterator[pd.DataFrame], at_once: int = 16) -> Iterator[pd.DataFrame]:
        names = ["path", "frame_idx", "pose", "ts_color", "ts_depth", "color_bytes", "depth_bytes", "color", "depth", "depth_codec", "depth_width", "depth_height"]
        for x in batches:
            for r in x.itertuples(index=False):
                with _open(r.path) as f:
                    f.seek(r.offset)
                    for i in range(0, r.count, at_once):
                        rows = []
                        for k in range(i, min(r.count, i + at_once)):
                            head = frame_head(f)
                            rows.append((r.path, r.first + k, *head, f.read(head[-2]), f.read(head[-1]), r.depth_codec, r.depth_width, r.depth_height))
                        yield pd.DataFrame(rows, columns=names)

    dealt = ranges.repartition(max(1, ranges.count()))
    return dealt.mapInPandas(frames, _HEAD + ", color binary, depth binary, depth_codec string, depth_width int, depth_height int")


def decode_depth(raw: bytes, codec: str, width: int, height: int) -> np.ndarray:
    """Depth image as 16-bit numbers; codecs other than raw and zlib are refused."""
    if codec == "zlib_ushort":
        raw = zlib.decompress(raw)
    elif codec != "raw_ushort":
        raise ValueError(f"depth codec {codec} isn't supported")
    return np.frombuffer(raw, "<u2").reshape(height, width)


def depth_statistics(frames: DataFrame) -> DataFrame:
    """(path, frame_idx, n_valid, min_depth, max_depth) of each frame's depth image; zeros are holes."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, i, raw, codec, w, h in zip(b["path"], b["frame_idx"], b["depth"], b["depth_codec"], b["depth_width"], b["depth_height"], strict=True):
                d = decode_depth(raw, codec, w, h)
                d = d[d > 0]
                rows.append((p, i, len(d), int(d.min()) if len(d) else 0, int(d.max()) if len(d) else 0))
            yield pd.DataFrame(rows, columns=["path", "frame_idx", "n_valid", "min_depth", "max_depth"])

    return frames.select("path", "frame_idx", "depth", "depth_codec", "depth_width", "depth_height").mapInPandas(of, "path string, frame_idx int, n_valid long, min_depth int, max_depth int")


def frame_index(frames: DataFrame) -> DataFrame:
    """The seven-column frame table: path, frame, stamps, camera position."""
    return frames.select("path", "frame_idx", "ts_color", "ts_depth", *[F.get("pose", F.lit(4 * i + 3)).alias(f"cam_{k}") for i, k in enumerate("xyz")])
