"""PLY files: ascii and both binary encodings, the vertex element, scalar properties."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import DIMENSION, LOCATION
from ..session import ROW_GROUP_ROWS
from .files import glob_paths, open_path

# Fixed values of the format: scalar names, numpy codes and Spark types.
SCALARS = {
    "char": ("i1", T.ByteType()), "int8": ("i1", T.ByteType()), "uchar": ("u1", T.ShortType()), "uint8": ("u1", T.ShortType()),
    "short": ("i2", T.ShortType()), "int16": ("i2", T.ShortType()), "ushort": ("u2", T.IntegerType()), "uint16": ("u2", T.IntegerType()),
    "int": ("i4", T.IntegerType()), "int32": ("i4", T.IntegerType()), "uint": ("u4", T.LongType()), "uint32": ("u4", T.LongType()),
    "float": ("f4", T.FloatType()), "float32": ("f4", T.FloatType()), "double": ("f8", T.DoubleType()), "float64": ("f8", T.DoubleType()),
}
NAMES = {"byte": "char", "tinyint": "char", "smallint": "short", "int": "int", "float": "float", "double": "double"}


def expand_paths(pattern: str) -> list[str]:
    """Paths of a comma-separated list, which may hold wildcards and folders, local or remote."""
    return [path for part in pattern.split(",") for path in glob_paths(part.strip())]


class Header:
    """What a PLY header says: the encoding and the elements before and up to the vertices."""

    def __init__(self, path: str):
        fs, at = open_path(path)
        with fs.open_input_file(at) as f:
            raw = b""
            while b"end_header" not in raw:
                more = f.read(1 << 12)
                if not more:
                    raise ValueError(f"{path}: no PLY header")
                raw += more
        end = raw.index(b"end_header")
        self.start = raw.index(b"\n", end) + 1
        lines = [x.split() for x in raw[:end].decode("ascii", "replace").splitlines()]
        if not lines or lines[0] != ["ply"]:
            raise ValueError(f"{path}: not a PLY file")
        self.encoding, elements = "", []
        for words in lines[1:]:
            if words[:1] == ["format"]:
                self.encoding = words[1]
            elif words[:1] == ["element"]:
                elements.append((words[1], int(words[2]), []))
            elif words[:1] == ["property"]:
                elements[-1][2].append((words[-1], words[1]))
        names = [e[0] for e in elements]
        if "vertex" not in names:
            raise ValueError(f"{path}: no vertex element")
        at = names.index("vertex")
        _, self.count, self.properties = elements[at]
        for _, _, properties in elements[: at + 1]:
            if any(kind == "list" for _, kind in properties):
                raise ValueError(f"{path}: list properties aren't supported")
        self.skip_lines = sum(n for _, n, _ in elements[:at])
        self.skip_bytes = sum(n * self.dtype(p).itemsize for _, n, p in elements[:at])

    def dtype(self, properties=None) -> np.dtype:
        order = ">" if self.encoding == "binary_big_endian" else "<"
        return np.dtype([(name, order + SCALARS[kind][0]) for name, kind in (self.properties if properties is None else properties)])

    def schema(self) -> T.StructType:
        axes = [n for n, _ in self.properties if n in ("x", "y", "z")]
        return T.StructType([T.StructField(n, SCALARS[k][1], True, {DIMENSION: str(axes.index(n) + 1), LOCATION: n} if n in axes else {}) for n, k in self.properties])


class Slice(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class PlyReader(DataSourceReader):
    def __init__(self, paths: list[str], schema: T.StructType):
        self.paths, self.schema = paths, schema

    def partitions(self):
        out = []
        for path in self.paths:
            h = Header(path)
            step = max(1, h.count) if h.encoding == "ascii" else ROW_GROUP_ROWS
            out += [Slice(path, a, min(step, h.count - a)) for a in range(0, max(1, h.count), step)]
        return out

    def read(self, part):
        from pyspark.sql.pandas.types import to_arrow_schema

        h, target = Header(part.path), to_arrow_schema(self.schema)
        fs, at = open_path(part.path)
        dtype = h.dtype()
        with fs.open_input_file(at) as f:
            if h.encoding == "ascii":
                f.seek(h.start)
                rest, taken, rows, held = b"", 0, [], h.skip_lines
                while taken < part.count:
                    more = f.read(1 << 20)
                    lines = (rest + more).split(b"\n")
                    rest = lines.pop() if more else b""
                    skipped = min(held, len(lines))
                    held -= skipped
                    lines = [x for x in lines[skipped:] if x.strip()][: part.count - taken]
                    taken += len(lines)
                    rows = [tuple(line.split()[: len(dtype.names)]) for line in lines]
                    if rows:
                        columns = list(zip(*rows, strict=True))
                        yield self.batch({n: np.array([float(v) if dtype[n].kind == "f" else int(v) for v in c], dtype=dtype[n]) for n, c in zip(dtype.names, columns, strict=True)}, target)
                    if not more and taken < part.count:
                        raise ValueError(f"{part.path}: {taken} vertices of {part.count}")
                return
            step = 1 << 16
            for a in range(part.first, part.first + part.count, step):
                n = min(step, part.first + part.count - a)
                raw = f.read_at(n * dtype.itemsize, h.start + h.skip_bytes + a * dtype.itemsize)
                data = np.frombuffer(raw, dtype=dtype, count=n)
                yield self.batch({name: data[name].astype(data[name].dtype.newbyteorder("=")) for name in dtype.names}, target)

    @staticmethod
    def batch(columns, target: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name]).cast(f.type) for f in target], schema=pa.schema([pa.field(f.name, f.type) for f in target]))


class PlyDataSource(DataSource):
    """``spark.read.format("ply").load(path)``: the vertices of one file or more with one schema."""

    @classmethod
    def name(cls):
        return "ply"

    def _paths(self):
        return expand_paths(self.options["path"])

    def schema(self):
        first, *others = [Header(p).schema() for p in self._paths()]
        if any(s != first for s in others):
            raise ValueError("the files' schemas differ")
        return first

    def reader(self, schema):
        return PlyReader(self._paths(), schema)


def write_ply(df: DataFrame, path: str, encoding: str = "binary_little_endian") -> int:
    """Write one PLY file, partition after partition; the header's count comes first."""
    if encoding not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise ValueError(f"unknown encoding {encoding!r}")
    kinds = []
    for f in df.schema:
        name = f.dataType.simpleString()
        if name not in NAMES:
            raise TypeError(f"PLY has no type for column {f.name}: {name}")
        kinds.append((f.name, NAMES[name]))
    count, order = df.count(), ">" if encoding == "binary_big_endian" else "<"
    dtype = np.dtype([(n, order + SCALARS[k][0]) for n, k in kinds])
    head = ["ply", f"format {encoding} 1.0", f"element vertex {count}", *[f"property {k} {n}" for n, k in kinds], "end_header"]
    fs, at = open_path(path)
    written = 0
    with fs.open_output_stream(at) as out:
        out.write(("\n".join(head) + "\n").encode())
        held = []

        def flush():
            if encoding == "ascii":
                out.write("".join(" ".join(repr(float(np.dtype(SCALARS[k][0]).type(v))) if SCALARS[k][0][0] == "f" and SCALARS[k][0] != "f4" else (str(np.float32(v)) if SCALARS[k][0] == "f4" else str(v)) for v, (_, k) in zip(row, kinds, strict=True)) + "\n" for row in held).encode())
            else:
                out.write(np.array(held, dtype=dtype).tobytes())

        for row in df.toLocalIterator(prefetchPartitions=True):
            held.append(tuple(row))
            written += 1
            if len(held) == 1 << 16:
                flush()
                held = []
        if held:
            flush()
    if written != count:
        raise RuntimeError(f"{path}: {written} rows written, {count} counted")
    return written
