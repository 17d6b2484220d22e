"""LAS files, point formats 0 to 10, uncompressed: files and chunks are skipped by their bounds."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..model import DIMENSION, LOCATION, OFFSET, SCALE
from ..session import ROW_GROUP_ROWS
from .files import open_path, scratch
from .ply import expand_paths

# Fixed values of the format: fields after the common ones, by point format.
GPS, RGB, NIR = {1, 3, 4, 5, 6, 7, 8, 9, 10}, {2, 3, 5, 7, 8, 10}, {8, 10}


class LasHeader:
    def __init__(self, path: str):
        if path.lower().endswith(".laz"):
            raise ValueError(f"{path}: LAZ needs a decompressor, which isn't here; convert it to LAS")
        fs, at = open_path(path)
        with fs.open_input_file(at) as f:
            raw = f.read(375)
        if raw[:4] != b"LASF":
            raise ValueError(f"{path}: not a LAS file")
        self.path = path
        self.version = raw[24], raw[25]
        (self.data_at,) = struct.unpack_from("<I", raw, 96)
        self.format, self.record = raw[104], struct.unpack_from("<H", raw, 105)[0]
        if self.format & 0x80:
            raise ValueError(f"{path}: its points are compressed")
        (self.count,) = struct.unpack_from("<I", raw, 107)
        if self.version >= (1, 4):
            self.count = struct.unpack_from("<Q", raw, 247)[0] or self.count
        self.scale, self.offset = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
        b = struct.unpack_from("<6d", raw, 179)
        self.upper, self.lower = b[0::2], b[1::2]

    def dtype(self) -> np.dtype:
        old = self.format < 6
        fields = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1")]
        fields += [("class", "u1"), ("angle", "i1"), ("user_data", "u1"), ("source", "<u2")] if old else [("flags", "u1"), ("class", "u1"), ("user_data", "u1"), ("angle", "<i2"), ("source", "<u2")]
        if self.format in GPS:
            fields.append(("gps_time", "<f8"))
        if self.format in RGB:
            fields += [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
        if self.format in NIR:
            fields.append(("nir", "<u2"))
        plain = np.dtype(fields)
        return np.dtype({"names": list(plain.names), "formats": [plain[n] for n in plain.names], "offsets": [plain.fields[n][1] for n in plain.names], "itemsize": max(self.record, plain.itemsize)})

    def schema(self, raw: bool) -> T.StructType:
        xyz = T.IntegerType() if raw else T.DoubleType()
        fields = [T.StructField(d, xyz, True, {DIMENSION: str(k), LOCATION: d}) for k, d in enumerate("xyz", 1)]
        if raw:
            fields += [T.StructField(f"{d}_{n}", T.DoubleType(), True, {key: d}) for n, key in (("scale", SCALE), ("offset", OFFSET)) for d in "xyz"]
        fields.append(T.StructField("intensity", T.IntegerType()))
        fields += [T.StructField(n, T.ShortType()) for n in ("return_number", "number_of_returns")]
        fields += [T.StructField(n, T.BooleanType()) for n in ("is_synthetic", "is_key_point", "is_withheld", "is_overlap")]
        fields += [T.StructField(n, T.ShortType()) for n in ("scanner_channel", "scan_direction")]
        fields += [T.StructField("is_edge_of_flight_line", T.BooleanType()), T.StructField("classification", T.ShortType()), T.StructField("user_data", T.ShortType()), T.StructField("scan_angle", T.FloatType()), T.StructField("point_source_id", T.IntegerType())]
        if self.format in GPS:
            fields.append(T.StructField("gps_time", T.DoubleType()))
        if self.format in RGB:
            fields += [T.StructField(n, T.IntegerType()) for n in ("red", "green", "blue")]
        if self.format in NIR:
            fields.append(T.StructField("nir", T.IntegerType()))
        return T.StructType(fields)

    def columns(self, data: np.ndarray, raw: bool) -> dict[str, np.ndarray]:
        """Typed columns of decoded records."""
        out: dict[str, np.ndarray] = {}
        for k, d in enumerate("xyz"):
            grid = data[d.upper()]
            out[d] = grid.astype(np.int32) if raw else grid * self.scale[k] + self.offset[k]
            if raw:
                out[f"{d}_scale"], out[f"{d}_offset"] = np.full(len(data), self.scale[k]), np.full(len(data), self.offset[k])
        r, c = data["returns"], data["class"]
        if self.format < 6:
            out |= {"return_number": r & 7, "number_of_returns": r >> 3 & 7, "scan_direction": r >> 6 & 1, "is_edge_of_flight_line": r >> 7 & 1}
            out |= {"classification": np.where((c & 31) == 12, 0, c & 31), "is_synthetic": c >> 5 & 1, "is_key_point": c >> 6 & 1, "is_withheld": c >> 7 & 1, "is_overlap": (c & 31) == 12, "scanner_channel": np.zeros(len(data), dtype=np.int16)}
            out["scan_angle"] = data["angle"].astype(np.float32)
        else:
            f = data["flags"]
            out |= {"return_number": r & 15, "number_of_returns": r >> 4, "is_synthetic": f & 1, "is_key_point": f >> 1 & 1, "is_withheld": f >> 2 & 1, "is_overlap": f >> 3 & 1}
            out |= {"scanner_channel": f >> 4 & 3, "scan_direction": f >> 6 & 1, "is_edge_of_flight_line": f >> 7 & 1, "classification": c}
            out["scan_angle"] = (data["angle"] * 0.006).astype(np.float32)
        out |= {"intensity": data["intensity"], "user_data": data["user_data"], "point_source_id": data["source"]}
        return out | {n: data[n] for n in ("gps_time", "red", "green", "blue", "nir") if n in data.dtype.names}


class Chunk(InputPartition):
    def __init__(self, path: str, first: int, count: int, bounds):
        self.path, self.first, self.count, self.bounds = path, first, count, bounds


def _read(h: LasHeader, first: int, count: int) -> np.ndarray:
    dtype = h.dtype()
    fs, at = open_path(h.path)
    with fs.open_input_file(at) as f:
        return np.frombuffer(f.read_at(count * dtype.itemsize, h.data_at + first * dtype.itemsize), dtype=dtype, count=count)


class LasReader(DataSourceReader):
    """One partition a chunk. ``ranges`` are the bounds that filters asked for; Spark still filters the rows."""

    def __init__(self, headers, schema, raw: bool, stats: bool, catalog: str | None, rows: int):
        self.headers, self.schema, self.raw, self.stats, self.catalog, self.rows = headers, schema, raw, stats, catalog, rows
        self.ranges: list[tuple[int, float, float]] = []

    def meets(self, lower, upper) -> bool:
        return all(upper[k] >= low and lower[k] <= high for k, low, high in self.ranges)

    def known(self) -> dict:
        """Bounds by file, first point and count, of a catalog written before: no point is read here."""
        if not self.catalog or self.raw or not self.ranges:
            return {}
        import pyarrow.dataset as ds

        fs, at = open_path(self.catalog)
        found = ds.dataset(at, filesystem=fs, format="parquet").to_table(columns=CATALOG).to_pylist()
        return {(r["file"], r["first"], r["n_points"]): ([r[f"{d}min"] for d in "xyz"], [r[f"{d}max"] for d in "xyz"]) for r in found}

    def partitions(self):
        out, known = [], self.known()
        for h in self.headers:
            # raw columns hold grid numbers, which the header's world bounds say nothing about
            if not self.raw and not self.meets(h.lower, h.upper):
                continue
            for first in range(0, h.count, self.rows):
                n = min(self.rows, h.count - first)
                bounds = known.get((h.path, first, n))
                if bounds is None and self.stats and self.ranges and not self.raw:
                    data = _read(h, first, n)
                    xyz = [np.sort(np.array([data[d].min(), data[d].max()]) * h.scale[k] + h.offset[k]) for k, d in enumerate("XYZ")]
                    bounds = [float(v[0]) for v in xyz], [float(v[1]) for v in xyz]
                if bounds is None or self.meets(*bounds):
                    out.append(Chunk(h.path, first, n, bounds))
        return out or [Chunk(self.headers[0].path, 0, 0, None)]

    def read(self, part):
        from pyspark.sql.pandas.types import to_arrow_schema

        h, target = LasHeader(part.path), to_arrow_schema(self.schema)
        step = 1 << 16
        for a in range(part.first, part.first + part.count, step):
            columns = h.columns(_read(h, a, min(step, part.first + part.count - a)), self.raw)
            arrays = [pa.array(np.asarray(columns[f.name]).astype(bool)) if pa.types.is_boolean(f.type) else pa.array(np.ascontiguousarray(columns[f.name])).cast(f.type) for f in target]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([pa.field(f.name, f.type) for f in target]))


class PushingLasReader(LasReader):
    """Needs spark.sql.python.filterPushdown.enabled; comparisons of a coordinate narrow the chunks and go back to Spark."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in ("x", "y", "z"):
                k, v = "xyz".index(f.attribute[0]), float(f.value)
                self.ranges.append((k, v, float("inf")) if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else (k, float("-inf"), v))
            yield f


class LasDataSource(DataSource):
    """``spark.read.format("las")``: options raw, rows (a chunk's), pushdown (needs the session's setting) and catalog (of chunks, to skip by).

    ``stats`` finds the bounds of the chunks of files that a filter meets while
    the read is planned, which suits a few files; ``write_chunk_catalog`` does
    so in tasks, once for all reads.
    """

    @classmethod
    def name(cls):
        return "las"

    def _flag(self, name: str) -> bool:
        return str(self.options.get(name, "false")).lower() == "true"

    def _headers(self):
        if hasattr(self, "_held"):
            return self._held
        headers = [LasHeader(p) for p in expand_paths(self.options["path"])]
        raw = self._flag("raw")
        if any(h.schema(raw) != headers[0].schema(raw) for h in headers):
            raise ValueError("the files' schemas differ")
        self._held = headers
        return headers

    def schema(self):
        return self._headers()[0].schema(self._flag("raw"))

    def reader(self, schema):
        kind = PushingLasReader if self._flag("pushdown") else LasReader
        return kind(self._headers(), schema, self._flag("raw"), self._flag("stats"), self.options.get("catalog"), int(self.options.get("rows", ROW_GROUP_ROWS)))


def _headers_of(batches):
    for batch in batches:
        heads = [LasHeader(p) for p in batch.column(0).to_pylist()]
        columns = [pa.array([h.path for h in heads], pa.string()), pa.array([h.format for h in heads], pa.int32()), pa.array([h.count for h in heads], pa.int64())]
        columns += [pa.array([float(end[k]) for h in heads for end in (getattr(h, e),)], pa.float64()) for k in range(3) for e in ("lower", "upper")]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "point_format", "n_points", "xmin", "xmax", "ymin", "ymax", "zmin", "zmax"])


def las_header_catalog(spark: SparkSession, pattern: str) -> DataFrame:
    """Count and bounds of each file, from the headers alone, read in tasks."""
    paths = expand_paths(pattern)
    files = spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(1, min(len(paths), 1024)))
    return files.mapInArrow(_headers_of, "file string, point_format int, n_points long, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double")


def _chunks_of(batches):
    for batch in batches:
        out: list[list] = [[] for _ in range(9)]
        for path, first, count in zip(*(batch.column(n).to_pylist() for n in ("file", "first", "n_points")), strict=True):
            h = LasHeader(path)
            data = _read(h, first, count)
            row = [path, first, count]
            for k, d in enumerate("XYZ"):
                low, high = sorted(float(v) * h.scale[k] + h.offset[k] for v in (data[d].min(), data[d].max()))
                row += [low, high]
            for column, value in zip(out, row, strict=True):
                column.append(value)
        types = [pa.string(), pa.int64(), pa.int64()] + [pa.float64()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=CATALOG)


CATALOG = ["file", "first", "n_points", "xmin", "xmax", "ymin", "ymax", "zmin", "zmax"]


def las_chunk_catalog(spark: SparkSession, pattern: str, rows: int = ROW_GROUP_ROWS) -> DataFrame:
    """Count and bounds of each chunk of ``rows`` points, decoded in tasks, a chunk at a time."""
    chunks = las_header_catalog(spark, pattern).where("n_points > 0").select("file", "n_points", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_points") - 1, F.lit(rows).cast("long"))).alias("first"))
    chunks = chunks.select("file", "first", F.least(F.lit(rows).cast("long"), F.col("n_points") - F.col("first")).alias("n_points"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return chunks.repartition(n, "file", "first").mapInArrow(_chunks_of, "file string, first long, n_points long, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double")


def write_chunk_catalog(spark: SparkSession, pattern: str, path: str | None = None, rows: int = ROW_GROUP_ROWS) -> str:
    """Write the chunk catalog as Parquet, for the ``catalog`` option of this and later reads; its path."""
    path = path or scratch(spark, "las-catalog")
    las_chunk_catalog(spark, pattern, rows).coalesce(1).write.mode("overwrite").parquet(path)
    return path


def read_points(spark: SparkSession, path: str, raw: bool = False, stats: bool = False) -> DataFrame:
    """A cloud by its path's suffix: LAS, PLY, otherwise Parquet."""
    low = path.lower().rstrip("/")
    if low.endswith((".las", ".laz")):
        LasHeader(expand_paths(path)[0])
        pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
        reader = spark.read.format("las").option("raw", str(raw)).option("pushdown", pushdown)
        if stats and not raw:
            reader = reader.option("catalog", write_chunk_catalog(spark, path))
        return reader.load(path)
    return spark.read.format("ply").load(path) if low.endswith(".ply") else spark.read.parquet(path)
