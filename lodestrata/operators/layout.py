"""Clustered Parquet: importance, cells, range partitions, row groups; merging and output paths."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Box, tag
from ..session import ROW_GROUP_ROWS
from .bounds import box_and_count
from .decompose import assign_grid, assign_quadtree, grid_size, quadtree_edge, quadtree_size

CODECS = ("uncompressed", "snappy", "gzip", "lz4_raw", "zstd")


@dataclass(frozen=True)
class Codec:
    name: str = "uncompressed"
    level: int | None = None

    @classmethod
    def parse(cls, text: str) -> Codec:
        """``zstd(3)``, ``snappy`` and so on."""
        name, _, level = text.lower().partition("(")
        if name not in CODECS:
            raise ValueError(f"codec {name!r} is not one of {', '.join(CODECS)}")
        return cls(name, int(level.rstrip(")")) if level else None)


def add_importance(df: DataFrame, seed: int | None = None, kind: str = "float", keys: list[str] | None = None) -> DataFrame:
    """A column ``i`` in [0, 1): random, or a hash of ``keys``, which gives the same value on every run.

    Random values change if a lost task is computed again; write them before
    they are used twice.
    """
    if kind not in ("float", "double"):
        raise TypeError(f"importance can't be {kind}; Spark has no half-precision float")
    if keys:
        value = F.pmod(F.xxhash64(*keys, F.lit(seed or 0)), F.lit(1 << 24).cast("long")) / F.lit(float(1 << 24))
    else:
        value = F.rand(seed)
    return tag(df.withColumn("i", value.cast(kind)))


def write_points(df: DataFrame, path: str, codec: Codec = Codec(), row_group: int = ROW_GROUP_ROWS, mode: str = "overwrite", statistics: str = "page") -> None:
    """Write Parquet with row groups of at most ``row_group`` rows and statistics of chunks and pages, or ``none``.

    Statistics of chunks without those of pages can't be had: Spark's writer
    adds the page index whenever it keeps statistics.
    """
    if statistics not in ("none", "page"):
        raise ValueError(f"statistics can be none or page, not {statistics!r}")
    for f in df.schema:
        if isinstance(f.dataType, T.VariantType):
            raise TypeError(f"column {f.name} has no Parquet point type")
    out = df.write.mode(mode).option("compression", codec.name).option("parquet.block.row.count.limit", str(row_group))
    if codec.level is not None:
        out = out.option("parquet.compression.codec.zstd.level", str(codec.level))
    if statistics == "none":
        out = out.option("parquet.column.statistics.enabled", "false")
    out.parquet(path)


def cluster(df: DataFrame, method: str = "quadtree", target: int = ROW_GROUP_ROWS, seed: int | None = None, partitions: int | None = None) -> DataFrame:
    """Order the cloud by cell: ``quadtree``, or ``grid(n)`` with n importance slices.

    Cells come from arithmetic on the point, one range exchange brings each
    cell's points together and sorts them; Parquet's statistics then skip what
    a query doesn't need. A cell larger than a partition spans several, since
    the range also runs over x and y: no cell is one task's.
    """
    if "i" not in df.columns:
        df = add_importance(df, seed, keys=[c for c in ("x", "y", "z") if c in df.columns])
    box, n = box_and_count(df, ("x", "y"))
    if box is None:
        return df
    if method == "quadtree":
        root, depth = quadtree_size(n, box, target)
        placed, order = assign_quadtree(df, root, depth, quadtree_edge(box)), ["level", "col", "row"]
    elif method.startswith("grid"):
        splits = int(method[5:-1] or 1) if "(" in method else 1
        size = grid_size(n, box.area(), splits, target)
        placed = assign_grid(df, size).withColumn("level", F.least(F.lit(splits - 1), F.floor(F.col("i") * splits)).cast("int"))
        order = ["k_x", "k_y", "level"]
    else:
        raise ValueError(f"unknown method {method!r}: quadtree or grid(n)")
    parts = partitions or max(1, -(-n // (4 * target)))
    return tag(placed.repartitionByRange(parts, *order, "x", "y").sortWithinPartitions(*order, "x", "y"))


def merge(spark: SparkSession, inputs: list[str], output: str, codec: Codec = Codec("zstd", 3), row_group: int = ROW_GROUP_ROWS, statistics: str = "page") -> None:
    """Concatenate Parquet inputs in one folder; the first input's columns hold.

    Each input is appended by itself, with the files' order kept and without an
    exchange: every input's tasks write files of their own, so no file and no
    row group mixes two inputs.
    """
    columns = spark.read.parquet(inputs[0]).columns
    for k, path in enumerate(inputs):
        write_points(spark.read.parquet(path).select(*columns), output, codec, row_group, "append" if k else "overwrite", statistics)


def output_path(inputs: list[str], output: str | None, suffix: str, several: bool = False) -> str:
    """Where the outcome of ``inputs`` goes.

    An output ending in .parquet is used; a folder, or any output of which
    ``several`` are written, gets <stem>.parquet in it; none gives
    <stem>_<suffix>.parquet beside the input.
    """
    stem = os.path.splitext(os.path.basename(inputs[0].rstrip("/")))[0]
    if output is None:
        return os.path.join(os.path.dirname(inputs[0]), f"{stem}_{suffix}.parquet")
    return output if output.endswith(".parquet") and not several else os.path.join(output, f"{stem}.parquet")


def root_box(df: DataFrame, target: int = ROW_GROUP_ROWS) -> tuple[Box, int]:
    """Root and depth that ``cluster`` used for a quadtree layout."""
    box, n = box_and_count(df, ("x", "y"))
    return quadtree_size(n, box, target)
