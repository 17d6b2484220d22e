"""Grids, splits and quadtrees as small tables of boxes, and the cell of a point as arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import grid_cell, level_bands, quadtree_index, quadtree_level
from ..model import Box
from ..session import ROW_GROUP_ROWS


def _cross(spark: SparkSession, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    df = spark.range(1).drop("id")
    for name, (a, b) in ranges.items():
        df = df.withColumn(name, F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long"))))
    return df


def grid_coverage(spark: SparkSession, box: Box, delta: float | None) -> DataFrame:
    """The origin-anchored cells that touch the box: k_<dim>, <dim>min, <dim>max. Without a delta, the box itself."""
    if delta is None:
        return spark.range(1).select(*[c for d in box.dims for c in (F.lit(0).cast("long").alias(f"k_{d}"), F.lit(float(box.range(d)[0])).alias(f"{d}min"), F.lit(float(box.range(d)[1])).alias(f"{d}max"))])
    df = _cross(spark, {f"k_{d}": (math.floor(box.range(d)[0] / delta), math.floor(box.range(d)[1] / delta)) for d in box.dims})
    return df.select(*[c for d in box.dims for c in (F.col(f"k_{d}"), (F.col(f"k_{d}") * F.lit(float(delta))).alias(f"{d}min"), ((F.col(f"k_{d}") + 1) * F.lit(float(delta))).alias(f"{d}max"))])


def split_box(spark: SparkSession, box: Box, splits) -> DataFrame:
    """Equal slices from the lower corner; the last ends at the upper corner exactly."""
    df = _cross(spark, {f"k_{d}": (0, n - 1) for d, n in zip(box.dims, splits, strict=True)})
    cols = []
    for d, n in zip(box.dims, splits, strict=True):
        a, b = (float(v) for v in box.range(d))
        width, k = (b - a) / n, F.col(f"k_{d}")
        cols += [k, (F.lit(a) + k * F.lit(width)).alias(f"{d}min"), F.when(k == n - 1, F.lit(b)).otherwise(F.lit(a) + (k + 1) * F.lit(width)).alias(f"{d}max")]
    return df.select(*cols)


def quadtree_cells(spark: SparkSession, box: Box, depth: int) -> DataFrame:
    """All cells of all levels: level, col, row, their box and importance band."""
    bands = [0.0, *level_bands(depth)]
    (x0, x1), (y0, y1) = box.range("x"), box.range("y")
    n = F.pow(F.lit(2.0), F.col("level"))
    df = spark.range(depth + 1).select(F.col("id").cast("int").alias("level"))
    df = df.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))).withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))
    table = F.array(*[F.lit(b) for b in bands])
    w, h = F.lit(float(x1 - x0)) / n, F.lit(float(y1 - y0)) / n
    edge = lambda low, k, step: F.lit(float(low)) + k * step
    return df.select(
        "level", "col", "row",
        edge(x0, F.col("col"), w).alias("xmin"), edge(x0, F.col("col") + 1, w).alias("xmax"),
        edge(y0, F.col("row"), h).alias("ymin"), edge(y0, F.col("row") + 1, h).alias("ymax"),
        F.element_at(table, F.col("level") + 1).alias("imin"), F.element_at(table, F.col("level") + 2).alias("imax"),
    )


def assign_grid(df: DataFrame, delta: float, dims=("x", "y")) -> DataFrame:
    return df.withColumns({f"k_{d}": grid_cell(d, delta) for d in dims})


def assign_quadtree(df: DataFrame, box: Box, depth: int, edge: float | None = None) -> DataFrame:
    """Level, col and row of each point: arithmetic, no join with the cells.

    ``edge`` is the side of a square box. Without it, it is taken from the
    corners, whose rounding can move points that lie on a cell's border.
    """
    (x0, x1), (y0, y1) = box.range("x"), box.range("y")
    df = df.withColumn("level", quadtree_level(depth))
    return df.withColumns({"col": quadtree_index("x", x0, edge or x1 - x0, F.col("level")), "row": quadtree_index("y", y0, edge or y1 - y0, F.col("level"))})


def grid_size(n_points: int, area: float, splits: int = 1, target: int = ROW_GROUP_ROWS) -> float:
    """Cell edge for about ``target`` points a cell and importance slice; small clouds get one cell's worth."""
    return max(1.0, float(round(math.sqrt(area / max(1, (n_points // target) // splits)))))


def quadtree_edge(box: Box) -> float:
    """Side of the square root box of a cloud within ``box``."""
    (x0, x1), (y0, y1) = box.range("x"), box.range("y")
    return max(x1 - x0, y1 - y0) + 0.1


def quadtree_size(n_points: int, box: Box, target: int = ROW_GROUP_ROWS) -> tuple[Box, int]:
    """Centred square root box and depth for about ``target`` points a cell."""
    (x0, x1), (y0, y1) = box.range("x"), box.range("y")
    size = quadtree_edge(box)
    area = max((x1 - x0) * (y1 - y0), 1e-9)
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    full = n_points * size * size / area
    depth = max(0, round(math.log(max(full / target, 1e-9), 4)))
    return Box(("x", "y"), (cx - size / 2, cy - size / 2), (cx + size / 2, cy + size / 2)), depth
