"""Point queries: boxes, circles, samples, neighbours and level-of-detail cells."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import boxes_intersect, distance_2, in_box, in_cell, in_circle
from ..model import Box
from .bounds import read_row_groups


def rect(df: DataFrame, x: float, y: float, edge: float) -> DataFrame:
    return df.filter(in_box(Box(("x", "y"), (x, y), (x + edge, y + edge))))


def box_query(df: DataFrame, box: Box, right_open: bool = True) -> DataFrame:
    return df.filter(in_box(box, right_open))


def cell_query(df: DataFrame, box: Box) -> DataFrame:
    return df.filter(in_cell(box))


def circle(df: DataFrame, x: float, y: float, r: float) -> DataFrame:
    return df.filter(in_circle(x, y, r))


def importance_sample(df: DataFrame, share: float, as_float: bool = True) -> DataFrame:
    """Points of importance below ``share``: the same points every time."""
    p = F.lit(float(share))
    return df.filter(F.col("i") < (p.cast("float") if as_float else p))


def knn_window(df: DataFrame, x: float, y: float, k: int, ties: list[Column | str] = ()) -> DataFrame:
    """The benchmark's approximate query: one fixed window, distances from its offset centre, at most k rows."""
    r = math.sqrt(k / 10)
    near = df.filter(in_box(Box(("x", "y"), (x - r, y - r), (x + r, y + r))))
    return near.withColumn("d", distance_2(x=x + r / 2, y=y + r / 2)).orderBy(F.asc_nulls_last("d"), *ties).limit(k)


def knn(df: DataFrame, x: float, y: float, k: int, ties: list[Column | str] = (), start: float | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """The k nearest points exactly, by a top-k and never a full sort.

    Without more knowledge that is one scan. With a ``catalog`` of chunks
    (n_points and bounds of x and y) a radius that surely holds k points is
    known beforehand, the smallest within which chunks with k points lie
    whole, and the scan skips by it; ``start`` gives a radius to try first.
    """
    near = df.filter("x is not null and y is not null")
    if start is not None and df.filter(in_circle(x, y, start)).limit(k).count() >= k:
        near = df.filter(in_circle(x, y, start))
    elif catalog is not None:
        reach = reduce(add, [F.pow(F.greatest(F.abs(F.col(f"{d}min") - F.lit(v)), F.abs(F.col(f"{d}max") - F.lit(v))), F.lit(2)) for d, v in (("x", float(x)), ("y", float(y)))])
        # the k chunks of smallest reach suffice, as each has a point
        first = catalog.where("n_points > 0").select(F.sqrt(reach).alias("reach"), "n_points").orderBy("reach").limit(k).collect()
        so_far = 0
        for row in first:
            so_far += row.n_points
            if so_far >= k:
                near = df.filter(in_circle(x, y, row.reach * (1 + 1e-9) + 1e-9))
                break
    return near.withColumn("d", distance_2(x=x, y=y)).orderBy(F.asc_nulls_last("d"), *ties).limit(k)


def lod_query(df: DataFrame, catalog: DataFrame, box: Box) -> DataFrame:
    """Points of a level-of-detail cell through the row-group catalog: only groups whose bounds meet the cell are read."""
    return cell_query(read_row_groups(prune(catalog, box), df), box)


def prune(catalog: DataFrame, box: Box) -> DataFrame:
    """Chunks whose closed bounds meet the box; unbounded ones always do."""
    from ..functions.expressions import box_intersects

    return catalog.filter(box_intersects(box))


def cell_hits(cells: DataFrame, catalog: DataFrame, dims=("x", "y", "i"), broadcast_rows: int = 20_000, most_tests: int = 50_000_000) -> DataFrame:
    """How many chunks meet each cell, 0 included.

    A nested loop with the cells broadcast tests every pair. It is taken while
    the cells are at most ``broadcast_rows`` and the pairs ``most_tests``;
    beyond either both sides go by a grid of x and y, about as fine as the
    cells are many, and meet by equality first.
    """
    keys = cells.columns
    many = cells.count()
    if many <= broadcast_rows and many * catalog.count() <= most_tests:
        hit = catalog.alias("c").join(F.broadcast(cells.alias("q")), boxes_intersect("q", "c", dims)).groupBy(*[F.col(f"q.{k}") for k in keys]).agg(F.count("*").alias("hits"))
    else:
        whole = cells.agg(*[f(f"{d}{e}").alias(f"{d}{e}") for d in ("x", "y") for f, e in ((F.min, "min"), (F.max, "max"))]).first()
        n = max(4, min(1024, math.isqrt(many)))
        steps = {d: max((whole[f"{d}max"] - whole[f"{d}min"]) / n, 1e-12) for d in ("x", "y")}

        def binned(df):
            at = lambda d, e: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(f"{d}{e}") - F.lit(whole[f"{d}min"])) / F.lit(steps[d])).cast("int")))
            df = df.withColumns({f"low_{d}": at(d, "min") for d in ("x", "y")})
            for d in ("x", "y"):
                df = df.withColumn(f"bin_{d}", F.explode(F.sequence(F.col(f"low_{d}"), at(d, "max"))))
            return df

        # a pair meets in every bin that both cover and counts in the first: where the later of the two begins
        first = [F.greatest(F.col(f"q.low_{d}"), F.col(f"c.low_{d}")) == F.col(f"q.bin_{d}") for d in ("x", "y")]
        on = [F.col("q.bin_x") == F.col("c.bin_x"), F.col("q.bin_y") == F.col("c.bin_y"), *first, boxes_intersect("q", "c", dims)]
        hit = binned(catalog).alias("c").join(binned(cells).alias("q"), on).groupBy(*[F.col(f"q.{k}") for k in keys]).agg(F.count("*").alias("hits"))
    return cells.join(hit, keys, "left").fillna(0, ["hits"])


def level_stats(hits: DataFrame) -> DataFrame:
    return hits.groupBy("level").agg(F.avg("hits").alias("mean"), F.stddev_pop("hits").alias("std"))


def probes(cells: DataFrame, per_level: int = 16) -> DataFrame:
    """Every so-many-th cell of each level, by its number over all levels; low levels are repeated up to ``per_level``."""
    n = F.pow(F.lit(4.0), F.col("level")).cast("long")
    before = ((n - 1) / 3).cast("long")
    number = before + F.col("col") * F.pow(F.lit(2.0), F.col("level")).cast("long") + F.col("row")
    picked = cells.withColumn("number", number).where(F.col("number") % F.greatest(F.lit(1).cast("long"), F.floor(n / per_level)) == 0)
    return picked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.lit(per_level) / n).cast("int")))))
