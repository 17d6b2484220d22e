"""Registered point queries over a cloud derived from ``lineitem``, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..model import Box, Dims
from ..operators import bounds as bd
from ..operators import decompose as dc
from ..operators import layout, query, transform
from ..session import register
from ..sources.files import scratch
from ..sources.ply import write_ply

ROOT = Box(("x", "y"), (0.0, 0.0), (2700.0, 2700.0))
DEPTH = 3
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
PKEYS = ", ".join(KEYS)

POINTS_SQL = """points AS (
  SELECT l_extendedprice / 40.0::DOUBLE AS x, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS y, l_quantity AS z,
         ((l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 1299709 + CAST(l_linenumber AS BIGINT) * 15485863) % 1000003) / 1000003.0::DOUBLE AS i,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem)"""


def points(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """x from the price, y days from 1995, z the quantity, i a hash of the keys in [0, 1)."""
    h = F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_suppkey") * 1299709 + F.col("l_linenumber").cast("long") * 15485863
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_extendedprice") / F.lit(40.0)).alias("x"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double").alias("y"), F.col("l_quantity").alias("z"),
        ((h % 1000003) / F.lit(1000003.0)).alias("i"), *KEYS, *more,
    )


def chunked(df: DataFrame) -> DataFrame:
    return df.withColumn("chunk", (F.col("l_orderkey") % 16).cast("long"))


CHUNKS_SQL = POINTS_SQL + """,
chunks AS (SELECT l_orderkey % 16 AS chunk, count(*) AS n_points, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(i) AS imin, max(i) AS imax FROM points GROUP BY 1)"""


def _catalog(spark, sf):
    return bd.chunk_catalog(chunked(points(spark, sf)), "chunk", ("x", "y", "i"))


def _levels_sql() -> str:
    bands = ex.level_bands(DEPTH)
    return "CASE " + " ".join(f"WHEN i < {b!r}::DOUBLE THEN {n}" for n, b in enumerate(bands[:-1])) + f" ELSE {DEPTH} END"


def _tree_sql() -> str:
    at = lambda d: f"greatest(0, least(CAST(floor(({d} - 0.0::DOUBLE) / (2700.0::DOUBLE / pow(2.0::DOUBLE, level))) AS BIGINT), CAST(pow(2.0::DOUBLE, level) AS BIGINT) - 1))"
    return POINTS_SQL + f""",
leveled AS (SELECT *, {_levels_sql()} AS level FROM points),
placed AS (SELECT *, {at("x")} AS col, {at("y")} AS row FROM leveled)"""


def _cells_sql() -> str:
    bands = [0.0, *ex.level_bands(DEPTH)]
    lists = "[" + ", ".join(f"{b!r}::DOUBLE" for b in bands) + "]"
    return f"""cells AS (
  SELECT level, col, row, 0.0::DOUBLE + col * w AS xmin, 0.0::DOUBLE + (col + 1) * w AS xmax, 0.0::DOUBLE + row * w AS ymin, 0.0::DOUBLE + (row + 1) * w AS ymax,
         {lists}[level + 1] AS imin, {lists}[level + 2] AS imax
  FROM (SELECT CAST(level AS INT) AS level, 2700.0::DOUBLE / pow(2.0::DOUBLE, level) AS w, CAST(pow(2, level) AS BIGINT) AS n FROM range({DEPTH + 1}) t(level)),
       LATERAL (SELECT unnest(range(n)) AS col), LATERAL (SELECT unnest(range(n)) AS row))"""


def _hits(spark, sf):
    return query.cell_hits(dc.quadtree_cells(spark, ROOT, DEPTH), _catalog(spark, sf))


HITS_SQL = f"WITH {CHUNKS_SQL}, {_cells_sql()}, hits AS (SELECT c.*, count(k.chunk) AS hits FROM cells c LEFT JOIN chunks k ON c.xmin <= k.xmax AND c.xmax >= k.xmin AND c.ymin <= k.ymax AND c.ymax >= k.ymin AND c.imin <= k.imax AND c.imax >= k.imin GROUP BY ALL)"

LOD = Box(("x", "y", "i"), (675.0, 1012.5, ex.level_bands(DEPTH)[1]), (1012.5, 1350.0, ex.level_bands(DEPTH)[2]))
QUERY_BOX = Box(("x", "y"), (900.0, 1100.0), (1400.0, 1700.0))


def _bounds(dims: Dims):
    names = [f"{d}{e}" for d in dims.value for e in ("min", "max")]
    sql = f"WITH {POINTS_SQL} SELECT " + ", ".join(f"{e}({d}) AS {d}{e}" for d in dims.value for e in ("min", "max")) + " FROM points"
    return (lambda s, d: bd.bounds(points(s, d), dims).select(*names)), sql


def _filter(make, where: str):
    cols = ["x", "y", "z", "i", *KEYS]
    return (lambda s, d: make(points(s, d)).select(*cols)), f"WITH {POINTS_SQL} SELECT {', '.join(cols)} FROM points WHERE {where}"


def _circle_sql(x, y, r):
    return f"x >= {x - r}::DOUBLE AND x < {x + r}::DOUBLE AND y >= {y - r}::DOUBLE AND y < {y + r}::DOUBLE AND (x - {x}::DOUBLE) * (x - {x}::DOUBLE) + (y - {y}::DOUBLE) * (y - {y}::DOUBLE) < {r * r}::DOUBLE"


def _knn(s, d):
    return query.knn(points(s, d), 1500.0, 1500.0, 100, KEYS).select("x", "y", "d", *KEYS)


def _knn_window(s, d):
    return query.knn_window(points(s, d), 1500.0, 1500.0, 1000, KEYS).select("x", "y", "d", *KEYS)


_R = math.sqrt(1000 / 10)


def _box_table(s, d):
    return _catalog(s, d)


def _sizing(s, d):
    df = points(s, d)
    root, depth = dc.quadtree_size(df.count(), bd.box_of(df, ("x", "y")), 4096)
    return s.createDataFrame([(depth, *(float(v) for v in (*root.lower, *root.upper)))], "depth int, x0 double, y0 double, x1 double, y1 double").select("depth", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


SIZING_SQL = f"""WITH {POINTS_SQL}, b AS (SELECT count(*) AS n, min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi FROM points),
s AS (SELECT *, greatest(x_hi - x_lo, y_hi - y_lo) + 0.1 AS size FROM b)
SELECT CAST(greatest(0, round(ln(n * size * size / ((x_hi - x_lo) * (y_hi - y_lo)) / 4096) / ln(4))) AS INT) AS depth, round((x_lo + x_hi) / 2 - size / 2, 6) AS x0, round((y_lo + y_hi) / 2 - size / 2, 6) AS y0, round((x_lo + x_hi) / 2 + size / 2, 6) AS x1, round((y_lo + y_hi) / 2 + size / 2, 6) AS y1 FROM s"""


def _normalize(s, d):
    return transform.normalize(points(s, d)).select(*[F.round(c, 9).alias(c) for c in "xyz"], *KEYS)


NORMALIZE_SQL = f"""WITH {POINTS_SQL}, b AS (SELECT min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi, min(z) AS z_lo, max(z) AS z_hi FROM points),
s AS (SELECT *, 2 / greatest(x_hi - x_lo, y_hi - y_lo, z_hi - z_lo) AS k FROM b)
SELECT round((x - (x_lo + x_hi) / 2) * k, 9) AS x, round((y - (y_lo + y_hi) / 2) * k, 9) AS y, round((z - (z_lo + z_hi) / 2) * k, 9) AS z, {PKEYS} FROM points, s"""

_C, _S = math.cos(0.5), math.sin(0.5)


def _rotate(s, d):
    return transform.rotate_z(points(s, d), 0.5).select(*[F.round(c, 6).alias(c) for c in "xyz"], *KEYS)


def _raw(s, d):
    df = points(s, d).withColumns({f"{c}_raw": ex.to_raw(c, 0.001, o) for c, o in (("x", 1000.0), ("y", -500.0))})
    back = {"x_raw": ("x_raw", 1000.0), "y_raw": ("y_raw", -500.0)}
    return df.select("x_raw", "y_raw", *[F.round(ex.from_raw(c, 0.001, o), 6).alias(c[0]) for c, o in back.values()], *KEYS)


def _colour(s, d):
    df = points(s, d).select(((F.col("l_partkey") * 131) % 65536).cast("int").alias("red"), *KEYS)
    return df.select("red", ex.rescale_16_8("red").cast("int").alias("red8"), *KEYS).where("red > 0")


def _hausdorff(s, d):
    """All points of lineitem: open orders' lines against finished ones."""
    df = points(s, d, "l_linestatus")
    return transform.hausdorff(df.where("l_linestatus = 'O'"), df.where("l_linestatus <> 'O'")).select(F.round("hausdorff", 9).alias("hausdorff"))


HAUSDORFF_SQL = f"""WITH {POINTS_SQL}, s AS (SELECT points.*, t.l_linestatus FROM points JOIN lineitem t USING ({PKEYS})),
a AS (SELECT DISTINCT x, y, z FROM s WHERE l_linestatus = 'O'), b AS (SELECT DISTINCT x, y, z FROM s WHERE l_linestatus <> 'O'),
d AS (SELECT a.x, a.y, a.z, b.x AS u, b.y AS v, b.z AS w, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d FROM a, b)
SELECT round(sqrt(max(m)), 9) AS hausdorff FROM (SELECT min(d) AS m FROM d GROUP BY x, y, z UNION ALL SELECT min(d) AS m FROM d GROUP BY u, v, w)"""


def _merge_concat(s, d):
    """Three clouds written apart, then merged and read back."""
    df, folder = points(s, d), scratch(s, "merge")
    for k in range(3):
        layout.write_points(df.where(F.col("l_orderkey") % 3 == k), f"{folder}/{k}")
    layout.merge(s, [f"{folder}/{k}" for k in range(3)], f"{folder}/merged")
    return s.read.parquet(f"{folder}/merged").select("x", "y", "z", "i", *KEYS)


def _clustered(s, d):
    """The quadtree layout, written and read back: the points of each cell and how many row groups hold them is up to the layout, the cells are not."""
    folder = f"{scratch(s, 'cluster')}/cloud"
    layout.write_points(layout.cluster(points(s, d), "quadtree", 4096), folder, row_group=4096)
    return s.read.parquet(folder)


def _cluster_cells(s, d):
    return _clustered(s, d).groupBy("level", "col", "row").agg(F.count("*").alias("n_points"), F.min("i").alias("imin"), F.max("i").alias("imax"))


def _row_groups(s, d):
    """The catalog of the clustered cloud's row groups, from footers, summed up over its files."""
    catalog = bd.row_group_catalog(_clustered(s, d))
    return catalog.agg(F.sum("n_points").alias("n_points"), *[f(f"{c}{e}").alias(f"{c}{e}") for c in ("x", "y", "i") for f, e in ((F.min, "min"), (F.max, "max"))])


def _lod_indexed(s, d):
    cloud = _clustered(s, d)
    return query.lod_query(cloud, bd.row_group_catalog(cloud), LOD).select("x", "y", "z", "i", *KEYS)


def _ply_round_trip(s, d):
    register(s)
    path = f"{scratch(s, 'ply')}/cloud.ply"
    write_ply(points(s, d).select("x", "y", "z", "i", *[F.col(k).cast("int") for k in KEYS]), path)
    return s.read.format("ply").load(path).select("x", "y", "z", "i", *[F.col(k).cast("long") for k in KEYS])


CELLS_SQL = f"""WITH {POINTS_SQL}, b AS (SELECT count(*) AS n, min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi FROM points),
s AS (SELECT *, greatest(x_hi - x_lo, y_hi - y_lo) + 0.1::DOUBLE AS size FROM b),
r AS (SELECT CAST(greatest(0, round(ln(n * size * size / ((x_hi - x_lo) * (y_hi - y_lo)) / 4096) / ln(4))) AS INT) AS depth, (x_lo + x_hi) / 2 - size / 2 AS x0, (y_lo + y_hi) / 2 - size / 2 AS y0, size FROM s),
bands AS (SELECT depth, x0, y0, size, level, CASE WHEN level = depth THEN 1.0::DOUBLE ELSE (pow(4, level + 1) - 1) / (pow(4, depth + 1) - 1) END AS upper FROM r, LATERAL (SELECT unnest(range(depth + 1)) AS level)),
leveled AS (SELECT p.*, (SELECT min(CASE WHEN p.i < b.upper OR b.level = b.depth THEN b.level END) FROM bands b) AS level FROM points p),
placed AS (SELECT leveled.*, greatest(0, least(CAST(floor((x - x0) / (size / pow(2.0::DOUBLE, level))) AS BIGINT), CAST(pow(2, level) AS BIGINT) - 1)) AS col, greatest(0, least(CAST(floor((y - y0) / (size / pow(2.0::DOUBLE, level))) AS BIGINT), CAST(pow(2, level) AS BIGINT) - 1)) AS row FROM leveled, r)
SELECT CAST(level AS INT) AS level, col, row, count(*) AS n_points, min(i) AS imin, max(i) AS imax FROM placed GROUP BY 1, 2, 3"""


def _probes(s, d):
    return query.probes(dc.quadtree_cells(s, ROOT, DEPTH)).select("level", "col", "row", "number", "copy")


PROBES_SQL = f"""WITH {_cells_sql()}, n AS (SELECT *, CAST((pow(4, level) - 1) / 3 AS BIGINT) + col * CAST(pow(2, level) AS BIGINT) + row AS number, CAST(pow(4, level) AS BIGINT) AS n FROM cells)
SELECT level, col, row, number, CAST(unnest(range(1, 1 + greatest(1, 16 // n))) AS INT) AS copy FROM n WHERE number % greatest(1, n // 16) = 0"""

_CAT = ["chunk", "n_points", "xmin", "xmax", "ymin", "ymax", "imin", "imax"]
_CELL = ["level", "col", "row", "xmin", "xmax", "ymin", "ymax", "imin", "imax"]

TABLE: dict[str, tuple] = {
    "pc_bounds_xy": _bounds(Dims.XY), "pc_bounds_xyz": _bounds(Dims.XYZ), "pc_bounds_xyi": _bounds(Dims.XYI), "pc_bounds_xyzi": _bounds(Dims.XYZI),
    "pc_bounds_by_cell": (lambda s, d: bd.bounds(dc.assign_grid(points(s, d), 250.0), Dims.XYZI, ["k_x", "k_y"]), f"WITH {POINTS_SQL} SELECT CAST(floor(x / 250.0) AS BIGINT) AS k_x, CAST(floor(y / 250.0) AS BIGINT) AS k_y, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax, min(i) AS imin, max(i) AS imax FROM points GROUP BY 1, 2"),
    "pc_count": (lambda s, d: points(s, d).agg(F.count("*").alias("n_points")), f"WITH {POINTS_SQL} SELECT count(*) AS n_points FROM points"),
    "pc_mean_x": (lambda s, d: points(s, d).agg(F.round(F.avg("x"), 6).alias("mean_x")), f"WITH {POINTS_SQL} SELECT round(avg(x), 6) AS mean_x FROM points"),
    "pc_rect_s": _filter(lambda p: query.rect(p, 1200, 1500, 70), "x >= 1200 AND x < 1270 AND y >= 1500 AND y < 1570"),
    "pc_rect_m": _filter(lambda p: query.rect(p, 1200, 1500, 220), "x >= 1200 AND x < 1420 AND y >= 1500 AND y < 1720"),
    "pc_box_closed": _filter(lambda p: query.box_query(p, Box(("x", "y", "z"), (1000, 1000, 5), (1250, 1250, 20)), right_open=False), "x BETWEEN 1000 AND 1250 AND y BETWEEN 1000 AND 1250 AND z BETWEEN 5 AND 20"),
    "pc_box_xyi": _filter(lambda p: query.box_query(p, Box(("x", "y"), (1000, 1000), (1500, 1500)).with_importance(0.25, 0.5)), "x >= 1000 AND x < 1500 AND y >= 1000 AND y < 1500 AND i >= 0.25 AND i < 0.5"),
    "pc_box_last_importance": _filter(lambda p: query.cell_query(p, Box(("x", "y"), (1000, 1000), (1500, 1500)).with_importance(0.75, 1.0)), "x >= 1000 AND x < 1500 AND y >= 1000 AND y < 1500 AND i >= 0.75 AND i <= 1.0"),
    "pc_range_one_sided": _filter(lambda p: p.filter((F.col("x") > 2000.0) & (F.col("y") <= 400.0)), "x > 2000.0::DOUBLE AND y <= 400.0::DOUBLE"),
    "pc_circle_s": _filter(lambda p: query.circle(p, 1500, 1500, 25), _circle_sql(1500, 1500, 25)),
    "pc_circle_m": _filter(lambda p: query.circle(p, 1500, 1500, 100), _circle_sql(1500, 1500, 100)),
    "pc_knn": (_knn, f"WITH {POINTS_SQL} SELECT x, y, (x - 1500.0::DOUBLE) * (x - 1500.0::DOUBLE) + (y - 1500.0::DOUBLE) * (y - 1500.0::DOUBLE) AS d, {PKEYS} FROM points ORDER BY d, {PKEYS} LIMIT 100"),
    "pc_knn_window": (_knn_window, f"WITH {POINTS_SQL} SELECT x, y, (x - {1500 + _R / 2!r}::DOUBLE) * (x - {1500 + _R / 2!r}::DOUBLE) + (y - {1500 + _R / 2!r}::DOUBLE) * (y - {1500 + _R / 2!r}::DOUBLE) AS d, {PKEYS} FROM points WHERE x >= {1500 - _R!r}::DOUBLE AND x < {1500 + _R!r}::DOUBLE AND y >= {1500 - _R!r}::DOUBLE AND y < {1500 + _R!r}::DOUBLE ORDER BY d, {PKEYS} LIMIT 1000"),
    "pc_sample_importance": _filter(lambda p: query.importance_sample(p, 0.1), "i < CAST(CAST(0.1 AS FLOAT) AS DOUBLE)"),
    "pc_grid_coverage": (lambda s, d: dc.grid_coverage(s, Box(("x", "y", "z"), (-300.0, 10.0, 5.0), (450.0, 700.0, 90.0)), 100.0), "SELECT x AS k_x, x * 100.0::DOUBLE AS xmin, (x + 1) * 100.0::DOUBLE AS xmax, y AS k_y, y * 100.0::DOUBLE AS ymin, (y + 1) * 100.0::DOUBLE AS ymax, z AS k_z, z * 100.0::DOUBLE AS zmin, (z + 1) * 100.0::DOUBLE AS zmax FROM range(-3, 5) a(x), range(0, 8) b(y), range(0, 1) c(z)"),
    "pc_grid_assign": (lambda s, d: dc.assign_grid(points(s, d), 100.0).select("k_x", "k_y", *KEYS), f"WITH {POINTS_SQL} SELECT CAST(floor(x / 100.0::DOUBLE) AS BIGINT) AS k_x, CAST(floor(y / 100.0::DOUBLE) AS BIGINT) AS k_y, {PKEYS} FROM points"),
    "pc_grid_histogram": (lambda s, d: dc.assign_grid(points(s, d), 100.0).groupBy("k_x", "k_y").agg(F.count("*").alias("n_points")), f"WITH {POINTS_SQL} SELECT CAST(floor(x / 100.0::DOUBLE) AS BIGINT) AS k_x, CAST(floor(y / 100.0::DOUBLE) AS BIGINT) AS k_y, count(*) AS n_points FROM points GROUP BY 1, 2"),
    "pc_split_box": (lambda s, d: dc.split_box(s, Box(("x", "y", "i"), (0.0, 100.0, 0.0), (1000.0, 700.0, 1.0)), (4, 3, 2)), "SELECT a AS k_x, 0.0 + a * 250.0::DOUBLE AS xmin, CASE WHEN a = 3 THEN 1000.0::DOUBLE ELSE (a + 1) * 250.0::DOUBLE END AS xmax, b AS k_y, 100.0 + b * 200.0::DOUBLE AS ymin, CASE WHEN b = 2 THEN 700.0::DOUBLE ELSE 100.0 + (b + 1) * 200.0::DOUBLE END AS ymax, c AS k_i, c * 0.5::DOUBLE AS imin, CASE WHEN c = 1 THEN 1.0::DOUBLE ELSE (c + 1) * 0.5::DOUBLE END AS imax FROM range(4) t(a), range(3) u(b), range(2) v(c)"),
    "pc_quadtree_cells": (lambda s, d: dc.quadtree_cells(s, ROOT, DEPTH).select(*_CELL), f"WITH {_cells_sql()} SELECT {', '.join(_CELL)} FROM cells"),
    "pc_quadtree_bands": (lambda s, d: dc.assign_quadtree(points(s, d), ROOT, DEPTH).groupBy("level").agg(F.count("*").alias("n_points"), F.min("i").alias("imin"), F.max("i").alias("imax")), f"WITH {_tree_sql()} SELECT CAST(level AS INT) AS level, count(*) AS n_points, min(i) AS imin, max(i) AS imax FROM placed GROUP BY 1"),
    "pc_quadtree_assign": (lambda s, d: dc.assign_quadtree(points(s, d), ROOT, DEPTH).select("level", "col", "row", *KEYS), f"WITH {_tree_sql()} SELECT CAST(level AS INT) AS level, col, row, {PKEYS} FROM placed"),
    "pc_quadtree_counts": (lambda s, d: dc.assign_quadtree(points(s, d), ROOT, DEPTH).groupBy("level", "col", "row").agg(F.count("*").alias("n_points")), f"WITH {_tree_sql()} SELECT CAST(level AS INT) AS level, col, row, count(*) AS n_points FROM placed GROUP BY 1, 2, 3"),
    "pc_quadtree_sizing": (_sizing, SIZING_SQL),
    "pc_chunk_catalog": (lambda s, d: _catalog(s, d).select(*_CAT), f"WITH {CHUNKS_SQL} SELECT {', '.join(_CAT)} FROM chunks"),
    "pc_chunk_prune": (lambda s, d: query.prune(_catalog(s, d), Box(("x", "i"), (0.0, 0.0), (23.0, 0.001))).select("chunk", "n_points"), f"WITH {CHUNKS_SQL} SELECT chunk, n_points FROM chunks WHERE xmin <= 23.0 AND xmax >= 0 AND imin <= 0.001 AND imax >= 0"),
    "pc_chunk_cell_hits": (lambda s, d: _hits(s, d).select("level", "col", "row", "hits"), f"{HITS_SQL} SELECT level, col, row, hits FROM hits"),
    "pc_level_hit_stats": (lambda s, d: query.level_stats(_hits(s, d)).select("level", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")), f"{HITS_SQL} SELECT level, round(avg(hits), 6) AS mean, round(stddev_pop(hits), 6) AS std FROM hits GROUP BY 1"),
    "pc_probe_selection": (_probes, PROBES_SQL),
    "pc_lod_query": _filter(lambda p: query.box_query(p, LOD), " AND ".join(f"{d} >= {a!r}::DOUBLE AND {d} < {b!r}::DOUBLE" for d, a, b in zip(LOD.dims, LOD.lower, LOD.upper, strict=True))),
    "pc_lod_prefix": (lambda s, d: dc.assign_quadtree(points(s, d), ROOT, DEPTH).where("level <= 1").select("x", "y", "i", *KEYS), f"WITH {_tree_sql()} SELECT x, y, i, {PKEYS} FROM placed WHERE level <= 1"),
    "pc_extent_stats": (lambda s, d: bd.layout_stats(_catalog(s, d)).select(*[F.round(c, 6).alias(c) for c in ("points_mean", "points_std", "dx_mean", "dx_std", "dy_mean", "dy_std", "di_mean", "di_std")]), f"WITH {CHUNKS_SQL} SELECT " + ", ".join(f"round({f}({e}), 6) AS {n}_{s}" for n, e in (("points", "n_points"), ("dx", "xmax - xmin"), ("dy", "ymax - ymin"), ("di", "imax - imin")) for f, s in (("avg", "mean"), ("stddev_pop", "std"))) + " FROM chunks"),
    "pc_box_area": (lambda s, d: _box_table(s, d).select("chunk", F.round(ex.box_area(), 6).alias("area"), F.round(ex.box_perimeter(), 6).alias("perimeter"), F.round(ex.box_center("x"), 6).alias("cx"), F.round(ex.box_center("y"), 6).alias("cy")), f"WITH {CHUNKS_SQL} SELECT chunk, round((xmax - xmin) * (ymax - ymin), 6) AS area, round((xmax - xmin) + (ymax - ymin), 6) AS perimeter, round((xmin + xmax) / 2, 6) AS cx, round((ymin + ymax) / 2, 6) AS cy FROM chunks"),
    "pc_box_intersection": (lambda s, d: _box_table(s, d).select("chunk", F.round(ex.box_intersection_area(QUERY_BOX), 6).alias("area"), ex.box_intersects(QUERY_BOX).alias("meets")), f"WITH {CHUNKS_SQL} SELECT chunk, round(greatest(0, least(xmax, 1400.0::DOUBLE) - greatest(xmin, 900.0::DOUBLE)) * greatest(0, least(ymax, 1700.0::DOUBLE) - greatest(ymin, 1100.0::DOUBLE)), 6) AS area, xmin <= 1400 AND xmax >= 900 AND ymin <= 1700 AND ymax >= 1100 AS meets FROM chunks"),
    "pc_box_distance": (lambda s, d: _box_table(s, d).select("chunk", F.round(ex.box_distance_2(x=10.0, y=2600.0), 6).alias("d2"), ex.box_contains_point(x=10.0, y=2600.0).alias("inside")), f"WITH {CHUNKS_SQL}, g AS (SELECT *, greatest(xmin - 10.0::DOUBLE, 0, 10.0::DOUBLE - xmax) AS gx, greatest(ymin - 2600.0::DOUBLE, 0, 2600.0::DOUBLE - ymax) AS gy FROM chunks) SELECT chunk, round(gx * gx + gy * gy, 6) AS d2, xmin <= 10 AND xmax >= 10 AND ymin <= 2600 AND ymax >= 2600 AS inside FROM g"),
    "pc_box_merge": (lambda s, d: _box_table(s, d).groupBy((F.col("chunk") % 4).alias("part")).agg(F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"), F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax")), f"WITH {CHUNKS_SQL} SELECT chunk % 4 AS part, min(xmin) AS xmin, max(xmax) AS xmax, min(ymin) AS ymin, max(ymax) AS ymax FROM chunks GROUP BY 1"),
    "pc_normalize": (_normalize, NORMALIZE_SQL),
    "pc_rotate": (_rotate, f"WITH {POINTS_SQL} SELECT round(x * {_C!r}::DOUBLE + y * {-_S!r}::DOUBLE, 6) AS x, round(x * {_S!r}::DOUBLE + y * {_C!r}::DOUBLE, 6) AS y, round(z, 6) AS z, {PKEYS} FROM points"),
    "pc_raw_roundtrip": (_raw, f"WITH {POINTS_SQL}, r AS (SELECT *, CAST(round((x - 1000.0::DOUBLE) / 0.001::DOUBLE) AS INT) AS x_raw, CAST(round((y - -500.0::DOUBLE) / 0.001::DOUBLE) AS INT) AS y_raw FROM points) SELECT x_raw, y_raw, round(x_raw * 0.001::DOUBLE + 1000.0::DOUBLE, 6) AS x, round(y_raw * 0.001::DOUBLE + -500.0::DOUBLE, 6) AS y, {PKEYS} FROM r"),
    "pc_rescale_16_8": (_colour, f"WITH {POINTS_SQL} SELECT CAST((l_partkey * 131) % 65536 AS INT) AS red, CAST(trunc(CAST((l_partkey * 131) % 65536 AS DOUBLE) / 65535 * 255) AS INT) AS red8, {PKEYS} FROM points WHERE (l_partkey * 131) % 65536 > 0"),
    "pc_hausdorff": (_hausdorff, HAUSDORFF_SQL),
    "pc_merge_concat": (_merge_concat, f"WITH {POINTS_SQL} SELECT x, y, z, i, {PKEYS} FROM points"),
    "pc_cluster_quadtree": (_cluster_cells, CELLS_SQL),
    "pc_row_group_catalog": (_row_groups, f"WITH {POINTS_SQL} SELECT CAST(count(*) AS BIGINT) AS n_points, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(i) AS imin, max(i) AS imax FROM points"),
    "pc_lod_indexed": (_lod_indexed, f"WITH {POINTS_SQL} SELECT x, y, z, i, {PKEYS} FROM points WHERE " + " AND ".join(f"{d} >= {a!r}::DOUBLE AND {d} < {b!r}::DOUBLE" for d, a, b in zip(LOD.dims, LOD.lower, LOD.upper, strict=True))),
    "pc_ply_roundtrip": (_ply_round_trip, f"WITH {POINTS_SQL} SELECT x, y, z, i, {PKEYS} FROM points"),
}

#: SQL that runs on both engines as it stands.
COMMON_SQL = {
    "sql_join_agg": "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "sql_semi_join": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "sql_anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "sql_outer_join": "SELECT s_suppkey, count(l_orderkey) AS n FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey AND l_quantity > 45 GROUP BY s_suppkey",
    "sql_theta_join": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "sql_anti_join_rows": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "sql_theta_join_range": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND a.s_acctbal > b.s_acctbal - 50",
    "sql_interval_join": "SELECT p_partkey, count(*) AS n FROM part JOIN lineitem ON l_quantity BETWEEN p_size AND p_size + 1 GROUP BY p_partkey",
    "sql_union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey + 100 FROM nation",
    "sql_union_all": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT n_regionkey FROM nation",
    "sql_except_all": "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region",
    "sql_intersect_all": "SELECT s_nationkey AS k FROM supplier INTERSECT ALL SELECT c_nationkey FROM customer",
    "sql_range_frame": "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM lineitem",
    "sql_ntile_lead": "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS q, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS r, coalesce(lead(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey), -1) AS after FROM orders",
    "sql_regexp": "SELECT p_partkey, regexp_extract(p_name, '[a-z]+', 0) AS word, regexp_extract(p_brand, '([A-Za-z]+)[^0-9]*([0-9]+)', 2) AS number FROM part",
    "sql_math": "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS s, CAST(floor(l_extendedprice / 7) AS BIGINT) AS f, abs(l_linenumber - 4) AS a, l_orderkey % 7 AS m FROM lineitem",
    "sql_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "sql_distinct_agg": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey",
    "sql_window_rank": "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t WHERE r <= 3",
    "sql_window_frame": "SELECT event_id, sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM (SELECT event_id, event_type, ts, round(value, 0) AS value FROM events) e",
    "sql_window_lag": "SELECT event_id, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS before FROM events",
    "sql_union_intersect_except": "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0",
    "sql_cte_subquery": "WITH t AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT o_custkey FROM t WHERE s > (SELECT avg(s) FROM t)",
    "sql_case_string": "SELECT p_partkey, upper(p_brand) AS brand, length(p_name) AS n, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size FROM part",
    "sql_date_group": "SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS month, count(*) AS n FROM orders GROUP BY 1",
    "sql_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "sql_filter_agg": "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS n, min(l_shipdate) AS first FROM lineitem GROUP BY l_returnflag",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _sql(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if f" {t}" in text:
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(text)

    return run


QUERIES = {name: pair[0] for name, pair in TABLE.items()} | {name: _sql(text) for name, text in COMMON_SQL.items()}
ORACLE = {name: pair[1] for name, pair in TABLE.items()} | COMMON_SQL


def asof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's latest event of its customer at or before it: a union and one window, no range join."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.col("o_orderkey").alias("o"), F.lit(None).cast("long").alias("e"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), F.lit(None).cast("long").alias("o"), F.col("event_id").alias("e"))
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy(F.col("t"), F.col("e").isNull(), F.col("e")).rowsBetween(Window.unboundedPreceding, 0)
    return orders.unionByName(events).withColumn("event_id", F.last("e", ignorenulls=True).over(w)).where("o is not null").select(F.col("o").alias("o_orderkey"), "event_id")


def arrays_and_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays, maps and JSON: each priority's order keys by status, and what is in them."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    grouped = orders.groupBy("o_orderpriority").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"), F.array_sort(F.collect_set("o_orderstatus")).alias("states"))
    json = F.to_json(F.struct(F.col("states").alias("states"), F.size("keys").alias("n")))
    return grouped.select("o_orderpriority", F.size("keys").alias("n"), F.element_at("keys", 1).alias("first"), F.array_join("states", "|").alias("states"), F.aggregate(F.transform("keys", lambda k: k % 10), F.lit(0).cast("long"), lambda a, k: a + k).alias("digits"), F.get_json_object(json, "$.states[0]").alias("state"))


def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sketch's count of distinct parts is within a tenth of the exact one."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.count_distinct("l_partkey").alias("n")).select("n", (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("close"))


QUERIES |= {"sql_array_json": arrays_and_json, "sql_approx_distinct": approximate_distinct}
ORACLE |= {
    "sql_array_json": "SELECT o_orderpriority, CAST(count(*) AS INT) AS n, min(o_orderkey) AS first, array_to_string(list_sort(list(DISTINCT o_orderstatus)), '|') AS states, CAST(sum(o_orderkey % 10) AS BIGINT) AS digits, min(o_orderstatus) AS state FROM orders GROUP BY 1",
    "sql_approx_distinct": "SELECT count(DISTINCT l_partkey) AS n, true AS close FROM lineitem",
}


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's number of lines with a quantity from its size to one more.

    Lines count by quantity and parts by size before they meet: the lines'
    quantities meet the sizes in bins one wide, by equality, and no pair of a
    part and a line is made.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_quantity").cast("double").alias("q")).agg(F.count("*").alias("lines")).where("q is not null")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_partkey", "p_size").agg(F.count("*").alias("parts")).where("p_size is not null")
    sizes = parts.select("p_size").distinct().select("p_size", F.explode(F.array(F.col("p_size").cast("long"), F.col("p_size").cast("long") + 1)).alias("bin"))
    # what lies beyond the sizes' type has no bin
    binned = lines.where("q >= -2147483648D and q < 2147483649D").withColumn("bin", F.floor("q").cast("long"))
    met = sizes.join(binned, "bin").where("q >= p_size and q <= CAST(p_size AS BIGINT) + 1").groupBy("p_size").agg(F.sum("lines").alias("lines"))
    return parts.join(met, "p_size").groupBy("p_partkey").agg(F.sum(F.col("parts") * F.col("lines")).alias("n"))


QUERIES["sql_interval_join"] = interval_join
QUERIES["sql_asof_join"] = asof_events
ORACLE["sql_asof_join"] = "SELECT o_orderkey, e.event_id FROM orders LEFT JOIN LATERAL (SELECT event_id FROM events WHERE user_id = o_custkey AND ts <= o_orderdate ORDER BY ts DESC, event_id DESC LIMIT 1) e ON true"
