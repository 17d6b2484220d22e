"""Transforms of clouds, distances between them, and registration."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import affine
from ..model import tag
from .bounds import box_of


def transform(df: DataFrame, matrix, offset=(0.0, 0.0, 0.0)) -> DataFrame:
    return tag(df.withColumns(affine(matrix, offset)))


def rotate_z(df: DataFrame, angle: float) -> DataFrame:
    c, s = math.cos(angle), math.sin(angle)
    return transform(df, ((c, -s, 0), (s, c, 0), (0, 0, 1)))


def normalize(df: DataFrame) -> DataFrame:
    """Centre the cloud and scale its largest extent to 2: within [-1, 1] each way."""
    box = box_of(df, ("x", "y", "z"))
    if box is None:
        return df
    k = 2 / (max(box.extent()) or 1.0)
    return tag(df.withColumns({d: (F.col(d) - F.lit(c)) * F.lit(k) for d, c in zip("xyz", box.center(), strict=True)}))


FEW, SOME = 256, 20_000
TILE, LEAF = 65_536, 512


def _splits(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A k-d tree over the sample: each inner node's dimension and value, each tile's lower and upper corner."""
    dims, values = np.zeros((1 << depth) - 1, dtype=np.int64), np.full((1 << depth) - 1, np.inf)
    parts, low, high = [sample], np.full((1, 3), -np.inf), np.full((1, 3), np.inf)
    for level in range(depth):
        following = []
        low, high = np.repeat(low, 2, axis=0), np.repeat(high, 2, axis=0)
        for k, part in enumerate(parts):
            node, d = (1 << level) - 1 + k, 0
            if len(part) > 1:
                d = int(np.ptp(part, axis=0).argmax())
                order = np.sort(part[:, d])
                above = order[order > order[0]]
                values[node] = max(order[len(order) // 2], above[0]) if len(above) else np.inf
            dims[node] = d
            left = part[:, d] < values[node]
            following += [part[left], part[~left]]
            high[2 * k, d], low[2 * k + 1, d] = values[node], values[node]
        parts = following
    return dims, values, low, high


def _in_tiles(depth: int, dims: np.ndarray, values: np.ndarray):
    def run(batches):
        for batch in batches:
            points = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
            at, row = np.zeros(len(points), dtype=np.int64), np.arange(len(points))
            for level in range(depth):
                node = at + (1 << level) - 1
                at = 2 * at + (points[row, dims[node]] >= values[node])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(batch.column(k) for k in range(4))], names=["tile", "x", "y", "z", "of_a"])

    return run


def _squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, summed in the order of the dimensions."""
    d = p[:, None, 0] - q[None, :, 0]
    out = d * d
    for k in (1, 2):
        np.subtract(p[:, None, k], q[None, :, k], out=d)
        out += d * d
    return out


def _leaves(points: np.ndarray, share: float):
    """Rows of the points in leaves of up to LEAF, cut across the longest side at ``share``."""
    todo = [np.arange(len(points))]
    while todo:
        part = todo.pop()
        if len(part) <= LEAF:
            yield part
            continue
        d = int(np.ptp(points[part], axis=0).argmax())
        cut = int(len(part) * share)
        part = part[np.argpartition(points[part, d], cut)]
        todo += [part[:cut], part[cut:]]


def _nearest_in_tile(low: np.ndarray, high: np.ndarray):
    """Of a tile's points: the largest squared distance that is sure within the tile, and the points that may have a larger one.

    Distances in two sets of small leaves bound those to the nearest point from above;
    only points over the largest sure distance then meet the tile's other cloud.
    """

    def run(_, rows):
        points = np.stack([rows.column(d).to_numpy() for d in ("x", "y", "z")], axis=1)
        of_a, tile = rows.column("of_a").to_numpy(), rows.column("tile")[0].as_py()
        best = np.full(len(points), np.inf)
        for share in (0.5, 0.37):
            for part in _leaves(points, share):
                a, b = part[of_a[part]], part[~of_a[part]]
                if len(a) and len(b):
                    d2 = _squares(points[a], points[b])
                    best[a], best[b] = np.minimum(best[a], d2.min(1)), np.minimum(best[b], d2.min(0))
        border = np.minimum(points - low[tile], high[tile] - points).min(1)
        inside = border * border * (1 - 1e-9)
        order, sure = np.argsort(-best), 0.0
        clouds = {side: points[of_a == side] for side in (True, False)}
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            if not best[part[0]] > sure:
                break
            for side in (True, False):
                mine, other = part[of_a[part] == side], clouds[not side]
                for c in range(0, len(other) if len(mine) else 0, 1 << 14):
                    best[mine] = np.minimum(best[mine], _squares(points[mine], other[c : c + (1 << 14)]).min(1))
            done = best[part] <= inside[part]
            sure = max(sure, best[part][done].max(initial=0.0))
        open_ = np.nonzero((best > sure) & (best > inside))[0]
        found = [*([v] for v in (None, None, None, None, sure)), [True]]
        rest = [*(points[open_, k] for k in range(3)), of_a[open_], best[open_], np.zeros(len(open_), dtype=bool)]
        kinds = (pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.float64(), pa.bool_())
        return pa.table([pa.chunked_array([pa.array(f, k), pa.array(r, k)]) for f, r, k in zip(found, rest, kinds, strict=True)], names=["x", "y", "z", "of_a", "m", "sure"])

    return run


def _farthest(a: DataFrame, b: DataFrame, cell: float, far: float | None = None) -> float | None:
    """Largest squared distance of a point of ``a`` to its nearest in ``b``, or ``far`` if that is larger.

    Each round joins the points still open with the 27 cells around them: a
    neighbour no farther than a cell's side is the nearest. The cell then
    doubles, and points with a neighbour no farther than the largest distance
    settled so far are dropped. The last few meet all of ``b``.
    """
    open_ = a
    d2 = sum(((F.col(d) - F.col(f"b_{d}")) * (F.col(d) - F.col(f"b_{d}")) for d in ("x", "y", "z")), F.lit(0.0))
    to = b.select(*[F.col(d).alias(f"b_{d}") for d in ("x", "y", "z")])
    while True:
        many = open_.limit(SOME + 1).count()
        few = many <= FEW
        if few:
            found = F.broadcast(open_).join(to, how="cross").groupBy("x", "y", "z").agg(F.min(d2).alias("m"))
        else:
            at = [F.floor(F.col(d) / cell) for d in ("x", "y", "z")]
            around = [F.explode(F.array(*[c + F.lit(k) for k in (-1, 0, 1)])) for c in at]
            near = open_
            for k, c in enumerate(around):
                near = near.withColumn(f"k{k}", c)
            held = to.withColumns({f"k{k}": F.floor(F.col(f"b_{d}") / cell) for k, d in enumerate(("x", "y", "z"))})
            found = (F.broadcast(near) if many <= SOME else near).join(held, ["k0", "k1", "k2"]).groupBy("x", "y", "z").agg(F.min(d2).alias("m"))
        found = found.persist()
        top = (found if few else found.where(F.col("m") <= cell * cell)).agg(F.max("m").alias("m")).first().m
        far = top if far is None or (top is not None and top > far) else far
        if few:
            found.unpersist()
            return far
        sure = found.where((F.col("m") <= cell * cell) | (F.col("m") <= F.lit(far)))
        following = open_.join(sure, ["x", "y", "z"], "left_anti").select("x", "y", "z").persist()
        following.count()
        found.unpersist()
        if open_ is not a:
            open_.unpersist()
        open_, cell = following, 2 * cell


def hausdorff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Discrete Hausdorff distance of two clouds, exact. Points with a null coordinate are left out.

    Both clouds go once through an exchange to the tiles of a k-d tree, whose
    cuts come from a sample of the points. A nearest neighbour no farther than
    the tile's border is sure; the largest such distance rules out all points
    that have any neighbour within it. The few others look for nearer ones
    through a grid over the whole cloud. Where the clouds lie far apart most
    points are such, and the join nears all pairs.
    """
    spark = a.sparkSession
    clouds = [df.select(*[F.col(d).cast("double").alias(d) for d in ("x", "y", "z")]).dropna() for df in (a, b)]
    both = clouds[0].withColumn("of_a", F.lit(True)).unionByName(clouds[1].withColumn("of_a", F.lit(False)))
    counts = {r.of_a: r["count"] for r in both.groupBy("of_a").count().collect()}
    if len(counts) < 2:
        return spark.createDataFrame([(None,)], "hausdorff double")
    n = sum(counts.values())
    depth = min(12, max(0, math.ceil(math.log2(n / TILE))))
    cut = both.select("x", "y", "z").where(F.xxhash64("x", "y", "z") <= int(-(2**63) + min(0.99, 64 * 2**depth / n) * (2**64 - 1))).distinct().limit(256 * 2**depth).collect() if depth else []
    dims, values, low, high = _splits(np.array(cut, dtype=float).reshape(-1, 3), depth)
    tiles = both.mapInArrow(_in_tiles(depth, dims, values), "tile int, x double, y double, z double, of_a boolean").repartition("tile").distinct()
    found = tiles.groupBy("tile").applyInArrow(_nearest_in_tile(low, high), "x double, y double, z double, of_a boolean, m double, sure boolean").persist()
    far = found.where("sure").agg(F.max("m").alias("m")).first().m
    for side in (True, False):
        open_ = found.where((F.col("of_a") == side) & (F.col("m") > F.lit(far)))
        most = open_.agg(F.max("m").alias("m")).first().m
        if most is None:
            continue
        cell = math.sqrt(most) * (1 + 1e-9)
        if not math.isfinite(cell):
            extents = [e for e in box_of(both, ("x", "y", "z")).extent() if e > 0]
            cell = (math.prod(extents) * 4 / min(counts.values())) ** (1 / len(extents)) if extents else 1.0
        far = _farthest(open_.select("x", "y", "z"), clouds[0 if not side else 1], cell, far)
    found.unpersist()
    return spark.createDataFrame([(math.sqrt(far),)], "hausdorff double")


def register_rotation(a: DataFrame, b: DataFrame, rounds: int = 4, steps: int = 24) -> float:
    """Angle about z that brings ``a`` closest to ``b``: ever finer tables of candidate angles, scored in one job each."""
    spark, low, high = a.sparkSession, 0.0, 2 * math.pi
    best = 0.0
    for _ in range(rounds):
        angles = spark.range(steps + 1).select((F.lit(low) + F.col("id") * F.lit((high - low) / steps)).alias("angle"))
        turned = a.select("x", "y", "z").crossJoin(F.broadcast(angles))
        turned = turned.select("angle", (F.col("x") * F.cos("angle") - F.col("y") * F.sin("angle")).alias("x"), (F.col("x") * F.sin("angle") + F.col("y") * F.cos("angle")).alias("y"), "z")
        pairs = turned.withColumn("_p", F.monotonically_increasing_id()).alias("a").crossJoin(b.select("x", "y", "z").withColumn("_q", F.monotonically_increasing_id()).alias("b"))
        d2 = sum(((F.col(f"a.{d}") - F.col(f"b.{d}")) * (F.col(f"a.{d}") - F.col(f"b.{d}")) for d in ("x", "y", "z")), F.lit(0.0))
        scored = pairs.select("angle", "_p", "_q", d2.alias("d"))
        there = scored.groupBy("angle", "_p").agg(F.min("d").alias("m")).groupBy("angle").agg(F.max("m").alias("h"))
        back = scored.groupBy("angle", "_q").agg(F.min("d").alias("m")).groupBy("angle").agg(F.max("m").alias("h"))
        best = there.unionByName(back).groupBy("angle").agg(F.max("h").alias("h")).orderBy("h", "angle").first().angle
        step = (high - low) / steps
        low, high = best - step, best + step
    return best % (2 * math.pi)
