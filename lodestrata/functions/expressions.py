"""Column expressions: box tests, distances, box algebra, cells and transforms. All stay in generated code."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, mul

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Box


def _lit(v: float) -> Column:
    return F.lit(float(v))


def in_box(box: Box, right_open: bool = True) -> Column:
    """Point within the box, every dimension half-open or closed: plain comparisons, so Parquet can skip by them."""
    tests = []
    for d, a, b in zip(box.dims, box.lower, box.upper, strict=True):
        tests += [F.col(d) >= _lit(a), F.col(d) < _lit(b) if right_open else F.col(d) <= _lit(b)]
    return reduce(and_, tests)


def in_cell(box: Box) -> Column:
    """Half-open, but the last importance slice (up to 1) is closed."""
    tests = []
    for d, a, b in zip(box.dims, box.lower, box.upper, strict=True):
        tests += [F.col(d) >= _lit(a), F.col(d) <= _lit(b) if d == "i" and b >= 1 else F.col(d) < _lit(b)]
    return reduce(and_, tests)


def distance_2(**at: float) -> Column:
    """Squared distance to a point, by products: equal in every engine."""
    return reduce(add, [(F.col(d) - _lit(v)) * (F.col(d) - _lit(v)) for d, v in at.items()])


def in_circle(x: float, y: float, r: float) -> Column:
    """Strictly within the circle; the box around it is what a scan can skip by."""
    return in_box(Box(("x", "y"), (x - r, y - r), (x + r, y + r))) & (distance_2(x=x, y=y) < _lit(r * r))


def box_area(dims=("x", "y")) -> Column:
    return reduce(mul, [F.col(f"{d}max") - F.col(f"{d}min") for d in dims])


def box_intersection_area(box: Box) -> Column:
    return reduce(mul, [F.greatest(_lit(0), F.least(F.col(f"{d}max"), _lit(box.range(d)[1])) - F.greatest(F.col(f"{d}min"), _lit(box.range(d)[0]))) for d in box.dims])


def box_intersects(box: Box) -> Column:
    return reduce(and_, [(F.col(f"{d}min") <= _lit(box.range(d)[1])) & (F.col(f"{d}max") >= _lit(box.range(d)[0])) for d in box.dims])


def box_contains_point(**at: float) -> Column:
    return reduce(and_, [(F.col(f"{d}min") <= _lit(v)) & (F.col(f"{d}max") >= _lit(v)) for d, v in at.items()])


def box_distance_2(**at: float) -> Column:
    gaps = [F.greatest(F.col(f"{d}min") - _lit(v), _lit(0), _lit(v) - F.col(f"{d}max")) for d, v in at.items()]
    return reduce(add, [g * g for g in gaps])


def box_center(dim: str) -> Column:
    return (F.col(f"{dim}min") + F.col(f"{dim}max")) / 2


def box_perimeter(dims=("x", "y")) -> Column:
    return reduce(add, [F.col(f"{d}max") - F.col(f"{d}min") for d in dims])


def boxes_intersect(a: str, b: str, dims=("x", "y")) -> Column:
    """Join condition of two box tables by their aliases."""
    return reduce(and_, [(F.col(f"{a}.{d}min") <= F.col(f"{b}.{d}max")) & (F.col(f"{a}.{d}max") >= F.col(f"{b}.{d}min")) for d in dims])


def grid_cell(dim: str, delta: float) -> Column:
    """Number of the origin-anchored cell: floored, below 0 too."""
    return F.floor(F.col(dim) / _lit(delta)).cast("long")


def level_bands(depth: int) -> list[float]:
    """Upper importance bound of each level: every cell of every level expects as many points."""
    total = sum(4**d for d in range(depth + 1))
    return [sum(4**d for d in range(level + 1)) / total for level in range(depth)] + [1.0]


def quadtree_level(depth: int) -> Column:
    """Level of a point's importance; 1 and above stay in the last."""
    expr = F.lit(depth)
    for level in reversed(range(depth)):
        expr = F.when(F.col("i") < _lit(level_bands(depth)[level]), F.lit(level)).otherwise(expr)
    return expr.cast("int")


def quadtree_index(dim: str, low: float, size: float, level: Column) -> Column:
    """Column or row of a point's cell at its level, the top edge clamped."""
    n = F.shiftleft(F.lit(1), level) if isinstance(level, int) else F.pow(F.lit(2.0), level)
    at = F.floor((F.col(dim) - _lit(low)) / (_lit(size) / n)).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(at, n.cast("long") - 1))


def affine(matrix, offset=(0.0, 0.0, 0.0)) -> dict[str, Column]:
    """x, y, z times a 3 x 3 matrix plus an offset, for ``withColumns``."""
    dims = ("x", "y", "z")
    return {d: reduce(add, [F.col(e) * _lit(m) for e, m in zip(dims, row, strict=True)]) + _lit(o) for d, row, o in zip(dims, matrix, offset, strict=True)}


def to_raw(dim: str, scale: float, offset: float) -> Column:
    return F.round((F.col(dim) - _lit(offset)) / _lit(scale)).cast("int")


def from_raw(dim: str, scale: float, offset: float) -> Column:
    return F.col(dim) * _lit(scale) + _lit(offset)


def rescale_16_8(name: str) -> Column:
    """16-bit colour to 8 bits, truncated."""
    return (F.col(name).cast("double") / 65535 * 255).cast("smallint")
