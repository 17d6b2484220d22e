"""Dimensions, boxes and the metadata that marks point columns."""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The keys of a point column's metadata.
DIMENSION, LOCATION, IMPORTANCE, SCALE, OFFSET = "PC:dimension", "PC:location", "PC:importance", "PC:scale", "PC:offset"


class Dims(Enum):
    XY = ("x", "y")
    XYZ = ("x", "y", "z")
    XYI = ("x", "y", "i")
    XYZI = ("x", "y", "z", "i")

    @classmethod
    def of(cls, names) -> Dims:
        names = tuple(names)
        for d in cls:
            if d.value == names:
                return d
        raise ValueError(f"not a set of dimensions: {names}")

    @property
    def importance(self) -> bool:
        return "i" in self.value


@dataclass(frozen=True)
class Box:
    """A closed box: its dimensions' names and two corners."""

    dims: tuple[str, ...]
    lower: tuple[float, ...]
    upper: tuple[float, ...]

    @classmethod
    def corners(cls, p, q, dims=None) -> Box:
        """The box of two points in any order."""
        dims = tuple(dims or ("x", "y", "z", "i")[: len(p)])
        return cls(dims, tuple(map(min, p, q)), tuple(map(max, p, q)))

    @classmethod
    def point(cls, p, dims=None) -> Box:
        return cls.corners(p, p, dims)

    @classmethod
    def empty(cls, dims=("x", "y", "z")) -> Box:
        """Identity of ``merged``."""
        n = len(dims)
        return cls(tuple(dims), (math.inf,) * n, (-math.inf,) * n)

    @property
    def is_empty(self) -> bool:
        return any(a > b for a, b in zip(self.lower, self.upper, strict=True))

    def extent(self) -> tuple[float, ...]:
        return tuple(b - a for a, b in zip(self.lower, self.upper, strict=True))

    def range(self, dim: str) -> tuple[float, float]:
        k = self.dims.index(dim)
        return self.lower[k], self.upper[k]

    def contains_point(self, p) -> bool:
        return all(a <= v <= b for a, v, b in zip(self.lower, p, self.upper, strict=True))

    def contains(self, other: Box) -> bool:
        return all(a <= c and d <= b for a, b, c, d in zip(self.lower, self.upper, other.lower, other.upper, strict=True))

    def intersects(self, other: Box) -> bool:
        return all(a <= d and c <= b for a, b, c, d in zip(self.lower, self.upper, other.lower, other.upper, strict=True))

    def merged(self, other: Box) -> Box:
        return Box(self.dims, tuple(map(min, self.lower, other.lower)), tuple(map(max, self.upper, other.upper)))

    def area(self) -> float:
        return 0.0 if self.is_empty else math.prod(self.extent())

    def intersection_area(self, other: Box) -> float:
        return math.prod(max(0.0, min(b, d) - max(a, c)) for a, b, c, d in zip(self.lower, self.upper, other.lower, other.upper, strict=True))

    def center(self) -> tuple[float, ...]:
        return tuple((a + b) / 2 for a, b in zip(self.lower, self.upper, strict=True))

    def perimeter(self) -> float:
        return sum(self.extent())

    def distance_2(self, p) -> float:
        return sum(max(a - v, 0.0, v - b) ** 2 for a, v, b in zip(self.lower, p, self.upper, strict=True))

    def min_max_distance_2(self, p) -> float:
        """The least, over the dimensions, of the furthest a box's nearer face can keep its closest content."""
        near = [(v - (a if v <= (a + b) / 2 else b)) ** 2 for a, v, b in zip(self.lower, p, self.upper, strict=True)]
        far = [(v - (a if v >= (a + b) / 2 else b)) ** 2 for a, v, b in zip(self.lower, p, self.upper, strict=True)]
        return min(sum(far) - far[k] + near[k] for k in range(len(far)))

    def with_importance(self, low: float, high: float) -> Box:
        kept = [(d, a, b) for d, a, b in zip(self.dims, self.lower, self.upper, strict=True) if d != "i"]
        return Box((*(d for d, *_ in kept), "i"), (*(a for _, a, _ in kept), low), (*(b for *_, b in kept), high))

    def id(self) -> str:
        return "_".join(f"{d}{a}-{b}" for d, a, b in zip(self.dims, self.lower, self.upper, strict=True))


def sort_boxes(boxes, dim: str) -> list[Box]:
    return sorted(boxes, key=lambda b: b.range(dim)[0])


def partition_boxes(boxes, dim: str, at: int) -> tuple[list[Box], list[Box]]:
    """The ``at`` boxes of lowest lower bound, and the others."""
    ranked = sort_boxes(boxes, dim)
    return ranked[:at], ranked[at:]


def tag(df: DataFrame, dims=None) -> DataFrame:
    """Mark the dimension columns by metadata, which computed columns lose."""
    dims = [d for d in ("x", "y", "z", "i") if d in df.columns] if dims is None else list(dims)
    cols = {}
    for k, d in enumerate(dims, 1):
        meta = {DIMENSION: str(k)} | ({IMPORTANCE: "random"} if d == "i" else {LOCATION: d})
        cols[d] = F.col(d).alias(d, metadata=meta)
    return df.select(*[cols.get(c, F.col(c)) for c in df.columns])


def dims_of(schema: T.StructType) -> Dims:
    found = sorted((f.metadata[DIMENSION], f.name) for f in schema if DIMENSION in f.metadata)
    return Dims.of(n for _, n in found) if found else Dims.of([d for d in ("x", "y", "z", "i") if d in schema.names])


def validate(df: DataFrame) -> Dims:
    """At least three numeric dimensions, or a clear error."""
    dims = dims_of(df.schema)
    if len(dims.value) < 3:
        raise ValueError("a point cloud has at least three dimensions")
    for d in dims.value:
        if not isinstance(df.schema[d].dataType, T.NumericType):
            raise TypeError(f"dimension {d} is {df.schema[d].dataType.simpleString()}, not numeric")
    return dims
