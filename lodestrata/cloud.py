"""A cloud of points as one object over a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Box, Dims, tag, validate
from .operators import bounds as b
from .operators import layout, query
from .operators.transform import normalize, transform


class PointCloud:
    """Points with named chunks: the schema is checked, everything else is deferred to Spark."""

    def __init__(self, df: DataFrame, dims: Dims | None = None, grid: float | None = None):
        self.dims = dims or validate(df)
        self.df = df if "chunk" in df.columns else df.withColumn("chunk", F.lit("0"))
        self.grid = grid

    @classmethod
    def of_points(cls, spark: SparkSession, points, dims: Dims = Dims.XYZ, **kw) -> PointCloud:
        """From tuples; components that are missing are 0."""
        n = len(dims.value)
        rows = [tuple(float(v) for v in (*p, *[0.0] * n)[:n]) for p in points]
        return cls(tag(spark.createDataFrame(rows, ", ".join(f"{d} double" for d in dims.value))), dims, **kw)

    @property
    def schema(self):
        return self.df.drop("chunk").schema

    def with_dims(self, dims: Dims) -> PointCloud:
        return PointCloud(self.df, dims, self.grid)

    def push(self, chunk: str, df: DataFrame) -> PointCloud:
        return PointCloud(self.df.unionByName(df.withColumn("chunk", F.lit(chunk)), allowMissingColumns=True), self.dims, self.grid)

    def append(self, df: DataFrame, name: str | None = None) -> PointCloud:
        """With a grid, each point goes to its cell's chunk; else all go to a new one."""
        if self.grid is None:
            return self.push(name or uuid.uuid4().hex, df)
        cell = F.concat_ws("_", *[F.floor(F.col(d) / F.lit(self.grid)).cast("string") for d in self.dims.value if d != "i"])
        return PointCloud(self.df.unionByName(df.withColumn("chunk", cell), allowMissingColumns=True), self.dims, self.grid)

    def chunk(self, key: str) -> DataFrame:
        return self.df.filter(F.col("chunk") == key).drop("chunk")

    def flush(self) -> PointCloud:
        self.df.unpersist()
        return self

    def bounds(self) -> Box | None:
        return b.box_of(self.df, self.dims)

    def num_points(self) -> int:
        return self.df.count()

    def points(self):
        """The dimensions row by row, partition after partition."""
        return self.df.select(*[F.col(d).cast("double") for d in self.dims.value]).toLocalIterator()

    def catalog(self) -> DataFrame:
        return b.chunk_catalog(self.df, "chunk", self.dims.value)

    def query(self, box: Box, right_open: bool = True) -> DataFrame:
        return query.box_query(self.df.drop("chunk"), box, right_open)

    def normalized(self) -> PointCloud:
        return PointCloud(normalize(self.df), self.dims, self.grid)

    def transformed(self, matrix, offset=(0.0, 0.0, 0.0)) -> PointCloud:
        return PointCloud(transform(self.df, matrix, offset), self.dims, self.grid)

    def write(self, path: str, method: str | None = None, **kw) -> None:
        df = self.df.drop("chunk")
        layout.write_points(layout.cluster(df, method) if method else df, path, **kw)
