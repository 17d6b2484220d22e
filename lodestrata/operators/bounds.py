"""Bounds, counts and the chunk catalog."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Box, Dims


def bounds(df: DataFrame, dims: Dims | tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """Least and greatest value of each dimension in one aggregate; nulls for no rows."""
    names = dims.value if isinstance(dims, Dims) else tuple(dims)
    aggs = [f(d).alias(f"{d}{n}") for d in names for f, n in ((F.min, "min"), (F.max, "max"))]
    return (df.groupBy(*by) if by else df).agg(*aggs)


def box_of(df: DataFrame, dims: Dims | tuple[str, ...]) -> Box | None:
    """The bounds as a box on the driver: one row."""
    names = dims.value if isinstance(dims, Dims) else tuple(dims)
    r = bounds(df, names).first()
    return None if r[0] is None else Box(names, tuple(float(r[f"{d}min"]) for d in names), tuple(float(r[f"{d}max"]) for d in names))


def box_and_count(df: DataFrame, dims: Dims | tuple[str, ...]) -> tuple[Box | None, int]:
    """The bounds and the number of all rows, in one pass."""
    names = dims.value if isinstance(dims, Dims) else tuple(dims)
    r = df.agg(*[f(d).alias(f"{d}{n}") for d in names for f, n in ((F.min, "min"), (F.max, "max"))], F.count("*").alias("n")).first()
    box = None if r[0] is None else Box(names, tuple(float(r[f"{d}min"]) for d in names), tuple(float(r[f"{d}max"]) for d in names))
    return box, r.n


def chunk_catalog(df: DataFrame, chunk: str, dims=("x", "y", "i")) -> DataFrame:
    """Count and bounds of each chunk."""
    aggs = [f(d).alias(f"{d}{n}") for d in dims for f, n in ((F.min, "min"), (F.max, "max"))]
    return df.groupBy(chunk).agg(F.count("*").alias("n_points"), *aggs)


def _footers(dims):
    def run(batches):
        import pyarrow.parquet as pq

        from ..sources.files import open_path

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = open_path(path)
                with fs.open_input_file(at) as f:
                    meta = pq.ParquetFile(f).metadata
                rows = []
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    stats = {group.column(c).path_in_schema: group.column(c).statistics for c in range(group.num_columns)}
                    row = [path, g, group.num_rows]
                    for d in dims:
                        s = stats.get(d)
                        # without statistics the chunk can't be skipped: unbounded
                        row += [float(s.min), float(s.max)] if s is not None and s.has_min_max else [float("-inf"), float("inf")]
                    rows.append(row)
                types = [pa.string(), pa.int32(), pa.int64()] + [pa.float64()] * (2 * len(dims))
                names = ["file", "row_group", "n_points"] + [f"{d}{e}" for d in dims for e in ("min", "max")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=names)

    return run


def row_group_catalog(df: DataFrame, dims=("x", "y", "i")) -> DataFrame:
    """One row for each row group of the files behind ``df``, from their footers: nothing else is read."""
    spark = df.sparkSession
    files = df.inputFiles()
    schema = "file string, row_group int, n_points long, " + ", ".join(f"{d}{e} double" for d in dims for e in ("min", "max"))
    paths = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), 1024)))
    return paths.mapInArrow(_footers(dims), schema)


def _groups(columns: list[str], schema: pa.Schema):
    def run(batches):
        import pyarrow.parquet as pq

        from ..sources.files import open_path

        for batch in batches:
            for path, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = open_path(path)
                with fs.open_input_file(at) as f:
                    # a row group goes out in pieces
                    for piece in pq.ParquetFile(f).iter_batches(1 << 16, row_groups=[group], columns=columns):
                        yield pa.RecordBatch.from_arrays([piece.column(c).cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def read_row_groups(catalog: DataFrame, like: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The rows of the row groups that ``catalog`` names (file, row_group), and of no others: a task reads its groups' bytes alone.

    ``like`` is a DataFrame over the same files, whose schema holds; nested
    columns are refused.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = T.StructType([like.schema[c] for c in columns or like.columns])
    for f in fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise TypeError(f"column {f.name}: row groups are read with plain columns")
    n = max(1, int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    named = catalog.select("file", "row_group").repartition(n, "file", "row_group")
    return named.mapInArrow(_groups(fields.fieldNames(), to_arrow_schema(fields)), fields)


def layout_stats(catalog: DataFrame, dims=("x", "y", "i")) -> DataFrame:
    """Mean and population deviation of the chunks' points, extents, area and volume."""
    ext = {d: F.col(f"{d}max") - F.col(f"{d}min") for d in dims}
    cols = {"points": F.col("n_points").cast("double")} | {f"d{d}": e for d, e in ext.items()} | {"area": ext["x"] * ext["y"]}
    if "i" in dims:
        cols["volume"] = ext["x"] * ext["y"] * ext["i"]
    return catalog.agg(*[f(c).alias(f"{n}_{s}") for n, c in cols.items() for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"))])
