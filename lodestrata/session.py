"""Session settings that the sources and the layout rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROW_GROUP_ROWS = 524_288

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def session(name: str = "lodestrata", **conf: str) -> SparkSession:
    """A session with the engine's settings and its point formats registered."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    return register(builder.getOrCreate())


def register(spark: SparkSession) -> SparkSession:
    """Register the ``las`` and ``ply`` formats for ``spark.read.format``."""
    from .sources.las import LasDataSource
    from .sources.ply import PlyDataSource

    spark.dataSource.register(LasDataSource)
    spark.dataSource.register(PlyDataSource)
    return spark
