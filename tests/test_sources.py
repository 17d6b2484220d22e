import os
import shutil
import struct

import numpy as np
import pytest

from lodestrata import cli
from lodestrata.cloud import PointCloud
from lodestrata.model import Box, Dims
from lodestrata.operators import bounds as bd
from lodestrata.operators import layout
from lodestrata.session import register
from lodestrata.sources import files
from lodestrata.sources.las import LasHeader, las_header_catalog, read_points, write_chunk_catalog
from lodestrata.sources.ply import write_ply
from lodestrata.streaming.append import append_stream


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    register(spark)


def make_las(path, fmt, xyz, scale=0.01, offset=(-100.0, 50.0, 0.0), extra=0):
    """A LAS file of the given point format, written by hand."""
    xyz = np.asarray(xyz, dtype=float)
    header = bytearray(375)
    header[:4] = b"LASF"
    header[24:26] = bytes((1, 4))
    sizes = {0: 20, 1: 28, 2: 26, 3: 34, 6: 30, 7: 36, 8: 38}
    struct.pack_into("<HI", header, 94, 375, 375)
    struct.pack_into("<BH", header, 104, fmt, sizes[fmt] + extra)
    struct.pack_into("<6d", header, 131, *[scale] * 3, *offset)
    lo, hi = (xyz.min(0), xyz.max(0)) if len(xyz) else (np.zeros(3), np.zeros(3))
    struct.pack_into("<6d", header, 179, *[v for k in range(3) for v in (hi[k], lo[k])])
    struct.pack_into("<Q", header, 247, len(xyz))
    path.write_bytes(bytes(header))
    h = LasHeader(str(path))
    data = np.zeros(len(xyz), dtype=h.dtype())
    for k, d in enumerate("XYZ"):
        data[d] = np.round((xyz[:, k] - offset[k]) / scale)
    data["intensity"] = np.arange(len(xyz))
    if fmt < 6:
        data["returns"], data["class"], data["angle"] = 1 | 2 << 3 | 1 << 7, 2 | 1 << 5, -5
    else:
        data["returns"], data["flags"], data["class"], data["angle"] = 3 | 4 << 4, 0b1001 | 2 << 4, 17, 1000
    for n in ("gps_time", "red", "green", "blue", "nir"):
        if n in data.dtype.names:
            data[n] = np.arange(len(xyz)) * 3
    path.write_bytes(bytes(header) + data.tobytes())
    return str(path)


@pytest.mark.parametrize("fmt", [0, 1, 2, 3, 6, 7, 8])
def test_las_round_trip(spark, tmp_path, fmt):
    xyz = [(-100 + i * 0.25, 50 - i * 0.5, i) for i in range(25)]
    path = make_las(tmp_path / "a.las", fmt, xyz, extra=3)
    df = spark.read.format("las").option("rows", "10").load(path)
    rows = sorted(df.collect(), key=lambda r: r.z)
    assert np.allclose([(r.x, r.y, r.z) for r in rows], xyz) and df.rdd.getNumPartitions() == 3
    r = rows[7]
    assert r.intensity == 7 and (r.return_number, r.number_of_returns) == ((1, 2) if fmt < 6 else (3, 4))
    assert r.classification == (2 if fmt < 6 else 17) and r.is_synthetic and r.is_overlap == (fmt >= 6)
    assert abs(r.scan_angle - (-5 if fmt < 6 else 6)) < 1e-6
    assert ("gps_time" in df.columns, "red" in df.columns, "nir" in df.columns) == (fmt in (1, 3, 6, 7, 8), fmt in (2, 3, 7, 8), fmt == 8)
    raw = spark.read.format("las").option("raw", "true").load(path)
    assert raw.schema["x"].dataType.simpleString() == "int"
    back = raw.selectExpr("x * x_scale + x_offset as x", "z * z_scale + z_offset as z").collect()
    assert np.allclose(sorted(r.x for r in back), sorted(p[0] for p in xyz))
    cat = las_header_catalog(spark, path).first()
    assert cat.n_points == 25 and cat.zmax == 24


def test_las_files_and_chunks_are_skipped(spark, tmp_path):
    a = make_las(tmp_path / "a.las", 1, [(i, 0, 0) for i in range(100)], offset=(0, 0, 0))
    b = make_las(tmp_path / "b.las", 1, [(i + 1000, 0, 0) for i in range(100)], offset=(0, 0, 0))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("las").option("stats", "true").option("rows", "10").option("pushdown", "true").load(f"{a},{b}")
        assert df.rdd.getNumPartitions() == 20
        one = df.filter("x > 1085.0")
        assert one.rdd.getNumPartitions() == 2 and one.count() == 14
        assert df.filter("x < 5.0").count() == 5 and df.filter("x > 5000.0").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    make_las(tmp_path / "c.las", 0, [(0, 0, 0)])
    with pytest.raises(Exception, match="schemas differ"):
        spark.read.format("las").load(str(tmp_path / "*.las")).count()
    with pytest.raises(ValueError, match="LAZ"):
        read_points(spark, str(tmp_path / "x.laz"))


@pytest.mark.parametrize("encoding", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply_round_trip(spark, tmp_path, encoding):
    df = spark.createDataFrame([(float(i), -i / 3, i % 128, i - 300, i * 1000, float(i) / 7) for i in range(600)], "x float, y double, a byte, b short, c int, z float")
    path = str(tmp_path / "a.ply")
    assert write_ply(df, path, encoding) == 600
    back = spark.read.format("ply").load(path)
    assert back.schema.names == df.schema.names and [f.dataType for f in back.schema] == [f.dataType for f in df.schema]
    assert sorted(back.collect()) == sorted(df.collect())


def test_ply_asset_like_files(spark, tmp_path):
    p = tmp_path / "a.ply"
    p.write_text("ply\nformat ascii 1.0\ncomment c\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement camera 1\nproperty float w\nend_header\n0 0 1\n1 2 3\n-1 -2 -3\n9\n")
    df = read_points(spark, str(p))
    assert df.count() == 3 and df.schema["x"].metadata["PC:dimension"] == "1"
    p.write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty list uchar int v\nend_header\n1 2\n")
    with pytest.raises(Exception, match="list properties"):
        read_points(spark, str(p)).count()
    with pytest.raises(TypeError):
        write_ply(spark.createDataFrame([("a",)], "s string"), str(tmp_path / "s.ply"))


def test_point_cloud(spark, tmp_path):
    cloud = PointCloud.of_points(spark, [(0, 0, 0), (5, 5), (-1, -2, -3)], grid=4.0)
    assert cloud.dims is Dims.XYZ and cloud.num_points() == 3
    more = cloud.append(spark.createDataFrame([(9.0, -9.0, 1.0)], "x double, y double, z double"))
    assert more.chunk("2_-3_0").count() == 1 and more.catalog().count() == 2
    assert more.push("k", more.chunk("2_-3_0")).flush().num_points() == 5
    assert more.query(Box(("x", "y"), (-1, -2), (5, 5))).count() == 2
    assert sorted(tuple(p) for p in cloud.points())[0] == (-1.0, -2.0, -3.0)
    more.normalized().write(str(tmp_path / "w"), "quadtree")
    assert spark.read.parquet(str(tmp_path / "w")).count() == 4
    assert cloud.transformed(((2, 0, 0), (0, 1, 0), (0, 0, 1))).bounds().range("x") == (-2, 10)


def test_stream_appends_to_cells(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(-i), 0.0) for i in range(20)], "x double, y double, z double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    append_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 5.0).awaitTermination()
    out = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out") + "/*")
    assert out.count() == 20 and out.where("k_x = 1").count() == 5


def test_command_line(spark, tmp_path, capsys):
    las = make_las(tmp_path / "t.las", 3, [(i % 40, i // 40, i % 7) for i in range(1600)], offset=(0, 0, 0))
    (out,) = cli.main(["convert", "-i", las, "--importance", "--compression", "zstd(1)"], spark)
    assert out.endswith("t_convert.parquet") and "i" in spark.read.parquet(out).columns
    (part,) = cli.main(["partition", "-i", out, "--method", "grid(4)"], spark)
    assert part.endswith("t_convert_grid.parquet") and spark.read.parquet(part).count() == 1600
    cli.main(["merge", out, out, str(tmp_path / "m.parquet")], spark)
    assert spark.read.parquet(str(tmp_path / "m.parquet")).count() == 3200
    found = cli.main(["benchmark", part, "--runs", "1", "--sampling"], spark)
    assert found["count"]["rows"] == 1600 and "m_circle" in found and "sample_100000" in found


def test_several_inputs_never_share_an_output(spark, tmp_path):
    for name, base in (("a", 0), ("b", 50)):
        write_ply(spark.createDataFrame([(float(i + base), 0.0, 1.0) for i in range(20)], "x double, y double, z double"), str(tmp_path / f"{name}.ply"))
    a, b, out = str(tmp_path / "a.ply"), str(tmp_path / "b.ply"), str(tmp_path / "out.parquet")
    paths = cli.main(["convert", "-i", a, b, "-o", out], spark)
    assert [spark.read.parquet(p).count() for p in paths] == [20, 20] and len(set(paths)) == 2
    assert spark.read.parquet(cli.main(["convert", "-i", a, b, "-o", str(tmp_path / "one.parquet"), "--merge"], spark)[0]).count() == 40
    os.makedirs(tmp_path / "other")
    shutil.copy(a, tmp_path / "other" / "a.ply")
    with pytest.raises(SystemExit):
        cli.main(["convert", "-i", a, str(tmp_path / "other" / "a.ply"), "-o", str(tmp_path / "folder")], spark)
    merged = str(tmp_path / "m.parquet")
    cli.main(["merge", *paths, merged, "--statistics", "none"], spark)
    groups = bd.row_group_catalog(spark.read.parquet(merged), ("x", "y", "z")).collect()
    assert sum(g.n_points for g in groups) == 40 and all(g.xmin == float("-inf") for g in groups)  # no statistics, and no group of both inputs
    cli.main(["merge", *paths, merged], spark)
    groups = bd.row_group_catalog(spark.read.parquet(merged), ("x", "y", "z")).collect()
    assert sum(g.n_points for g in groups) == 40 and all(g.xmax < 50 or g.xmin >= 50 for g in groups)
    with pytest.raises(ValueError, match="statistics"):
        layout.write_points(spark.range(1), str(tmp_path / "x"), statistics="chunk")


def test_las_catalog_is_written_once_and_read_without_points(spark, tmp_path):
    a = make_las(tmp_path / "a.las", 1, [(i, 0, 0) for i in range(100)], offset=(0, 0, 0))
    where = write_chunk_catalog(spark, a, str(tmp_path / "catalog"), rows=10)
    assert spark.read.parquet(where).count() == 10
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("las").option("catalog", where).option("rows", "10").option("pushdown", "true").load(a)
        assert df.filter("x > 85.0").rdd.getNumPartitions() == 2 and df.filter("x > 85.0").count() == 14
        assert read_points(spark, a, stats=True).filter("x < 5.0").count() == 5
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_remote_folders_and_wildcards(spark, tmp_path):
    for name in "ab":
        write_ply(spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double"), str(tmp_path / f"{name}.ply"))
    assert spark.read.format("ply").load(f"file://{tmp_path}/*.ply").count() == 2
    assert files.glob_paths(f"file://{tmp_path}") == [f"file://{tmp_path}/a.ply", f"file://{tmp_path}/b.ply"]
    write_ply(spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "x double, y double, z double, i double"), str(tmp_path / "c.ply"))
    with pytest.raises(Exception, match="schemas differ"):
        spark.read.format("ply").load(f"{tmp_path}/*.ply").count()
    with pytest.raises(ValueError, match="no file system"):
        files.open_path("nosuch://x/y")
