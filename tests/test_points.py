import math
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import expressions as ex
from lodestrata.model import Box, Dims, dims_of, partition_boxes, sort_boxes, tag, validate
from lodestrata.operators import bounds as bd
from lodestrata.operators import decompose as dc
from lodestrata.operators import layout, query, transform
from lodestrata.plans import points as pt

TABLES = ("nation", "region", "customer", "supplier", "part", "orders", "lineitem", "events")


def norm(rows, columns):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted(repr(tuple(value(r[k]) for k in at)) for r in rows)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(pt.QUERIES))
def test_query_against_sql(spark, sf_dir, con, name):
    got = pt.QUERIES[name](spark, sf_dir)
    want = con.sql(pt.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got.collect(), got.columns) == norm(want.fetchall(), want.columns)


boxes = st.builds(lambda p, q: Box.corners(p, q, ("x", "y")), *[st.tuples(*[st.integers(-20, 20).map(float)] * 2)] * 2)


@settings(max_examples=60, deadline=None)
@given(boxes, boxes, st.tuples(*[st.integers(-25, 25).map(float)] * 2))
def test_box_algebra(a, b, p):
    both = a.merged(b)
    assert both.contains(a) and both.contains(b) and both.area() >= max(a.area(), b.area())
    assert a.merged(Box.empty(("x", "y"))) == a and Box.empty(("x", "y")).area() == 0
    assert a.intersects(b) == b.intersects(a) and (not a.intersection_area(b) or a.intersects(b))
    assert a.contains_point(p) == (a.distance_2(p) == 0)
    assert a.distance_2(p) <= a.min_max_distance_2(p)
    assert a.contains_point(a.center()) and a.perimeter() == sum(a.extent())


def test_box_helpers():
    b = Box.corners((3, 1), (1, 2))
    assert (b.lower, b.upper) == ((1, 1), (3, 2))
    assert b.with_importance(0.2, 0.5).with_importance(0.1, 0.3).range("i") == (0.1, 0.3)
    assert Dims.of(["x", "y", "i"]) is Dims.XYI
    with pytest.raises(ValueError):
        Dims.of(["y", "x"])
    other = Box.point((0, 5))
    assert sort_boxes([b, other], "x")[0] is other and partition_boxes([b, other], "y", 1) == ([b], [other])
    assert "x1" in b.id()


def test_metadata_and_validation(spark):
    df = tag(spark.createDataFrame([(1.0, 2.0, 3.0, 0.5)], "x double, y double, z double, i float"))
    assert dims_of(df.schema) is Dims.XYZI and dims_of(df.filter("x > 0").schema) is Dims.XYZI
    with pytest.raises(ValueError):
        validate(df.select("x", "y"))
    with pytest.raises(TypeError):
        validate(spark.createDataFrame([(1.0, 2.0, "a")], "x double, y double, z string"))


def test_empty_bounds_are_null(spark):
    df = spark.createDataFrame([], "x double, y double, z double")
    assert bd.bounds(df, Dims.XYZ).first().xmin is None and bd.box_of(df, Dims.XYZ) is None


def test_grid_cells_of_reference_cases(spark):
    box = Box(("x", "y", "z"), (-0.9,) * 3, (0.9,) * 3)
    assert dc.grid_coverage(spark, box, None).count() == 1
    assert dc.grid_coverage(spark, box, 1.0).count() == 8


def test_each_point_in_one_quadtree_cell(spark, sf_dir):
    df = pt.points(spark, sf_dir)
    placed = dc.assign_quadtree(df, pt.ROOT, pt.DEPTH)
    cells = dc.quadtree_cells(spark, pt.ROOT, pt.DEPTH)
    inside = placed.join(cells, ["level", "col", "row"]).where("x >= xmin and x <= xmax and y >= ymin and y <= ymax and i >= imin and i <= imax")
    assert inside.count() == df.count()
    edge = spark.createDataFrame([(2700.0, 2700.0, 1.0), (0.0, 0.0, 0.0)], "x double, y double, i double")
    assert sorted(tuple(r)[3:] for r in dc.assign_quadtree(edge, pt.ROOT, 3).collect()) == [(0, 0, 0), (3, 7, 7)]


def test_sizes_of_small_clouds():
    root, depth = dc.quadtree_size(10, Box(("x", "y"), (0, 0), (5, 1)))
    assert depth == 0 and root.contains(Box(("x", "y"), (0, 0), (5, 1)))
    assert dc.grid_size(10, 100.0, 8) == 10.0


def test_knn_is_exact(spark, sf_dir):
    df = pt.points(spark, sf_dir)
    rows = sorted(((r.x - 5000) ** 2 + (r.y + 100) ** 2, *[r[k] for k in pt.KEYS]) for r in df.collect())
    got = [(r.d, *[r[k] for k in pt.KEYS]) for r in query.knn(df, 5000.0, -100.0, 30, pt.KEYS).collect()]
    assert [g[1:] for g in got] == [r[1:] for r in rows[:30]]
    assert query.knn(df, 0.0, 0.0, 10**6).count() == df.count()
    assert query.knn(df.limit(0), 0.0, 0.0, 3).count() == 0


def test_filters_reach_the_scan(spark, sf_dir, tmp_path):
    pt.points(spark, sf_dir).write.parquet(str(tmp_path / "p"))
    plan = query.circle(spark.read.parquet(str(tmp_path / "p")).select("x", "y"), 1500, 1500, 25)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(x,1475.0)" in plan and "ReadSchema: struct<x:double,y:double>" in plan


def test_cluster_keeps_rows_and_cuts_row_group_hits(spark, sf_dir, tmp_path):
    df = pt.points(spark, sf_dir)
    for method in ("quadtree", "grid(1)", "grid(8)"):
        out = str(tmp_path / method)
        layout.write_points(layout.cluster(df, method, 256, partitions=2), out, layout.Codec.parse("zstd(3)"), row_group=256)
        back = spark.read.parquet(out)
        assert back.count() == df.count() and back.select(*df.columns).exceptAll(df).count() == 0
        groups = bd.row_group_catalog(back)
        assert groups.agg(F.sum("n_points")).first()[0] == df.count() and groups.count() > 10
        cell = Box(("x", "y"), (1000, 1000), (1200, 1200)).with_importance(0.9, 1.0)
        kept = query.prune(groups, cell)
        assert kept.count() < groups.count() / 2
        assert query.box_query(back, cell).count() == query.box_query(df, cell).count()
    assert bd.layout_stats(groups).first().points_mean > 0
    layout.merge(spark, [str(tmp_path / "quadtree"), str(tmp_path / "quadtree")], str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2 * df.count()


def test_cell_hits_by_bins_equal_those_by_broadcast(spark, sf_dir):
    cells, catalog = dc.quadtree_cells(spark, pt.ROOT, 2), bd.chunk_catalog(pt.chunked(pt.points(spark, sf_dir)), "chunk", ("x", "y", "i"))
    key = lambda df: sorted((r.level, r.col, r.row, r.hits) for r in df.collect())
    assert key(query.cell_hits(cells, catalog)) == key(query.cell_hits(cells, catalog, broadcast_rows=1))


def test_importance(spark, sf_dir):
    df = pt.points(spark, sf_dir).drop("i")
    one, two = (layout.add_importance(df, 3, keys=["x", "y", "z"]) for _ in range(2))
    assert one.exceptAll(two).count() == 0
    low, high = layout.add_importance(df, 1, "double").agg(F.min("i"), F.max("i")).first()
    assert 0 <= low < high < 1
    with pytest.raises(TypeError):
        layout.add_importance(df, kind="half")
    with pytest.raises(ValueError):
        layout.Codec.parse("brotli")


def test_output_paths():
    assert layout.output_path(["/a/t.las"], None, "convert") == "/a/t_convert.parquet"
    assert layout.output_path(["/a/t.las"], "/b", "x") == "/b/t.parquet" and layout.output_path(["/a/t.las"], "/b/c.parquet", "x") == "/b/c.parquet"


def test_transforms(spark):
    df = spark.createDataFrame([(1.0, 0.0, 2.0), (-3.0, 4.0, 8.0)], "x double, y double, z double")
    box = bd.box_of(transform.normalize(df), Dims.XYZ)
    assert all(-1 - 1e-9 <= a <= b <= 1 + 1e-9 for a, b in zip(box.lower, box.upper, strict=True))
    r = transform.rotate_z(df, math.pi / 2).first()
    assert abs(r.x) < 1e-12 and abs(r.y - 1) < 1e-12
    assert ex.level_bands(1) == [0.2, 1.0]
    assert transform.hausdorff(df, df).first().hausdorff == 0


def test_registration_finds_the_turn(spark):
    pts = [(1.0, 0.0, 0.0), (2.0, 0.5, 1.0), (-1.0, 3.0, 2.0), (0.2, -2.0, 1.0)]
    a = spark.createDataFrame(pts, "x double, y double, z double")
    angle = transform.register_rotation(a, transform.rotate_z(a, 1.1), rounds=3)
    assert abs(angle - 1.1) < 0.01


def test_hausdorff_of_whole_clouds(spark):
    rng = random.Random(3)
    cloud = lambda n, dx: [(rng.random() * 50 + dx, rng.random() * 9, float(rng.randrange(5))) for _ in range(n)]
    for p, q in ((cloud(900, 0), [*cloud(700, 0), (400.0, -30.0, 2.0)]), (cloud(600, 0), cloud(500, 80)), ([(1.0, 1.0, 1.0)] * 3, cloud(400, 0))):
        want = max(max(min(math.dist(a, b) for b in there) for a in here) for here, there in ((p, q), (q, p)))
        a, b = (spark.createDataFrame(c, "x double, y double, z double") for c in (p, q))
        assert abs(transform.hausdorff(a, b).first().hausdorff - want) < 1e-9
    assert transform.hausdorff(a, b.limit(0)).first().hausdorff is None


def test_hausdorff_query_sees_every_point(spark, sf_dir, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf_dir}/lineitem.parquet")
    keys = t["l_orderkey"].to_pylist()
    k = next(k for k, key in enumerate(keys) if key % 40 > 2 and t["l_linestatus"][k].as_py() == "O")  # outside the ids that pc_hausdorff takes
    far = [x if j != k else 400_000.0 for j, x in enumerate(t["l_extendedprice"].to_pylist())]
    name = t.schema.get_field_index("l_extendedprice")
    pq.write_table(t.set_column(name, t.schema.field(name), pa.array(far, t.schema.field(name).type)), tmp_path / "lineitem.parquet")
    assert pt.QUERIES["pc_hausdorff"](spark, str(tmp_path)).first().hausdorff > 5000


def test_knn_by_catalog_and_radius(spark, sf_dir):
    df = pt.points(spark, sf_dir)
    want = [(r.d, r.l_orderkey) for r in query.knn(df, 1500.0, 1500.0, 50, pt.KEYS).collect()]
    catalog = bd.chunk_catalog(dc.assign_grid(df, 100.0), "k_x", ("x", "y"))
    for more in ({"catalog": catalog}, {"start": 300.0}, {"start": 0.001}, {"start": 0.001, "catalog": catalog}):
        assert [(r.d, r.l_orderkey) for r in query.knn(df, 1500.0, 1500.0, 50, pt.KEYS, **more).collect()] == want
    assert query.knn(df, 1500.0, 1500.0, 10**6, catalog=catalog).count() == df.where("x is not null and y is not null").count()


def test_cell_hits_by_bins_as_by_nested_loop(spark, sf_dir):
    cells, catalog = dc.quadtree_cells(spark, pt.ROOT, 3), bd.chunk_catalog(dc.assign_grid(pt.points(spark, sf_dir), 150.0).withColumn("chunk", F.concat_ws("_", "k_x", "k_y")), "chunk", ("x", "y", "i"))
    plain = sorted(map(tuple, query.cell_hits(cells, catalog).collect()))
    assert sorted(map(tuple, query.cell_hits(cells, catalog, most_tests=1).collect())) == plain
    assert sorted(map(tuple, query.cell_hits(cells, catalog, broadcast_rows=1).collect())) == plain


def test_row_groups_are_read_by_name(spark, sf_dir, tmp_path):
    layout.write_points(layout.cluster(pt.points(spark, sf_dir), "quadtree", 500), str(tmp_path / "c"), row_group=500)
    cloud = spark.read.parquet(str(tmp_path / "c"))
    catalog = bd.row_group_catalog(cloud)
    some = catalog.orderBy("xmin", "file", "row_group").limit(3)
    assert bd.read_row_groups(some, cloud).count() == sum(r.n_points for r in some.collect())
    assert bd.read_row_groups(catalog, cloud, ["x", "i"]).columns == ["x", "i"]
    box = pt.LOD
    assert query.prune(catalog, box).count() < catalog.count()
    key = lambda df: sorted((r.l_orderkey, r.l_linenumber, r.x) for r in df.collect())
    assert key(query.lod_query(cloud, catalog, box)) == key(query.cell_query(cloud, box))


def test_quadtree_layout_of_points_on_a_border(spark):
    """The root box's corners are rounded; cells come from its side itself, as in the SQL."""
    cloud = spark.createDataFrame([(22.5455 if k % 2 else 2624.947, (1.0, 1250.0, 2499.0)[k % 3], k / 60) for k in range(60)], "x double, y double, i double")
    got = {(r.level, r.row) for r in layout.cluster(cloud, "quadtree", 4).where("y = 1250 and level > 0").collect()}
    edge = (2624.947 - 22.5455) + 0.1
    want = {level: math.floor((1250.0 - (1250.0 - edge / 2)) / (edge / 2**level)) for level, _ in got}
    assert got and got == set(want.items())


def test_interval_join_makes_no_pairs(spark, sf_dir, tmp_path):
    """Quantities between the bins, on their borders, null and not finite; repeated parts. No step makes a row for each pair."""
    q = [None, float("nan"), float("inf"), -1.0, -0.5, 0.0, 1.0, 1.5, 2.0, 2.000001, 3.0, 1e300] * 50
    spark.createDataFrame([(v,) for v in q], "l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, -1), (3, None), (None, 1), (4, 2147483646), (5, 9)] * 3, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    c = duckdb.connect()
    for t in ("lineitem", "part"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = pt.QUERIES["sql_interval_join"](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, c.sql(pt.ORACLE["sql_interval_join"]).fetchall()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2 and plan.count("Aggregate") >= 4  # lines are counted before they are joined


def test_hausdorff_sends_each_point_to_one_tile(spark, monkeypatch):
    """Many tiles of uneven clouds with copies equal brute force; no point is sent to 27 cells first."""
    import numpy as np

    rng = np.random.default_rng(5)
    a = np.concatenate([rng.random((3000, 3)), np.repeat(rng.random((5, 3)), 200, axis=0), [[1.4, 0.2, 0.5], [0.3, 0.3, 1.2]]])
    b = np.concatenate([rng.random((2500, 3)) * [1.1, 1, 1], [[-0.2, 0.5, 0.5]]])
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    want = max(d.min(1).max(), d.min(0).max())
    monkeypatch.setattr(transform, "TILE", 300)
    monkeypatch.setattr(transform, "LEAF", 40)
    opened = []
    farthest = transform._farthest
    monkeypatch.setattr(transform, "_farthest", lambda p, *rest: (opened.append(p.count()), farthest(p, *rest))[1])
    frames = [spark.createDataFrame([tuple(map(float, r)) for r in c], "x double, y double, z double") for c in (a, b)]
    got = transform.hausdorff(*frames).first()[0]
    assert got == pytest.approx(want, rel=1e-12) and sum(opened) < 300
