"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

NAMES = ["pc_bounds_xyz", "pc_rect_s", "pc_rect_m", "pc_circle_s", "pc_circle_m", "pc_sample_importance", "pc_knn", "pc_knn_window", "pc_quadtree_counts", "pc_chunk_cell_hits", "pc_lod_query", "pc_grid_histogram"]


def main() -> None:
    from pyspark.sql import SparkSession

    from lodestrata.operators import layout
    from lodestrata.plans.points import QUERIES, points
    from lodestrata.session import CONF, register

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus)
    for k, v in CONF.items():
        builder = builder.config(k, v)
    spark = register(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times = {}

    def timed(name, run):
        run()
        best = []
        for _ in range(3):
            start = time.time()
            run()
            best.append(time.time() - start)
        times[name] = round(sorted(best)[1], 4)

    for name in NAMES:
        timed(name, lambda name=name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    folder = f"/tmp/lodestrata-bench-{os.getpid()}"
    cloud = points(spark, sf_dir)
    timed("convert_importance", lambda: layout.write_points(layout.add_importance(cloud.drop("i"), keys=["x", "y", "z"]), f"{folder}/convert"))
    for method in ("grid(1)", "grid(8)", "quadtree"):
        timed(f"cluster_{method}", lambda method=method: layout.write_points(layout.cluster(cloud, method, 4096), f"{folder}/{method}", row_group=8192))
    import shutil

    shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
