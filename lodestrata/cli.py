"""Command line: convert, partition, merge, benchmark."""

from __future__ import annotations

import argparse
import json
import random
import statistics
import time

from .operators import layout, query
from .operators.bounds import box_of
from .session import session
from .sources.las import read_points


def benchmark(df, runs: int = 10, sampling: bool = False, seed: int = 76) -> dict[str, dict]:
    """Time the query set over random places; mean and population deviation in seconds, mean rows."""
    out: dict[str, dict] = {}

    def timed(name, make):
        times, rows = [], 0
        for _ in range(runs):
            start = time.time()
            rows += make().count()
            times.append(time.time() - start)
        out[name] = {"mean": statistics.fmean(times), "std": statistics.pstdev(times), "rows": rows / runs}

    rng = random.Random(seed)
    start = time.time()
    n = df.count()
    out["count"] = {"mean": time.time() - start, "rows": n}
    box = box_of(df, ("x", "y"))
    (x0, x1), (y0, y1) = box.range("x"), box.range("y")
    # margins of the query set: 1,000 from the lower and 400 from the upper bound, where the cloud is that wide
    span = lambda a, b: (a + 1000, b - 400) if a + 1000 < b - 400 else (a, b)
    at = lambda: (rng.uniform(*span(x0, x1)), rng.uniform(*span(y0, y1)))
    for name, edge in (("s_rect", 70.0), ("m_rect", 220.0)):
        timed(name, lambda edge=edge: query.rect(df, *at(), edge))
    for name, r in (("s_circle", 25.0), ("m_circle", 100.0)):
        timed(name, lambda r=r: query.circle(df, *at(), r))
    for k in (1000, 5000):
        timed(f"nn_{k}", lambda k=k: query.knn_window(df, *at(), k))
    if sampling and "i" in df.columns:
        for amount in (100_000, 500_000, 700_000):
            timed(f"sample_{amount}", lambda amount=amount: query.importance_sample(df, amount / max(1, n)))
    return out


def main(argv: list[str] | None = None, spark=None):
    parser = argparse.ArgumentParser(prog="lodestrata")
    sub = parser.add_subparsers(dest="command", required=True)
    writing = argparse.ArgumentParser(add_help=False)
    writing.add_argument("--compression", default="uncompressed")
    writing.add_argument("--statistics", choices=("none", "page"), default="page")
    c = sub.add_parser("convert", parents=[writing])
    c.add_argument("-i", "--input", nargs="+", required=True)
    c.add_argument("-o", "--output")
    c.add_argument("--raw", action="store_true")
    c.add_argument("--importance", action="store_true")
    c.add_argument("--merge", action="store_true")
    p = sub.add_parser("partition", parents=[writing])
    p.add_argument("-i", "--input", nargs="+", required=True)
    p.add_argument("-o", "--output")
    p.add_argument("--method", default="quadtree")
    p.add_argument("--merge", action="store_true")
    m = sub.add_parser("merge", parents=[writing])
    m.add_argument("inputs", nargs="+")
    m.add_argument("output")
    m.add_argument("--importance", action="store_true")
    b = sub.add_parser("benchmark")
    b.add_argument("input")
    b.add_argument("--collect-statistics", action="store_true")
    b.add_argument("--sampling", action="store_true")
    b.add_argument("--runs", type=int, default=10)
    args = parser.parse_args(argv)
    spark = spark or session()

    if args.command == "benchmark":
        df = read_points(spark, args.input, stats=args.collect_statistics)
        print(json.dumps(found := benchmark(df, args.runs, args.sampling)))
        return found
    codec = layout.Codec.parse(args.compression)
    if args.command == "merge":
        if args.importance:
            df = layout.add_importance(spark.read.parquet(*args.inputs))
            layout.write_points(df, args.output, codec, statistics=args.statistics)
        else:
            layout.merge(spark, args.inputs, args.output, codec, statistics=args.statistics)
        return [args.output]
    groups = [args.input] if args.merge else [[f] for f in args.input]
    suffix, paths = "convert" if args.command == "convert" else args.method.split("(")[0], []
    targets = [layout.output_path(g, args.output, suffix, len(groups) > 1) for g in groups]
    if len(set(targets)) < len(targets):
        parser.error(f"several inputs would go to one output: {', '.join(sorted({t for t in targets if targets.count(t) > 1}))}")
    for group, target in zip(groups, targets, strict=True):
        frames = [read_points(spark, f, raw=getattr(args, "raw", False)) for f in group]
        df = frames[0]
        for other in frames[1:]:
            df = df.unionByName(other)
        if args.command == "partition":
            df = layout.cluster(df, args.method)
        elif args.importance:
            df = layout.add_importance(df)
        layout.write_points(df, target, codec, statistics=args.statistics)
        paths.append(target)
    return paths


if __name__ == "__main__":
    main()
