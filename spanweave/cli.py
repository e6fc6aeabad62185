"""Command line: run, benchmark, list-algorithms and info."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import api
from .operators import solvers
from .sources import readers


def chosen(text: str, include_slow: bool) -> list[str]:
    """'all' means the fast algorithms unless slow ones are asked for; else a comma-separated list."""
    if text == "all":
        return list(solvers.REGISTRY) if include_slow else solvers.fast_names()
    return [n.strip() for n in text.split(",") if n.strip()]


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spanweave", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "benchmark"):
        p = sub.add_parser(name)
        p.add_argument("roads")
        p.add_argument("locations")
        p.add_argument("-a", "--algorithms", default=api.DEFAULT_ALGORITHM if name == "run" else "all")
        p.add_argument("-o", "--output")
        p.add_argument("--include-slow", action="store_true")
        p.add_argument("--max-snap", type=float, default=200.0)
        p.add_argument("--max-terminals", type=int)
    sub.add_parser("list-algorithms")
    sub.add_parser("info").add_argument("layer")
    options = parser.parse_args(args)
    if options.command == "list-algorithms":
        for name, (_, fast, about) in solvers.REGISTRY.items():
            print(f"{name:<26}{'fast' if fast else 'slow':<6}{about}")
        return 0
    spark = SparkSession.builder.appName("spanweave").getOrCreate()
    if options.command == "info":
        layer = readers.read_geojson(spark, options.layer)
        layer.groupBy("kind").count().orderBy("kind").show()
        return 0
    names = chosen(options.algorithms, options.include_slow)
    config = api.Config(max_snap_m=options.max_snap, max_terminals=options.max_terminals, algorithm=names[0])
    network, _ = api.solve_files(spark, options.roads, options.locations, config)
    if options.command == "benchmark":
        rows = api.benchmark(spark, {"input": (network.edges, network.terminals)}, names)
        rows.show(truncate=False)
        if options.output:
            rows.write.mode("overwrite").json(options.output)
        return 0
    for name in names[1:]:
        network.solve(name)
    for name, found in network.results.items():
        print(f"{name}: {found.total_weight / 1000:.1f} m, connected: {found.is_connected}")
        if options.output:
            network.export(name, f"{options.output}/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
