"""Command line: ``python -m callweave.cli file:function [options]``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import exact
from .session import Project, rendered


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="callweave", description="Explore the calls of a code base.")
    p.add_argument("entry", help="file:function, a function's name, or with --describe words that describe it")
    p.add_argument("--project", default=".")
    p.add_argument("--format", choices=("json", "mermaid", "text"), default=None)
    p.add_argument("--direction", choices=("downstream", "upstream", "bidirectional"), default="downstream")
    p.add_argument("--depth", type=int)
    p.add_argument("--max-nodes", type=int, default=exact.MOST_NODES)
    p.add_argument("--no-conditionals", action="store_true")
    p.add_argument("--include-unresolved", action="store_true")
    p.add_argument("--describe", action="store_true")
    p.add_argument("--output")
    args = p.parse_args(argv)
    if args.depth is not None and args.depth < 0:
        p.error("--depth must not be negative")
    return args


def main(argv: list[str] | None = None) -> int:
    args = arguments(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("callweave").getOrCreate()
    project = Project.open(spark, str(Path(args.project).resolve()))
    if args.describe:
        best = project.rank(args.entry).first()
        entry = best["node_id"] if best else None
    else:
        entry = project.entry(args.entry)
    if entry is None:
        print(f"No symbol matches {args.entry}", file=sys.stderr)
        return 1
    depth = args.depth if args.depth is not None else None if project.config.default_depth == float("inf") else int(project.config.default_depth)
    g = project.graph(entry, args.direction, exact.Options(depth, args.max_nodes, not args.no_conditionals))
    if not args.include_unresolved:
        g = exact.without_unresolved(g)
    text = rendered(g, args.format or project.config.default_format, project.root)
    if args.output:
        Path(args.output).write_text(text)
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
