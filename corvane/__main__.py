"""Command line: ``python -m corvane COMMAND --data-dir DIR --site NAME=BASE_URL ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from corvane.plans.engine import Engine, Layout
from corvane.schema import Site, Sites
from corvane.sources.shipping import ship


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvane", description="Ingest, index and search documentation.")
    p.add_argument("--data-dir", required=True, help="folder of JSON lines and the index")
    p.add_argument("--site", action="append", default=[], metavar="NAME=BASE_URL", required=True)
    p.add_argument("--html", action="append", default=[], metavar="NAME=FOLDER", help="raw HTML of a site")
    commands = p.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="write a site's JSON lines")
    ingest.add_argument("name")
    ingest.add_argument("--docs", help="folder of Markdown files (else the site's HTML)")
    ingest.add_argument("--source", help="folder of Python files")
    commands.add_parser("rebuild", help="index all JSON lines")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("-k", default=10)
    for option in ("in-site", "heading", "keywords"):
        search.add_argument(f"--{option}")
    get = commands.add_parser("get")
    get.add_argument("address")
    get.add_argument("--anchor")
    get.add_argument("--max-chars", type=int)
    api = commands.add_parser("api")
    api.add_argument("symbol")
    api.add_argument("--anchor")
    for name in ("build", "check", "status", "validate", "mode"):
        commands.add_parser(name)
    clean = commands.add_parser("clean")
    clean.add_argument("--force", action="store_true")
    return p


def run(engine: Engine, args: argparse.Namespace):
    match args.command:
        case "ingest":
            site = engine.sites.named(args.name)
            if site is None:
                raise SystemExit(f"unknown site: {args.name}")
            return engine.ingest_source(site, args.docs, args.source) if args.docs or args.source else engine.ingest_html(site)
        case "search":
            return engine.search(args.query, args.k, args.in_site, args.heading, args.keywords)
        case "get":
            return engine.section(args.address, args.anchor) if args.anchor else engine.get(args.address, args.max_chars)
        case "api":
            return engine.api(args.symbol, args.anchor)
        case "clean":
            return engine.clean(args.force)
        case command:
            return getattr(engine, command)()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    pairs = lambda values: dict(v.split("=", 1) for v in values)
    spark = SparkSession.builder.appName("corvane").getOrCreate()
    ship(spark)
    sites = Sites(tuple(Site(n, u) for n, u in pairs(args.site).items()))
    result = run(Engine(spark, sites, Layout(args.data_dir, pairs(args.html))), args)
    if isinstance(result, int):
        print(result)
    else:
        for line in result.toJSON().toLocalIterator():
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
