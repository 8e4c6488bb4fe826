"""Command line: python -m lumidex.cli --catalog FOLDER COMMAND. Commands that ask print the rows of one operator."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from lumidex.common import scratch
from lumidex.jobs import package as packaging
from lumidex.jobs import scan as scanning
from lumidex.jobs import serve as serving
from lumidex.operators import mapview, positions, progress, search, stacks
from lumidex.sources import files, pictures, site, transport
from lumidex.sources.catalog import Catalog
from lumidex.sources.plugins import Helper, load_helper
from lumidex.sources.thumbs import Thumbs


def scan(spark: SparkSession, catalog: Catalog, config: dict, thumbs: Thumbs | None = None, helper: Helper = Helper()) -> str:
    """The listing part of the scan command; returns the name of the snapshot written."""
    return scanning.scan(spark, catalog, config, thumbs, helper)


def _scan(spark: SparkSession, catalog: Catalog, config: dict, thumbs: Thumbs, helper: Helper, args) -> None:
    stop = (lambda at=args.abort_file: os.path.exists(at)) if args.abort_file else None
    if not args.no_scan:
        print(scanning.scan(spark, catalog, config, thumbs, helper, stop=stop))
    if not (stop and stop()):
        print(f"{scanning.backfill(catalog, config, helper)} hashes filled in")
    if not args.no_describe and config["endpoint"] and not (stop and stop()):
        libraries = scanning.Libraries.of(config)
        call = transport.caller(libraries.roots, helper.load_image, helper.call_api, pictures.to_jpeg)
        done = scanning.describe_pending(catalog, config, call, helper, args.newest_first, stop) if scanning.describe.endpoints(config) else None
        if done is not None:
            errors = done.filter("info IS NULL").select("id", "error")
            print(f"{done.filter('info IS NOT NULL').count()} described, {errors.count()} in error")
            if args.log_errors:
                errors.write.mode("append").json(args.log_errors)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--catalog", required=True)
    parser.add_argument("--config", default="config.json")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("scan", help="bring the catalog up to the libraries, then describe")
    p.add_argument("--no-scan", action="store_true")
    p.add_argument("--no-describe", action="store_true")
    p.add_argument("--newest-first", action="store_true")
    p.add_argument("--log-errors", help="append the errors of the describer to this folder, as JSON lines")
    p.add_argument("--abort-file", help="stop soon after this file appears")
    p = commands.add_parser("search")
    p.add_argument("query")
    p.add_argument("--library")
    p.add_argument("--stacked", action="store_true")
    p = commands.add_parser("progress")
    p.add_argument("what", choices=["counts", "files"])
    p.add_argument("--newest-first", action="store_true")
    p = commands.add_parser("pins", help="greedy pins of the positions; with --output as a PNG")
    p.add_argument("--output")
    p.add_argument("--basemap")
    p.add_argument("--width", type=int, default=mapview.PIN_WIDTH)
    p.add_argument("--height", type=int, default=mapview.PIN_HEIGHT)
    p.add_argument("--radius", type=float, default=mapview.PIN_RADIUS)
    p = commands.add_parser("tiles", help="cut a world picture into a tile pyramid")
    p.add_argument("source")
    p.add_argument("output")
    p.add_argument("--max-zoom", type=int, default=6)
    p.add_argument("--width", type=int, default=21_600)
    p.add_argument("--height", type=int, default=10_800)
    p.add_argument("--url", help="where to fetch the source from if it is not there")
    p.add_argument("--quality", type=int, default=85)
    p.add_argument("--force", action="store_true")
    p = commands.add_parser("package")
    p.add_argument("output")
    p.add_argument("--tiles")
    p.add_argument("--world", help="picture to cut tiles from where there is no pyramid")
    p = commands.add_parser("serve")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    p.add_argument("--tiles")
    p.add_argument("--world", help="picture to cut missing tiles from")
    return parser


def main(argv: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("lumidex").getOrCreate()
    with scratch(spark):
        _main(spark, _parser().parse_args(argv))


def _main(spark: SparkSession, args) -> None:
    catalog, config = Catalog(spark, args.catalog), site.load_config(args.config)
    thumbs, helper = Thumbs(spark, f"{args.catalog.rstrip('/')}-thumbs"), load_helper(config["helper"])
    show = lambda df: [print(json.dumps(r.asDict(recursive=True), default=str)) for r in df.toLocalIterator()]
    if args.command == "scan":
        _scan(spark, catalog, config, thumbs, helper, args)
    elif args.command == "search":
        rows = search.search(catalog.images(), args.query, args.library)
        show(stacks.capped(stacks.stacks(rows)) if args.stacked else search.top(rows.select("id", "name", "library")))
    elif args.command == "progress" and args.what == "counts":
        columns = ["library", "described", "current", "left", "total", "done"]
        print(progress.grid(columns, [[r[c] for c in columns] for r in progress.counts(catalog.images(), total=True).collect()]))
    elif args.command == "progress":
        show(progress.pending(catalog.images(), args.newest_first))
    elif args.command == "pins":
        pins = mapview.greedy_pins(positions.positions(catalog.images()), args.width, args.height, args.radius)
        if args.output:
            files.write(args.output, mapview.world_picture(pins.toPandas(), args.width, args.height, files.read(args.basemap) if args.basemap else None))
        else:
            show(pins)
    elif args.command == "tiles":
        if args.url and not files.exists(args.source):
            transport.download(args.url, args.source)
        cut = pictures.cut_tiles(mapview.tile_boxes(spark, args.max_zoom, args.width, args.height), args.source, quality=args.quality)
        show(site.write_tiles(cut, args.output, args.force).groupBy("status").count())
        files.write(f"{args.output}/manifest.json", json.dumps({"max_zoom": args.max_zoom}).encode())
    elif args.command == "package":
        print(json.dumps(packaging.package(catalog.images(), config, args.output, thumbs, helper, args.tiles, args.world, pictures.to_jpeg)))
    else:
        serving.server(serving.Routes(catalog, config, thumbs, args.tiles, helper, pictures.to_jpeg, pictures.fallback_tile(args.world) if args.world else None), args.host, args.port).serve_forever()


if __name__ == "__main__":
    main()
