"""Command line: ``python -m rastrella [flags] request...``; ``-`` reads requests from standard input."""

from __future__ import annotations

import logging
import os
import sys
import time

from pyspark.sql import SparkSession

from rastrella.plans import execute, options

LEVELS = {-2: logging.CRITICAL, -1: logging.ERROR, 0: logging.WARNING, 1: logging.INFO, 2: logging.DEBUG}


def main(args: list[str]) -> int:
    """Serve the requests, write one file for each and format, and print the manifest; 0, 1 for bad flags, 2 for failures."""
    try:
        chosen = options.parse(args)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    if chosen.show:
        print(__doc__ if chosen.show == "help" else "rastrella 0.2")
        return 0
    logging.basicConfig(level=LEVELS[max(-2, min(2, chosen.level))], format="%(levelname)s %(message)s")
    spark = SparkSession.builder.appName("rastrella").getOrCreate()
    lines = [line.strip() for line in sys.stdin if line.strip()] if chosen.inputs == ("-",) else list(chosen.inputs)
    table = spark.createDataFrame(list(enumerate(lines)), "req_id long, request string")
    paths = sorted({f for line in lines for f in line.split(":")[0].split("@")[-1].split(",")})
    there = [p for p in paths if os.path.exists(p)]
    # the driver opens the command line's few files; execute.run takes any relation of paths and bytes
    files = spark.createDataFrame([(p, open(p, "rb").read()) for p in there], "path string, data binary")
    failed, began = 0, time.perf_counter()
    for kind in chosen.whole_formats():
        kind = "PNM" if kind == "RAW" else kind
        if kind not in ("PNG", "PNM", "JPEG", "WEBP"):
            logging.error("%s cannot be written", kind)
            failed = 2
            continue
        more = {"quality": chosen.quality} if kind == "JPEG" and chosen.quality else {}
        images, manifest = execute.run(table, files, kind, chosen.folder, chosen.fill, chosen.memory_limit, **more)
        for row in images.join(manifest.select("req_id", "outfile"), "req_id").toLocalIterator():
            with open(row["outfile"], "wb") as out:
                out.write(row["data"])
        for row in manifest.orderBy("req_id").toLocalIterator():
            logging.info("%s: %s (%s B)", row["infile"], row["status"], row["size"])
            if row["entry"]:
                print(row["entry"])
        failed = max(failed, execute.exit_code(manifest))
        logging.debug("%s: %.1f s since the start", kind, time.perf_counter() - began)
    if chosen.zooms:
        if chosen.tile not in (None, "PNG"):
            logging.warning("tiles are written as PNG")
        names = {r["req_id"]: r["name"] for r in execute.plan(table).toLocalIterator()}
        for row in execute.map_tiles(table, files, chosen.zooms, fill=chosen.fill).toLocalIterator():
            path = f"{chosen.folder}{names[row['req_id']]}/{row['path'].split('/', 1)[1]}"
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as out:
                out.write(row["data"])
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
