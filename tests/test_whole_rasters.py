"""Queries over rasters that are higher than those of the oracles' tables read all of their rows."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rastrella import catalog
from rastrella.operators import raster as op
from rastrella.sources.fixtures import raster

LARGE = "/root/testdata/sf0.1"


def resized(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """Plain bilinear samples, truncated."""
    sh, sw = image.shape
    sy, sx = (np.arange(h) + 0.5) / h * sh, (np.arange(w) + 0.5) / w * sw
    y0, x0 = np.minimum(np.floor(sy).astype(int), sh - 1), np.minimum(np.floor(sx).astype(int), sw - 1)
    y1, x1, dy, dx = np.minimum(y0 + 1, sh - 1), np.minimum(x0 + 1, sw - 1), (sy - y0)[:, None], sx - x0
    top = image[y0][:, x0] + dx * (image[y0][:, x1] - image[y0][:, x0])
    low = image[y1][:, x0] + dx * (image[y1][:, x1] - image[y1][:, x0])
    return np.floor(top + dy * (low - top) + 1e-7).astype(int)


def test_tile_pyramid_reads_whole_raster(spark):
    rows = raster(spark, LARGE, "rgb").select("y", "x", "r").toPandas()
    image = np.zeros((rows["y"].max() + 1, rows["x"].max() + 1))
    image[rows["y"], rows["x"]] = rows["r"]
    assert image.shape[0] > 200
    want = Counter()
    for z, (w, h) in catalog._LEVELS.items():
        for (y, x), v in np.ndenumerate(resized(image, w, h)):
            want[z, y // 64, x // 64] += int(v)
    assert {(r["z"], r["ty"], r["tx"]): r["total"] for r in catalog.queries()["tile_pyramid"](spark, LARGE).collect()} == want


def test_warp_utm_reads_whole_raster(spark):
    px = raster(spark, LARGE, "radar").select("y", "x", F.col("dn").alias("v"), F.when(F.col("dn") % 7 == 0, 0).otherwise(255).alias("a"))
    assert px.agg(F.max("y")).first()[0] == 1499
    want = op.warp_utm(px, catalog._UTM_BOX, catalog._UTM_ZONE, 100, 1500, *catalog._UTM_OUT)
    assert sorted(map(tuple, catalog.queries()["warp_utm"](spark, LARGE).collect())) == sorted(map(tuple, want.collect()))
