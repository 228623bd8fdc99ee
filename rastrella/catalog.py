"""All queries of the raster engine and, for each that SQL can express, DuckDB SQL over the same tables."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrella.functions import geo, pixels, requests
from rastrella.operators import blocks
from rastrella.operators import raster as op
from rastrella.plans import execute, strategy
from rastrella.sources import headers, images
from rastrella.sources.fixtures import duck, raster
from rastrella.streaming import feed

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# SQL spellings of the pixel functions


def _trunc(x: str) -> str:
    return f"CAST(floor({x} + 1e-7) AS INTEGER)"


def _sat(x: str) -> str:
    return f"least(greatest({x}, 0.0), 1.0)"


def _boa(dn: str) -> str:
    return _trunc(_sat(f"({dn} - 1000) / CAST(10000 AS DOUBLE)") + " * 65535")


def _ramp(nd: str, name: str, shift: int) -> str:
    points = pixels.RAMPS[name]
    level = lambda c: c >> shift & 255
    cases = [f"WHEN {nd} <= {points[0][0]} THEN {level(points[0][1])}"]
    for (lo, c1), (hi, c2) in zip(points, points[1:]):
        span = f"CAST({hi - lo!r} AS DOUBLE)"
        t = f"({nd} - CAST({lo} AS DOUBLE))"
        cases.append(f"WHEN {nd} <= {hi} THEN CAST(floor({level(c1)} * ({span} - {t}) / {span} + {level(c2)} * {t} / {span} + 0.5000001) AS INTEGER)")
    return f"CASE {' '.join(cases)} ELSE {level(points[-1][1])} END"


_PIXELS = duck("bands")[:-1] + f", px AS (SELECT band, y, x, {_boa('dn')} AS v, CASE WHEN dn = 0 THEN 0 ELSE 255 END AS a FROM bands) "
#: Half-pixel samples of every band by clamped self-joins, side by side.
_SAMPLED = (
    _PIXELS[:-1]
    + """, edge AS (SELECT max(x) mx, max(y) my FROM px), s AS (
  SELECT p.band, p.y, p.x, (p.v + 0.5 * (r.v - p.v)) + 0.5 * ((d.v + 0.5 * (q.v - d.v)) - (p.v + 0.5 * (r.v - p.v))) AS v,
         CAST(floor((p.a + r.a + d.a + q.a) / 4.0 + 1e-7) AS INTEGER) AS a
  FROM px p, edge, px r, px d, px q
  WHERE r.band = p.band AND r.y = p.y AND r.x = least(p.x + 1, mx) AND d.band = p.band AND d.y = least(p.y + 1, my) AND d.x = p.x
    AND q.band = p.band AND q.y = least(p.y + 1, my) AND q.x = least(p.x + 1, mx)),
st AS (SELECT y, x, max(CASE WHEN band = 0 THEN v END) b0, max(CASE WHEN band = 1 THEN v END) b1, max(CASE WHEN band = 2 THEN v END) b2,
         max(CASE WHEN band = 3 THEN v END) b3, max(CASE WHEN band = 0 THEN a END) a FROM s GROUP BY y, x),
nd AS (SELECT *, (b0 - b1) / (b0 + b1 + 1e-9) AS i FROM st) """
)


def _coloured(r: str, g: str, b: str) -> str:
    return _SAMPLED + "SELECT y, x, " + ", ".join(f"CAST(CASE WHEN a = 255 THEN {e} ELSE 0 END AS INTEGER) AS {n}" for e, n in ((r, "r"), (g, "g"), (b, "b"))) + ", a FROM nd"


def _ramped(name: str) -> str:
    return _coloured(*(_ramp("i", name, s) for s in (16, 8, 0)))


# radiometry


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir, "bands").select("band", "y", "x", pixels.boa(F.col("dn")).alias("v"), pixels.nodata_alpha(F.col("dn")).alias("a"))


@query(duck("bands") + f"SELECT band, y, x, {_boa('dn')} AS v FROM bands")
def px_boa(spark, sf_dir):
    return _levels(spark, sf_dir).select("band", "y", "x", "v")


@query(duck("bands") + "SELECT band, y, x, CASE WHEN dn = 0 THEN 0 ELSE 255 END AS a FROM bands")
def px_nodata_alpha(spark, sf_dir):
    return _levels(spark, sf_dir).select("band", "y", "x", "a")


@query(duck("bands") + f"SELECT band, y, x, {_boa('dn')} >> 8 AS v FROM bands")
def px_16to8(spark, sf_dir):
    return _levels(spark, sf_dir).select("band", "y", "x", pixels.to_8bit(F.col("v")).alias("v"))


@query(duck("complex") + "SELECT l_orderkey, l_linenumber, CAST(floor(sqrt(CAST(i * i + q * q AS DOUBLE)) + 1e-7) AS INTEGER) AS mag FROM complex")
def px_complex_mag(spark, sf_dir):
    return raster(spark, sf_dir, "complex").select("l_orderkey", "l_linenumber", pixels.complex_magnitude(F.col("i"), F.col("q")).alias("mag"))


@query(duck("radar") + f", s AS (SELECT least(avg(dn) + 2 * stddev_pop(dn), max(dn)) AS scale FROM radar) SELECT y, x, {_trunc(_sat('CASE WHEN scale = 0 THEN 0 ELSE dn / scale END') + ' * 255')} AS level FROM radar, s")
def px_equalise(spark, sf_dir):
    return op.equalise(raster(spark, sf_dir, "radar"), "dn").select("y", "x", "level")


@query(duck("radar") + "SELECT count(dn) AS n, round(avg(dn), 6) AS mean, round(stddev_pop(dn), 6) AS std, min(dn) AS low, max(dn) AS high FROM radar")
def stats_global(spark, sf_dir):
    return op.statistics(raster(spark, sf_dir, "radar"), "dn").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(duck("radar") + "SELECT dn >> 8 AS v, count(*) AS n FROM radar GROUP BY 1")
def value_histogram(spark, sf_dir):
    return raster(spark, sf_dir, "radar").groupBy(F.shiftright("dn", 8).alias("v")).agg(F.count("*").alias("n"))


# colours


_LUMA = "(16839 * {r} + 33059 * {g} + 6420 * {b} + 32768 + 1048576) >> 16"


@query(duck("rgb") + f"SELECT y, x, {_LUMA.format(r='r', g='r', b='r')} AS luma FROM rgb")
def px_gray_limited(spark, sf_dir):
    r = F.col("r")
    return raster(spark, sf_dir, "rgb").select("y", "x", pixels.luma(r, r, r).alias("luma"))


@query(duck("rgb") + f"SELECT y, x, {_LUMA.format(r='r', g='g', b='b')} AS luma FROM rgb")
def px_rgb_to_y(spark, sf_dir):
    return raster(spark, sf_dir, "rgb").select("y", "x", pixels.luma(F.col("r"), F.col("g"), F.col("b")).alias("luma"))


@query(duck("rgb") + "SELECT y, x, CAST(r AS BIGINT) * 16777216 + g * 65536 + b * 256 + a AS rgba FROM rgb")
def px_rgba_pack(spark, sf_dir):
    c = {n: F.col(n).cast("long") for n in "rgba"}
    packed = F.shiftleft(c["r"], 24).bitwiseOR(F.shiftleft(c["g"], 16)).bitwiseOR(F.shiftleft(c["b"], 8)).bitwiseOR(c["a"])
    return raster(spark, sf_dir, "rgb").select("y", "x", packed.alias("rgba"))


@query(duck("rgb") + "SELECT y, x, r AS gray, a FROM rgb")
def px_rgba_gray(spark, sf_dir):
    return raster(spark, sf_dir, "rgb").select("y", "x", F.col("r").alias("gray"), "a")


_CLIP = "least(255, greatest(0, ({v} + 33554432 + 131072) >> 18))"


@query(
    duck("rgb")[:-1]
    + ", sz AS (SELECT max(x) AS mx, max(y) AS my FROM rgb), e AS (SELECT rgb.*, (CASE WHEN x = mx AND mx % 2 = 0 THEN 2 ELSE 1 END) * (CASE WHEN y = my AND my % 2 = 0 THEN 2 ELSE 1 END) AS w FROM rgb, sz), s AS (SELECT CAST(floor(y / 2) AS INTEGER) AS by_, CAST(floor(x / 2) AS INTEGER) AS bx, CAST(sum(r * w) AS BIGINT) r, CAST(sum(g * w) AS BIGINT) g, CAST(sum(b * w) AS BIGINT) b FROM e GROUP BY 1, 2) "
    + f"SELECT by_ AS \"by\", bx, CAST({_CLIP.format(v='(-9719 * r - 19081 * g + 28800 * b)')} AS INTEGER) AS u, CAST({_CLIP.format(v='(28800 * r - 24116 * g - 4684 * b)')} AS INTEGER) AS v FROM s"
)
def yuv420_planes(spark, sf_dir):
    px = raster(spark, sf_dir, "rgb")
    return op.chroma_420(px, *px.agg(F.max("x") + 1, F.max("y") + 1).first())


# features


def _feature(spark, sf_dir, name: str, *bands: int) -> DataFrame:
    return blocks.combine(_levels(spark, sf_dir), name, bands)


@query(_coloured(*[_trunc(_sat("(i + 1) / 2") + " * 255")] * 3))
def nd_unspec(spark, sf_dir):
    return _feature(spark, sf_dir, "ND_UNSPEC", 0, 1)


@query(_ramped("NDVI"))
def ndvi(spark, sf_dir):
    return _feature(spark, sf_dir, "NDVI", 0, 1)


@query(_ramped("NDMI"))
def ndmi(spark, sf_dir):
    return _feature(spark, sf_dir, "NDMI", 0, 1)


@query(_ramped("NDWI"))
def ndwi(spark, sf_dir):
    return _feature(spark, sf_dir, "NDWI", 0, 1)


def _bright(b: str) -> str:
    return _trunc(_sat(f"{b} / CAST(65535 AS DOUBLE) * 2.5") + " * 255")


@query(_coloured(*(f"CASE WHEN i > 0.42 THEN {snow} ELSE {_bright(b)} END" for snow, b in ((0, "b2"), (204, "b0"), (255, "b3")))))
def ndsi(spark, sf_dir):
    return _feature(spark, sf_dir, "NDSI", 0, 1, 2, 3)


@query(_coloured(*(_trunc(_sat(f"cbrt(CAST(0.6 AS DOUBLE) * {b} / CAST(65535 AS DOUBLE) - CAST(0.035 AS DOUBLE))") + " * 255") for b in ("b0", "b1", "b2"))))
def hons(spark, sf_dir):
    return _feature(spark, sf_dir, "HONS", 0, 1, 2)


@query(
    _SAMPLED.replace("AS v, CASE", ">> 8 AS v, CASE", 1) + "SELECT y, x, " + ", ".join(f"{_trunc(b)} AS {n}" for b, n in (("b0", "r"), ("b1", "g"), ("b2", "b"))) + ", a FROM st"
)
def rgb_composite(spark, sf_dir):
    return blocks.combine(_levels(spark, sf_dir).withColumn("v", pixels.to_8bit(F.col("v"))), "", (0, 1, 2))


_HALF = ", half AS (SELECT CAST(y / 2 AS INTEGER) AS y, CAST(x / 2 AS INTEGER) AS x, CAST(v AS DOUBLE) AS v FROM px WHERE band = 1 AND x % 2 = 0 AND y % 2 = 0)"
#: Samples of the coarse band 1 on the grid of band 0, beside those of band 0 itself.
_MIXED = (
    _SAMPLED[: _SAMPLED.index("st AS (")]
    + _HALF[2:]
    + """, hz AS (SELECT max(x) + 1 AS sw, max(y) + 1 AS sh FROM half), fz AS (SELECT max(x) + 1 AS ow, max(y) + 1 AS oh FROM px),
hg AS (SELECT y, x, (x + 0.5) / CAST(ow AS DOUBLE) * sw AS sx, (y + 0.5) / CAST(oh AS DOUBLE) * sh AS sy, sw, sh FROM px, hz, fz WHERE band = 0),
hc AS (SELECT y, x, sx - least(floor(sx), sw - 1) AS dx, sy - least(floor(sy), sh - 1) AS dy, CAST(least(floor(sx), sw - 1) AS INTEGER) AS x0, CAST(least(floor(sx) + 1, sw - 1) AS INTEGER) AS x1, CAST(least(floor(sy), sh - 1) AS INTEGER) AS y0, CAST(least(floor(sy) + 1, sh - 1) AS INTEGER) AS y1 FROM hg),
hs AS (SELECT c.y, c.x, (p.v + dx * (r.v - p.v)) + dy * ((d.v + dx * (q.v - d.v)) - (p.v + dx * (r.v - p.v))) AS v FROM hc c JOIN half p ON p.y * 65536 + p.x = y0 * 65536 + x0 JOIN half r ON r.y * 65536 + r.x = y0 * 65536 + x1 JOIN half d ON d.y * 65536 + d.x = y1 * 65536 + x0 JOIN half q ON q.y * 65536 + q.x = y1 * 65536 + x1),
st AS (SELECT s.y, s.x, s.v AS b0, hs.v AS b1, s.a FROM s JOIN hs ON hs.y = s.y AND hs.x = s.x WHERE s.band = 0),
nd AS (SELECT *, (b0 - b1) / (b0 + b1 + 1e-9) AS i FROM st) """
)


@query(_MIXED + "SELECT y, x, " + ", ".join(f"CAST(CASE WHEN a = 255 THEN {_ramp('i', 'NDMI', k)} ELSE 0 END AS INTEGER) AS {n}" for n, k in (("r", 16), ("g", 8), ("b", 0))) + ", a FROM nd")
def ndmi_mixed(spark, sf_dir):
    """A feature of a fine band and one of half its resolution."""
    levels = _levels(spark, sf_dir)
    return blocks.combine(levels.filter("band = 0").unionByName(op.downscale_nearest(levels.filter("band = 1"), 2)), "NDMI", (0, 1))


_LUT = ", ".join(f"({i}, {c >> 16}, {c >> 8 & 255}, {c & 255})" for i, c in enumerate(pixels.CLASS_COLOURS) if c)


@query(
    duck("classes")
    + f"SELECT y, x, {', '.join(f'CASE WHEN l{n} IS NOT NULL AND a = 255 THEN l{n} ELSE 0 END AS {n}' for n in 'rgb')}, CASE WHEN lr IS NOT NULL AND a = 255 THEN 255 ELSE 0 END AS a FROM classes LEFT JOIN (VALUES {_LUT}) t(k, lr, lg, lb) ON code = k"
)
def scl_classify(spark, sf_dir):
    return op.classify(raster(spark, sf_dir, "classes"))


_NDVI_EDGES = [p[0] for p in pixels.RAMPS["NDVI"]]
_SEGMENT = "CASE " + " ".join(f"WHEN i <= {e} THEN {k}" for k, e in enumerate(_NDVI_EDGES)) + f" ELSE {len(_NDVI_EDGES)} END"


@query(_PIXELS[:-1] + f", n AS (SELECT y, x, (max(CASE WHEN band = 0 THEN v END) - max(CASE WHEN band = 1 THEN v END)) / (max(CASE WHEN band = 0 THEN v END) + max(CASE WHEN band = 1 THEN v END) + CAST(1e-9 AS DOUBLE)) AS i FROM px GROUP BY y, x) SELECT y, x, {_SEGMENT} AS segment FROM n")
def ramp_range_join(spark, sf_dir):
    nd = op.stack(_levels(spark, sf_dir), (0, 1)).withColumn("i", pixels.normalised_difference(F.col("b0").cast("double"), F.col("b1").cast("double")))
    return op.ramp_segments(nd, "i", pixels.RAMPS["NDVI"]).select("y", "x", "segment")


# resampling


@query(_SAMPLED + "SELECT band, y, x, round(v, 6) AS v, a FROM s")
def resample_same_size(spark, sf_dir):
    out = op.resample_same(_levels(spark, sf_dir), ["v", "a"], ["band"])
    return out.select("band", "y", "x", F.round("v", 6).alias("v"), pixels.trunc(F.col("a")).alias("a"))


def _resized(source: str, w: int | str, h: int | str, value: str) -> str:
    """Bilinear samples of ``source (y, x, v)`` on a w x h grid by four joins."""
    return f""", sz AS (SELECT max(x) + 1 AS sw, max(y) + 1 AS sh FROM {source}), o AS (SELECT CAST(gy.i AS INTEGER) AS y, CAST(gx.i AS INTEGER) AS x, (gx.i + 0.5) / CAST({w} AS DOUBLE) * sw AS sx, (gy.i + 0.5) / CAST({h} AS DOUBLE) * sh AS sy, sw, sh FROM sz, range({h}) gy(i), range({w}) gx(i)),
c AS (SELECT y, x, sx - least(floor(sx), sw - 1) AS dx, sy - least(floor(sy), sh - 1) AS dy, CAST(least(floor(sx), sw - 1) AS INTEGER) AS x0, CAST(least(floor(sx) + 1, sw - 1) AS INTEGER) AS x1, CAST(least(floor(sy), sh - 1) AS INTEGER) AS y0, CAST(least(floor(sy) + 1, sh - 1) AS INTEGER) AS y1 FROM o)
SELECT c.y, c.x, {value.format(v='((p.v + dx * (r.v - p.v)) + dy * ((d.v + dx * (q.v - d.v)) - (p.v + dx * (r.v - p.v))))')} AS v FROM c JOIN {source} p ON p.y * 65536 + p.x = y0 * 65536 + x0 JOIN {source} r ON r.y * 65536 + r.x = y0 * 65536 + x1 JOIN {source} d ON d.y * 65536 + d.x = y1 * 65536 + x0 JOIN {source} q ON q.y * 65536 + q.x = y1 * 65536 + x1"""


@query(_PIXELS[:-1] + ", half AS (SELECT CAST(y / 2 AS INTEGER) AS y, CAST(x / 2 AS INTEGER) AS x, CAST(v AS DOUBLE) AS v FROM px WHERE band = 1 AND x % 2 = 0 AND y % 2 = 0)" + _resized("half", 16, 500, "round({v}, 6)"))
def resample_mixed_size(spark, sf_dir):
    half = op.downscale_nearest(_levels(spark, sf_dir).filter("band = 1"), 2)
    return op.resample_to(half, "v", 16, 500).select("y", "x", F.round("v", 6).alias("v"))


@query(duck("rgb")[:-1] + ", red AS (SELECT y, x, CAST(r AS DOUBLE) AS v FROM rgb)" + _resized("red", 37, 101, _trunc("{v}")))
def resize_linear(spark, sf_dir):
    return op.resample_to(raster(spark, sf_dir, "rgb"), "r", 37, 101).select("y", "x", pixels.trunc(F.col("r")).alias("v"))


@query(duck("rgb") + "SELECT CAST(y / 3 AS INTEGER) AS y, CAST(x / 3 AS INTEGER) AS x, r, g, b FROM rgb WHERE x % 3 = 0 AND y % 3 = 0")
def downscale_factor(spark, sf_dir):
    return op.downscale_nearest(raster(spark, sf_dir, "rgb"), 3).select("y", "x", "r", "g", "b")


# sizes


@query(duck("meta") + ", n AS (SELECT raster_id, width * 100 AS w, height * 100 AS h, CAST(width * 100 AS DOUBLE) * (height * 100) * 60 AS need FROM meta), k AS (SELECT *, CAST(greatest(0, ceil(ln(need / 2e9) / ln(4) - 1e-12)) AS INTEGER) AS halvings FROM n) SELECT raster_id, halvings, CAST(floor(w / pow(2, halvings)) AS INTEGER) AS width, CAST(floor(h / pow(2, halvings)) AS INTEGER) AS height FROM k")
def mem_limit_size(spark, sf_dir):
    meta = raster(spark, sf_dir, "meta").select("raster_id", (F.col("width") * 100).alias("w"), (F.col("height") * 100).alias("h"))
    meta = meta.withColumn("halvings", strategy.halvings(F.col("w"), F.col("h"), 3, 2e9))
    return meta.select("raster_id", "halvings", strategy.halved(F.col("w"), F.col("halvings")).alias("width"), strategy.halved(F.col("h"), F.col("halvings")).alias("height"))


@query(duck("meta") + ", n AS (SELECT raster_id, width * 50 AS w, height * 50 AS h FROM meta) SELECT raster_id, CAST(CASE WHEN w <= 16383 AND h <= 16383 THEN w WHEN w > h THEN 16383 ELSE floor(CAST(16383 AS BIGINT) * w / h) END AS INTEGER) AS width, CAST(CASE WHEN w <= 16383 AND h <= 16383 THEN h WHEN w > h THEN floor(CAST(16383 AS BIGINT) * h / w) ELSE 16383 END AS INTEGER) AS height FROM n")
def webp_size_cap(spark, sf_dir):
    w, h = strategy.within_side(F.col("width") * 50, F.col("height") * 50)
    return raster(spark, sf_dir, "meta").select("raster_id", w.alias("width"), h.alias("height"))


# geodesy; the footprints' corners are simple functions of the metadata

_CORNERS = duck("meta")[:-1] + """, f AS (SELECT raster_id, epsg, width, height, (epsg - 32600) * 6 - 183 + (x_min - 500000) / 70000 AS l, (epsg - 32600) * 6 - 183 + (x_min + width * px_w - 500000) / 70000 AS r, y_max / 111000 AS t, (y_max + height * px_h) / 111000 AS b FROM meta) """


def _footprints(spark, sf_dir):
    mid = (F.col("epsg") - 32600) * 6 - 183
    m = raster(spark, sf_dir, "meta").withColumns({"l": mid + (F.col("x_min") - 500000) / 70000, "r": mid + (F.col("x_min") + F.col("width") * F.col("px_w") - 500000) / 70000, "t": F.col("y_max") / 111000, "b": (F.col("y_max") + F.col("height") * F.col("px_h")) / 111000})
    corner = lambda lat, lon: F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    return m.withColumn("corners", F.array(corner("t", "l"), corner("t", "r"), corner("b", "r"), corner("b", "l")))


_BBOX = "CASE WHEN least(l, r) < 0 AND greatest(l, r) >= 0 THEN {a} ELSE {b} END"


@query(_CORNERS + f"SELECT raster_id, '[' || printf('%.6f', {_BBOX.format(a='greatest(l, r)', b='least(l, r)')}) || ', ' || printf('%.6f', least(t, b)) || ', ' || printf('%.6f', {_BBOX.format(a='least(l, r)', b='greatest(l, r)')}) || ', ' || printf('%.6f', greatest(t, b)) || ']' AS bbox FROM f")
def bbox_manifest(spark, sf_dir):
    box = op.lat_lon_box(F.col("corners"))
    swap = (box["lon_min"] < 0) & (box["lon_max"] >= 0)
    values = (F.when(swap, box["lon_max"]).otherwise(box["lon_min"]), box["lat_min"], F.when(swap, box["lon_min"]).otherwise(box["lon_max"]), box["lat_max"])
    return _footprints(spark, sf_dir).select("raster_id", F.format_string("[%.6f, %.6f, %.6f, %.6f]", *values).alias("bbox"))


def _mercator_sql(lat: str, lon: str) -> tuple[str, str]:
    return f"(pi() + radians({lon})) / (2 * pi())", f"(pi() - ln(tan(pi() / 4 + radians({lat}) / 2))) / (2 * pi())"


_MX, _MY = _mercator_sql("lat", "lon")


@query(duck("tie") + f"SELECT gy, gx, round({_MX}, 9) AS mx, round({_MY}, 9) AS my FROM tie")
def webmerc_forward(spark, sf_dir):
    mx, my = geo.mercator(F.col("lat"), F.col("lon"))
    return raster(spark, sf_dir, "tie").select("gy", "gx", F.round(mx, 9).alias("mx"), F.round(my, 9).alias("my"))


@query(duck("tie") + ", m AS (SELECT gy, gx, px / 100.0 AS u, 0.2 + py / 250.0 AS v FROM tie) SELECT gy, gx, round(degrees(2 * atan(exp(pi() * (1 - 2 * v))) - pi() / 2), 9) AS lat, round(360 * u - 180, 9) AS lon FROM m")
def webmerc_inverse(spark, sf_dir):
    lat, lon = geo.geographic(F.col("px") / F.lit(100.0), F.lit(0.2) + F.col("py") / F.lit(250.0))
    return raster(spark, sf_dir, "tie").select("gy", "gx", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


def _utm_sql(lat: str, lon: str, zone: int, source: str, keep: str) -> str:
    """CTE ``u`` with easting and northing ``e, n`` of the rows of ``source``, from the published series' literals."""
    ecc = 2 * math.sqrt(geo._N) / (1 + geo._N)
    x, y = "eta", "xi"
    for j, a in enumerate(geo._ALPHA, 1):
        x += f" + CAST({a!r} AS DOUBLE) * cos({2 * j} * xi) * sinh({2 * j} * eta)"
        y += f" + CAST({a!r} AS DOUBLE) * sin({2 * j} * xi) * cosh({2 * j} * eta)"
    k = f"CAST({geo._K0 * geo._RECT!r} AS DOUBLE)"
    return f""", u0 AS (SELECT {keep}, radians({lon} - {zone * 6 - 183}) AS lam, sinh(atanh(sin(radians({lat}))) - {ecc!r}::DOUBLE * atanh({ecc!r}::DOUBLE * sin(radians({lat})))) AS t FROM {source}),
u1 AS (SELECT {keep}, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM u0), u AS (SELECT {keep}, 500000 + {k} * ({x}) AS e, {k} * ({y}) AS n FROM u1) """


@query(duck("tie")[:-1] + _utm_sql("lat", "lon", 32, "tie", "gy, gx") + "SELECT gy, gx, round(e, 3) AS e, round(n, 3) AS n FROM u")
def utm_forward(spark, sf_dir):
    e, n = geo.utm(F.col("lat"), F.col("lon"), F.lit(32))
    return raster(spark, sf_dir, "tie").select("gy", "gx", F.round(e, 3).alias("e"), F.round(n, 3).alias("n"))


@query(duck("meta") + "SELECT raster_id, x_min AS xleft, y_max AS ytop, x_min + width * px_w AS xright, y_max + height * px_h AS ybottom, epsg BETWEEN 32601 AND 32660 OR epsg BETWEEN 32701 AND 32760 AS utm FROM meta")
def geotransform_bounds(spark, sf_dir):
    return raster(spark, sf_dir, "meta").select("raster_id", F.col("x_min").alias("xleft"), F.col("y_max").alias("ytop"), (F.col("x_min") + F.col("width") * F.col("px_w")).alias("xright"), (F.col("y_max") + F.col("height") * F.col("px_h")).alias("ybottom"), geo.is_utm(F.col("epsg")).alias("utm"))


@query(_CORNERS + f", m AS (SELECT raster_id, {_mercator_sql('t', 'l')[0]} AS xl, {_mercator_sql('t', 'r')[0]} AS xr, {_mercator_sql('t', 'l')[1]} AS yt, {_mercator_sql('b', 'l')[1]} AS yb, t > 85 OR b < -85 AS polar, width, height FROM f) SELECT raster_id, polar, round(xl, 9) AS xl, round(yt, 9) AS yt, round(xr, 9) AS xr, round(yb, 9) AS yb, round((xr - xl) / (yb - yt), 6) AS aspect, CAST(CASE WHEN (xr - xl) / (yb - yt) >= width / height THEN floor(width * ((xr - xl) / (yb - yt))) ELSE width END AS INTEGER) AS out_w, CAST(CASE WHEN (xr - xl) / (yb - yt) >= width / height THEN height ELSE floor(height / ((xr - xl) / (yb - yt))) END AS INTEGER) AS out_h FROM m")
def coords_normalise(spark, sf_dir):
    f = _mercator_boxes(spark, sf_dir)
    box = op.lat_lon_box(F.col("corners"))
    ratio = (F.col("xr") - F.col("xl")) / (F.col("yb") - F.col("yt"))
    w, h = strategy.suggested_size(F.col("width"), F.col("height"), ratio)
    return f.select("raster_id", geo.is_polar(box["lat_min"], box["lat_max"]).alias("polar"), *(F.round(c, 9).alias(c) for c in ("xl", "yt", "xr", "yb")), F.round(ratio, 6).alias("aspect"), w.alias("out_w"), h.alias("out_h"))


def _mercator_boxes(spark, sf_dir):
    (xl, yt), (xr, yb) = geo.mercator(F.col("t"), F.col("l")), geo.mercator(F.col("b"), F.col("r"))
    return _footprints(spark, sf_dir).withColumns({"xl": xl, "yt": yt, "xr": xr, "yb": yb})


def _inverse_sql(x: str, y: str) -> tuple[str, str]:
    """Latitude and longitude of UTM coordinates in the CTE ``p (px, py, zone)``, from the published series' literals."""
    k = f"CAST({geo._K0 * geo._RECT!r} AS DOUBLE)"
    xi, eta = f"({y} / {k})", f"(({x} - 500000) / {k})"
    a, b = xi, eta
    for j, c in enumerate(geo._BETA, 1):
        a += f" - CAST({c!r} AS DOUBLE) * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})"
        b += f" - CAST({c!r} AS DOUBLE) * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})"
    chi = f"asin(sin({a}) / cosh({b}))"
    return f"degrees({chi}" + "".join(f" + CAST({d!r} AS DOUBLE) * sin({2 * j} * {chi})" for j, d in enumerate(geo._DELTA, 1)) + ")", f"zone * 6 - 183 + degrees(atan2(sinh({b}), cos({a})))"


def _footprint_sql() -> str:
    corners = {"tl": ("x_min", "y_max"), "tr": ("x_min + width * px_w", "y_max"), "br": ("x_min + width * px_w", "y_max + height * px_h"), "bl": ("x_min", "y_max + height * px_h")}
    picked = ", ".join(f"round({e}, 8) AS {n}_{k}" for n, (x, y) in corners.items() for k, e in zip(("lat", "lon"), _inverse_sql(f"({x})", f"({y})")))
    return duck("meta")[:-1] + f", p AS (SELECT *, epsg % 100 AS zone FROM meta) SELECT raster_id, {picked} FROM p"


@query(_footprint_sql())
def utm_footprint(spark, sf_dir):
    """Corners of the footprints in degrees, from their affine transforms and coordinate systems."""
    meta = raster(spark, sf_dir, "meta")
    zone, south = geo.zone_of(F.col("epsg"))
    x0, y0 = F.col("x_min"), F.col("y_max")
    x1, y1 = x0 + F.col("width") * F.col("px_w"), y0 + F.col("height") * F.col("px_h")
    out = []
    for name, (x, y) in {"tl": (x0, y0), "tr": (x1, y0), "br": (x1, y1), "bl": (x0, y1)}.items():
        out += [F.round(c, 8).alias(f"{name}_{k}") for k, c in zip(("lat", "lon"), geo.geographic_of_utm(x, y, zone, south))]
    return meta.select("raster_id", *out)


# warps

_UTM_BOX, _UTM_ZONE, _UTM_OUT = (400000.0, 5600000.0, 500000.0, 5450000.0), 33, (60, 80)


def _sampled_at(points: str, px: str, values: str) -> str:
    """Bilinear samples at (sx, sy) of the CTE ``points`` by four joins."""
    lerp = lambda v: f"((p.{v} + dx * (r.{v} - p.{v})) + dy * ((d.{v} + dx * (q.{v} - d.{v})) - (p.{v} + dx * (r.{v} - p.{v}))))"
    picked = ", ".join(f"{lerp(v)} AS {v}" for v in values)
    return f""", ends AS (SELECT max(x) AS ex, max(y) AS ey FROM {px}), c0 AS (SELECT {points}.*, ex, ey, greatest(0, least(CAST(floor(sx) AS INTEGER), ex)) AS x0, greatest(0, least(CAST(floor(sy) AS INTEGER), ey)) AS y0 FROM {points}, ends), c AS (SELECT *, sx - x0 AS dx, sy - y0 AS dy, least(x0 + 1, ex) AS x1, least(y0 + 1, ey) AS y1 FROM c0),
got AS (SELECT c.*, {picked} FROM c JOIN {px} p ON p.y * 65536 + p.x = y0 * 65536 + x0 JOIN {px} r ON r.y * 65536 + r.x = y0 * 65536 + x1 JOIN {px} d ON d.y * 65536 + d.x = y1 * 65536 + x0 JOIN {px} q ON q.y * 65536 + q.x = y1 * 65536 + x1) """


def _grid_sql(bounds: tuple, w: int, h: int) -> str:
    left, top, right, bottom = bounds
    return f", o AS (SELECT CAST(gy.i AS INTEGER) AS y, CAST(gx.i AS INTEGER) AS x, {left!r}::DOUBLE + {right - left!r}::DOUBLE * ((gx.i + 0.5) / {w}::DOUBLE) AS mx, {top!r}::DOUBLE + {bottom - top!r}::DOUBLE * ((gy.i + 0.5) / {h}::DOUBLE) AS my FROM range({h}) gy(i), range({w}) gx(i))"


def _warp_sql() -> str:
    left, top, right, bottom = _UTM_BOX
    geographic = ", g AS (SELECT y, x, degrees(2 * atan(exp(pi() * (1 - 2 * my))) - pi() / 2) AS lat, 360 * mx - 180 AS lon FROM o)"
    source = f", w AS (SELECT y, x, (e - {left}) / {right - left} AS fu, (n - {top}) / {bottom - top} AS fv, (e - {left}) / {right - left} * pw AS sx, (n - {top}) / {bottom - top} * ph AS sy FROM u, (SELECT max(x) + 1 AS pw, max(y) + 1 AS ph FROM radar))"
    px = ", src AS (SELECT y, x, CAST(dn AS DOUBLE) AS v, CASE WHEN dn % 7 = 0 THEN 0 ELSE 255 END AS a FROM radar)"
    ok = "fu BETWEEN 0 AND 1 AND fv BETWEEN 0 AND 1 AND floor(a + 1e-7) = 255"
    return duck("radar")[:-1] + px + _grid_sql(geo.mercator_bounds_of_utm(*_UTM_BOX, _UTM_ZONE), *_UTM_OUT) + geographic + _utm_sql("lat", "lon", _UTM_ZONE, "g", "y, x") + source + _sampled_at("w", "src", "va") + f"SELECT y, x, CASE WHEN {ok} THEN {_trunc('v')} ELSE 0 END AS v, CASE WHEN {ok} THEN 255 ELSE 0 END AS a FROM got"


@query(_warp_sql())
def warp_utm(spark, sf_dir):
    px = raster(spark, sf_dir, "radar").select("y", "x", F.col("dn").alias("v"), F.when(F.col("dn") % 7 == 0, 0).otherwise(255).alias("a"))
    width, height = px.agg(F.max("x") + 1, F.max("y") + 1).first()
    return op.warp_utm(px, _UTM_BOX, _UTM_ZONE, width, height, *_UTM_OUT)


def _warp_rgb_sql() -> str:
    left, top, right, bottom = _UTM_BOX
    geographic = ", g AS (SELECT y, x, degrees(2 * atan(exp(pi() * (1 - 2 * my))) - pi() / 2) AS lat, 360 * mx - 180 AS lon FROM o)"
    source = f", w AS (SELECT y, x, (e - {left}) / {right - left} AS fu, (n - {top}) / {bottom - top} AS fv, (e - {left}) / {right - left} * pw AS sx, (n - {top}) / {bottom - top} * ph AS sy FROM u, (SELECT max(x) + 1 AS pw, max(y) + 1 AS ph FROM rgb))"
    ok = "fu BETWEEN 0 AND 1 AND fv BETWEEN 0 AND 1 AND floor(a + 1e-7) = 255"
    src = ", src AS (SELECT y, x, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b, CAST(a AS DOUBLE) AS a FROM rgb)"
    colours = ", ".join(f"CASE WHEN {ok} THEN {_trunc(c)} ELSE 7 END AS {c}" for c in "rgb")
    return duck("rgb")[:-1] + src + _grid_sql(geo.mercator_bounds_of_utm(*_UTM_BOX, _UTM_ZONE), *_UTM_OUT) + geographic + _utm_sql("lat", "lon", _UTM_ZONE, "g", "y, x") + source + _sampled_at("w", "src", "rgba") + f"SELECT CAST(1 AS BIGINT) AS raster_id, y, x, {colours}, CASE WHEN {ok} THEN 255 ELSE 0 END AS a FROM got"


@query(_warp_rgb_sql())
def warp_utm_rgb(spark, sf_dir):
    """Three channels, reprojected by a row of metadata."""
    px = raster(spark, sf_dir, "rgb").withColumn("raster_id", F.lit(1).cast("long"))
    meta = px.groupBy("raster_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    placed = meta.withColumns({n: F.lit(v) for n, v in zip(("xleft", "ytop", "xright", "ybottom", "epsg", "out_w", "out_h"), (*_UTM_BOX, 32600 + _UTM_ZONE, *_UTM_OUT))})
    return op.warp_utm_each(px, placed, ["r", "g", "b"], ["raster_id"], fill=7)


#: Mercator box around the ground-control points, of which the fixture's formula gives the corners.
_TIE_BOX = (*geo.mercator_point(50.12, 10.0), *geo.mercator_point(48.4, 12.08))
_TIE_SIDE = 100
_CELLS = f""", m AS (SELECT gy, gx, px, py, {_MX} AS u, {_MY} AS v FROM tie), cells AS (SELECT a.gy, a.gx, a.u AS ax, a.v AS ay, b.u AS bx, b.v AS by_, c.u AS cx, c.v AS cy, d.u AS dx_, d.v AS dy_, a.py AS apy, b.px AS bpx, c.py AS cpy, d.px AS dpx
FROM m a JOIN m b ON b.gy = a.gy AND b.gx = a.gx + 1 JOIN m c ON c.gy = a.gy + 1 AND c.gx = a.gx + 1 JOIN m d ON d.gy = a.gy + 1 AND d.gx = a.gx)"""
_CROSSES = {"c1": ("ax", "ay", "bx", "by_"), "c2": ("bx", "by_", "cx", "cy"), "c3": ("cx", "cy", "dx_", "dy_"), "c4": ("dx_", "dy_", "ax", "ay")}
_CROSS_SQL = ", ".join(f"({x2} - {x1}) * (my - {y1}) - ({y2} - {y1}) * (mx - {x1}) AS {n}" for n, (x1, y1, x2, y2) in _CROSSES.items())
_SIDE_SQL = ", ".join(f"sqrt(({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1})) AS l{n[1]}" for n, (x1, y1, x2, y2) in _CROSSES.items())
_HELD = duck("tie")[:-1] + _CELLS + _grid_sql(_TIE_BOX, _TIE_SIDE, _TIE_SIDE) + f", t AS (SELECT o.*, cells.*, {_CROSS_SQL}, {_SIDE_SQL} FROM o, cells), held AS (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY gy, gx) AS k FROM t WHERE least(c1, c2, c3, c4) >= 0 OR greatest(c1, c2, c3, c4) <= 0)"


def _located(spark, sf_dir):
    cells = op.tie_cells(raster(spark, sf_dir, "tie"))
    return op.locate_in_cells(op.mercator_grid(spark, _TIE_BOX, _TIE_SIDE, _TIE_SIDE), cells, _TIE_BOX)


@query(_HELD + " SELECT y, x, gy, gx FROM held WHERE k = 1")
def tie_cell_lookup(spark, sf_dir):
    return _located(spark, sf_dir).select("y", "x", "gy", "gx")


@query(
    _HELD.replace("WITH ", "WITH radar AS (" + duck("radar")[len("WITH radar AS (") : -1] + ", ", 1)
    + ", src AS (SELECT y, x, CAST(dn AS DOUBLE) AS v FROM radar), h AS (SELECT y, x, abs(c1) / l1 AS d1, abs(c2) / l2 AS d2, abs(c3) / l3 AS d3, abs(c4) / l4 AS d4, apy, bpx, cpy, dpx FROM held WHERE k = 1), w AS (SELECT y, x, (bpx * d4 + dpx * d2) / (d2 + d4) * ((ex) / 100.0::DOUBLE) AS sx, (apy * d3 + cpy * d1) / (d1 + d3) * ((ey) / 100.0::DOUBLE) AS sy FROM h, (SELECT max(x) AS ex, max(y) AS ey FROM src))"
    + _sampled_at("w", "src", "v") + f"SELECT y, x, round(sx, 5) AS sx, round(sy, 5) AS sy, CAST(floor(round(v, 4)) AS INTEGER) AS v FROM got"
)
def warp_tie_points(spark, sf_dir):
    """The points' grid of 101 x 101 is stretched over the whole raster."""
    px = raster(spark, sf_dir, "radar").select("y", "x", F.col("dn").alias("v"))
    x_last, y_last = px.agg(F.max("x"), F.max("y")).first()
    points = op.tie_source(_located(spark, sf_dir)).withColumns({"sx": F.col("sx") * F.lit(x_last / 100.0), "sy": F.col("sy") * F.lit(y_last / 100.0)})
    got = op.sample_at(points, px, ["v"], x_last + 1, y_last + 1)
    return got.select("y", "x", F.round("sx", 5).alias("sx"), F.round("sy", 5).alias("sy"), F.floor(F.round("v", 4)).cast("int").alias("v"))


@query(duck("tie") + "SELECT CAST(gy * 5 + gx AS INTEGER) AS i, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, lon, lat, CAST(5 AS BIGINT) AS grid_width FROM tie")
def tie_points_parse(spark, sf_dir):
    tie = raster(spark, sf_dir, "tie")
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("gy", "gx", F.array(F.col("px").cast("double"), F.col("py").cast("double"), F.lit(0.0), F.col("lon"), F.col("lat"), F.lit(0.0)).alias("t")))), lambda p: p["t"]))
    tag = tie.groupBy("raster_id").agg(flat.alias("tag"))
    return op.points_of_tag(tag).select("i", "px", "py", "lon", "lat", "grid_width")


@query(duck("tie") + ", e AS (SELECT *, max(px) OVER () AS mx, max(py) OVER () AS my FROM tie) SELECT raster_id, bit_or(CASE WHEN px = 0 AND py = 0 THEN 1 WHEN px = mx AND py = 0 THEN 2 WHEN px = mx AND py = my THEN 4 WHEN px = 0 AND py = my THEN 8 ELSE 0 END) AS corners, round(min(lat), 9) AS lat_min, round(max(lat), 9) AS lat_max, round(min(lon), 9) AS lon_min, round(max(lon), 9) AS lon_max FROM e GROUP BY raster_id")
def corner_mask(spark, sf_dir):
    tie = raster(spark, sf_dir, "tie")
    size = tie.groupBy("raster_id").agg(F.max("px").alias("mx"), F.max("py").alias("my"))
    px, py, mx, my = map(F.col, ("px", "py", "mx", "my"))
    bit = F.when((px == 0) & (py == 0), 1).when((px == mx) & (py == 0), 2).when((px == mx) & (py == my), 4).when((px == 0) & (py == my), 8).otherwise(0)
    return tie.join(size, "raster_id").groupBy("raster_id").agg(F.bit_or(bit).alias("corners"), *(F.round(f(c), 9).alias(f"{c}_{n}") for c in ("lat", "lon") for f, n in ((F.min, "min"), (F.max, "max"))))


_QUAD = ((10.0, 4.0), (58.0, 9.0), (50.0, 44.0), (3.0, 36.0))


def _triangle_sql(i: int, j: int, k: int) -> str:
    (ax, ay), (bx, by), (cx, cy) = _QUAD[i], _QUAD[j], _QUAD[k]
    area = (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)
    v = f"(((x + 0.5::DOUBLE) - {ax}) * {cy - ay} - {cx - ax} * ((y + 0.5::DOUBLE) - {ay})) / {area}"
    w = f"({bx - ax} * ((y + 0.5::DOUBLE) - {ay}) - ((x + 0.5::DOUBLE) - {ax}) * {by - ay}) / {area}"
    return f"({v} >= 0 AND {w} >= 0 AND 1 - {v} - {w} >= 0)"


@query(f"SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CASE WHEN {_triangle_sql(0, 1, 2)} OR {_triangle_sql(2, 3, 0)} THEN 255 ELSE 0 END AS a FROM range(48) r(y), range(64) c(x)")
def quad_alpha(spark, sf_dir):
    return op.quad_alpha(op.grid(spark, 64, 48), _QUAD)


def _warp_quad_sql() -> str:
    """The eight coefficients come from a linear system here, and from cross products in the operator."""
    out_w, out_h = 64, 48
    rows, right = [], []
    for (x, y), (u, v) in zip(_QUAD, ((0, 0), (1, 0), (1, 1), (0, 1))):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    a, b, c, d, e, f, g, h = (f"({k!r}::DOUBLE)" for k in np.linalg.solve(np.array(rows, float), np.array(right, float)).tolist())
    inside = f"{_triangle_sql(0, 1, 2)} OR {_triangle_sql(2, 3, 0)}"
    grid = f", o AS (SELECT CAST(gy.i AS INTEGER) AS y, CAST(gx.i AS INTEGER) AS x FROM range({out_h}) gy(i), range({out_w}) gx(i)), m AS (SELECT y, x, CASE WHEN {inside} THEN 255 ELSE 0 END AS a0, x + 0.5::DOUBLE AS cx, y + 0.5::DOUBLE AS cy FROM o)"
    at = f", w AS (SELECT y, x, ({a} * cx + {b} * cy + {c}) / ({g} * cx + {h} * cy + 1) * pw AS sx, ({d} * cx + {e} * cy + {f}) / ({g} * cx + {h} * cy + 1) * ph AS sy FROM m, (SELECT max(x) + 1 AS pw, max(y) + 1 AS ph FROM radar) WHERE a0 = 255)"
    px = ", src AS (SELECT y, x, CAST(dn AS DOUBLE) AS v FROM radar)"
    return duck("radar")[:-1] + px + grid + at + _sampled_at("w", "src", "v") + f"SELECT m.y, m.x, CASE WHEN a0 = 255 THEN {_trunc('got.v')} ELSE 0 END AS v, a0 AS a FROM m LEFT JOIN got ON got.y = m.y AND got.x = m.x"


@query(_warp_quad_sql())
def warp_quad(spark, sf_dir):
    px = raster(spark, sf_dir, "radar").select("y", "x", F.col("dn").alias("v"))
    width, height = px.agg(F.max("x") + 1, F.max("y") + 1).first()
    return op.warp_quad(px, _QUAD, ["v"], width, height, 64, 48)


@query(duck("meta") + ", k AS (SELECT *, raster_id % 3 = 0 AS ties, raster_id % 5 <> 0 AS known, CASE WHEN raster_id % 7 = 0 THEN 4326 ELSE epsg END AS crs, CASE WHEN raster_id % 11 = 0 THEN 88 ELSE 40 END AS top FROM meta) SELECT raster_id, CASE WHEN NOT known OR top > 85 THEN 'copy' WHEN crs BETWEEN 32601 AND 32660 OR crs BETWEEN 32701 AND 32760 THEN 'utm' WHEN ties THEN 'ties' ELSE 'quad' END AS strategy FROM k")
def warp_strategy(spark, sf_dir):
    i = F.col("raster_id")
    crs, top = F.when(i % 7 == 0, 4326).otherwise(F.col("epsg")), F.when(i % 11 == 0, 88.0).otherwise(40.0)
    return raster(spark, sf_dir, "meta").select("raster_id", strategy.warp_strategy(crs, i % 5 != 0, i % 3 == 0, F.lit(30.0), top).alias("strategy"))


@query(duck("meta") + f"SELECT raster_id, round((x_min + {geo.HALF_EQUATOR!r}::DOUBLE) / (2 * {geo.HALF_EQUATOR!r}::DOUBLE), 9) AS mx, round(1 - (y_max + {geo.HALF_EQUATOR!r}::DOUBLE) / (2 * {geo.HALF_EQUATOR!r}::DOUBLE), 9) AS my FROM meta")
def metres_to_unit(spark, sf_dir):
    mx, my = geo.metres_to_unit(F.col("x_min"), F.col("y_max"))
    return raster(spark, sf_dir, "meta").select("raster_id", F.round(mx, 9).alias("mx"), F.round(my, 9).alias("my"))


# tiles

_BOXES = _CORNERS[:-1] + f", m AS (SELECT raster_id, {_mercator_sql('t', 'l')[0]} AS xl, {_mercator_sql('t', 'l')[1]} AS yt, {_mercator_sql('b', 'r')[0]} AS xr, {_mercator_sql('b', 'r')[1]} AS yb FROM f), z AS (SELECT raster_id, z, xl * pow(2, z) AS xl, yt * pow(2, z) AS yt, xr * pow(2, z) AS xr, yb * pow(2, z) AS yb FROM m, (VALUES (6), (9), (12)) q(z)) "
_INT = "CAST({} AS INTEGER)"


@query(_BOXES + f"SELECT raster_id, z, {_INT.format('floor(xl)')} AS x_first, {_INT.format('ceil(xr)')} AS x_end, {_INT.format('floor(yt)')} AS y_first, {_INT.format('ceil(yb)')} AS y_end FROM z")
def tile_range(spark, sf_dir):
    return op.tile_ranges(_mercator_boxes(spark, sf_dir), (6, 9, 12)).select("raster_id", "z", "x_first", "x_end", "y_first", "y_end")


@query(_BOXES + f"SELECT raster_id, z, {_trunc('(xl - floor(xl)) * 256')} AS x_off, {_trunc('(yt - floor(yt)) * 256')} AS y_off, {_trunc('(xr - xl) * 256')} AS width, {_trunc('(yb - yt) * 256')} AS height FROM z")
def tile_layout(spark, sf_dir):
    return op.tile_ranges(_mercator_boxes(spark, sf_dir), (6, 9, 12)).select("raster_id", "z", "x_off", "y_off", "width", "height")


_CUT = duck("rgb")[:-1] + ", k AS (SELECT *, CAST(floor((x + 40) / 64) + 7 AS INTEGER) AS tx, CAST(floor((y + 30) / 64) + 5 AS INTEGER) AS ty, CAST((x + 40) % 64 AS INTEGER) AS ix, CAST((y + 30) % 64 AS INTEGER) AS iy FROM rgb) "


@query(_CUT + "SELECT tx, ty, count(*) AS n, min(ix) AS ix0, max(ix) AS ix1, min(iy) AS iy0, max(iy) AS iy1, CAST(sum(r) AS BIGINT) AS r FROM k GROUP BY tx, ty")
def tile_cut(spark, sf_dir):
    cut = op.cut_tiles(raster(spark, sf_dir, "rgb"), 7, 5, 40, 30, tile=64)
    return cut.groupBy("tx", "ty").agg(F.count("*").alias("n"), F.min("ix").alias("ix0"), F.max("ix").alias("ix1"), F.min("iy").alias("iy0"), F.max("iy").alias("iy1"), F.sum("r").alias("r"))


def _pyramid_sql() -> str:
    levels = []
    for z, (w, h) in _LEVELS.items():
        body = _resized("red", w, h, _trunc("{v}"))
        ctes, select = body[2:].rsplit("\nSELECT", 1)
        renamed = ctes.replace("sz AS", f"sz{z} AS").replace("FROM sz,", f"FROM sz{z},").replace(" o AS", f" o{z} AS").replace("FROM o)", f"FROM o{z})").replace("\nc AS", f"\nc{z} AS")
        levels.append((renamed, f"SELECT {z} AS z, CAST(floor(y / 64) AS INTEGER) AS ty, CAST(floor(x / 64) AS INTEGER) AS tx, v FROM (SELECT{select.replace('FROM c JOIN', f'FROM c{z} c JOIN')})"))
    return duck("rgb")[:-1] + ", red AS (SELECT y, x, CAST(r AS DOUBLE) AS v FROM rgb), " + ", ".join(c for c, _ in levels) + " SELECT z, ty, tx, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM (" + " UNION ALL ".join(s for _, s in levels) + ") GROUP BY z, ty, tx"


_LEVELS = {1: (40, 160), 2: (80, 320), 3: (160, 640)}


@query(_pyramid_sql())
def tile_pyramid(spark, sf_dir):
    sampled = blocks.resample(raster(spark, sf_dir, "rgb"), ["r"], [(z, w, h) for z, (w, h) in _LEVELS.items()])
    tiles = op.cut_tiles(sampled, 0, 0, 0, 0, tile=64)
    return tiles.groupBy("z", "ty", "tx").agg(F.count("*").alias("n"), F.sum(pixels.trunc(F.col("r"))).alias("total"))


# requests

_BODY = "split_part(request, ':', 1)"
_FEATURE = "CASE WHEN p = '' THEN '' WHEN contains(p, 'HONS') THEN 'HONS' WHEN contains(p, 'NDVI') THEN 'NDVI' WHEN contains(p, 'NDMI') THEN 'NDMI' WHEN contains(p, 'NDWI') THEN 'NDWI' WHEN contains(p, 'NDSI') THEN 'NDSI' WHEN contains(p, 'ND_UNSPEC') THEN 'ND_UNSPEC' WHEN contains(p, 'SCL') THEN 'SCL' END"
_PARSED = duck("requests")[:-1] + f", q0 AS (SELECT req_id, request, regexp_extract({_BODY}, '^([^@]*)@', 1) AS p, string_split(regexp_replace({_BODY}, '^[^@]*@', ''), ',') AS f FROM requests), q AS (SELECT *, {_FEATURE} AS feature FROM q0) "
_OPTION = "CAST(nullif(regexp_extract(request, ':{}=([0-9]+)', 1), '') AS INTEGER)"


@query(_PARSED + f"SELECT req_id, feature, CAST(len(f) AS INTEGER) AS n_files, f[1] AS first_file, {_OPTION.format('q')} AS quality, {_OPTION.format('s')} AS scale, ends_with(f[1], '.jp2') AS jp2 FROM q")
def req_parse(spark, sf_dir):
    r = F.col("request")
    files = requests.files(r)
    return raster(spark, sf_dir, "requests").select("req_id", requests.feature(r).alias("feature"), F.size(files).alias("n_files"), files[0].alias("first_file"), requests.option(r, "q").alias("quality"), requests.option(r, "s").alias("scale"), requests.is_jp2(files[0]).alias("jp2"))


@query(_PARSED + ", n AS (SELECT *, list_transform(f, lambda s: regexp_replace(split_part(s, '/', -1), '[.][^.]*$', '')) AS stems FROM q) SELECT req_id, substr(CASE WHEN feature = '' AND len(stems) = 1 THEN stems[1] ELSE CASE WHEN feature = '' THEN 'RGB' ELSE feature END || '-' || array_to_string(stems, '-COMMA-') END, 1, 255) AS name FROM n")
def req_names(spark, sf_dir):
    return raster(spark, sf_dir, "requests").select("req_id", requests.output_name(F.col("request")).alias("name"))


@query(_PARSED + ", n AS (SELECT *, CASE feature WHEN '' THEN 1 WHEN 'HONS' THEN 3 WHEN 'NDSI' THEN 4 WHEN 'SCL' THEN 1 ELSE 2 END AS arity FROM q) SELECT req_id, arity, coalesce(len(f) <= 4 AND ((feature = '' AND len(f) IN (1, 3)) OR (feature <> '' AND len(f) = arity)), false) AS valid FROM n")
def req_arity(spark, sf_dir):
    r = F.col("request")
    return raster(spark, sf_dir, "requests").select("req_id", requests.arity(requests.feature(r)).alias("arity"), requests.valid(r).alias("valid"))


_BANDS_NEEDED = ", ".join(f"('{k}', '{v}')" for k, v in requests.BANDS.items())


@query(_PARSED + f"SELECT req_id, needs FROM q LEFT JOIN (VALUES {_BANDS_NEEDED}) t(name, needs) ON name = feature")
def req_bands(spark, sf_dir):
    """Bands that a request's feature is made of; null without one."""
    r = raster(spark, sf_dir, "requests")
    return r.select("req_id", requests.bands(requests.feature(F.col("request"))).alias("needs"))


@query(duck("requests") + ", z AS (SELECT req_id, list_transform(string_split(CAST(req_id % 25 AS VARCHAR) || ',' || CAST(req_id % 7 AS VARCHAR) || ',19', ','), lambda s: CAST(s AS INTEGER)) AS l FROM requests) SELECT req_id, array_to_string(list_filter(l, lambda v: v <= 19), ' ') AS zooms FROM z")
def req_zooms(spark, sf_dir):
    i = F.col("req_id")
    text = F.concat_ws(",", (i % 25).cast("string"), (i % 7).cast("string"), F.lit("19"))
    return raster(spark, sf_dir, "requests").select("req_id", F.array_join(requests.zooms(text), " ").alias("zooms"))


_EXTENSIONS = ", ".join(f"('{k}', '{v}')" for k, v in requests.EXTENSIONS.items())


@query(duck("requests")[:-1] + f", f AS (SELECT req_id, CASE req_id % 5 WHEN 0 THEN 'JPEG' WHEN 1 THEN 'WEBP' WHEN 2 THEN 'RAW' WHEN 3 THEN 'PNG' ELSE 'NULL' END AS kind FROM requests) SELECT req_id, kind, ext FROM f JOIN (VALUES {_EXTENSIONS}) t(k, ext) ON k = kind")
def req_extension(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("JPEG", "WEBP", "RAW", "PNG", "NULL"))), (F.col("req_id") % 5 + 1).cast("int"))
    return raster(spark, sf_dir, "requests").select("req_id", kind.alias("kind"), requests.extension(kind).alias("ext"))


@query(duck("radar") + "SELECT y, x, format('{:,}', CAST(dn AS BIGINT) * 1009) AS n FROM radar")
def number_format(spark, sf_dir):
    return raster(spark, sf_dir, "radar").select("y", "x", F.format_number(F.col("dn").cast("long") * 1009, 0).alias("n"))


@query(duck("bands")[:-1] + f", l AS (SELECT band, y, x, {_boa('dn')} AS v FROM bands) SELECT band, y, x, {_trunc('(v / CAST(65535 AS DOUBLE)) * (v / CAST(65535 AS DOUBLE)) * 255')} AS v FROM l")
def px_gamma(spark, sf_dir):
    return _levels(spark, sf_dir).select("band", "y", "x", pixels.gamma(F.col("v")).alias("v"))


@query(_coloured(*[_trunc(_sat("(i + 1) / 2") + " * 255")] * 3))
def gray_override(spark, sf_dir):
    """A feature rendered in gray, as an option of the run."""
    return blocks.combine(_levels(spark, sf_dir), "NDVI", (0, 1), gray=True)


# files


def _round_trip(spark, sf_dir, kind: str, **options):
    """Pixels through files of a kind, in blocks of 50 rows, and back."""
    px = raster(spark, sf_dir, "rgb").withColumn("block", F.floor(F.col("y") / 50).cast("int"))
    back = images.decode(images.encode(px, ["block"], ["r", "g", "b"], kind, **options), ["block"], kind)
    return back.select((F.col("block") * 50 + F.col("y")).alias("y"), "x", "c", "v")


_CHANNELS = duck("rgb") + "SELECT y, x, 0 AS c, r AS v FROM rgb UNION ALL SELECT y, x, 1, g FROM rgb UNION ALL SELECT y, x, 2, b FROM rgb"


@query(_CHANNELS)
def encode_png_tiles(spark, sf_dir):
    return _round_trip(spark, sf_dir, "PNG")


@query(_CHANNELS)
def encode_pnm(spark, sf_dir):
    return _round_trip(spark, sf_dir, "PNM")


@query(_CHANNELS)
def decode_tiff(spark, sf_dir):
    return _round_trip(spark, sf_dir, "TIFF", tile=16)


@query(duck("rgb") + "SELECT CAST(floor(y / 50) AS INTEGER) AS block, CAST(max(x) + 1 AS INTEGER) AS width, CAST(max(y) - min(y) + 1 AS INTEGER) AS height, 'FFD8FFE0' AS head, 'FFD9' AS tail FROM rgb GROUP BY 1")
def encode_jpeg(spark, sf_dir):
    """JPEG files of blocks: their sizes, first and last marks; a plain decoder reads such files in the tests."""
    px = raster(spark, sf_dir, "rgb").withColumn("block", F.floor(F.col("y") / 50).cast("int"))
    files = images.encode(px, ["block"], ["r", "g", "b"], "JPEG", quality=82)
    return files.select("block", "width", "height", F.hex(F.substring("data", 1, 4)).alias("head"), F.hex(F.substring("data", -2, 2)).alias("tail"))


@query(_PARSED + f"SELECT request, feature, coalesce(len(f) <= 4 AND ((feature = '' AND len(f) IN (1, 3)) OR (feature <> '' AND len(f) = CASE feature WHEN 'HONS' THEN 3 WHEN 'NDSI' THEN 4 WHEN 'SCL' THEN 1 ELSE 2 END)), false) AS valid, {_OPTION.format('q')} AS quality FROM q")
def stream_requests(spark, sf_dir):
    """The request list as a stream of text files into the manifest."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="rastrella-feed-")
    base = f"{base}/feed-{spark.sparkContext.applicationId}-{id(object())}"
    raster(spark, sf_dir, "requests").select("request").write.mode("overwrite").text(f"{base}/in")
    feed.watch(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("request", "feature", "valid", "quality")


@query(duck("rgb") + "SELECT y, x, 0 AS c, r AS v FROM rgb UNION ALL SELECT y, x, 1, g FROM rgb UNION ALL SELECT y, x, 2, b FROM rgb UNION ALL SELECT y, x, 3, a FROM rgb")
def encode_png_alpha(spark, sf_dir):
    px = raster(spark, sf_dir, "rgb").withColumn("block", F.floor(F.col("y") / 50).cast("int"))
    back = images.decode(images.encode(px, ["block"], ["r", "g", "b", "a"], "PNG"), ["block"], "PNG")
    return back.select((F.col("block") * 50 + F.col("y")).alias("y"), "x", "c", "v")


@query(duck("bands") + "SELECT band, y, x, 0 AS c, dn AS v FROM bands UNION ALL SELECT band, y, x, 1, CASE WHEN dn = 0 THEN 0 ELSE 65535 END FROM bands")
def encode_pam16(spark, sf_dir):
    """16-bit gray with alpha as PAM files and back."""
    px = raster(spark, sf_dir, "bands").withColumn("a", F.when(F.col("dn") == 0, 0).otherwise(65535))
    files = images.encode(px, ["band"], ["dn", "a"], "PNM", "uint16", alpha=True)
    return images.decode(files, ["band"], "PNM").select("band", "y", "x", "c", "v")


@query(_SQL["px_equalise"])
def decode_tiff16_equalise(spark, sf_dir):
    """16-bit TIFF tiles, decoded and stretched to 8 bits by the statistics of the whole raster."""
    px = raster(spark, sf_dir, "radar").withColumn("block", F.floor(F.col("y") / 100).cast("int"))
    back = images.decode(images.encode(px, ["block"], ["dn"], "TIFF", "uint16", tile=32), ["block"], "TIFF")
    whole = back.select((F.col("block") * 100 + F.col("y")).alias("y"), "x", F.col("v").alias("dn"))
    return op.equalise(whole, "dn").select("y", "x", "level")


@query(duck("radar") + "SELECT y, x, CAST(floor(sqrt(CAST(((dn % 3000) - 1500) * ((dn % 3000) - 1500) + ((dn % 777) - 300) * ((dn % 777) - 300) AS DOUBLE)) + 1e-7) AS INTEGER) AS v FROM radar")
def decode_complex_tiff(spark, sf_dir):
    """Strips of complex 16-bit pairs, decoded to magnitudes."""
    px = raster(spark, sf_dir, "radar").select("y", "x", F.floor(F.col("y") / 100).cast("int").alias("block"), ((F.col("dn") % 3000) - 1500).alias("i"), ((F.col("dn") % 777) - 300).alias("q"))
    pairs = images.encode(px, ["block"], ["i", "q"], "TIFF", "int16", extra=((258, 3, [32]), (277, 3, [1]), (339, 3, [5])))
    return images.decode(pairs, ["block"], "TIFF").select((F.col("block") * 100 + F.col("y")).alias("y"), "x", "v")


_META_TAGS = "SELECT CAST(raster_id AS BIGINT) AS raster_id, epsg, 16 + raster_id % 5 AS width, 8 + raster_id % 3 AS height, x_min, y_max FROM meta"


@query(duck("meta")[:-1] + f", t AS ({_META_TAGS}) SELECT raster_id, 'TIFF' AS format, width, height, 1 AS samples, 16 AS bits, 'deflate' AS compression, epsg, x_min AS xleft, y_max AS ytop, x_min + width * 10.0::DOUBLE AS xright, y_max - height * 10.0::DOUBLE AS ybottom, raster_id % 4 = 0 AS slc FROM t")
def tiff_geo_tags(spark, sf_dir):
    """Coordinate system and bounds of TIFF files, from their tags alone."""
    meta = raster(spark, sf_dir, "meta").select("raster_id", "epsg", "x_min", "y_max", (F.col("raster_id") % 5 + 16).alias("width"), (F.col("raster_id") % 3 + 8).alias("height"))

    def make(batches):
        for batch in batches:
            data = []
            for i, epsg, x, y, w, h in batch.itertuples(index=False):
                tags = [(33922, 12, [0.0, 0.0, 0.0, x, y, 0.0]), (33550, 12, [10.0, 10.0, 0.0]), (34735, 3, [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, int(epsg)]), (270, 2, ["a SLC product" if i % 4 == 0 else "a GRD product"])]
                data.append(images.write_tiff(np.zeros((h, w, 1), np.uint16), extra=tags))
            yield batch[["raster_id"]].assign(data=data)

    found = headers.headers(meta.mapInPandas(make, "raster_id long, data binary"), ["raster_id"])
    t = F.col("transform")
    return found.select("raster_id", "format", "width", "height", "samples", "bits", "compression", "epsg", t[0].alias("xleft"), t[3].alias("ytop"), (t[0] + F.col("width") * t[1]).alias("xright"), (t[3] + F.col("height") * t[5]).alias("ybottom"), "slc")


@query(_SQL["tie_points_parse"])
def tiff_tie_tags(spark, sf_dir):
    """Ground-control points of a TIFF file, from its model tie points."""
    def make(rows):
        rows = rows.sort_values(["gy", "gx"])
        ties = [float(v) for r in rows.itertuples() for v in (r.px, r.py, 0, r.lon, r.lat, 0)]
        return rows[["raster_id"]].head(1).assign(data=[images.write_tiff(np.zeros((8, 8, 1), np.uint16), extra=[(33922, 12, ties)])])

    files = raster(spark, sf_dir, "tie").groupBy("raster_id").applyInPandas(make, "raster_id int, data binary")
    points = op.points_of_tag(headers.headers(files, ["raster_id"]).select("raster_id", F.col("tie_points").alias("tag")))
    return points.select("i", "px", "py", "lon", "lat", "grid_width")


#: A JPEG 2000 codestream of 12 x 10 pixels in two tiles, whose samples are 8 x + 5 y.
_JP2 = (
    "ff4fff51002900000000000c0000000a00000000000000000000000c0000000800000000000000000001070101ff52000c00000001000201010001ff64000a000172656d61726bff5c000a"
    "4048505058505058ff90000a0000000000330001ff93cfc01c07a26c7b83153fc0f9c1c07c80c01144df0b3c3fc07c81201f08602c5bff7f03824fff90000a0001000000260001ff93c7da"
    "08062bb247c0f9c1000d9fc07c80a01f0840140f0299ffd9"
)


@query(duck("meta") + "SELECT raster_id, CAST(gy.i AS INTEGER) AS y, CAST(gx.i AS INTEGER) AS x, CAST(8 * gx.i + 5 * gy.i AS INTEGER) AS v FROM meta, range(10) gy(i), range(12) gx(i)")
def decode_jp2(spark, sf_dir):
    """A JPEG 2000 file for each footprint, decoded tile by tile."""
    files = raster(spark, sf_dir, "meta").select("raster_id", F.unhex(F.lit(_JP2)).alias("data"))
    return images.decode(files, ["raster_id"]).select("raster_id", "y", "x", "v")


# whole requests

_ASKED = ("NDVI@b0.pgm,b1.pgm", "HONS@b0.pgm,b1.pgm,b2.pgm", "b0.pgm,b1.pgm,b2.pgm", "colours.ppm", "NDSI@b0.pgm,b1.pgm,b2.pgm,b3.pgm:q=80", "SCL@codes.pgm", "NDVI@b0.pgm,lost.pgm", "NDVI@b0.pgm", "NDVI@b0.pgm,broken.pgm", "NDWI@b0.pgm,broken.pgm", "colours.ppm:s=2")
_PICTURE = {
    0: _coloured(*(_ramp("i", "NDVI", s) for s in (16, 8, 0))),
    1: _SQL["hons"],
    2: _SQL["rgb_composite"],
    4: _SQL["ndsi"],
    5: _SQL["scl_classify"].replace("a = 255", "a >= 0").replace("FROM classes", "FROM (SELECT y, x, code, 255 AS a FROM classes)"),
}


def _requests_sql() -> str:
    sums = "CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b, CAST(sum(a) AS BIGINT) AS a"
    parts = [f"SELECT CAST({i} AS BIGINT) AS req_id, CAST(max(x) + 1 AS INTEGER) AS width, CAST(max(y) + 1 AS INTEGER) AS height, {sums} FROM ({sql})" for i, sql in _PICTURE.items()]
    # a picture of its own size is sampled half a pixel off, like any band
    half = duck("rgb")[:-1] + ", e AS (SELECT max(x) AS mx, max(y) AS my FROM {src}), s AS (SELECT p.y, p.x, " + ", ".join(f"CAST(floor((p.{c} + 0.5 * (r.{c} - p.{c})) + 0.5 * ((d.{c} + 0.5 * (q.{c} - d.{c})) - (p.{c} + 0.5 * (r.{c} - p.{c}))) + 1e-7) AS INTEGER) AS {c}" for c in "rgb") + ", 255 AS a FROM {src} p, e, {src} r, {src} d, {src} q WHERE r.y = p.y AND r.x = least(p.x + 1, mx) AND d.y = least(p.y + 1, my) AND d.x = p.x AND q.y = least(p.y + 1, my) AND q.x = least(p.x + 1, mx)) SELECT * FROM s"
    small = half.replace(", e AS", ", two AS (SELECT CAST(y / 2 AS INTEGER) AS y, CAST(x / 2 AS INTEGER) AS x, r, g, b FROM rgb WHERE y % 2 = 0 AND x % 2 = 0), e AS", 1)
    for i, sql in ((3, half.replace("{src}", "rgb")), (10, small.replace("{src}", "two"))):
        parts.append(f"SELECT CAST({i} AS BIGINT) AS req_id, CAST(max(x) + 1 AS INTEGER) AS width, CAST(max(y) + 1 AS INTEGER) AS height, {sums} FROM ({sql})")
    names = ["NDVI-b0-COMMA-b1", "HONS-b0-COMMA-b1-COMMA-b2", "RGB-b0-COMMA-b1-COMMA-b2", "colours", "NDSI-b0-COMMA-b1-COMMA-b2-COMMA-b3", "SCL-codes", None, None, None, None, "colours"]
    status = ["ok"] * 6 + ["missing file", "invalid request", "unreadable file", "unreadable file", "ok"]
    rows = ", ".join(f"({i}, '{s}', {'NULL' if n is None else repr('out/' + n + '.png')})" for i, (s, n) in enumerate(zip(status, names)))
    return f"SELECT CAST(t.i AS BIGINT) AS req_id, t.status, t.outfile, width, height, r, g, b, a FROM (VALUES {rows}) t(i, status, outfile) LEFT JOIN ({' UNION ALL '.join(parts)}) p ON p.req_id = t.i"


@query(_requests_sql())
def run_requests(spark, sf_dir):
    """Requests from strings to encoded files and back: sums of the channels of what was written, and the manifest's status."""
    lines = spark.createDataFrame(list(enumerate(_ASKED)), "req_id long, request string")
    path = lambda df, name: df.select(name.alias("path"), "data")
    bands = images.encode(raster(spark, sf_dir, "bands"), ["band"], ["dn"], "PNM", "uint16")
    one = lambda name, columns: images.encode(raster(spark, sf_dir, name).withColumn("k", F.lit(0)), ["k"], columns, "PNM")
    files = path(bands, F.format_string("b%d.pgm", "band")).unionByName(path(one("rgb", ["r", "g", "b"]), F.lit("colours.ppm"))).unionByName(path(one("classes", ["code"]), F.lit("codes.pgm")))
    files = files.unionByName(spark.createDataFrame([("broken.pgm", b"P5 9")], "path string, data binary"))
    encoded, manifest = execute.run(lines, files, "PNG", "out/")
    back = images.decode(encoded, ["req_id"], "PNG")
    sums = back.groupBy("req_id").agg(*(F.sum(F.when(F.col("c") == i, F.col("v"))).alias(n) for i, n in enumerate("rgba")))
    return manifest.join(sums, "req_id", "left").select("req_id", "status", "outfile", "width", "height", *"rgba")


#: Bounds of the picture in Mercator, and the zooms of its tiles.
_TILED, _TILE_ZOOMS = (0.5501, 0.3502, 0.5507, 0.3514), (7, 9, 11)


def _tiles_sql() -> str:
    left, top, right, bottom = _TILED
    levels = []
    for z in _TILE_ZOOMS:
        n = 2.0**z
        w, h = math.floor((right * n - left * n) * 256 + 1e-7), math.floor((bottom * n - top * n) * 256 + 1e-7)
        x_off, y_off = (math.floor((v * n - math.floor(v * n)) * 256 + 1e-7) for v in (left, top))
        x_first, y_first, x_end, y_end = math.floor(left * n), math.floor(top * n), math.ceil(right * n), math.ceil(bottom * n)
        body = _resized("src", w, h, "{v}")
        ctes, select = body[2:].rsplit("\nSELECT", 1)
        for name in ("sz", "o", "c"):
            ctes = ctes.replace(f"{name} AS (", f"{name}{z} AS MATERIALIZED (").replace(f"FROM {name})", f"FROM {name}{z})").replace(f"FROM {name},", f"FROM {name}{z},")
        lerp = lambda v: _trunc(f"((p.{v} + dx * (r.{v} - p.{v})) + dy * ((d.{v} + dx * (q.{v} - d.{v})) - (p.{v} + dx * (r.{v} - p.{v}))))")
        joins = select[select.index("FROM c JOIN") :].replace("FROM c JOIN", f"FROM c{z} c JOIN")
        levels.append((ctes, f"SELECT {z} AS z, CAST(floor((c.x + {x_off}) / 256) + {x_first} AS INTEGER) AS tx, CAST(floor((c.y + {y_off}) / 256) + {y_first} AS INTEGER) AS ty, {lerp('r')} AS r, {lerp('a')} AS a {joins}"))
        assert (x_off + w - 1) // 256 < x_end - x_first and (y_off + h - 1) // 256 < y_end - y_first
    base = duck("rgb")[:-1] + ", src AS MATERIALIZED (SELECT y, x, CAST(r AS DOUBLE) AS r, CAST(a AS DOUBLE) AS a FROM rgb), " + ", ".join(c for c, _ in levels)
    body = " UNION ALL ".join(s for _, s in levels)
    return base + f" SELECT '1/' || z || '/' || tx || '/' || ty || '.png' AS path, CAST(65536 AS BIGINT) AS n, CAST(sum(r) + (65536 - count(*)) * 9 AS BIGINT) AS r, count(CASE WHEN a = 255 THEN 1 END) AS opaque FROM ({body}) GROUP BY z, tx, ty"


@query(_tiles_sql())
def encode_tiles(spark, sf_dir):
    """Map tiles of a picture at several zooms, encoded on canvases with a fill colour, and what is in the files."""
    px = raster(spark, sf_dir, "rgb").withColumn("raster_id", F.lit(1).cast("long"))
    box = spark.createDataFrame([(1, *_TILED)], "raster_id long, xl double, yt double, xr double, yb double")
    tiles = blocks.render_tiles(px, op.tile_ranges(box, _TILE_ZOOMS), ["r", "g", "b"], images.write_png, ".png", ["raster_id"], fill=9)
    back = images.decode(tiles, ["path"], "PNG")
    return back.groupBy("path").agg((F.count("*") / 4).cast("long").alias("n"), F.sum(F.when(F.col("c") == 0, F.col("v"))).alias("r"), F.count(F.when((F.col("c") == 3) & (F.col("v") == 255), 1)).alias("opaque"))
