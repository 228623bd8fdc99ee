"""Operators on pixel relations ``(keys..., y, x, value columns)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastrella.functions import geo, pixels
from rastrella.functions.pixels import trunc

TILE = 256


# statistics


def statistics(px: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, standard deviation of the population, least and largest value of each raster."""
    return px.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))


def equalise(px: DataFrame, value: str, keys: Sequence[str] = (), sigmas: float = 2.0) -> DataFrame:
    """Add ``level``, 8 bits against the smaller of mean + sigmas x deviation and the maximum of the raster."""
    scale = statistics(px, value, keys).select(*keys, F.least(F.col("mean") + sigmas * F.col("std"), F.col("high").cast("double")).alias("_scale"))
    joined = px.join(scale, list(keys)) if keys else px.crossJoin(F.broadcast(scale))  # without keys: one row
    return joined.withColumn("level", pixels.equalise(F.col(value), F.col("_scale"))).drop("_scale")


# sampling


def with_neighbours(px: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Each value as an array of the pixel, its right, its lower and its lower right neighbour, repeated at the edges.

    A neighbour is the pixel at the next place; where there is none, as at an edge or in a raster with gaps, the pixel
    stands for it.
    """
    right, down = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    beside, below = F.lead("x").over(right) == F.col("x") + 1, F.lead("y").over(down) == F.col("y") + 1
    px = px.withColumns({f"_r_{v}": F.when(beside, F.lead(v).over(right)).otherwise(F.col(v)) for v in values})
    px = px.withColumns({v: F.array(F.col(v), F.col(f"_r_{v}"), F.when(below, F.lead(v).over(down)).otherwise(F.col(v)), F.when(below, F.lead(f"_r_{v}").over(down)).otherwise(F.col(f"_r_{v}"))).alias(v) for v in values})
    return px.drop(*(f"_r_{v}" for v in values))


def lerp(quad: Column, dx: Column, dy: Column) -> Column:
    """Bilinear value: along x first, then along y."""
    top = quad[0] + dx * (quad[1] - quad[0])
    low = quad[2] + dx * (quad[3] - quad[2])
    return top + dy * (low - top)


def resample_same(px: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Bilinear samples on the raster's own grid, which lie half a pixel right and down of its samples."""
    half = F.lit(0.5)
    return with_neighbours(px, values, keys).withColumns({v: lerp(F.col(v), half, half) for v in values})


def _axis(at: Column, n_out: Column, n_in: Column) -> tuple[Column, Column, Column]:
    """First and second source index and the second's weight for an output index."""
    place = (at + F.lit(0.5)) / n_out * n_in
    first = F.least(F.floor(place).cast("int"), (n_in - 1).cast("int"))
    return first, F.least(first + 1, (n_in - 1).cast("int")), place - first


def resample_to(px: DataFrame, value: str, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """Bilinear samples on a grid of another size: ``(keys, y, x, value)``.

    Pixels are gathered into rows, each output row joins its two source rows, and the samples along x are taken inside
    the arrays; so the joins handle rows of the raster, not pixels.
    """
    keys = list(keys)
    lines = px.groupBy(*keys, "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", F.col(value).cast("double").alias("v")))), lambda p: p["v"]).alias("line"))
    size = lines.groupBy(*keys).agg((F.max("y") + 1).alias("_h"))
    grid = size.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    y0, y1, dy = _axis(F.col("y"), F.lit(height), F.col("_h"))
    grid = grid.select(*keys, "y", y0.alias("_y0"), y1.alias("_y1"), dy.alias("_dy"))
    top = lines.select(*keys, F.col("y").alias("_y0"), F.col("line").alias("_a"))
    low = lines.select(*keys, F.col("y").alias("_y1"), F.col("line").alias("_b"))
    both = grid.join(top, [*keys, "_y0"]).join(low, [*keys, "_y1"])

    def sample(x: Column) -> Column:
        x0, x1, dx = _axis(x, F.lit(width), F.size("_a"))
        a, b = F.col("_a"), F.col("_b")
        first = F.get(a, x0) + dx * (F.get(a, x1) - F.get(a, x0))
        second = F.get(b, x0) + dx * (F.get(b, x1) - F.get(b, x0))
        return first + F.col("_dy") * (second - first)

    return both.select(*keys, "y", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), sample)).alias("x", value))


def sample_at(points: DataFrame, px: DataFrame, values: Sequence[str], width: int | Column, height: int | Column, keys: Sequence[str] = (), sx: str = "sx", sy: str = "sy") -> DataFrame:
    """Bilinear samples at ``(sx, sy)`` of each point: one join on the pixel that holds the point's neighbours."""
    quads = with_neighbours(px, values, keys).select(*keys, F.col("y").alias("_y0"), F.col("x").alias("_x0"), *values)
    last = lambda n: (n - 1).cast("int") if isinstance(n, Column) else F.lit(n - 1)
    x0 = F.greatest(F.lit(0), F.least(F.floor(sx).cast("int"), last(width)))
    y0 = F.greatest(F.lit(0), F.least(F.floor(sy).cast("int"), last(height)))
    joined = points.withColumn("_x0", x0).withColumn("_y0", y0).join(quads, [*keys, "_y0", "_x0"])
    dx, dy = F.col(sx) - F.col("_x0"), F.col(sy) - F.col("_y0")
    return joined.withColumns({v: lerp(F.col(v), dx, dy) for v in values}).drop("_x0", "_y0")


def downscale_nearest(px: DataFrame, factor: int) -> DataFrame:
    """Every ``factor``-th pixel of both axes."""
    kept = px.filter((F.col("x") % factor == 0) & (F.col("y") % factor == 0))
    return kept.withColumn("x", (F.col("x") / factor).cast("int")).withColumn("y", (F.col("y") / factor).cast("int"))


# band combination


def stack(px: DataFrame, bands: Sequence[int], value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """Bands of a long relation side by side, ``b0, b1, ...`` and the first band's alpha ``a``: one shuffle, no joins."""
    picks = [F.max(F.when(F.col("band") == b, F.col(value))).alias(f"b{i}") for i, b in enumerate(bands)]
    alpha = F.max(F.when(F.col("band") == bands[0], F.col("a"))).alias("a")
    return px.filter(F.col("band").isin(*bands)).groupBy(*keys, "y", "x").agg(*picks, alpha)


def colour_feature(stacked: DataFrame, name: str, fill: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Red, green, blue and alpha of a spectral feature; pixels that are not opaque take the fill colour."""
    b = [F.col(f"b{i}") for i in range(4)]
    if name == "HONS":
        rgb = [pixels.highlight(c) for c in b[:3]]
    else:
        nd = pixels.normalised_difference(b[0], b[1])
        if name in pixels.RAMPS:
            rgb = pixels.ramp(nd, pixels.RAMPS[name])
        elif name == "NDSI":
            rgb = [F.when(nd > pixels.SNOW_LIMIT, snow).otherwise(pixels.brighten(c)) for snow, c in zip(pixels.SNOW_COLOUR, (b[2], b[0], b[3]))]
        elif name == "ND_UNSPEC":
            rgb = [pixels.gray_of_index(nd)] * 3
        else:
            raise ValueError(f"unknown feature {name}")
    opaque = F.col("a") == 255
    return stacked.select(*keys, "y", "x", *(F.when(opaque, c).otherwise(fill).cast("int").alias(n) for c, n in zip(rgb, "rgb")), "a")


def composite(stacked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Three bands as red, green and blue."""
    return stacked.select(*keys, "y", "x", *(F.col(f"b{i}").cast("int").alias(n) for i, n in enumerate("rgb")), "a")


def classify(px: DataFrame, code: str = "code", fill: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Colour of class codes by a join with the twelve classes; unknown and empty classes are transparent."""
    rows = [(i, *pixels.rgb_parts(c)) for i, c in enumerate(pixels.CLASS_COLOURS) if c]
    table = px.sparkSession.createDataFrame(rows, f"{code} int, _r int, _g int, _b int")
    joined = px.join(F.broadcast(table), code, "left").withColumn("_ok", F.col("_r").isNotNull() & (F.col("a") == 255))
    return joined.select(*keys, "y", "x", *(F.when(F.col("_ok"), F.col(f"_{n}")).otherwise(fill).alias(n) for n in "rgb"), F.when(F.col("_ok"), 255).otherwise(0).alias("a"))


def ramp_segments(px: DataFrame, value: str, points: Sequence[tuple]) -> DataFrame:
    """General form of a ramp: join each value with its segment ``lo < value <= hi`` of a small table."""
    bounds = [None, *(p[0] for p in points), None]
    table = px.sparkSession.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(zip(bounds, bounds[1:]))], "segment int, lo double, hi double")
    v = F.col(value)
    return px.join(F.broadcast(table), (F.col("lo").isNull() | (v > F.col("lo"))) & (F.col("hi").isNull() | (v <= F.col("hi"))), "left")


def chroma_420(px: DataFrame, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """U and V of each block of two by two pixels; at odd sizes the last column and row count twice."""
    weight = F.when((F.col("x") == width - 1) & F.lit(width % 2 == 1), 2).otherwise(1) * F.when((F.col("y") == height - 1) & F.lit(height % 2 == 1), 2).otherwise(1)
    block = px.groupBy(*keys, F.floor(F.col("y") / 2).cast("int").alias("by"), F.floor(F.col("x") / 2).cast("int").alias("bx"))
    sums = block.agg(*(F.sum(F.col(c) * weight).cast("int").alias(f"_{c}") for c in "rgb"))
    rgb = [F.col("_r"), F.col("_g"), F.col("_b")]
    return sums.select(*keys, "by", "bx", pixels.chroma_u(*rgb).cast("int").alias("u"), pixels.chroma_v(*rgb).cast("int").alias("v"))


# warps


def grid(spark, width: int, height: int) -> DataFrame:
    """All pixels of an output raster."""
    rows = spark.range(height).select(F.col("id").cast("int").alias("y"))
    return rows.select("y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))


def mercator_grid(spark, bounds: tuple, width: int, height: int) -> DataFrame:
    """Output pixels with the Mercator coordinates of their centres ``mx, my``."""
    left, top, right, bottom = bounds
    return grid(spark, width, height).withColumns({"mx": F.lit(left) + F.lit(right - left) * ((F.col("x") + 0.5) / width), "my": F.lit(top) + F.lit(bottom - top) * ((F.col("y") + 0.5) / height)})


def warp_utm(px: DataFrame, bounds: tuple, zone: int, width: int, height: int, out_width: int, out_height: int, south: bool = False, fill: int = 0, resample: str = "bilinear") -> DataFrame:
    """Reproject a UTM raster ``(y, x, v, a)`` with native bounds (left, top, right, bottom) to Web Mercator.

    Every output pixel is mapped back; what falls outside or on a sample that is not opaque is transparent.
    """
    left, top, right, bottom = bounds
    out = mercator_grid(px.sparkSession, geo.mercator_bounds_of_utm(*bounds, zone, south), out_width, out_height)
    east, north = geo.utm(*geo.geographic(F.col("mx"), F.col("my")), F.lit(zone), south)
    out = out.withColumns({"_u": (east - left) / (right - left), "_v": (north - top) / (bottom - top)}).withColumns({"sx": F.col("_u") * width, "sy": F.col("_v") * height})
    if resample == "nearest":  # for class codes, which have no values in between
        out = out.withColumns({"sx": F.floor("sx").cast("double"), "sy": F.floor("sy").cast("double")})
    got = sample_at(out, px, ["v", "a"], width, height)
    inside = F.col("_u").between(0, 1) & F.col("_v").between(0, 1) & (trunc(F.col("a")) == 255)
    return got.select("y", "x", F.when(inside, trunc(F.col("v"))).otherwise(fill).alias("v"), F.when(inside, 255).otherwise(0).alias("a"))


def warp_utm_each(px: DataFrame, meta: DataFrame, channels: Sequence[str], keys: Sequence[str], fill: int = 0) -> DataFrame:
    """Reproject UTM rasters ``px (keys, y, x, channels, a)`` to Web Mercator, each by its own row of ``meta``.

    ``meta (keys, epsg, xleft, ytop, xright, ybottom, width, height, out_w, out_h)`` has native bounds, source and output
    sizes. The output covers the Mercator box around the projected corners. Gives ``(keys, y, x, channels, a)``; what falls
    outside or on a sample that is not opaque is transparent and takes the fill colour.
    """
    keys = list(keys)
    zone, south = geo.zone_of(F.col("epsg"))
    corners = [geo.mercator(*geo.geographic_of_utm(F.col(x), F.col(y), zone, south)) for x in ("xleft", "xright") for y in ("ytop", "ybottom")]
    boxed = meta.withColumns({"_l": F.least(*(c[0] for c in corners)), "_t": F.least(*(c[1] for c in corners)), "_r": F.greatest(*(c[0] for c in corners)), "_b": F.greatest(*(c[1] for c in corners))})
    out = boxed.withColumn("y", F.explode(F.sequence(F.lit(0), (F.col("out_h") - 1).cast("int")))).withColumn("x", F.explode(F.sequence(F.lit(0), (F.col("out_w") - 1).cast("int"))))
    mx = F.col("_l") + (F.col("_r") - F.col("_l")) * ((F.col("x") + 0.5) / F.col("out_w"))
    my = F.col("_t") + (F.col("_b") - F.col("_t")) * ((F.col("y") + 0.5) / F.col("out_h"))
    east, north = geo.utm(*geo.geographic(mx, my), zone, south)
    out = out.withColumns({"_u": (east - F.col("xleft")) / (F.col("xright") - F.col("xleft")), "_v": (north - F.col("ytop")) / (F.col("ybottom") - F.col("ytop"))})
    out = out.withColumns({"sx": F.col("_u") * F.col("width"), "sy": F.col("_v") * F.col("height")})
    got = sample_at(out, px.select(*keys, F.col("y"), F.col("x"), *channels, "a"), [*channels, "a"], F.col("width"), F.col("height"), keys)
    inside = F.col("_u").between(0, 1) & F.col("_v").between(0, 1) & (trunc(F.col("a")) == 255)
    return got.select(*keys, "y", "x", *(F.when(inside, trunc(F.col(c))).otherwise(fill).alias(c) for c in channels), F.when(inside, 255).otherwise(0).alias("a"))


def points_of_tag(files: DataFrame, tag: str = "tag") -> DataFrame:
    """Ground-control points ``(raster_id, i, px, py, lon, lat, grid_width)`` of model tie points in groups of six."""
    six = F.transform(F.sequence(F.lit(0), (F.size(tag) / 6).cast("int") - 1), lambda i: F.struct(F.get(tag, i * 6).alias("px"), F.get(tag, i * 6 + 1).alias("py"), F.get(tag, i * 6 + 3).alias("lon"), F.get(tag, i * 6 + 4).alias("lat")))
    points = files.filter(F.size(tag) >= 6).withColumn("p", six).withColumn("grid_width", F.size(F.filter("p", lambda p: p["py"] == 0)).cast("long"))
    return points.select("raster_id", F.posexplode("p").alias("i", "q"), "grid_width").select("raster_id", "i", F.col("q.px").cast("int").alias("px"), F.col("q.py").cast("int").alias("py"), "q.lon", "q.lat", "grid_width")


def tie_cells(points: DataFrame) -> DataFrame:
    """Cells of a grid of ground-control points ``(gy, gx, px, py, lat, lon)``: corners a, b, c, d clockwise, in Mercator."""
    mx, my = geo.mercator(F.col("lat"), F.col("lon"))
    p = points.select("gy", "gx", F.struct(mx.alias("x"), my.alias("y"), F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py")).alias("p"))
    right, down = Window.partitionBy("gy").orderBy("gx"), Window.partitionBy("gx").orderBy("gy")
    p = p.withColumn("b", F.lead("p").over(right)).withColumn("d", F.lead("p").over(down)).withColumn("c", F.lead("b").over(down))
    return p.filter("b is not null and c is not null and d is not null").select("gy", "gx", F.col("p").alias("a"), "b", "c", "d")


def _cross(cell: Column | None, m: str, n: str) -> Column:
    """On which side of the edge from m to n the point ``mx, my`` lies; corners are fields of ``cell``, or columns."""
    of = (lambda k: F.col(k)) if cell is None else (lambda k: cell[k])
    dx, dy = of(n)["x"] - of(m)["x"], of(n)["y"] - of(m)["y"]
    return dx * (F.col("my") - of(m)["y"]) - dy * (F.col("mx") - of(m)["x"])


#: Cells of a grid that are broadcast; a larger grid is joined by bucket.
MOST_CELLS = 50_000


def locate_in_cells(out: DataFrame, cells: DataFrame, bounds: tuple, buckets: int | None = None) -> DataFrame:
    """Each point ``(y, x, mx, my)`` with the first cell, by row and column, that holds it; points in no cell are left out.

    Cells are dealt to the buckets of a coarse grid that their box touches, by default about as many buckets as cells, and
    gathered by bucket; a point meets its bucket's few cells in one row, and the exact test is an expression on it. Up to
    ``MOST_CELLS`` cells are broadcast, so that points are not shuffled at all.
    """
    left, top, right, bottom = bounds
    count = cells.count()
    side = buckets or max(1, min(4096, int(count**0.5) + 1))
    bx = lambda v: F.floor((v - left) / (right - left) * side).cast("int")
    by = lambda v: F.floor((v - top) / (bottom - top) * side).cast("int")
    corner = lambda f, k: f(*(F.col(c)[k] for c in "abcd"))
    spread = cells.withColumn("_bx", F.explode(F.sequence(bx(corner(F.least, "x")), bx(corner(F.greatest, "x"))))).withColumn("_by", F.explode(F.sequence(by(corner(F.least, "y")), by(corner(F.greatest, "y")))))
    gathered = spread.groupBy("_bx", "_by").agg(F.collect_list(F.struct("gy", "gx", "a", "b", "c", "d")).alias("_cells"))
    met = out.withColumn("_bx", bx(F.col("mx"))).withColumn("_by", by(F.col("my"))).join(F.broadcast(gathered) if count <= MOST_CELLS else gathered, ["_bx", "_by"])

    def holds(cell: Column) -> Column:
        crosses = [_cross(cell, m, n) for m, n in ("ab", "bc", "cd", "da")]
        return (F.least(*crosses) >= 0) | (F.greatest(*crosses) <= 0)

    first = met.withColumn("_m", F.array_min(F.filter("_cells", holds))).filter("_m is not null")
    return first.select("y", "x", "mx", "my", "_m.*")


def tie_source(located: DataFrame) -> DataFrame:
    """Source coordinates ``sx, sy`` in a cell, weighted by the distances from its four sides."""

    def dist(m: str, n: str) -> Column:
        dx, dy = F.col(n)["x"] - F.col(m)["x"], F.col(n)["y"] - F.col(m)["y"]
        return F.abs(_cross(None, m, n)) / F.sqrt(dx * dx + dy * dy)

    ab, bc, cd, da = (dist(m, n) for m, n in ("ab", "bc", "cd", "da"))
    return located.withColumns({"sy": (F.col("a")["py"] * cd + F.col("c")["py"] * ab) / (ab + cd), "sx": (F.col("b")["px"] * da + F.col("d")["px"] * bc) / (bc + da)})


def quad_alpha(px: DataFrame, quad: Sequence[tuple[float, float]]) -> DataFrame:
    """Add ``a``: 255 where the pixel's centre lies in a convex quadrilateral, else 0."""

    def inside(i: int, j: int, k: int) -> Column:
        (ax, ay), (bx, by), (cx, cy) = quad[i], quad[j], quad[k]
        x, y = F.col("x") + 0.5, F.col("y") + 0.5
        area = (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)
        v = ((x - ax) * (cy - ay) - (cx - ax) * (y - ay)) / area
        w = ((bx - ax) * (y - ay) - (x - ax) * (by - ay)) / area
        return (v >= 0) & (w >= 0) & (1 - v - w >= 0)

    return px.withColumn("a", F.when(inside(0, 1, 2) | inside(2, 3, 0), 255).otherwise(0))


def warp_quad(px: DataFrame, quad: Sequence[tuple[float, float]], values: Sequence[str], width: int, height: int, out_width: int, out_height: int, fill: int = 0) -> DataFrame:
    """Warp a raster so that its corners (top left, top right, bottom right, bottom left) come to lie on ``quad``.

    The perspective map of the quadrilateral onto the raster is column arithmetic on the centre of each output pixel.
    Pixels outside the quadrilateral are transparent and take the fill colour.
    """
    out = quad_alpha(grid(px.sparkSession, out_width, out_height), quad)
    u, v = geo.unit_of_quad(F.col("x") + F.lit(0.5), F.col("y") + F.lit(0.5), quad)
    out = out.withColumns({"sx": u * F.lit(float(width)), "sy": v * F.lit(float(height))})
    got = sample_at(out.filter("a = 255"), px.select("y", "x", *values), values, width, height).select("y", "x", *values)
    joined = out.select("y", "x", "a").join(got, ["y", "x"], "left")
    return joined.select("y", "x", *(F.when(F.col("a") == 255, trunc(F.col(c))).otherwise(fill).alias(c) for c in values), "a")


# footprints


def lat_lon_box(corners: Column) -> dict[str, Column]:
    """Least and largest latitude and longitude of an array of ``(lat, lon)``."""
    pick = lambda k: F.transform(corners, lambda c: c[k])
    return {"lat_min": F.array_min(pick("lat")), "lat_max": F.array_max(pick("lat")), "lon_min": F.array_min(pick("lon")), "lon_max": F.array_max(pick("lon"))}


# tiles


def tile_ranges(rasters: DataFrame, zooms: Sequence[int], keys: Sequence[str] = ("raster_id",)) -> DataFrame:
    """For each raster ``(xl, yt, xr, yb)`` and zoom: tile range, offset in the first tile, and size in pixels."""
    z = rasters.withColumn("z", F.explode(F.array(*map(F.lit, zooms)))).withColumn("_s", F.pow(F.lit(2.0), F.col("z")))
    scaled = {c: F.col(c) * F.col("_s") for c in ("xl", "yt", "xr", "yb")}
    whole = lambda c: c.cast("int")
    return z.select(
        *keys, "z",
        whole(F.floor(scaled["xl"])).alias("x_first"), whole(F.ceil(scaled["xr"])).alias("x_end"), whole(F.floor(scaled["yt"])).alias("y_first"), whole(F.ceil(scaled["yb"])).alias("y_end"),
        trunc((scaled["xl"] - F.floor(scaled["xl"])) * TILE).alias("x_off"), trunc((scaled["yt"] - F.floor(scaled["yt"])) * TILE).alias("y_off"),
        trunc((scaled["xr"] - scaled["xl"]) * TILE).alias("width"), trunc((scaled["yb"] - scaled["yt"]) * TILE).alias("height"),
    )


def cut_tiles(px: DataFrame, x_first: int, y_first: int, x_off: int, y_off: int, tile: int = TILE) -> DataFrame:
    """Tile ``tx, ty`` and place ``ix, iy`` in it of each pixel of a canvas."""
    cx, cy = F.col("x") + x_off, F.col("y") + y_off
    at = lambda c, first: (F.floor(c / tile) + first).cast("int")
    return px.withColumns({"tx": at(cx, x_first), "ty": at(cy, y_first), "ix": (cx % tile).cast("int"), "iy": (cy % tile).cast("int")})
