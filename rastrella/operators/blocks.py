"""Resampling, features and tiles block by block: samples are shuffled once, to the output blocks that need them.

An output grid of W x H pixels, set off on a canvas, is cut into square blocks. A sample of a source of w x h goes to every
block with a pixel that it takes part in: mostly one, at a block's edge two, at a corner four. Each block's samples then
make dense arrays of bounded size, and the rest is array arithmetic. So a scene is never in one task, whatever its size,
bands of different sizes meet without a join, and all zooms of a pyramid share one exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrella.functions import pixels

SIDE = 256
#: Added before truncation, as in ``pixels.trunc``.
TINY = pixels.TINY


def sizes(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, w, h)`` of rasters that start at 0."""
    return px.groupBy(*keys).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def _touched(at: Column, n_in: Column, n_out: Column, offset: Column, side: int) -> Column:
    """Blocks along an axis with a pixel that samples the source index ``at`` (its first or second neighbour)."""
    ratio = n_out.cast("double") / n_in
    # generous by a pixel at both ends: a block ignores samples that it does not need
    first = F.greatest(F.lit(0), F.floor((at - 1) * ratio - 0.5).cast("int") - 1)
    last = F.least((n_out - 1).cast("int"), F.when(at >= n_in - 1, n_out).otherwise(F.ceil((at + 1) * ratio - 0.5)).cast("int") + 1)
    return F.sequence(F.floor((first + offset) / side).cast("int"), F.floor((F.greatest(first, last) + offset) / side).cast("int"))


def to_blocks(px: DataFrame, side: int = SIDE) -> DataFrame:
    """``px (..., y, x, w, h, out_w, out_h, off_x, off_y)`` with a row for each block ``(by, bx)`` that needs the sample."""
    cols = {"by": _touched(F.col("y"), F.col("h"), F.col("out_h"), F.col("off_y"), side), "bx": _touched(F.col("x"), F.col("w"), F.col("out_w"), F.col("off_x"), side)}
    wide = px.withColumns(cols)
    return wide.withColumn("by", F.explode("by")).withColumn("bx", F.explode("bx"))


def axis(block: int, side: int, n_in: int, n_out: int, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Output indices of a block along an axis, and their first and second source index and the second's weight."""
    out = np.arange(max(0, block * side - offset), max(0, min(n_out, (block + 1) * side - offset)))
    place = (out + 0.5) / n_out * n_in
    first = np.minimum(np.floor(place).astype(np.int64), n_in - 1)
    return out, first, np.minimum(first + 1, n_in - 1), place - first


def sample(y: np.ndarray, x: np.ndarray, values: np.ndarray, ys: tuple, xs: tuple) -> np.ndarray:
    """Bilinear samples (rows, columns, channels) on two axes of what is at ``(y, x)``; a missing sample counts as 0."""
    (_, y0, y1, dy), (_, x0, x1, dx) = ys, xs
    top, left = (int(at.min()) if len(at) else 0 for at in (y0, x0))
    high, wide = (int(y1.max()) - top + 1 if len(y1) else 0), (int(x1.max()) - left + 1 if len(x1) else 0)
    grid = np.zeros((high, wide, values.shape[1]))
    ok = (y >= top) & (y < top + high) & (x >= left) & (x < left + wide)
    grid[y[ok] - top, x[ok] - left] = values[ok]
    a, b, c, d = y0 - top, y1 - top, x0 - left, x1 - left
    dx, dy = dx[None, :, None], dy[:, None, None]
    first = grid[a][:, c] + dx * (grid[a][:, d] - grid[a][:, c])
    second = grid[b][:, c] + dx * (grid[b][:, d] - grid[b][:, c])
    return first + dy * (second - first)


# colours of whole arrays, the same formulas as the column functions


def trunc(x: np.ndarray) -> np.ndarray:
    return np.floor(x + TINY).astype(np.int64)


def _sat(x: np.ndarray) -> np.ndarray:
    return np.clip(np.nan_to_num(x, nan=0.0), 0.0, 1.0)


def ramp(nd: np.ndarray, points: tuple) -> np.ndarray:
    """Colours (..., 3) of an index."""
    edges = np.array([p[0] for p in points])
    colours = np.array([pixels.rgb_parts(p[1]) for p in points], np.float64)
    k = np.clip(np.searchsorted(edges, nd, side="left"), 1, len(points) - 1)  # a value on an edge belongs to the segment below
    span, t = (edges[k] - edges[k - 1])[..., None], (nd - edges[k - 1])[..., None]
    mixed = np.floor(colours[k - 1] * (span - t) / span + colours[k] * t / span + (0.5 + TINY))
    return np.where((nd <= edges[0])[..., None], colours[0], np.where((nd > edges[-1])[..., None], colours[-1], mixed)).astype(np.int64)


def feature_rgb(name: str, b: Sequence[np.ndarray]) -> np.ndarray:
    """Red, green and blue (..., 3) of a spectral feature of 16-bit levels, or of three 8-bit bands without a feature."""
    if name == "":
        return np.stack([trunc(x) for x in (b if len(b) == 3 else [b[0]] * 3)], axis=-1)
    if name == "HONS":
        return np.stack([trunc(_sat(np.cbrt(0.6 * x / 65535.0 - 0.035)) * 255) for x in b[:3]], axis=-1)
    if name == "SCL":
        code, table = trunc(b[0]), np.array([pixels.rgb_parts(c) for c in pixels.CLASS_COLOURS])
        return np.where(((code > 0) & (code < len(table)))[..., None], table[np.clip(code, 0, len(table) - 1)], 0)
    nd = (b[0] - b[1]) / (b[0] + b[1] + 1e-9)
    if name in pixels.RAMPS:
        return ramp(nd, pixels.RAMPS[name])
    if name == "ND_UNSPEC":
        return np.stack([trunc(_sat((nd + 1) / 2) * 255)] * 3, axis=-1)
    if name == "NDSI":
        bright = lambda x: trunc(_sat(x / 65535.0 * 2.5) * 255)
        return np.stack([np.where(nd > pixels.SNOW_LIMIT, snow, bright(x)) for snow, x in zip(pixels.SNOW_COLOUR, (b[2], b[0], b[3]))], axis=-1)
    raise ValueError(f"unknown feature {name}")


# whole relations


def _grouped(blocks: DataFrame, keys: Sequence[str], work: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """``work`` on each block: its keys, and its rows as arrays; the arrays it returns become rows."""
    fields = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        key = {k: table[k][0].as_py() for k in (*keys, "by", "bx")}
        out = work(key, {c: table[c].to_numpy() for c in table.column_names if c not in keys})
        n = len(out[names[0]])
        kept = [pa.array([key[k]] * n, blocks_schema[k]) for k in keys]
        return pa.table([*kept, *(pa.array(out[c]) for c in names)], names=[*keys, *names])

    blocks_schema = {k: pa.from_numpy_dtype(np.int32) if blocks.schema[k].dataType.simpleString() == "int" else pa.int64() if blocks.schema[k].dataType.simpleString() == "bigint" else pa.string() for k in keys}
    return blocks.groupBy(*keys, "by", "bx").applyInArrow(run, ", ".join(x for x in (fields, schema) if x))


def combine(px: DataFrame, name: str, bands: Sequence[int], keys: Sequence[str] = (), fill: int = 0, side: int = SIDE, gray: bool = False) -> DataFrame:
    """Red, green, blue and alpha of a feature, or of a composite where ``name`` is empty: ``(keys, y, x, r, g, b, a)``.

    ``px (keys, band, y, x, v, a)``: the grid is the first band's; the others, of whatever size, are sampled at the same
    relative place (equal sizes are half a pixel apart from their samples). Alpha comes from the first band; what is not
    opaque takes the fill colour. With ``gray`` a feature of several bands is rendered as the gray of its first two. Rows
    outside the bands are not shuffled; an empty relation gives no rows.
    """
    keys, wanted = list(keys), list(dict.fromkeys(bands))
    px = px.filter(F.col("band").isin(*wanted)).select(*keys, "band", "y", "x", F.col("v").cast("double").alias("v"), F.col("a").cast("double").alias("a"))
    size = sizes(px, [*keys, "band"])
    grid = size.filter(F.col("band") == bands[0]).select(*keys, F.col("w").alias("out_w"), F.col("h").alias("out_h"))
    size = size.join(grid, keys) if keys else size.crossJoin(F.broadcast(grid))  # without keys: one row
    ready = px.join(size, [*keys, "band"]).withColumns({"off_x": F.lit(0), "off_y": F.lit(0)})
    blocks = to_blocks(ready, side)

    def work(key: dict, rows: dict) -> dict:
        planes, alpha, shape = [], None, None
        for b in bands:
            at = np.flatnonzero(rows["band"] == b)
            if not len(at):  # a band without samples here: transparent
                return {c: np.zeros(0, np.int32) for c in ("y", "x", "r", "g", "b", "a")}
            one = lambda c: int(rows[c][at[0]])  # noqa: B023, E731
            ys, xs = axis(key["by"], side, one("h"), one("out_h"), 0), axis(key["bx"], side, one("w"), one("out_w"), 0)
            got = sample(rows["y"][at], rows["x"][at], np.stack([rows["v"][at], rows["a"][at]], axis=1), ys, xs)
            planes.append(got[..., 0])
            if alpha is None:
                alpha, shape = trunc(got[..., 1]), (ys[0], xs[0])
        rgb = np.where((alpha == 255)[..., None] | (name == ""), feature_rgb("ND_UNSPEC" if gray and name and len(planes) > 1 else name, planes), fill)
        y, x = (g.ravel().astype(np.int32) for g in np.meshgrid(*shape, indexing="ij"))
        return {"y": y, "x": x, **{c: rgb[..., i].ravel().astype(np.int32) for i, c in enumerate("rgb")}, "a": alpha.ravel().astype(np.int32)}

    return _grouped(blocks, keys, work, "y int, x int, r int, g int, b int, a int")


def combine_each(px: DataFrame, names: Sequence[str], keys: Sequence[str], fill: int = 0, side: int = SIDE) -> DataFrame:
    """``combine`` for rasters of different features in one exchange: ``px`` also has ``which``, the place in ``names``.

    All bands of a raster that are there take part, in their order. Codes (SCL) are taken from the nearest sample, as they
    have no values in between.
    """
    keys = list(keys)
    px = px.select(*keys, "which", "band", "y", "x", F.col("v").cast("double").alias("v"), F.col("a").cast("double").alias("a"))
    size = sizes(px, [*keys, "band"])
    grid = size.filter("band = 0").select(*keys, F.col("w").alias("out_w"), F.col("h").alias("out_h"))
    blocks = to_blocks(px.join(size.join(grid, keys), [*keys, "band"]).withColumns({"off_x": F.lit(0), "off_y": F.lit(0)}), side)

    def work(key: dict, rows: dict) -> dict:
        name, planes, alpha, shape = names[int(rows["which"][0])], [], None, None
        for b in range(int(rows["band"].max()) + 1):
            at = np.flatnonzero(rows["band"] == b)
            if not len(at):
                return {c: np.zeros(0, np.int32) for c in ("y", "x", "r", "g", "b", "a")}
            one = lambda c: int(rows[c][at[0]])  # noqa: B023, E731
            ys, xs = axis(key["by"], side, one("h"), one("out_h"), 0), axis(key["bx"], side, one("w"), one("out_w"), 0)
            if name == "SCL":
                ys, xs = ((*a[:3], np.zeros(len(a[0]))) for a in (ys, xs))
            got = sample(rows["y"][at], rows["x"][at], np.stack([rows["v"][at], rows["a"][at]], axis=1), ys, xs)
            planes.append(got[..., 0])
            if alpha is None:
                alpha, shape = trunc(got[..., 1]), (ys[0], xs[0])
        if name == "SCL":
            alpha = np.where((planes[0] > 0) & (planes[0] < len(pixels.CLASS_COLOURS)) & (alpha == 255), 255, 0)
        rgb = np.where((alpha == 255)[..., None] | (name == ""), feature_rgb(name, planes), fill)
        y, x = (g.ravel().astype(np.int32) for g in np.meshgrid(*shape, indexing="ij"))
        return {"y": y, "x": x, **{c: rgb[..., i].ravel().astype(np.int32) for i, c in enumerate("rgb")}, "a": alpha.ravel().astype(np.int32)}

    return _grouped(blocks, keys, work, "y int, x int, r int, g int, b int, a int")


def resample(px: DataFrame, values: Sequence[str], levels: Sequence[tuple[int, int, int]], keys: Sequence[str] = (), side: int = SIDE) -> DataFrame:
    """Bilinear samples of a raster on several grids ``(z, width, height)`` at once: ``(keys, z, y, x, values)``."""
    keys = list(keys)
    levelled = F.array(*(F.struct(F.lit(z).alias("z"), F.lit(w).alias("out_w"), F.lit(h).alias("out_h")) for z, w, h in levels))
    px = px.select(*keys, "y", "x", *(F.col(v).cast("double").alias(v) for v in values))
    size = sizes(px, keys)
    ready = px.join(size, keys) if keys else px.crossJoin(F.broadcast(size))
    ready = ready.withColumn("_l", F.explode(levelled)).select(*keys, "_l.*", "y", "x", "w", "h", F.lit(0).alias("off_x"), F.lit(0).alias("off_y"), *values)

    def work(key: dict, rows: dict) -> dict:
        one = lambda c: int(rows[c][0])
        ys, xs = axis(key["by"], side, one("h"), one("out_h"), 0), axis(key["bx"], side, one("w"), one("out_w"), 0)
        got = sample(rows["y"], rows["x"], np.stack([rows[v] for v in values], axis=1), ys, xs)
        y, x = (g.ravel().astype(np.int32) for g in np.meshgrid(ys[0], xs[0], indexing="ij"))
        return {"y": y, "x": x, **{v: got[..., i].ravel() for i, v in enumerate(values)}}

    return _grouped(to_blocks(ready, side), [*keys, "z"], work, "y int, x int, " + ", ".join(f"{v} double" for v in values))


def render_tiles(px: DataFrame, layout: DataFrame, channels: Sequence[str], encode: Callable[[np.ndarray], bytes], extension: str, keys: Sequence[str], fill: int = 0, side: int = SIDE) -> DataFrame:
    """Encoded map tiles ``(keys, z, tx, ty, path, opaque, data)`` of rasters ``px (keys, y, x, channels, a)``.

    ``layout (keys, z, x_first, y_first, x_off, y_off, width, height)`` has a row for each zoom, as from ``tile_ranges``.
    Every zoom is resampled from the full resolution into its canvas of whole tiles, whose rest has the fill colour and
    alpha 0. A raster that is smaller than a pixel at a zoom has no tiles there. The path is ``name/z/x/y`` with the
    extension, the name being the keys.
    """
    keys = list(keys)
    px = px.select(*keys, "y", "x", *(F.col(v).cast("double").alias(v) for v in (*channels, "a")))
    ready = px.join(sizes(px, keys), keys).join(layout.filter("width > 0 and height > 0"), keys)
    ready = ready.select(*keys, "z", "x_first", "y_first", "y", "x", "w", "h", F.col("width").alias("out_w"), F.col("height").alias("out_h"), F.col("x_off").alias("off_x"), F.col("y_off").alias("off_y"), *channels, "a")

    def work(key: dict, rows: dict) -> dict:
        one = lambda c: int(rows[c][0])
        ys = axis(key["by"], side, one("h"), one("out_h"), one("off_y"))
        xs = axis(key["bx"], side, one("w"), one("out_w"), one("off_x"))
        got = trunc(sample(rows["y"], rows["x"], np.stack([rows[v] for v in (*channels, "a")], axis=1), ys, xs))
        canvas = np.full((side, side, len(channels) + 1), fill, np.int64)
        canvas[..., -1] = 0
        if len(ys[0]) and len(xs[0]):
            top, left = int(ys[0][0]) + one("off_y") - key["by"] * side, int(xs[0][0]) + one("off_x") - key["bx"] * side
            canvas[top : top + got.shape[0], left : left + got.shape[1]] = got
        tx, ty = one("x_first") + key["bx"], one("y_first") + key["by"]
        name = "-".join(str(key[k]) for k in keys)
        return {"tx": np.array([tx], np.int32), "ty": np.array([ty], np.int32), "path": [f"{name}/{key['z']}/{tx}/{ty}{extension}"], "opaque": np.array([int((canvas[..., -1] == 255).sum())], np.int64), "data": [encode(canvas.astype(np.uint8))]}

    tiles = _grouped(to_blocks(ready, side), [*keys, "z"], work, "tx int, ty int, path string, opaque bigint, data binary")
    return tiles


# windows: samples as arrays, for scenes of which a row for each sample would be too many


WINDOW = "by int, bx int, band int, grid_h int, grid_w int, h int, w int, top int, left int, rows int, deep boolean, data binary"


def windows(img: np.ndarray, band: int, grid: tuple[int, int] | None = None, side: int = SIDE) -> dict[str, list]:
    """The parts of one channel (height, width) that the blocks of a grid (height, width) need, as columns of ``WINDOW``.

    A window holds the samples of its block and the next row and column, so that blocks can be sampled apart: a scene is
    dealt out with hardly a byte twice.
    """
    (h, w), (grid_h, grid_w) = img.shape, grid or img.shape
    out: dict[str, list] = {f.split()[0]: [] for f in WINDOW.split(", ")}
    for by in range(-(-grid_h // side)):
        _, y0, y1, _ = axis(by, side, h, grid_h, 0)
        for bx in range(-(-grid_w // side)):
            _, x0, x1, _ = axis(bx, side, w, grid_w, 0)
            part = np.ascontiguousarray(img[y0[0] : y1[-1] + 1, x0[0] : x1[-1] + 1])
            row = (by, bx, band, grid_h, grid_w, h, w, int(y0[0]), int(x0[0]), part.shape[0], img.dtype.itemsize == 2, part.tobytes())
            for column, value in zip(out.values(), row):
                column.append(value)
    return out


def combine_windows(df: DataFrame, name: str, bands: Sequence[int], keys: Sequence[str] = (), fill: int = 0, side: int = SIDE, encode: Callable[[np.ndarray], bytes] | None = None) -> DataFrame:
    """A feature or composite of windows ``(keys, WINDOW)``: ``(keys, by, bx, h, w, data)``, the block's four channels or its file.

    Samples of 16 bits are digital numbers: 0 is transparent in the first band, the rest becomes a reflectance level. One
    exchange of two bytes a sample; bands may differ in size if all were cut for the first one's grid.
    """
    keys, wanted = list(keys), list(dict.fromkeys(bands))
    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(table: pa.Table) -> pa.Table:
        rows = {r["band"]: r for r in table.to_pylist()}
        if any(b not in rows for b in wanted):
            return table.slice(0, 0).select([*keys, "by", "bx"]).append_column("h", pa.array([], pa.int32())).append_column("w", pa.array([], pa.int32())).append_column("data", pa.array([], pa.binary()))
        planes, alpha = [], None
        for b in bands:
            r = rows[b]
            ys, xs = axis(r["by"], side, r["h"], r["grid_h"], 0), axis(r["bx"], side, r["w"], r["grid_w"], 0)
            raw = np.frombuffer(r["data"], np.uint16 if r["deep"] else np.uint8).reshape(r["rows"], -1)
            values = raw.astype(np.float64)
            level = np.floor(np.clip((values - pixels.BOA_OFFSET) / float(pixels.BOA_RANGE), 0, 1) * 65535 + TINY) if r["deep"] else values
            a, c, e, g = ys[1] - r["top"], ys[2] - r["top"], xs[1] - r["left"], xs[2] - r["left"]
            mix = lambda v: _mixed(v, a, c, e, g, ys[3][:, None], xs[3][None, :])  # noqa: B023, E731
            planes.append(mix(level if name else level // 256 if r["deep"] else level))
            if alpha is None:
                alpha = trunc(mix(np.where(raw == 0, 0.0, 255.0))) if r["deep"] and not raw.all() else np.full(planes[0].shape, 255)
        rgb = np.where((alpha == 255)[..., None] | (name == ""), feature_rgb(name, planes), fill)
        img = np.concatenate([rgb, alpha[..., None]], axis=2).astype(np.uint8)
        first = table.slice(0, 1).select([*keys, "by", "bx"])
        size = [pa.array([n], pa.int32()) for n in img.shape[:2]]
        return first.append_column("h", size[0]).append_column("w", size[1]).append_column("data", pa.array([encode(img) if encode else img.tobytes()], pa.binary()))

    schema = ", ".join(x for x in (fields, "by int, bx int, h int, w int, data binary") if x)
    return df.filter(F.col("band").isin(*wanted)).groupBy(*keys, "by", "bx").applyInArrow(run, schema)


def _mixed(v: np.ndarray, a: np.ndarray, c: np.ndarray, e: np.ndarray, g: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """Bilinear samples at rows a and c, columns e and g."""
    across = v[:, e] + dx * (v[:, g] - v[:, e])
    return across[a] + dy * (across[c] - across[a])
