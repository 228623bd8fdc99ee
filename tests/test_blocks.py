"""Blocks, tiles, requests and options against plain arrays, on edge cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrella.functions import geo, requests
from rastrella.operators import blocks
from rastrella.operators import raster as op
from rastrella.plans import execute, options
from rastrella.sources import images


def frame(spark, arrays, schema="band int, y int, x int, v int, a int"):
    """Bands of arrays (value, alpha)."""
    rows = [(b, y, x, int(v[y, x]), int(a[y, x])) for b, (v, a) in arrays.items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    return spark.createDataFrame(rows, schema).repartition(3)


def sampled(v, h, w):
    sy, sx = (np.arange(h) + 0.5) / h * v.shape[0], (np.arange(w) + 0.5) / w * v.shape[1]
    y0, x0 = np.minimum(sy.astype(int), v.shape[0] - 1), np.minimum(sx.astype(int), v.shape[1] - 1)
    y1, x1, dy, dx = np.minimum(y0 + 1, v.shape[0] - 1), np.minimum(x0 + 1, v.shape[1] - 1), (sy - y0)[:, None], sx - x0
    top = v[y0][:, x0] + dx * (v[y0][:, x1] - v[y0][:, x0])
    low = v[y1][:, x0] + dx * (v[y1][:, x1] - v[y1][:, x0])
    return top + dy * (low - top)


def image_of(rows, h, w, channels):
    out = np.full((h, w, len(channels)), -1)
    for r in rows:
        out[r["y"], r["x"]] = [r[c] for c in channels]
    assert len(rows) == h * w and (out >= -0.5).all()
    return out


@pytest.mark.parametrize(("sizes", "side"), [(((11, 9), (11, 9)), 4), (((13, 10), (5, 3)), 4), (((6, 7), (25, 30)), 4), (((1, 1), (1, 1)), 256), (((9, 17), (1, 2)), 8), (((8, 8), (8, 8)), 8)])
def test_bands_of_any_size_meet(spark, sizes, side):
    rng = np.random.default_rng(1)
    arrays = {b: (rng.integers(0, 65536, s), np.where(rng.random(s) < 0.1, 0, 255)) for b, s in enumerate(sizes)}
    got = image_of(blocks.combine(frame(spark, arrays), "NDWI", (0, 1), side=side, fill=3).collect(), *sizes[0], "rgba")
    b0, b1 = (sampled(arrays[b][0].astype(float), *sizes[0]) for b in (0, 1))
    alpha = np.floor(sampled(arrays[0][1].astype(float), *sizes[0]) + 1e-7)
    want = np.where((alpha == 255)[..., None], blocks.feature_rgb("NDWI", [b0, b1]), 3)
    assert (got[..., :3] == want).all() and (got[..., 3] == alpha).all()


def test_several_rasters_and_gaps(spark):
    rng = np.random.default_rng(2)
    sizes = {1: (5, 8), 2: (9, 3)}
    rows, arrays = [], {}
    for i, s in sizes.items():
        v = rng.integers(1, 60_000, (2, *s))
        arrays[i] = v
        rows += [(i, b, y, x, int(v[b, y, x]), 255) for b in (0, 1) for y in range(s[0]) for x in range(s[1])]
    px = spark.createDataFrame(rows, "k long, band int, y int, x int, v int, a int")
    whole = blocks.combine(px, "ND_UNSPEC", (0, 1), ["k"], side=4).collect()
    for i, s in sizes.items():
        got = image_of([r for r in whole if r["k"] == i], *s, "rgba")
        b = [sampled(arrays[i][j].astype(float), *s) for j in (0, 1)]
        assert (got[..., :3] == blocks.feature_rgb("ND_UNSPEC", b)).all()
    holed = blocks.combine(px.filter("k = 1 and not (x = 3 and y = 2)"), "ND_UNSPEC", (0, 1), ["k"], side=4).collect()
    alpha = image_of(holed, 5, 8, "rgba")[..., 3]
    assert (alpha[1:3, 2:4] == 191).all() and (np.delete(alpha.ravel(), [10, 11, 18, 19]) == 255).all()
    assert blocks.combine(px.limit(0), "NDVI", (0, 1), ["k"]).count() == 0


def test_neighbours_of_a_raster_with_gaps(spark):
    px = spark.createDataFrame([(0, 0, 1), (0, 2, 3), (0, 3, 4), (1, 0, 5), (3, 0, 9)], "y int, x int, v int")
    got = {(r["y"], r["x"]): list(r["v"]) for r in op.with_neighbours(px, ["v"]).collect()}
    assert got == {(0, 0): [1, 1, 5, 5], (0, 2): [3, 4, 3, 4], (0, 3): [4, 4, 4, 4], (1, 0): [5, 5, 5, 5], (3, 0): [9, 9, 9, 9]}


def test_every_feature_equals_its_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 0, *map(int, rng.integers(0, 65536, 4)), 255) for i in range(400)] + [(400, 0, 0, 0, 0, 0, 255), (401, 0, 65535, 65535, 65535, 65535, 255), (402, 0, 30_000, 20_000, 1, 2, 0)]
    table = spark.createDataFrame([(r[0], r[1], *map(float, r[2:6]), r[6]) for r in rows], "x int, y int, b0 double, b1 double, b2 double, b3 double, a int")
    planes = [np.array([float(r[2 + i]) for r in rows]) for i in range(4)]
    for name in ("NDVI", "NDMI", "NDWI", "NDSI", "HONS", "ND_UNSPEC"):
        got = {r["x"]: (r["r"], r["g"], r["b"]) for r in op.colour_feature(table, name, 9).collect()}
        want = np.where((np.array([r[6] for r in rows]) == 255)[:, None], blocks.feature_rgb(name, planes), 9)
        assert [got[r[0]] for r in rows] == [tuple(w) for w in want.tolist()], name


def test_zero_raster_and_odd_chroma(spark):
    px = spark.createDataFrame([(y, x, 0) for y in range(3) for x in range(3)], "y int, x int, dn int")
    assert {r["level"] for r in op.equalise(px, "dn").collect()} == {0}
    rng = np.random.default_rng(4)
    img = rng.integers(0, 256, (5, 3, 3))
    px = spark.createDataFrame([(y, x, *map(int, img[y, x])) for y in range(5) for x in range(3)], "y int, x int, r int, g int, b int")
    got = {(r["by"], r["bx"]): (r["u"], r["v"]) for r in op.chroma_420(px, 3, 5).collect()}
    padded = np.pad(img, ((0, 1), (0, 1), (0, 0)), mode="edge").astype(int)
    for y in range(3):
        for x in range(2):
            r, g, b = padded[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].reshape(4, 3).sum(axis=0).tolist()
            u, v = ((c + (128 << 18) + (1 << 17)) >> 18 for c in (-9719 * r - 19081 * g + 28800 * b, 28800 * r - 24116 * g - 4684 * b))
            assert got[y, x] == (min(255, max(0, u)), min(255, max(0, v)))


def test_tiles_cover_their_canvas(spark, tmp_path):
    rng = np.random.default_rng(5)
    img, alpha = rng.integers(0, 256, (40, 60)), np.full((40, 60), 255)
    px = spark.createDataFrame([(7, y, x, int(img[y, x]), int(alpha[y, x])) for y in range(40) for x in range(60)], "raster_id long, y int, x int, r int, a int")
    box = spark.createDataFrame([(7, 0.5004, 0.2501, 0.5023, 0.2517)], "raster_id long, xl double, yt double, xr double, yb double")
    layout = op.tile_ranges(box, (0, 8, 10))
    tiles = blocks.render_tiles(px, layout, ["r"], images.write_png, ".png", ["raster_id"], fill=77)
    execute.write_tiles(tiles, str(tmp_path / "tiles"))
    rows = spark.read.parquet(str(tmp_path / "tiles")).collect()
    assert {r["z"] for r in rows} == {8, 10}  # at zoom 0 the raster is smaller than a pixel
    for z in (8, 10):
        n = 2.0**z
        w, h = (int(s * n * 256 + 1e-7) for s in (0.5023 - 0.5004, 0.2517 - 0.2501))
        x0, y0 = int(0.5004 * n * 256 + 1e-7), int(0.2501 * n * 256 + 1e-7)
        want = np.floor(sampled(img.astype(float), h, w) + 1e-7)
        canvas = {}
        for r in rows:
            if r["z"] == z:
                tile = images.read_png(r["data"])
                assert tile.shape == (256, 256, 2) and r["path"] == f"7/{z}/{r['tx']}/{r['ty']}.png"
                canvas[r["tx"], r["ty"]] = tile
        seen = 0
        for (tx, ty), tile in canvas.items():
            for y in range(256):
                for x in range(256):
                    iy, ix = ty * 256 + y - y0, tx * 256 + x - x0
                    inside = 0 <= iy < h and 0 <= ix < w
                    seen += inside
                    assert tuple(tile[y, x]) == ((want[iy, ix], 255) if inside else (77, 0))
        assert seen == w * h


def test_quad_warp_maps_corners(spark):
    quad = ((10.0, 4.0), (58.0, 9.0), (50.0, 44.0), (3.0, 36.0))
    at = spark.createDataFrame([(x, y) for x, y in quad], "x double, y double")
    u, v = geo.unit_of_quad(F.col("x"), F.col("y"), quad)
    assert [(round(r[0], 9), round(r[1], 9)) for r in at.select(u, v).collect()] == [(0, 0), (1, 0), (1, 1), (0, 1)]
    square = ((0.0, 0.0), (8.0, 0.0), (8.0, 6.0), (0.0, 6.0))
    px = spark.createDataFrame([(y, x, y * 10 + x) for y in range(6) for x in range(8)], "y int, x int, v int")
    got = op.warp_quad(px, square, ["v"], 8, 6, 8, 6).collect()
    assert {r["a"] for r in got} == {255} and len(got) == 48
    img = np.array([[y * 10 + x for x in range(8)] for y in range(6)], float)
    want = np.floor(sampled(img, 6, 8) + 1e-7)
    assert all(r["v"] == want[r["y"], r["x"]] for r in got)


def test_requests_end_to_end(spark):
    rng = np.random.default_rng(6)
    bands = [rng.integers(0, 9000, (6, 5, 1)).astype(np.uint16) for _ in range(2)]
    files = [(f"in/b{i}.v1.tif", images.write_tiff(b)) for i, b in enumerate(bands)] + [("gray.png", images.write_png(np.full((3, 4, 1), 9, np.uint8))), ("bad.png", b"\x89PNG but no more"), ("empty.pgm", b"")]
    asked = ["NDMI@in/b0.v1.tif,in/b1.v1.tif", "gray.png", "bad.png", "no.png", "NDMI@gray.png", "empty.pgm", "a,b,c,d,e", "WHAT@gray.png", "gray.png:q=3:s=2", "gray.png,gray.png,gray.png"]
    lines = spark.createDataFrame(list(enumerate(asked)), "req_id long, request string")
    encoded, manifest = execute.run(lines, spark.createDataFrame(files, "path string, data binary"), "PNG", "/out/")
    rows = {r["req_id"]: r for r in manifest.collect()}
    assert [rows[i]["status"] for i in range(10)] == ["ok", "ok", "unreadable file", "missing file", "invalid request", "unreadable file", "invalid request", "invalid request", "ok", "ok"]
    assert json.loads(rows[0]["entry"]) == {"infile": asked[0].split("@")[1], "outfile": "/out/NDMI-b0.v1-COMMA-b1.v1.png"} and rows[2]["entry"] is None
    assert (rows[8]["width"], rows[8]["height"]) == (2, 2) and (rows[9]["width"], rows[9]["height"]) == (4, 3) and rows[0]["size"] == f"{rows[0]['n_bytes']:,}"
    assert execute.exit_code(manifest) == 2 and execute.exit_code(manifest.filter("status = 'ok'")) == 0
    pictures = {r["req_id"]: images.read_png(bytes(r["data"])) for r in encoded.collect()}
    assert set(pictures) == {0, 1, 8, 9} and (pictures[1] == [9, 9, 9, 255]).all()
    levels = [np.floor(np.clip((b[..., 0].astype(float) - 1000) / 10000, 0, 1) * 65535 + 1e-7) for b in bands]
    alpha = np.floor(sampled(np.where(bands[0][..., 0] == 0, 0.0, 255.0), 6, 5) + 1e-7)
    want = np.where((alpha == 255)[..., None], blocks.feature_rgb("NDMI", [sampled(v, 6, 5) for v in levels]), 0)
    assert (pictures[0][..., :3] == want).all()


def test_limits_and_boxes_of_requests(spark):
    tags = [(33922, 12, [0.0, 0.0, 0.0, 5e5, 5.6e6, 0.0]), (33550, 12, [10.0, 10.0, 0.0]), (34735, 3, [1, 1, 0, 1, 3072, 0, 1, 32633])]
    files = [("g.tif", images.write_tiff(np.full((7, 9, 1), 40, np.uint8), extra=tags)), ("n.png", images.write_png(np.full((7, 9, 1), 40, np.uint8), predict=False))]
    lines = spark.createDataFrame([(0, "g.tif"), (1, "n.png")], "req_id long, request string")
    _, manifest = execute.run(lines, spark.createDataFrame(files, "path string, data binary"), "PNG", memory=7 * 9 * 4 * 20 / 4)
    rows = {r["req_id"]: r for r in manifest.collect()}
    assert (rows[0]["width"], rows[0]["height"]) == (5, 4) and rows[1]["bbox"] is None and "bbox" not in json.loads(rows[1]["entry"])
    west, south, east, north = json.loads(json.loads(rows[0]["entry"])["bbox"])
    lat, lon = geo.utm_inverse(5e5, 5.6e6, 33)
    assert abs(north - lat) < 2e-6 and abs(west - lon) < 2e-6 and south < north and west < east
    bands = spark.createDataFrame([(0, 0, y, x, x, 255) for y in range(3) for x in range(10)], "req_id long, band int, y int, x int, v int, a int")
    got = sorted((r["y"], r["x"], r["v"]) for r in execute.shrunk(bands, 4).collect())
    assert got == [(0, 0, 0), (0, 1, 3), (0, 2, 6), (0, 3, 9)]


def test_map_tiles_of_requests(spark):
    """From files with coordinates to tiles: the tiles hold the picture, at the place that its corners have."""
    tags = lambda x, y: [(33922, 12, [0.0, 0.0, 0.0, x, y, 0.0]), (33550, 12, [10.0, 10.0, 0.0]), (34735, 3, [1, 1, 0, 1, 3072, 0, 1, 32633])]
    img = np.full((40, 60, 1), 200, np.uint8)
    files = [("a.tif", images.write_tiff(img, extra=tags(5e5, 5.6e6))), ("b.tif", images.write_tiff(img, extra=tags(6e5, 5.5e6))), ("plain.png", images.write_png(img))]
    lines = spark.createDataFrame([(0, "a.tif"), (1, "b.tif"), (2, "plain.png"), (3, "lost.tif")], "req_id long, request string")
    rows = execute.map_tiles(lines, spark.createDataFrame(files, "path string, data binary"), (12, 14)).collect()
    assert {(r["req_id"], r["z"]) for r in rows} == {(0, 12), (0, 14), (1, 12), (1, 14)}
    for i, (x, y) in enumerate(((5e5, 5.6e6), (6e5, 5.5e6))):
        left, top, right, bottom = geo.mercator_bounds_of_utm(x, y, x + 600, y - 400, 33)
        for z in (12, 14):
            n, found = 2.0**z, [r for r in rows if r["req_id"] == i and r["z"] == z]
            assert {(r["tx"], r["ty"]) for r in found} <= {(a, b) for a in range(int(left * n), int(right * n) + 1) for b in range(int(top * n), int(bottom * n) + 1)}
            area = (right - left) * (bottom - top) * n * n * 65_536
            opaque = sum(r["opaque"] for r in found)
            assert 0.75 * area <= opaque <= 1.02 * area
            for r in found:
                tile = images.read_png(bytes(r["data"]))
                assert (tile[tile[..., 3] == 255][:, :3] == 200).all() and (tile[tile[..., 3] == 0][:, :3] == 0).all()


def test_options():
    o = options.parse(["-F", "0x10", "-p", "-J", "-W", "-z", "8,0x9", "-o", "out/", "-q", "82", "-s", "2", "-n", "-v", "-v", "-D", "1", "a.tif", "b.tif"])
    assert (o.fill, o.tile, o.whole, o.zooms, o.folder, o.quality, o.scale, o.warp, o.level, o.inputs) == (16, "PNG", ("JPEG", "WEBP"), (8, 9), "out/", 82, 2, False, 2, ("a.tif", "b.tif"))
    assert options.parse(["-p", "x"]).whole_formats() == ("PNG",) and options.parse(["-p", "-N", "x"]).whole_formats() == () and options.parse(["x"]).whole_formats() == ("JPEG",)
    assert options.parse(["-j", "x"]).alpha_wanted("NDVI") and not options.parse(["-j", "x"]).alpha_wanted() and options.parse(["-w", "x"]).alpha_wanted()
    for bad in (["-F", "256", "x"], ["-F", "-1", "x"], [], ["-y", "x"], ["-z", "25", "x"], ["-J", "-P", "-R", "-W", "-J", "x"]):
        with pytest.raises(ValueError):
            options.parse(bad)


def test_request_prefix_has_nine_characters(spark):
    rows = spark.createDataFrame([("ABCDEFGHIJNDVI@x",), ("MY_NDVI_X@x",), ("x",)], "r string")
    assert [r[0] for r in rows.select(requests.prefix(F.col("r"))).collect()] == ["ABCDEFGHI", "MY_NDVI_X", ""]
    assert [r[0] for r in rows.select(requests.feature(F.col("r"))).collect()] == [None, "NDVI", ""]


@pytest.mark.parametrize("sizes", [((30, 21), (30, 21)), ((30, 21), (15, 11)), ((9, 7), (20, 3))])
def test_windows_equal_samples(spark, sizes):
    """The array form of a feature, from files, against the form that has a row for each sample."""
    rng = np.random.default_rng(9)
    raw = [np.where(rng.random(s) < 0.03, 0, rng.integers(900, 12_000, s)).astype(np.uint16) for s in sizes]
    files = [(1, b, images.write_tiff(v[..., None]) if b else images.write_pnm(v[..., None]), *sizes[0]) for b, v in enumerate(raw)] + [(2, 0, b"broken", 5, 5)]
    frame_ = spark.createDataFrame(files, "k long, band int, data binary, grid_h int, grid_w int")
    got = blocks.combine_windows(images.decode_windows(frame_, ["k"], side=8), "NDMI", (0, 1), ["k"], fill=4, side=8).collect()
    out = np.full((*sizes[0], 4), -1)
    for r in got:
        assert r["k"] == 1
        out[r["by"] * 8 : r["by"] * 8 + r["h"], r["bx"] * 8 : r["bx"] * 8 + r["w"]] = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"], 4)
    levels = [np.floor(np.clip((v.astype(float) - 1000) / 10000, 0, 1) * 65535 + 1e-7) for v in raw]
    arrays = {b: (levels[b], np.where(raw[b] == 0, 0, 255)) for b in (0, 1)}
    assert (out == image_of(blocks.combine(frame(spark, arrays), "NDMI", (0, 1), fill=4, side=8).collect(), *sizes[0], "rgba")).all()
    plain = blocks.combine_windows(images.decode_windows(frame_.drop("grid_h", "grid_w").filter("k = 1 and band = 0"), ["k"], side=8), "", (0,), ["k"], side=8, encode=images.write_png).collect()
    assert all(images.read_png(bytes(r["data"])).shape == (r["h"], r["w"], 4) for r in plain)
