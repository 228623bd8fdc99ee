"""Pixel-wise column functions: radiometry, indices, colours. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour ramps (breakpoint, red-green-blue), class colours, bands that a feature needs.
RAMPS = {
    "NDVI": ((-1.0, 0x0C0C0C), (-0.5, 0xBFBFBF), (-0.2, 0xDBDBDB), (0.0, 0xEAEAEA), (0.025, 0xFFF9CC), (0.075, 0xDDD89B), (0.1, 0xCCC682), (0.2, 0x91BF51), (1.0, 0x004400)),
    "NDMI": ((-0.8, 0x800000), (-0.24, 0xFF0000), (-0.032, 0xFFFF00), (0.032, 0x00FFFF), (0.24, 0x0000FF), (0.8, 0x000080)),
    "NDWI": ((-0.8, 0x008000), (0.0, 0xFFFFFF), (0.8, 0x0000CC)),
}
CLASS_COLOURS = (0x000000, 0xFF0000, 0x2F2F2F, 0x643200, 0x00A000, 0xFFE65A, 0x0000FF, 0x808080, 0xC0C0C0, 0xFFFFFF, 0x64C8FF, 0xFF96FF)
SNOW_LIMIT, SNOW_COLOUR = 0.42, (0, 204, 255)
BOA_OFFSET, BOA_RANGE = 1000, 10000

#: Products that are whole numbers on paper may come out a bit below; this is added before truncation.
TINY = 1e-7


def trunc(x: Column) -> Column:
    """Whole part of a value that is not negative."""
    return F.floor(x + F.lit(TINY)).cast("int")


def sat01(x: Column) -> Column:
    """Clamp to 0..1; NaN and null become 0."""
    return F.least(F.greatest(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def boa(dn: Column) -> Column:
    """Bottom-of-atmosphere reflectance of a digital number, as an unsigned 16-bit level."""
    return trunc(sat01((dn - BOA_OFFSET) / F.lit(float(BOA_RANGE))) * 65535)


def nodata_alpha(dn: Column) -> Column:
    return F.when(dn == 0, 0).otherwise(255)


def to_8bit(v: Column) -> Column:
    return F.shiftright(v, 8)


def complex_magnitude(i: Column, q: Column) -> Column:
    return trunc(F.sqrt((i * i + q * q).cast("double")))


def equalise(v: Column, scale: Column) -> Column:
    """8-bit level of ``v`` against a scale; a scale of 0 gives 0."""
    return trunc(sat01(F.try_divide(v.cast("double"), scale)) * 255)


def normalised_difference(a: Column, b: Column) -> Column:
    return (a - b) / (a + b + F.lit(1e-9))


def gray_of_index(nd: Column) -> Column:
    return trunc(sat01((nd + 1) / 2) * 255)


def highlight(v: Column) -> Column:
    """Highlight-optimised level of a 16-bit reflectance."""
    return trunc(sat01(F.cbrt(F.lit(0.6) * v / F.lit(65535.0) - F.lit(0.035))) * 255)


def brighten(v: Column) -> Column:
    return trunc(sat01(v / F.lit(65535.0) * F.lit(2.5)) * 255)


def gamma(v: Column) -> Column:
    """8-bit level of a 16-bit one under a gamma of 2."""
    share = v / F.lit(65535.0)
    return trunc(share * share * 255)


def rgb_parts(colour: int) -> tuple[int, int, int]:
    return colour >> 16, colour >> 8 & 255, colour & 255


def ramp(nd: Column, points: tuple) -> list[Column]:
    """Red, green and blue of an index by linear interpolation between breakpoints, clamped at both ends.

    A value on a breakpoint belongs to the segment below. One generated CASE, no join.
    """
    out = []
    for part in range(3):
        level = lambda c: float(rgb_parts(c)[part])  # noqa: B023, E731
        case = F.when(nd <= points[0][0], int(level(points[0][1])))
        for (lo, c1), (hi, c2) in zip(points, points[1:]):
            t = nd - F.lit(lo)
            mixed = F.lit(level(c1)) * (F.lit(hi - lo) - t) / F.lit(hi - lo) + F.lit(level(c2)) * t / F.lit(hi - lo)
            case = case.when(nd <= hi, F.floor(mixed + F.lit(0.5 + TINY)).cast("int"))
        out.append(case.otherwise(int(level(points[-1][1]))))
    return out


# The weights of luma and chroma in 16 and 18 bits.


def luma(r: Column, g: Column, b: Column) -> Column:
    """Limited-range Y of full-range RGB."""
    return F.shiftright(r * 16839 + g * 33059 + b * 6420 + 32768 + (16 << 16), 16)


def _chroma(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(v + (128 << 18) + (1 << 17), 18)))


def chroma_u(r4: Column, g4: Column, b4: Column) -> Column:
    """U of a block from the sums of its four pixels."""
    return _chroma(r4 * -9719 - g4 * 19081 + b4 * 28800)


def chroma_v(r4: Column, g4: Column, b4: Column) -> Column:
    return _chroma(r4 * 28800 - g4 * 24116 - b4 * 4684)
