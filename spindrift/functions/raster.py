"""Look-ups in rasters packed as one array a frame, row by row: no pixel is ever shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixel(raster: Column, x: Column, y: Column, h: Column, w: Column, outside: float | None = None) -> Column:
    """The value at whole x, y; beyond the edge the nearest one, or `outside`."""
    held = F.get(raster, (F.least(F.greatest(y, F.lit(0)), h - 1) * w + F.least(F.greatest(x, F.lit(0)), w - 1)).cast("int")).cast("double")
    if outside is None:
        return held
    return F.when((x >= 0) & (y >= 0) & (x < w) & (y < h), held).otherwise(F.lit(outside))


def bilinear(raster: Column, x: Column, y: Column, h: Column, w: Column, outside: float | None = None) -> Column:
    """Value between the four pixels around x, y, pixel centres being whole numbers.

    outside None: coordinates are held to the raster; else neighbours beyond it have that value.
    """
    if outside is None:
        x, y = F.least(F.greatest(x, F.lit(0.0)), w - 1.0), F.least(F.greatest(y, F.lit(0.0)), h - 1.0)
    x0, y0 = F.floor(x), F.floor(y)
    fx, fy = x - x0, y - y0
    at = lambda i, j: pixel(raster, x0 + i, y0 + j, h, w, outside)
    return at(0, 0) * (1 - fx) * (1 - fy) + at(1, 0) * fx * (1 - fy) + at(0, 1) * (1 - fx) * fy + at(1, 1) * fx * fy


def normalised_coordinate(c: Column, size: Column) -> Column:
    """Pixel coordinate to [-1, 1], the ends being the first and last pixel's centres."""
    return c / (size - 1.0) * 2.0 - 1.0


def resized_coordinate(c: Column, size: Column, new_size: Column) -> Column:
    return c * new_size / size


def trilinear(volume: Column, x: Column, y: Column, z: Column, d: int, h: int, w: int) -> Column:
    """Value between the eight cells around x, y, z of a packed d x h x w volume; coordinates are held to it."""
    held = [F.least(F.greatest(c, F.lit(0.0)), F.lit(n - 1.0)) for c, n in ((x, w), (y, h), (z, d))]
    low = [F.least(F.floor(c), F.lit(n - 2)) if n > 1 else F.lit(0) for c, n in zip(held, (w, h, d), strict=True)]
    share = [c - c0 for c, c0 in zip(held, low, strict=True)]
    total = F.lit(0.0)
    for corner in range(8):
        bits = [corner >> i & 1 for i in range(3)]
        at = [F.least(c0 + b, F.lit(n - 1)) for c0, b, n in zip(low, bits, (w, h, d), strict=True)]
        weight = F.lit(1.0)
        for b, f in zip(bits, share, strict=True):
            weight = weight * (f if b else 1.0 - f)
        total = total + weight * F.get(volume, ((at[2] * h + at[1]) * w + at[0]).cast("int")).cast("double")
    return total


def byte_to_signed(v: Column) -> Column:
    """0..255 to -1..1."""
    return v / 255.0 * 2.0 - 1.0


def pixel_to_clip(px: Column, py: Column, depth: Column, w: Column, h: Column) -> list[Column]:
    """A pixel with depth as homogeneous clip coordinates: x and y from -1 to 1 with y upward, times the depth."""
    return [(px / w * 2.0 - 1.0) * depth, (1.0 - py / h * 2.0) * depth, depth, depth]
