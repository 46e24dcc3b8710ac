"""Column expressions of the plane geometry: projection, blocks, borders, retention laws."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.0


def project(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Equirectangular x, y in km from (lon0, lat0), the longitude shrunk by the cosine of the node's own latitude."""
    return (lon - lon0) * KM_PER_DEGREE * F.cos(F.radians(lat)), (lat - lat0) * KM_PER_DEGREE


def extent_km(lon_min: Column, lon_max: Column, lat_min: Column, lat_max: Column) -> tuple[Column, Column]:
    """Width and height in km of a box, the longitude shrunk by the cosine at the box's centre."""
    return (lon_max - lon_min) * KM_PER_DEGREE * F.cos(F.radians((lat_min + lat_max) / 2)), (lat_max - lat_min) * KM_PER_DEGREE


def block_number(x: Column, y: Column, g: float, max_gy: int) -> Column:
    """Number of the square block of side g that holds (x, y), both from 0 on; max_gy is the largest row of blocks."""
    return (F.floor(x / g) * (max_gy + 1) + F.floor(y / g)).cast("long")


def block_place(block: Column, max_gy: int) -> tuple[Column, Column]:
    """Column and row of a block number."""
    return F.floor(block / (max_gy + 1)).cast("long"), (block % (max_gy + 1)).cast("long")


def border_distance(x: Column, y: Column, g: float) -> Column:
    """Distance to the border of the own block."""
    dx, dy = x - F.floor(x / g) * g, y - F.floor(y / g) * g
    return F.least(dx, g - dx, dy, g - dy)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6_371_000.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def falling_ratio(top: Column, bottom: Column, m: Column) -> Column:
    """(top)_m / (bottom)_m of falling factorials, m from 0 to 8; 0 where there are fewer than m to choose from."""
    share = lambda j: F.greatest(F.coalesce(F.try_divide((top - j).cast("double"), (bottom - j).cast("double")), F.lit(0.0)), F.lit(0.0))
    return F.aggregate(F.sequence(F.lit(0), F.lit(8)), F.lit(1.0), lambda acc, j: F.when(j < m, acc * share(j)).otherwise(acc))


def retention_law(g: Column, b: Column, q: Column) -> Column:
    """Mean share of a block of side g that is left by a trim of b when each neighbour spares it with probability q."""
    inner, corner = g - 2 * b, b * b
    return (inner * inner + 4 * b * inner * q + (4 - math.pi) * corner * q * q + math.pi * corner * q * q * q) / (g * g)


SIDES = ("left", "right", "bottom", "top")
CORNERS = [(x, y) for y in ("bottom", "top") for x in ("left", "right")]


def trimmed_area(width: Column, height: Column, b: Column, trims: dict[str | tuple[str, str], Column]) -> Column:
    """Area that a buffer b leaves of a block whose neighbours trim (1) or not (0), by side and by corner (pair of sides).

    A side takes a strip. A corner's quarter disc counts only where neither strip beside it has taken it already.
    """
    quarter = math.pi * b * b / 4
    lost = [trims[x, y] * (1 - trims[x]) * (1 - trims[y]) * quarter for x, y in CORNERS]
    across, up = (F.greatest(F.lit(0.0), size - b * (trims[x] + trims[y])) for size, x, y in ((width, "left", "right"), (height, "bottom", "top")))
    return F.least(F.greatest(across * up - sum(lost[1:], lost[0]), F.lit(0.0)), width * height)
