"""A hexagonal grid as Column expressions.

A cell of a level has axial coordinates (q, r) on the plane (longitude shrunk by the cosine of a fixed latitude,
latitude), pointed at the top. Its id is "level_q_r". Everything is arithmetic on columns, so cells of billions of points
are computed inside code generation, and neighbours, distances and parents need no lookup table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of the nominal resolutions in km, as fixed by the data model (10 km is coarser than 22 km there).
LEVELS = {64: 2, 22: 5, 10: 4, 1: 7}
#: Distance from the centre of a cell to a corner, in degrees of latitude.
SIZE = {2: 1.5, 4: 0.6, 5: 0.25, 7: 0.05}
#: Degrees by which boxes are widened before they are filled.
BUFFER = {2: 2.5, 4: 0.5, 5: 0.25, 7: 0.05}
SHRINK = math.cos(math.radians(35.0))
ROOT3 = math.sqrt(3.0)
KM_PER_DEGREE = 111.0


def level_of(km: int) -> int:
    if km not in LEVELS:
        raise ValueError(f"no grid level for {km} km; known: {sorted(LEVELS)}")
    return LEVELS[km]


def axial(lat: Column, lon: Column, level: int) -> tuple[Column, Column]:
    """(q, r) of the cell that holds a point, by cube rounding."""
    x, s = lon * SHRINK, SIZE[level]
    q, r = (x * (ROOT3 / 3) - lat / 3) / s, (lat * 2 / 3) / s
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(-q - r + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - (-q - r))
    out_q = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    out_r = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return out_q.cast("long"), out_r.cast("long")


def cell_id(q: Column, r: Column, level: int) -> Column:
    return F.concat(F.lit(f"{level}_"), q.cast("string"), F.lit("_"), r.cast("string"))


def cell_of(lat: Column, lon: Column, level: int) -> Column:
    """Id of the cell of a point; null if a coordinate is."""
    return cell_id(*axial(lat, lon, level), level)


def coordinates(cell: Column) -> tuple[Column, Column]:
    parts = F.split(cell, "_")
    return parts[1].cast("long"), parts[2].cast("long")


def centroid(q: Column, r: Column, level: int) -> tuple[Column, Column]:
    """(lat, lon) of the centre, six decimals."""
    s = SIZE[level]
    return F.bround(r * 1.5 * s, 6), F.bround((q + r / 2) * (ROOT3 * s) / SHRINK, 6)


def disk(q: Column, r: Column, k: int) -> Column:
    """Array of (q, r, ring) of all cells up to k rings away, the cell itself included."""
    offsets = [(a, b, max(abs(a), abs(b), abs(a + b))) for a in range(-k, k + 1) for b in range(-k, k + 1) if abs(a + b) <= k]
    return F.array(*[F.struct((q + a).alias("q"), (r + b).alias("r"), F.lit(ring).alias("ring")) for a, b, ring in offsets])


def distance(q1: Column, r1: Column, q2: Column, r2: Column) -> Column:
    """Steps from cell to cell."""
    a, b = q1 - q2, r1 - r2
    return F.greatest(F.abs(a), F.abs(b), F.abs(a + b))


def parent(q: Column, r: Column, level: int, coarser: int) -> Column:
    """The coarser cell that holds the centre."""
    return cell_of(*centroid(q, r, level), coarser)


def boundary(q: Column, r: Column, level: int) -> Column:
    """The six corners as an array of (lon, lat)."""
    lat, lon = centroid(q, r, level)
    s = SIZE[level]
    corners = [(math.cos(math.radians(60 * i + 30)) * s / SHRINK, math.sin(math.radians(60 * i + 30)) * s) for i in range(6)]
    return F.array(*[F.struct((lon + a).alias("lon"), (lat + b).alias("lat")) for a, b in corners])


def area_km2(level: int) -> float:
    return 1.5 * ROOT3 * (SIZE[level] * KM_PER_DEGREE) ** 2
