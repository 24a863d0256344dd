"""Distances and cells as column expressions.

Cells are pointy-topped hexagons on a plane: degrees become metres by one scale for the whole city, so equal arithmetic
gives equal cells on every engine. A cell is named ``size:q:r``.
"""

from __future__ import annotations

from collections.abc import Callable
from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Metres of a degree of latitude, and of longitude at the city's centre.
LAT_M, LON_M = 111_000.0, 87_750.0
CENTRE = (37.76, -122.44)
#: Edge lengths in metres of three resolutions: regions, surge cells, cells of trip rows.
REGION_M, SURGE_M, TRIP_M = 8_544.0, 461.0, 174.0


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def equirectangular(lat1, lon1, lat2, lon2) -> Column:
    """Metres on a plane that is stretched by the cosine of the mean latitude."""
    a, b, c, d = map(_col, (lat1, lon1, lat2, lon2))
    east = (d - b) * F.cos(F.radians((a + c) / 2))
    return F.lit(LAT_M) * F.sqrt(east * east + (c - a) * (c - a))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    a, b, c, d = map(_col, (lat1, lon1, lat2, lon2))
    s1, s2 = F.sin(F.radians(c - a) / 2), F.sin(F.radians(d - b) / 2)
    x = s1 * s1 + F.cos(F.radians(a)) * F.cos(F.radians(c)) * s2 * s2
    return 2 * EARTH_M * F.atan2(F.sqrt(x), F.sqrt(1 - x))


def plane(lat, lon) -> tuple[Column, Column]:
    """Metres east and north of the centre."""
    return (_col(lon) - CENTRE[1]) * LON_M, (_col(lat) - CENTRE[0]) * LAT_M


def planar(lat1, lon1, lat2, lon2) -> Column:
    """Metres on the city's plane; ranks like the true distance there, and without trigonometry."""
    (a, b), (c, d) = plane(lat1, lon1), plane(lat2, lon2)
    return F.sqrt((a - c) * (a - c) + (b - d) * (b - d))


def along(lat1, lon1, lat2, lon2, share: Column) -> tuple[Column, Column]:
    """The position after a share of the straight way from one place to the other."""
    a, b, c, d = map(_col, (lat1, lon1, lat2, lon2))
    return a + (c - a) * share, b + (d - b) * share


def ring_offsets(rings: int) -> list[tuple[int, int]]:
    """Steps in q and r to the cells within ``rings``, ring by ring, the cell itself first."""
    steps = [(a, b) for a in range(-rings, rings + 1) for b in range(-rings, rings + 1) if abs(a + b) <= rings]
    return sorted(steps, key=lambda s: (max(abs(s[0]), abs(s[1]), abs(s[0] + s[1])), s))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def axial(lat, lon, size: float) -> tuple[Column, Column]:
    """Axial coordinates q and r of the hexagon, by rounding in cube coordinates.

    Plain arithmetic without lambdas, so it runs in generated code, which computes repeated parts once.
    """
    x, y = plane(lat, lon)
    q, r = (x * (sqrt(3) / 3) - y / 3) / size, (y * 2 / 3) / size
    s = -q - r
    near = lambda v: F.floor(v + 0.5).cast("double")
    nq, nr, ns = near(q), near(r), near(s)
    dq, dr, ds = F.abs(nq - q), F.abs(nr - r), F.abs(ns - s)
    first = (dq > dr) & (dq > ds)
    return F.when(first, -nr - ns).otherwise(nq).cast("long"), F.when(first, nr).when(dr > ds, -nq - ns).otherwise(nr).cast("long")


def named(q, r, size: float) -> Column:
    """The name of the cell at axial coordinates."""
    return F.concat(F.lit(f"{int(size)}:"), _col(q).cast("string"), F.lit(":"), _col(r).cast("string"))


def middle(q, r, size) -> tuple[Column, Column]:
    """Latitude and longitude of the centre of the cell at axial coordinates."""
    q, r = _col(q), _col(r)
    x, y = size * (sqrt(3) * q + sqrt(3) / 2 * r), size * 1.5 * r
    return y / LAT_M + CENTRE[0], x / LON_M + CENTRE[1]


def cell(lat, lon, size: float) -> Column:
    return named(*axial(lat, lon, size), size)


def centre(cell_: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a named cell's centre."""
    p = F.split(cell_, ":")
    return middle(p[1].cast("long"), p[2].cast("long"), p[0].cast("double"))


def disk(cell_: Column, rings: int) -> Column:
    """The cells within ``rings`` steps, the cell itself first, then ring by ring."""
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ring_offsets(rings)])

    def around(p: Column) -> Column:
        move = lambda o: F.concat_ws(":", p[0], (p[1].cast("long") + o.a).cast("string"), (p[2].cast("long") + o.b).cast("string"))
        return F.transform(offsets, move)

    return let(F.split(cell_, ":"), around)


def cell_sql(lat: str, lon: str, size: float) -> str:
    """DuckDB's expression for ``cell``."""
    x, y = f"(({lon}) - ({CENTRE[1]}::DOUBLE)) * {LON_M}::DOUBLE", f"(({lat}) - {CENTRE[0]}::DOUBLE) * {LAT_M}::DOUBLE"
    q, r = f"(({x}) * {sqrt(3) / 3!r}::DOUBLE - ({y}) / 3) / {size}::DOUBLE", f"(({y}) * 2 / 3) / {size}::DOUBLE"
    return (
        f"(SELECT '{int(size)}:' || (CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END)::BIGINT || ':' || "
        f"(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END)::BIGINT FROM ("
        f"SELECT rq, rr, rs, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM ("
        f"SELECT q, r, s, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(s + 0.5) AS rs FROM ("
        f"SELECT q, r, -q - r AS s FROM (SELECT {q} AS q, {r} AS r)))))"
    )
