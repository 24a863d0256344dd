"""Hexagonal cells that nest sevenfold: a cell and its six neighbours are the children of one cell of the level above.

Level 0 are the cells of ``geo.cell`` at one size; each level above has edges the square root of seven times as long and is turned by
about 19 degrees. A cell of a level is what its finest cells climb to, so counts of a level are the sums of those below. Cells are named
``size/level:q:r``; steps between levels are whole-number arithmetic. The outline of a cell is the plain hexagon, as in other such
hierarchies, so finest cells at its rim may reach over it. Null names and positions give null.
"""

from __future__ import annotations

from cmath import phase
from math import cos, pi, sin, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.functions.geo import CENTRE, LAT_M, LON_M, TRIP_M, axial, let
from ridelake.storage import counted, dropped, kept

#: Steps from a parent's middle to its children, at the place (3q + r) mod 7.
STEPS = [(0, 0), (0, 1), (1, -1), (1, 0), (-1, 0), (-1, 1), (0, -1)]
#: Radians by which a level is turned against the one below: the angle of two steps and one aside.
TURN = phase(2 + complex(0.5, sqrt(3) / 2))


def _steps() -> Column:
    return F.array(*[F.struct(F.lit(a).cast("long").alias("q"), F.lit(b).cast("long").alias("r")) for a, b in STEPS])


def _at(q: Column, r: Column) -> Column:
    return F.struct(q.cast("long").alias("q"), r.cast("long").alias("r"))


def _above(c: Column, _=None) -> Column:
    """The parent of axial coordinates."""
    inner = lambda s: let(_at(c.q - s.q, c.r - s.r), lambda m: _at((3 * m.q + m.r) / 7, (2 * m.r - m.q) / 7))
    return let(_steps()[F.pmod(3 * c.q + c.r, F.lit(7)).cast("int")], inner)


def _below(c: Column) -> Column:
    return F.transform(_steps(), lambda s: _at(2 * c.q - c.r + s.q, c.q + 3 * c.r + s.r))


def _parts(cell: str | Column) -> Column:
    """Size, level and coordinates of a name."""
    p = F.split(F.col(cell) if isinstance(cell, str) else cell, "[/:]")
    return F.struct(p[0].alias("size"), p[1].cast("int").alias("level"), p[2].cast("long").alias("q"), p[3].cast("long").alias("r"))


def _name(size: Column, level: Column, c: Column) -> Column:
    return F.concat(size, F.lit("/"), level.cast("string"), F.lit(":"), c.q.cast("string"), F.lit(":"), c.r.cast("string"))


def _climbed(c: Column, levels) -> Column:
    return F.aggregate(F.array_repeat(F.lit(0), F.lit(levels) if isinstance(levels, int) else levels), _at(c.q, c.r), _above)


def cell(lat, lon, level: int = 0, size: float = TRIP_M) -> Column:
    """The cell of a position at a level."""
    q, r = axial(lat, lon, size)
    return let(_at(q, r), lambda c: _name(F.lit(str(int(size))), F.lit(level), _climbed(c, level)))


def level(cell_: str | Column) -> Column:
    return _parts(cell_).level


def parent(cell_: str | Column, levels: int | Column = 1) -> Column:
    """The cell that holds this one so many levels above."""
    return let(_parts(cell_), lambda p: _name(p.size, p.level + levels, _climbed(p, levels)))


def children(cell_: str | Column) -> Column:
    """The seven cells of the level below, the middle one first; none of level 0."""
    made = lambda p: F.when(p.level > 0, F.transform(_below(p), lambda c: _name(p.size, p.level - 1, c))).when(p.level == 0, F.array().cast("array<string>"))
    return let(_parts(cell_), made)


def _place(p: Column, corner: int | None) -> Column:
    """Position of a cell's middle, or of one of its corners."""
    x, y = sqrt(3) * (p.q + p.r / 2), 1.5 * p.r
    if corner is not None:
        x, y = x + cos((2 * corner + 1) * pi / 6), y + sin((2 * corner + 1) * pi / 6)
    reach, turn = p.size.cast("double") * F.pow(F.lit(sqrt(7)), p.level), p.level * F.lit(TURN)
    east, north = reach * (x * F.cos(turn) - y * F.sin(turn)), reach * (x * F.sin(turn) + y * F.cos(turn))
    return F.struct((north / LAT_M + CENTRE[0]).alias("lat"), (east / LON_M + CENTRE[1]).alias("lon"))


def middle(cell_: str | Column) -> Column:
    """(lat, lon) of a cell's middle."""
    return let(_parts(cell_), lambda p: F.when(p.q.isNotNull(), _place(p, None)))


def boundary(cell_: str | Column) -> Column:
    """The six corners (lat, lon) of a cell, against the clock."""
    return let(_parts(cell_), lambda p: F.when(p.q.isNotNull(), F.array(*[_place(p, k) for k in range(6)])))


def rolled_up(counts: DataFrame, cell_: str, value: str, levels: int) -> DataFrame:
    """(level, cell, value, cells): sums of a table with a row for each cell of level 0, at every level up to ``levels``."""
    each = counts.where(F.col(cell_).isNotNull()).select(F.col(cell_).alias("__c"), F.col(value).alias("__v"), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    named = each.groupBy("level", parent("__c", F.col("level")).alias("cell"))
    return named.agg(F.sum("__v").alias(value), F.count("*").alias("cells"))


def compacted(cells: DataFrame, most: int = 16) -> DataFrame:
    """(cell): the cells of one level with all seven children of a cell replaced by it, level by level; repeated and null ones don't count."""
    left = kept(cells.select("cell").where(F.col("cell").isNotNull()).distinct())
    for _ in range(most):
        above = left.withColumn("parent", parent("cell"))
        whole, seen = counted(above.groupBy("parent").count().where("count = 7").select("parent"), n=F.count("*"))
        if not seen["n"]:
            break
        rest = above.join(whole, "parent", "left_anti").select("cell")
        before, left = left, kept(rest.unionByName(whole.withColumnRenamed("parent", "cell")))
        dropped(before, whole)
    return left


def spread(cells: DataFrame, most: int = 16) -> DataFrame:
    """(cell): cells of any level up to ``most`` as those of level 0 below them, in one pass."""
    below = lambda found, _: F.flatten(F.transform(found, _below))
    parts = cells.select(_parts("cell").alias("p")).where(F.col("p.q").isNotNull() & (F.col("p.level") <= most))
    c = F.explode(F.aggregate(F.array_repeat(F.lit(0), F.col("p.level")), F.array(_at(F.col("p.q"), F.col("p.r"))), below)).alias("c")
    return parts.select("p.size", c).select(_name(F.col("size"), F.lit(0), F.col("c")).alias("cell"))
