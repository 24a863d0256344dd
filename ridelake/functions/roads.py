"""Road attributes from map tags, and slowdown by traffic, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Free-flow metres per second of the drivable classes.
SPEEDS = {
    "motorway": 27.78, "motorway_link": 27.78, "trunk": 22.22, "trunk_link": 22.22, "primary": 16.67, "primary_link": 16.67,
    "secondary": 13.89, "secondary_link": 13.89, "tertiary": 11.11, "tertiary_link": 11.11, "unclassified": 8.33,
    "residential": 8.33, "living_street": 8.33, "service": 5.56,
}
#: Metres of lane that a standing car takes.
CAR_M = 7.0


def tag(tags: str | Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(tags) if isinstance(tags, str) else tags, F.lit(name)), F.lit(""))


def class_speed(highway: Column) -> Column:
    """Free-flow speed of a class; null where it can't be driven on."""
    return F.create_map(*[F.lit(x) for pair in SPEEDS.items() for x in pair])[highway]


def max_speed(text: Column) -> Column:
    """Metres per second of a maxspeed tag; 0 where it names no positive number."""
    t = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    number = F.regexp_extract(t, r"^(.*?)\s*(mph|km/h|kph|kmh)?$", 1)
    value = F.when(F.trim(number).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), F.trim(number).try_cast("double"))
    factor = F.when(t.endswith("mph"), F.lit(0.44704)).otherwise(F.lit(1.0))
    speed = F.when(t.endswith("mph"), value * factor).otherwise(value / 3.6)
    return F.when(value > 0, speed).otherwise(0.0)


def _count(text: Column) -> Column:
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]{1,9}$"), text.try_cast("int")), F.lit(0))


def lanes(tags: str | Column, oneway: Column) -> tuple[Column, Column]:
    """Lanes forward and backward. Those of a two-way road are split, the odd one forward, unless
    tags say how many each way has."""
    total, ahead, back = (_count(tag(tags, n)) for n in ("lanes", "lanes:forward", "lanes:backward"))
    forward = F.when(ahead > 0, ahead).otherwise(F.floor((total + 1) / 2).cast("int"))
    backward = F.when(back > 0, back).otherwise(F.floor(total / 2).cast("int"))
    one = F.lit(1)
    return F.when(oneway, F.greatest(total, one)).otherwise(F.greatest(forward, one)), F.when(oneway, 0).otherwise(F.greatest(backward, one))


def one_way(tags: str | Column) -> Column:
    """Whether a way is driven in one direction only; motorways and roundabouts are unless they say otherwise."""
    oneway, junction, highway = tag(tags, "oneway"), tag(tags, "junction"), tag(tags, "highway")
    said = oneway.isin("yes", "true", "1", "-1")
    denied = oneway.isin("no", "false", "0")
    return said | (~denied & (highway.isin("motorway", "motorway_link") | junction.isin("roundabout", "circular")))


def base_weight(length: Column, speed: Column, given: Column | None = None) -> Column:
    """Free-flow seconds of an edge: as given, else length by speed; infinite without a speed."""
    own = F.when(speed > 0, length / speed).otherwise(F.lit(float("inf")))
    return own if given is None else F.when(F.coalesce(given, F.lit(0.0)) != 0, given).otherwise(own)


def delay_factor(cars: Column, capacity: Column, alpha: float = 1.0, beta: float = 2.0, cap: float = 5.0) -> Column:
    """Slowdown by density: 1 + alpha * (cars / capacity) ** beta, at most ``cap``; 1 without capacity."""
    f = 1 + F.lit(alpha) * F.pow(cars / capacity, F.lit(beta))
    return F.when(capacity > 0, F.least(f, F.lit(cap))).otherwise(1.0)


def link_factor(cars: Column, storage: Column) -> Column:
    """Slowdown of a link by the cars on it other than one: a car does not hold up itself."""
    return delay_factor(F.greatest(cars - 1, F.lit(0)).cast("double"), storage)
