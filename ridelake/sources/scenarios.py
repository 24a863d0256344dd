"""Scenario files: JSON with known keys only, checked before anything runs."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from math import isfinite


@dataclass(frozen=True)
class Hotspot:
    lat: float
    lon: float
    radius_m: float
    weight: float
    name: str = ""

    def __post_init__(self):
        if not all(isfinite(x) for x in (self.lat, self.lon, self.radius_m, self.weight)):
            raise ValueError(f"hotspot {self.name!r}: numbers must be finite")
        if self.radius_m <= 0 or self.weight <= 0:
            raise ValueError(f"hotspot {self.name!r}: radius_m and weight must be above 0")
        if abs(self.lat) > 90 or abs(self.lon) > 180:
            raise ValueError(f"hotspot {self.name!r}: no such place, {self.lat}, {self.lon}")


@dataclass(frozen=True)
class RatePoint:
    t: float  # seconds from the start
    rate: float  # requests per second

    def __post_init__(self):
        if not isfinite(self.rate) or self.rate < 0:
            raise ValueError(f"rate at {self.t}: {self.rate} is not a finite number of at least 0")


@dataclass(frozen=True)
class Vehicles:
    count: int
    spawn: str = "random"

    def __post_init__(self):
        if self.count <= 0:
            raise ValueError("vehicles.count must be above 0")
        if not self.spawn:
            object.__setattr__(self, "spawn", "random")
        if self.spawn not in ("random", "pickups"):
            raise ValueError(f"vehicles.spawn {self.spawn!r}: use random or pickups")


@dataclass(frozen=True)
class Arrivals:
    rate_segments: list[RatePoint]
    pickup_hotspots: list[Hotspot]
    dropoff_hotspots: list[Hotspot]

    def __post_init__(self):
        at = [p.t for p in self.rate_segments]
        if not at:
            raise ValueError("arrivals.rate_segments is empty")
        if any(b <= a for a, b in zip(at, at[1:], strict=False)):
            raise ValueError("arrivals.rate_segments: t must grow from entry to entry")

    def segments(self) -> list[tuple[float, float]]:
        """The form that the operators on demand take."""
        return [(p.t, p.rate) for p in self.rate_segments]

    def hotspots(self, side: str) -> list[tuple[str, float, float, float, float]]:
        of = self.pickup_hotspots if side == "pickup" else self.dropoff_hotspots
        return [(h.name or f"{side}_{i}", h.lat, h.lon, h.radius_m, h.weight) for i, h in enumerate(of)]


@dataclass(frozen=True)
class Scenario:
    name: str
    duration_s: float
    vehicles: Vehicles
    arrivals: Arrivals
    seed: int = 0
    description: str = ""
    start_time: str = ""

    def __post_init__(self):
        if not self.name:
            raise ValueError("a scenario needs a name")
        if not (isfinite(self.duration_s) and self.duration_s > 0):
            raise ValueError("duration_s must be above 0")


def _made(kind: type, given: object, where: str):
    """An object of ``kind`` from a JSON object; a key that it does not have, or one that it lacks, is an error."""
    if not isinstance(given, dict):
        raise ValueError(f"{where}: an object is expected")
    if unknown := sorted(set(given) - {f.name for f in fields(kind)}):
        raise ValueError(f"{where}: unknown keys {unknown}")
    try:
        return kind(**given)
    except TypeError as e:
        raise ValueError(f"{where}: {e}") from None


def parse(text: str) -> Scenario:
    given = json.loads(text)
    if not isinstance(given, dict):
        raise ValueError("scenario: an object is expected")
    given = dict(given)
    if "vehicles" in given:
        given["vehicles"] = _made(Vehicles, given["vehicles"], "vehicles")
    if isinstance(arrivals := given.get("arrivals"), dict):
        lists = {"rate_segments": RatePoint, "pickup_hotspots": Hotspot, "dropoff_hotspots": Hotspot}
        read = {k: [_made(kind, x, f"arrivals.{k}") for x in arrivals.get(k) or []] for k, kind in lists.items()}
        given["arrivals"] = _made(Arrivals, {**arrivals, **read}, "arrivals")
    return _made(Scenario, given, "scenario")


def load(path: str) -> Scenario:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def demand_levels(text: str) -> list[float]:
    """Multipliers from a list like ``1, 1.5, 2``: above 0, finite, none twice; in rising order."""
    out: list[float] = []
    for part in text.split(","):
        try:
            level = float(part)
        except ValueError:
            level = -1.0
        if not (isfinite(level) and level > 0):
            raise ValueError(f"demand {part.strip()!r} is not a number above 0")
        if level in out:
            raise ValueError(f"demand {level:g} is given twice")
        out.append(level)
    return sorted(out)
