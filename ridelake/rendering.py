"""Reports of experiments as Markdown, with charts as SVG.

Everything over the trips is computed by Spark; what is rendered here are its small results: a row for each policy and demand, or
for each run, and curves thinned to the chart's width.
"""

from __future__ import annotations

import math
import subprocess
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.functions import stats
from ridelake.operators.ordered import beside, percentiles, running_total

WIDTH, HEIGHT, EDGE = 640, 360, 48
COLOURS = ["#3366aa", "#cc5533", "#449944", "#996699", "#887733"]


@dataclass(frozen=True)
class Provenance:
    """Where a report's numbers come from."""

    graph: str
    scenario: str
    command: str
    commit: str


def commit_of(folder: str) -> str:
    """The checked-out commit, marked where files differ from it."""
    git = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=True).stdout.strip()
    try:
        return git("rev-parse", "--short", "HEAD") + ("-dirty" if git("status", "--porcelain", "--untracked-files=no") else "")
    except (OSError, subprocess.CalledProcessError):
        return "unknown"


def cdf_name(demand: float, levels: int) -> str:
    return "wait_cdf.svg" if levels == 1 else f"wait_cdf_{demand:g}x.svg"


def markdown_table(head: Sequence[str], rows: Iterable[Sequence[object]], numbers_from: int = 1) -> str:
    """A table whose columns from ``numbers_from`` on are aligned to the right."""
    cell = lambda x: "" if x is None else f"{x:.1f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    rule = ["---" if i < numbers_from else "---:" for i in range(len(head))]
    return "\n".join("| " + " | ".join(map(cell, r)) + " |" for r in (head, rule, *rows)) + "\n"


def policies(waits: DataFrame) -> DataFrame:
    """(demand, policy, requested, picked_up, mean, p50, p95) of waits (demand, policy, seed, wait_seconds, picked_up)."""
    keys = ["demand", "policy"]
    made = waits.groupBy(*keys).agg(F.count("*").alias("requested"), F.sum(F.col("picked_up").cast("long")).alias("picked_up"), F.avg("wait_seconds").alias("mean"))
    return beside(made, percentiles(waits, keys, "wait_seconds", {"p50": 0.5, "p95": 0.95}), keys, "left")


def report(waits: DataFrame, base: str, title: str, source: Provenance) -> str:
    """Markdown: where the numbers come from, each demand's policies, and every other policy against ``base``, run by run."""
    table = sorted(policies(waits).collect(), key=lambda x: (x.demand, x.policy != base, x.policy))
    diffs = stats.paired_differences(waits, base, ["demand", "seed"])
    runs = sorted(diffs.collect(), key=lambda x: (x.demand, x.policy, x.seed))  # a row for each run
    intervals = {(x.demand, x.policy): x for x in stats.t_interval(diffs, ["demand", "policy"], "diff").collect()}
    counted = diffs.groupBy("demand", "policy").agg(F.count(F.when(F.col("diff") < 0, 1)).alias("wins"), F.count(F.when(F.col("diff") != 0, 1)).alias("n"))
    tests = {(x.demand, x.policy): x for x in counted.withColumn("p", stats.sign_test(F.col("wins"), F.col("n"))).collect()}
    demands = sorted({x.demand for x in table})
    out = [f"# {title}\n", markdown_table(["source", "value"], [(k, f"`{v}`") for k, v in vars(source).items()], 2)]
    for demand in demands:
        out.append(f"## Demand {demand:g}\n")
        own = [x for x in table if x.demand == demand]
        share = lambda x: f"{x.picked_up} ({100 * x.picked_up / x.requested if x.requested else 0:.1f}%)"
        head = ["policy", "requested", "picked up", "mean wait (s)", "p50 (s)", "p95 (s)"]
        out.append(markdown_table(head, [(x.policy, x.requested, share(x), x["mean"], x.p50, x.p95) for x in own]))
        for policy in [x.policy for x in own if x.policy != base]:
            out.append(f"### {policy} against {base}\n")
            pairs = [x for x in runs if x.demand == demand and x.policy == policy]
            if not pairs:
                out.append("No run has riders under both policies.\n")
                continue
            out.append(markdown_table(["seed", base, policy, "difference"], [(x.seed, x.base_wait, x.alt_wait, f"{x['diff']:+.1f}") for x in pairs]))
            i, t = intervals[demand, policy], tests[demand, policy]
            out.append(f"Mean difference {i['mean']:+.1f} s, 95 % interval {i.lo:+.1f} to {i.hi:+.1f} s; {policy} is lower in {t.wins} of {t.n} runs (sign test, p = {t.p:.3g}).\n")
        out.append(f"![waits]({cdf_name(demand, len(demands))})\n")
    return "\n".join(out)


def nice_ceil(x: float) -> float:
    """The next 1, 2 or 5 times a power of ten; 1 for nothing or less."""
    if x <= 0:
        return 1.0
    power = math.floor(math.log10(x))  # which may be off by one for rounding
    return min(s for k in range(power - 1, power + 3) for s in (10.0**k, 2 * 10.0**k, 5 * 10.0**k) if s >= x)


def cdf_points(waits: DataFrame, width: int = WIDTH) -> tuple[float, DataFrame]:
    """The end of the axis, and (policy, x, share): the share of waits up to each of ``width`` steps.

    The axis ends at a round number above the policies' 99th percentiles. A policy has a row at most for each step.
    """
    far = percentiles(waits, ["policy"], "wait_seconds", {"p99": 0.99}).agg(F.max("p99")).first()[0]
    end = nice_ceil(far or 0.0)
    step = F.ceil(F.col("wait_seconds") / F.lit(end) * width).cast("long")
    t = waits.where(F.col("wait_seconds").isNotNull()).groupBy("policy", F.greatest(step, F.lit(0)).alias("step")).agg(F.count("*").alias("c"))
    whole = t.groupBy("policy").agg(F.sum("c").alias("n"))
    upto = beside(running_total(t, "step", "c", "upto", by=("policy",)), whole, ["policy"]).where(F.col("step") <= width)
    return end, upto.select("policy", (F.col("step") * F.lit(end) / width).alias("x"), (F.col("upto") / F.col("n")).alias("share"))


def chart(lines: dict[str, list[tuple[float, float]]], x_end: float, y_end: float, x_name: str, y_name: str) -> str:
    """A line chart as SVG, with a grid of five parts each way and the lines' names."""
    px = lambda x: EDGE + (WIDTH - 2 * EDGE) * x / x_end
    py = lambda y: HEIGHT - EDGE - (HEIGHT - 2 * EDGE) * y / y_end
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="11">']
    for i in range(6):
        x, y = x_end * i / 5, y_end * i / 5
        out.append(f'<path d="M{px(x):.1f} {py(0):.1f}V{py(y_end):.1f}M{px(0):.1f} {py(y):.1f}H{px(x_end):.1f}" stroke="#ddd"/>')
        out.append(f'<text x="{px(x):.1f}" y="{py(0) + 16:.1f}" text-anchor="middle">{x:g}</text>')
        out.append(f'<text x="{px(0) - 6:.1f}" y="{py(y) + 4:.1f}" text-anchor="end">{y:g}</text>')
    for i, (name, points) in enumerate(sorted(lines.items())):
        colour = COLOURS[i % len(COLOURS)]
        path = " ".join(f"{px(min(x, x_end)):.1f},{py(min(y, y_end)):.1f}" for x, y in sorted(points))
        out.append(f'<polyline points="{path}" fill="none" stroke="{colour}" stroke-width="2"/>')
        out.append(f'<text x="{px(x_end) - 4:.1f}" y="{py(0) - 10 - 14 * i:.1f}" text-anchor="end" fill="{colour}">{escape(name)}</text>')
    out.append(f'<text x="{WIDTH / 2}" y="{HEIGHT - 8}" text-anchor="middle">{escape(x_name)}</text>')
    out.append(f'<text x="{EDGE}" y="20">{escape(y_name)}</text></svg>')
    return "\n".join(out)


def wait_cdf_svg(waits: DataFrame) -> str:
    end, points = cdf_points(waits)
    lines: dict[str, list[tuple[float, float]]] = {}
    for p in points.collect():
        lines.setdefault(p.policy, [(0.0, 0.0)]).append((p.x, p.share))
    return chart(lines, end, 1.0, "wait (s)", "share of riders")


def demand_svg(waits: DataFrame) -> str:
    """Each policy's mean wait over the demand."""
    lines: dict[str, list[tuple[float, float]]] = {}
    for x in waits.groupBy("demand", "policy").agg(F.avg("wait_seconds").alias("mean")).where("mean IS NOT NULL").collect():
        lines.setdefault(x.policy, []).append((x.demand, x["mean"]))
    every = [p for line in lines.values() for p in line]
    return chart(lines, nice_ceil(max((x for x, _ in every), default=0)), nice_ceil(max((y for _, y in every), default=0)), "demand", "mean wait (s)")
