"""URL filter by a tree of path templates. DataFrame functions only.

Each host has a tree of templates over the segments of its paths. It grows level by level: a segment
that few of a node's pages have becomes the wildcard ``*``, unless the same test tells its labelled rate
from that of the rest of its node; then a node's branches are put in the
order of their labelled rates, and neighbours whose rates a two-proportion test cannot tell
apart become one branch (written ``de|en|*``), with one subtree. Levels go on until no node with
``support`` pages has a further segment; ``depth`` can end them before. A template is rejected when the share of good pages among its labelled ones,
smoothed towards the share of the whole table by ``weight`` pages, is below ``purity``.

Fixed rules, (host and path, verdict), come before the method: a rule fits its host and all subdomains
where the path begins with the rule's path, and the longest wins.

Pages are first summed up by host and path, segments by node, so a host with a large share of all pages
moves as counts; nothing groups all pages of a host. A node has at most 1 / ``share`` literal branches and those whose rates stand out;
the window over them sees a row for each. More than ``NAMES`` branches in one are written as
the first and a digest of all.

Defined results: a null url, or one without ``://``, has empty host and path. A page without labels counts
towards wildcards only; with several, one bad label makes it bad. A null page_id has no label. Repeated rows each
come back. Without any label nothing is rejected. Further columns are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelake.llm.common import ascii_lower, stored

#: The rules of the contract.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
NAMES = 21
ALLOW, BLOCK = "allow", "block"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_of(rules) -> Column:
    """The longest rule that fits the columns host and path, or null."""
    host, path, tests = F.col("host"), F.col("path"), []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        tests.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*tests, F.lit(None).cast("string"))


def _prior(paths: DataFrame) -> tuple[float, int]:
    bad, labelled = paths.agg(F.sum("bad"), F.sum("labelled")).first()
    return ((bad or 0) / labelled if labelled else 0.0), labelled or 0


def _apart(a: Column, b: Column, a0: Column, b0: Column, z: float) -> Column:
    """Whether b bad ones of a labelled are a rate apart from b0 of a0, by ``z`` standard errors."""
    both, together = a + a0, b + b0
    return (b * a0 - b0 * a) * (b * a0 - b0 * a) * both > z * z * a * a0 * together * (both - together)


def _open(paths: DataFrame, level: int, support: int) -> bool:
    """Whether a node with a further segment has pages enough for a branch."""
    further = paths.where(F.size("segments") > level).groupBy("host", "template").agg(F.sum("n").alias("n"))
    return not further.where(F.col("n") >= support).isEmpty()


def _branches(paths: DataFrame, level: int, support: int, share: float, z: float, prior: float, weight: int) -> DataFrame:
    """(host, template, segment, to): the branch that each segment of a node leads to."""
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    node = ["host", "template"]
    segments = paths.where(F.size("segments") > level).withColumn("segment", F.col("segments")[level])
    segments = segments.groupBy(*node, "segment").agg(*sums)
    whole = segments.groupBy(*node).agg(F.sum("n").alias("whole"), F.sum("labelled").alias("of"), F.sum("bad").alias("of_bad"))
    a, b = F.col("labelled").cast("double"), F.col("bad").cast("double")
    other = _apart(a, b, F.col("of") - a, F.col("of_bad") - b, z)
    own = (F.col("n") >= support) & ((F.col("n") >= share * F.col("whole")) | other)
    named = segments.join(whole, node).withColumn("name", F.when(own, F.col("segment")).otherwise("*"))
    named = stored(named.select(*node, "segment", "name", "n", "labelled", "bad"))
    branches = named.groupBy(*node, "name").agg(*sums)
    rate = (F.col("bad") + prior * weight) / (F.col("labelled") + weight)
    order = Window.partitionBy(*node).orderBy("rate", "name")
    a0, b0 = F.lag(a).over(order), F.lag(b).over(order)
    apart = _apart(a, b, a0, b0, z)
    branches = branches.withColumn("rate", rate).withColumn("new", F.coalesce(apart, F.lit(False)).cast("int"))
    branches = branches.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = branches.groupBy(*node, "part").agg(F.sort_array(F.collect_list("name")).alias("names"))
    joined = F.array_join("names", "|")
    joined = F.when(F.size("names") > NAMES, F.concat(F.col("names")[0], F.lit("|~"), F.sha2(joined, 256))).otherwise(joined)
    parts = parts.select(*node, "names", F.concat("template", F.lit("/"), joined).alias("to"))
    to = parts.select(*node, F.explode("names").alias("name"), "to")
    return named.select(*node, "segment", "name").join(to, [*node, "name"]).select(*node, "segment", "to")


def templates(pages: DataFrame, labels: DataFrame, depth: int | None, support: int, share: float, z: float, weight: int, purity: float) -> DataFrame:
    """(host, path, template, rejected) for every host and path of ``pages`` (page_id, host, path);
    ``labels``: (page_id, bad)."""
    known = labels.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    paths = pages.join(known, "page_id", "left").groupBy("host", "path")
    paths = stored(
        paths.agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumn("segments", F.filter(F.split("path", "/"), lambda x: x != ""))
        .withColumn("template", F.lit(""))
    )
    prior, labelled = _prior(paths)
    level = 0
    while level != depth and _open(paths, level, support):
        to = _branches(paths, level, support, share, z, prior, weight)
        here = paths.withColumn("segment", F.try_element_at("segments", F.lit(level + 1)))
        joined = here.join(to, ["host", "template", "segment"], "left")
        paths = stored(joined.withColumn("template", F.coalesce("to", "template")).select(*paths.columns))
        level += 1
    # what is left has wildcards only
    rest = (F.size("segments") if depth is None else F.least(F.size("segments"), F.lit(depth))) - level
    paths = paths.withColumn("template", F.concat("template", F.repeat(F.lit("/*"), F.greatest(rest, F.lit(0)))))
    leaves = paths.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    good = F.col("labelled") - F.col("bad") + (1 - prior) * weight
    rejected = (good < purity * (F.col("labelled") + weight)) & F.lit(labelled > 0)
    leaves = leaves.select("host", "template", rejected.alias("rejected"))
    return paths.join(leaves, ["host", "template"]).select("host", "path", "template", "rejected")


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules=RULES,
    depth: int | None = None,
    support: int = 8,
    share: float = 0.05,
    z: float = 2.0,
    weight: int = 4,
    purity: float = 0.6,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) for each row of ``pages`` (page_id, url).

    ``labels``: (page_id, bad). ``support`` and ``share``: pages a segment needs, in number and in share of
    its node, to be a branch of its own (a rate that stands out needs no share); ``z``: standard errors that keep two branches apart.
    """
    host, path = host_and_path()
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    made = templates(split, labels, depth, support, share, z, weight, purity)
    rule = rule_of(rules)
    verdict = reduce(lambda out, r: F.when(F.col("rule") == r[0], F.lit(r[1])).otherwise(out), rules, F.lit(None).cast("string"))
    method = F.when(F.col("rejected"), BLOCK).otherwise(ALLOW)
    joined = split.join(made, ["host", "path"], "left").withColumn("rule", rule)
    return joined.select("page_id", "host", "path", "rule", F.coalesce(verdict, method).alias("verdict"), "template")


def sql(depth: int = 4, support: int = 8, share: float = 0.05, z: float = 2.0, weight: int = 4, purity: float = 0.6) -> str:
    """The same in DuckDB's SQL over the tables pages and labels, with the rules of the contract."""
    levels = []
    for i in range(depth):
        levels.append(f"""
  seg{i} AS (SELECT host, template, segments[{i + 1}] AS segment, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad
             FROM lev{i} WHERE len(segments) > {i} GROUP BY ALL),
  nam{i} AS (SELECT *, CASE WHEN n >= {support} AND n >= {share}::DOUBLE * sum(n) OVER (PARTITION BY host, template)
                       THEN segment ELSE '*' END AS name FROM seg{i}),
  bra{i} AS (SELECT host, template, name, sum(labelled)::DOUBLE AS a, sum(bad)::DOUBLE AS b FROM nam{i} GROUP BY ALL),
  rat{i} AS (SELECT *, (b + (SELECT prior FROM total) * {weight}) / (a + {weight}) AS rate FROM bra{i}),
  lag{i} AS (SELECT *, lag(a) OVER w AS a0, lag(b) OVER w AS b0 FROM rat{i}
             WINDOW w AS (PARTITION BY host, template ORDER BY rate, name)),
  new{i} AS (SELECT *, coalesce((b * a0 - b0 * a) * (b * a0 - b0 * a) * (a + a0)
                                > {z * z}::DOUBLE * a * a0 * (b + b0) * ((a + a0) - (b + b0)), false)::INT AS new FROM lag{i}),
  par{i} AS (SELECT *, sum(new) OVER (PARTITION BY host, template ORDER BY rate, name ROWS UNBOUNDED PRECEDING) AS part FROM new{i}),
  grp{i} AS (SELECT host, template, part, template || '/' || string_agg(name, '|' ORDER BY name) AS goal FROM par{i} GROUP BY host, template, part),
  too{i} AS (SELECT m.host, m.template, m.segment, g.goal FROM nam{i} m JOIN par{i} p USING (host, template, name)
             JOIN grp{i} g ON g.host = p.host AND g.template = p.template AND g.part = p.part),
  lev{i + 1} AS (SELECT l.host, l.path, l.n, l.labelled, l.bad, l.segments, coalesce(t.goal, l.template) AS template
             FROM lev{i} l LEFT JOIN too{i} t ON t.host = l.host AND t.template = l.template AND t.segment = l.segments[{i + 1}]),""")
    tests = []
    for rule, verdict in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        own, slash, rest = rule.partition("/")
        tests.append((f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{slash + rest}')", rule, verdict))
    rule = " ".join(f"WHEN {t} THEN '{r}'" for t, r, _ in tests)
    verdict = " ".join(f"WHEN {t} THEN '{v}'" for t, _, v in tests)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
  split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
  known AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
  lev0 AS (SELECT host, path, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad,
                  list_filter(string_split(path, '/'), lambda x: x <> '') AS segments, '' AS template
           FROM split LEFT JOIN known USING (page_id) GROUP BY host, path),
  total AS (SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(labelled), 0), 0) AS prior, sum(labelled) AS labelled FROM lev0),{"".join(levels)}
  leaf AS (SELECT host, template, sum(labelled) AS labelled, sum(bad) AS bad FROM lev{depth} GROUP BY ALL),
  bad AS (SELECT host, template, labelled - bad + (1 - (SELECT prior FROM total)) * {weight} < {purity}::DOUBLE * (labelled + {weight})
                 AND (SELECT labelled FROM total) > 0 AS rejected FROM leaf)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN rejected THEN 'block' ELSE 'allow' END AS verdict, template
FROM split JOIN lev{depth} USING (host, path) JOIN bad USING (host, template)"""
