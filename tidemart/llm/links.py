"""Operator 9, URL filters: rules first, then trust and distrust carried over links between hosts.

A rule names a host and a path prefix; it fits its host and all subdomains, and the longest that fits decides.
Pages without a rule get their host's verdict. Hosts are scored in Spark by two personalised PageRanks over
host edges (absolute links in the pages, each host's weights adding up to 1): trust starts from hosts in
proportion to their rule-allowed pages and follows links; distrust starts from rule-blocked pages and follows
links backwards, since a host that links to blocked ones is suspect. A host is blocked if its distrust exceeds
its trust and reaches `threshold` of what a fully blocked host without links has.

A null url, or one without `://`, has empty host and path, fits no rule and is allowed. Null html has no links.
Repeated pages count as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemart.llm.session import LOWER, UPPER, stored, table

DAMPING = 0.85
THRESHOLD = 0.5
TOLERANCE = 1e-9
MOST_STEPS = 40
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting(rules: tuple[Rule, ...]) -> Column:
    """Struct of the longest fitting rule's text and verdict, or null. The list is a parameter, so it is an expression, not a join."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def judged_by_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    split = pages.withColumns({"host": host, "path": path})
    return split.withColumn("by", fitting(rules))


def host_edges(pages: DataFrame) -> DataFrame:
    """from, to, weight: share of a host's links to other hosts; a page counts once per host it links to."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER)))
    links = pages.filter("host <> ''").select(F.col("host").alias("from"), F.explode(found).alias("to")).filter(F.col("from") != F.col("to"))
    counts = links.groupBy("from", "to").agg(F.count("*").alias("n"))
    totals = counts.groupBy("from").agg(F.sum("n").alias("total"))
    return counts.join(totals, "from").select("from", "to", (F.col("n") / F.col("total")).alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, steps: int = MOST_STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """Scores of `seeds` (host, seed) and all hosts they reach: score = (1 - damping) seed + damping sum(weight score)."""
    scores = stored(seeds.select("host", "seed", ((1 - damping) * F.col("seed")).alias("score")), "link-scores")
    for _ in range(steps):
        sent = edges.join(scores.filter("score > 0"), edges["from"] == scores["host"]).groupBy(F.col("to").alias("host"))
        sent = sent.agg((damping * F.sum(F.col("weight") * F.col("score"))).alias("got"))
        fresh = scores.join(sent, "host", "full").select(
            "host", F.coalesce("seed", F.lit(0.0)).alias("seed"), F.coalesce("score", F.lit(0.0)).alias("old"),
            ((1 - damping) * F.coalesce("seed", F.lit(0.0)) + F.coalesce("got", F.lit(0.0))).alias("score"),
        )
        fresh = stored(fresh, "link-scores")
        moved = fresh.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
        scores = fresh.drop("old")
        if moved is None or moved <= tolerance:
            break
    return scores.select("host", "score")


def host_scores(judged: DataFrame, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """host, trust, distrust, blocked."""
    share = lambda verdict: F.avg(F.when(F.col("by.verdict") == verdict, 1.0).otherwise(0.0))
    hosts = judged.filter("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("refused"))
    hosts = stored(hosts, "link-hosts")
    edges = stored(host_edges(judged), "link-edges")
    trust = propagate(hosts.select("host", F.col("allowed").alias("seed")), edges, damping)
    # A host that gets no link has no share to hand back, so the reversed weights are taken anew per target.
    back = edges.groupBy("to").agg(F.sum("weight").alias("total"))
    back = edges.join(back, "to").select(F.col("to").alias("from"), F.col("from").alias("to"), (F.col("weight") / F.col("total")).alias("weight"))
    distrust = propagate(hosts.select("host", F.col("refused").alias("seed")), stored(back, "link-back"), damping)
    both = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    blocked = (zero("distrust") > zero("trust")) & (zero("distrust") >= threshold * (1 - damping))
    return both.select("host", zero("trust").alias("trust"), zero("distrust").alias("distrust"), blocked.alias("blocked"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust."""
    judged = judged_by_rules(pages.select("page_id", "url", "html"), rules)
    scores = stored(host_scores(judged, damping, threshold), "link-verdicts")
    out = judged.drop("html", "url").join(scores, "host", "left")
    verdict = F.coalesce("by.verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    rounded = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c)
    return out.select("page_id", "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"), rounded("trust"), rounded("distrust"))


def op9(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages"))


def _sql() -> str:
    rules = "".join(
        f" WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'"
        for r in sorted(RULES, key=lambda r: -len(r.text))
    )
    rank = lambda name, seed, edges: (
        f"{name} AS (SELECT 0 AS n, host, CAST({seed} AS DOUBLE) AS seed, {1 - DAMPING} * {seed} AS x FROM h UNION ALL "
        f"SELECT s.n + 1, s.host, s.seed, {1 - DAMPING} * s.seed + {DAMPING} * coalesce(sum(g.w * p.x), 0) FROM {name} AS s "
        f"LEFT JOIN {edges} AS g ON g.b = s.host LEFT JOIN {name} AS p ON p.host = g.a WHERE s.n < {MOST_STEPS} GROUP BY s.n, s.host, s.seed)"
    )
    verdicts = " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in RULES)
    return f"""
WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT *, CASE{rules} END AS rule FROM v),
k AS (SELECT *, CASE rule {verdicts} END AS ruled FROM j),
l AS (SELECT DISTINCT page_id, host AS a, translate(unnest(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*["'']?\\s*(?:https?:)?//([^/?#"''\\s>]+)', 1)), '{UPPER}', '{LOWER}') AS b FROM k WHERE host <> ''),
e AS (SELECT a, b, count(*) / sum(count(*)) OVER (PARTITION BY a) AS w FROM l WHERE a <> b GROUP BY a, b),
q AS (SELECT b AS a, a AS b, w / sum(w) OVER (PARTITION BY b) AS w FROM e),
o AS (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS allowed, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS refused FROM k WHERE host <> '' GROUP BY host),
h AS (SELECT * FROM o UNION ALL SELECT DISTINCT b, 0.0, 0.0 FROM e WHERE b NOT IN (SELECT host FROM o)),
{rank('t', 'allowed', 'e')}, {rank('f', 'refused', 'q')},
s AS (SELECT host, t.x AS trust, f.x AS distrust FROM t JOIN f USING (host, n) WHERE n = {MOST_STEPS})
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust > trust AND distrust >= {THRESHOLD * (1 - DAMPING)} THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(trust, 0), 6) AS trust, round(coalesce(distrust, 0), 6) AS distrust
FROM k LEFT JOIN s USING (host)
"""


SQL9 = _sql()
