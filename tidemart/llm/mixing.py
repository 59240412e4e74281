"""Operator 1, mixing sources to target weights by iterative proportional fitting.

Documents fold to cells of source, language and topic with their token counts; a cell's factor is raked over
the margins in turn until every margin has its target share of tokens. A document's probability is its
cell's factor over the largest, so no probability exceeds 1 and the expected tokens of each margin stand in
the ratio of the targets. Sampling compares it with a uniform number taken from a digest of seed and id, so
the same id always falls the same way. All of it is DataFrame functions; the texts are scanned twice and
never shuffled, and only cells are iterated.

On that scale the rarest cell sets the rate of the whole corpus, so one stray category can empty the sample. With
`keep`, the share of tokens to sample, the scale is stated instead: a margin's targets are shares of that budget, a
category that holds less than its target is kept whole and the others share what is left, and probabilities are
raked with 1 as their bound (`rake_within`). The registered query keeps the scale of its SQL; the pipeline states `KEEP`.

A null category is one of its own. Null and empty texts have no tokens; a category without tokens keeps its
factor. Categories that explicit targets do not name get 0 and are not sampled; named ones that hold no
tokens are left out of the total. Rows with the same id are sampled together. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemart.llm.session import WHITE, stored, table

#: Share of each margin's tokens: a mapping names target weights, a number raises the present shares to that power.
TARGETS: dict[str, Mapping[str, float] | float] = {"source": 0.8, "lang": 0.8, "topic": 0.9}
#: Topics by the first that has one of its marks in the text.
TOPICS = (("contact", ("@", "+1 (")), ("legal", ("icense", "opyright")), ("secret", ("password", "token =", "AKIA")), ("markup", ("#", "*", "$", "|")))
#: Share of tokens that the pipeline samples.
KEEP = 0.5
TOLERANCE = 1e-12
#: Bounded raking ends at this error in token shares, or when so many sweeps in a row do not lower it by a hundredth.
CLOSE, PATIENCE = 1e-6, 5
MOST_SWEEPS = 16


def topic(text: Column) -> Column:
    out = F.lit("general")
    for name, marks in reversed(TOPICS):
        out = F.when(reduce(lambda a, b: a | b, (text.contains(m) for m in marks)), name).otherwise(out)
    return F.coalesce(out, F.lit("general"))


def n_tokens(text: Column) -> Column:
    """Words of the text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))).otherwise(0).cast("long")


def _goals(cells: DataFrame, margin: str, target: Mapping[str, float] | float) -> DataFrame:
    """Target share of each category that has tokens, 1 in total."""
    wide = cells.groupBy(margin).agg(F.sum("share").alias("share")).filter("share > 0")
    if isinstance(target, Mapping):
        named = F.create_map(*(F.lit(x) for k, v in target.items() for x in (k, float(v))))
        wide = wide.withColumn("goal", F.coalesce(named[F.col(margin)], F.lit(0.0)))
    else:
        wide = wide.withColumn("goal", F.pow("share", F.lit(float(target))))
    total = wide.agg(F.sum("goal")).first()[0] or 1.0
    return wide.select(F.col(margin).alias("_m"), (F.col("goal") / total).alias(f"goal_{margin}"))


def _held(margin: str) -> Column:
    return F.sum(F.col("share") * F.col("factor")).over(Window.partitionBy(margin))


def _aimed(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | float]) -> DataFrame:
    """Cells with their share of tokens and the goals of their categories. Only sums over all cells reach the driver."""
    cells = stored(cells, "mix-cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    cells = cells.withColumn("share", F.col("tokens") / F.lit(float(total)))
    for m, target in targets.items():
        goals = _goals(cells, m, target)
        cells = cells.join(goals, cells[m].eqNullSafe(goals["_m"]), "left").drop("_m")
    return cells


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | float], tolerance: float = TOLERANCE, sweeps: int = MOST_SWEEPS) -> DataFrame:
    """`cells` (margins, tokens) with `factor`: raked until no margin's share is off by more than `tolerance`.

    Only sums over all cells, one number each, reach the driver.
    """
    cells = stored(_aimed(cells, targets).withColumn("factor", F.lit(1.0)), "mix-cells")
    for _ in range(sweeps):
        for m in targets:
            cells = cells.withColumn("held", _held(m))
            step = F.when(F.col("held") > 0, F.col(f"goal_{m}") / F.col("held")).otherwise(1.0)
            cells = cells.withColumn("factor", F.col("factor") * step).drop("held")
        cells = stored(cells, "mix-cells")
        off = [cells.groupBy(m).agg(F.abs(F.sum(F.col("share") * F.col("factor")) - F.first(f"goal_{m}")).alias("off")) for m in targets]
        worst = reduce(DataFrame.union, (x.select("off") for x in off)).agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    return cells


def _budgets(open_cells: DataFrame, margin: str, keep: float) -> DataFrame:
    """`aim` per category: its part of `keep`, at most what it holds; what full categories leave goes to the others."""
    wide = open_cells.groupBy(margin).agg(F.sum("share").alias("have"), F.first(f"goal_{margin}").alias("goal"))
    wide, rate, full = stored(wide, "mix-budgets"), 0.0, -1
    while True:
        whole = F.col("have") <= rate * F.col("goal")
        n, held, goals = wide.agg(F.count_if(whole), F.sum(F.when(whole, F.col("have"))), F.sum(F.when(~whole, F.col("goal")))).first()
        if n == full or not goals:
            break
        # Full categories hold less than their part, so the rate of the others only rises.
        full, rate = n, max(rate, (keep - (held or 0.0)) / goals)
    return wide.select(F.col(margin).alias("_m"), F.least("have", rate * F.col("goal")).alias(f"aim_{margin}"))


def rake_within(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | float], keep: float, tolerance: float = CLOSE) -> tuple[DataFrame, dict[str, float]]:
    """`cells` with `factor` and `probability`, the factor bounded by 1, and the error left in each margin's token shares.

    A cell at 1 stays there and the free cells of its category are raked to the rest of the aim; only if cells at 1
    hold more than the aim are all of them lowered. Cells of a category with goal 0, or without tokens, get 0.
    """
    cells = stored(_aimed(cells, targets), "mix-cells")
    may = reduce(lambda a, b: a & b, (F.coalesce(F.col(f"goal_{m}"), F.lit(0.0)) > 0 for m in targets)) & (F.col("share") > 0)
    open_cells = cells.filter(may)
    keep = min(keep, open_cells.agg(F.sum("share")).first()[0] or 0.0)
    for m in targets:
        aims = _budgets(open_cells, m, keep)
        cells = cells.join(aims, cells[m].eqNullSafe(aims["_m"]), "left").drop("_m")
    cells = stored(cells.withColumn("factor", F.when(may, F.lit(keep)).otherwise(0.0)), "mix-cells")
    bounded, best, idle = F.least("factor", F.lit(1.0)), float("inf"), 0
    while True:
        for m in targets:
            of = Window.partitionBy(m)
            at_one = F.col("factor") >= 1
            cells = cells.withColumns({
                "fixed": F.sum(F.when(at_one, F.col("share")).otherwise(0.0)).over(of), "free": F.sum(F.when(at_one, 0.0).otherwise(F.col("share") * F.col("factor"))).over(of),
            })
            rest = F.col(f"aim_{m}") - F.col("fixed")
            step = F.when((rest > 0) & (F.col("free") > 0), rest / F.col("free")).otherwise(F.col(f"aim_{m}") / (F.col("fixed") + F.col("free")))
            step = F.when(F.col("fixed") + F.col("free") > 0, step).otherwise(1.0)
            # Cells at 1 are not raised further, so that they can come down again as soon as they must.
            raised = F.when(at_one, F.col("factor") * F.least(step, F.lit(1.0))).otherwise(F.col("factor") * step)
            lowered = F.when((rest > 0) & at_one, F.col("factor")).otherwise(raised)
            cells = cells.withColumn("factor", F.coalesce(F.least(lowered, F.lit(1.0)), F.lit(0.0))).drop("fixed", "free")
        cells = stored(cells, "mix-cells")
        off = {m: cells.filter(may).groupBy(m).agg(F.abs(F.sum(F.col("share") * bounded) - F.first(f"aim_{m}")).alias("off")) for m in targets}
        left = {m: x.agg(F.max("off")).first()[0] or 0.0 for m, x in off.items()}
        worst = max(left.values(), default=0.0)
        idle, best = (0, worst) if worst < 0.99 * best else (idle + 1, min(best, worst))
        if worst <= tolerance or idle >= PATIENCE:
            return cells.withColumn("probability", bounded), left


def calibrated(
    docs: DataFrame, targets: Mapping[str, Mapping[str, float] | float] = TARGETS, id: str = "doc_id", text: str = "text", seed: str = "mix", keep: float | None = None,
) -> DataFrame:
    """`row`, `n_tokens`, `topic`, `factor`, `probability`, `sampled`; margins are columns of the row, or `topic` of its text."""
    body = docs[text]
    keyed = docs.select(
        F.struct("*").alias("row"), n_tokens(body).alias("n_tokens"), topic(body).alias("topic"), docs[id].cast("string").alias("key"),
        *(docs[m].alias(m) for m in targets if m != "topic"),
    )
    margins = list(targets)
    cells = keyed.groupBy(*margins).agg(F.sum("n_tokens").alias("tokens"))
    if keep is None:
        cells = rake(cells, targets)
        top = cells.filter("share > 0").agg(F.max("factor")).first()[0] or 1.0
        cells = cells.withColumn("probability", F.least(F.col("factor") / top, F.lit(1.0)))
    else:
        cells, _ = rake_within(cells, targets, keep)
    rates = stored(cells.select(*(F.col(m).alias(f"c_{m}") for m in margins), "factor", "probability"), "mix-rates")
    same = reduce(lambda a, b: a & b, (F.col(m).eqNullSafe(F.col(f"c_{m}")) for m in margins))
    uniform = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("key", F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    out = keyed.join(rates, same, "left").withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    return out.select("row", "n_tokens", "topic", "factor", "probability", (uniform < F.col("probability")).alias("sampled"))


def sampled_rows(
    docs: DataFrame, targets: Mapping[str, Mapping[str, float] | float] = TARGETS, id: str = "doc_id", text: str = "text", seed: str = "mix", keep: float | None = None,
) -> DataFrame:
    """The sampled documents, columns unchanged."""
    return calibrated(docs, targets, id, text, seed, keep).filter("sampled").select("row.*")


def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    out = calibrated(docs)
    return out.select(
        "row.doc_id", "row.source", "row.lang", "topic", "n_tokens", F.round("factor", 6).alias("factor"),
        F.round("probability", 6).alias("probability"), "sampled",
    )


def _sql() -> str:
    has = lambda marks: " OR ".join(f"contains(text, '{m}')" for m in marks)
    topics = "".join(f" WHEN {has(marks)} THEN '{name}'" for name, marks in TOPICS)
    step = lambda m, inner: (
        f"SELECT n, source, lang, topic, share, g_source, g_lang, g_topic, factor * g_{m} / sum(share * factor) OVER (PARTITION BY {m}) AS factor FROM ({inner})"
    )
    goal = lambda m, p: (
        f"{m[0]}g AS (SELECT {m}, power(sum(share), {p}) / sum(power(sum(share), {p})) OVER () AS g_{m} FROM s GROUP BY {m})"
    )
    sweep = step("topic", step("lang", step("source", f"SELECT n + 1 AS n, source, lang, topic, share, g_source, g_lang, g_topic, factor FROM r WHERE n < {MOST_SWEEPS}")))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n_tokens,
  CASE{topics} ELSE 'general' END AS topic FROM documents),
c AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM d GROUP BY ALL),
s AS (SELECT source, lang, topic, tokens / sum(tokens) OVER () AS share FROM c),
{goal('source', TARGETS['source'])}, {goal('lang', TARGETS['lang'])}, {goal('topic', TARGETS['topic'])},
r AS (SELECT 0 AS n, source, lang, topic, share, g_source, g_lang, g_topic, CAST(1 AS DOUBLE) AS factor FROM s JOIN sg USING (source) JOIN lg USING (lang) JOIN tg USING (topic)
  UNION ALL {sweep}),
f AS (SELECT source, lang, topic, factor, factor / max(factor) OVER () AS p FROM r WHERE n = {MOST_SWEEPS})
SELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(factor, 6) AS factor, round(p, 6) AS probability,
  CAST(CAST('0x' || substr(md5('mix:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 < p AS sampled
FROM d JOIN f USING (source, lang, topic)
"""


SQL1 = _sql()
