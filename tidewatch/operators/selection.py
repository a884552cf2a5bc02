"""Top-k rows, thresholds for a budget, and lexicographic choices of candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import clock
from tidewatch.operators import scan


def oracle_mask(rows: DataFrame, score: str, capacities: dict[str, int]) -> DataFrame:
    """Best rows of each entity-month up to the capacity, nested over capacities.

    An entity-month of a dense panel is bounded by the calendar.
    """
    w = Window.partitionBy("entity", clock.month_start("t")).orderBy(F.desc_nulls_last(score), "t")
    ranked = rows.withColumn("_rank", F.row_number().over(w))
    return ranked.withColumns({n: ((F.col("_rank") <= c) & F.col(score).isNotNull()).cast("int") for n, c in capacities.items()}).drop("_rank")


def budget_threshold(rows: DataFrame, score: str, label: str, hours: float, step_minutes: int) -> DataFrame:
    """Highest score that must stay silent so that at most B negatives alarm; alarm iff score > threshold.

    B is the whole number of bins the budget pays over all entity-months.  The
    score at descending rank B+1 among the negatives is the threshold; with no
    more than B negatives everything may alarm (NULL, ``everything`` = 1).
    """
    months = rows.select("entity", clock.month_key("t").alias("m")).distinct().agg(
        F.floor(F.lit(hours * 60 / step_minutes) * F.greatest(F.count(F.lit(1)), F.lit(1)))).scalar()
    negatives = rows.filter((F.col(label) == 0) & F.col(score).isNotNull())
    ladder = scan.running_totals(negatives, score, {"n": F.lit(1)}, descending=True).withColumn("budget_bins", months)
    return ladder.agg(
        F.max(F.when((F.col("n_cum") - F.col("n") <= F.col("budget_bins")) & (F.col("budget_bins") < F.col("n_cum")), F.col(score))).alias("threshold"),
        F.max("budget_bins").alias("budget_bins"), F.max("n_total").alias("negatives"),
    ).withColumn("everything", (F.col("negatives") <= F.col("budget_bins")).cast("int"))


def best_rows(candidates: DataFrame, by: list[str], order: list[Column], feasible: Column | None = None) -> DataFrame:
    """One row per group by lexicographic order; infeasible rows only when nothing is feasible."""
    first = [] if feasible is None else [F.desc(F.coalesce(feasible, F.lit(False)).cast("int"))]
    w = Window.partitionBy(*by).orderBy(*first, *order)
    return candidates.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def best_within_tie(candidates: DataFrame, by: list[str], value: str, tie: float, order: list[Column]) -> DataFrame:
    top = F.max(value).over(Window.partitionBy(*by))
    return best_rows(candidates.withColumn("_top", top).filter(F.col(value) >= F.col("_top") - tie).drop("_top"), by, order)


def matched_comparison(candidates: DataFrame, group: list[str], strategy: str, measure: str, feasible: Column, order: list[Column]) -> DataFrame:
    """Nearest feasible candidate per strategy to the smallest of the strategies' largest feasible measures."""
    fit = candidates.filter(feasible)
    reach = fit.groupBy(*group, strategy).agg(F.max(measure).alias("_max"))
    target = reach.groupBy(*group).agg(F.min("_max").alias("target"))
    near = fit.join(target, group).withColumn("gap", F.abs(F.col(measure) - F.col("target")))
    return best_rows(near, [*group, strategy], [F.asc("gap"), *order])


def monotone_path(candidates: DataFrame, budgets: list[float], measures: list[str]) -> DataFrame:
    """Non-increasing thresholds over increasing budgets with the best summed measures.

    One join per budget stage: each threshold keeps the best path among those
    that end at a threshold at least as high.  Ties prefer the lower threshold path.
    """
    total = [f"s{i}" for i in range(len(measures))]
    path: DataFrame | None = None
    for budget in budgets:
        here = candidates.filter((F.col("budget") == budget) & (F.col("budget_met") == 1)).select(
            "threshold", *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(measures)])
        if path is None:
            scored = here.select("threshold", *[F.col(f"m{i}").alias(s) for i, s in enumerate(total)], F.array("threshold").alias("path"))
        else:
            before = path.select(F.col("threshold").alias("prev"), *[F.col(s).alias(f"p_{s}") for s in total], F.col("path").alias("prev_path"))
            # Candidates of one budget form a small parameter grid, not data rows.
            pairs = here.join(before, F.col("prev") >= F.col("threshold"))
            scored = pairs.select("threshold", *[(F.col(f"m{i}") + F.col(f"p_{s}")).alias(s) for i, s in enumerate(total)],
                                  F.concat("prev_path", F.array("threshold")).alias("path"))
        best = scored.groupBy("threshold").agg(F.max(F.struct(*total, "path")).alias("b"))
        path = best.select("threshold", "b.*")
    chosen = path.agg(F.max(F.struct(*total, "path")).alias("b"))
    return chosen.select(F.posexplode("b.path").alias("i", "threshold")).select(
        F.element_at(F.array(*[F.lit(float(b)) for b in budgets]), F.col("i") + 1).alias("budget"), "threshold")


def guarded_choice(models: DataFrame, reference: str, slack: float) -> DataFrame:
    """Models whose log-loss stays within ``slack`` of the reference; best average precision first."""
    ref = models.filter(F.col("model") == reference).agg(F.max("log_loss")).scalar()
    allowed = models.withColumn("limit", ref + slack).filter(F.col("log_loss") <= F.col("limit"))
    return allowed.orderBy(F.desc("average_precision"), "log_loss", "brier", "declared").limit(1)


def feasible_everywhere(results: DataFrame, conditions: list[str], primary: Column, utility: str) -> DataFrame:
    """Candidates that satisfy every condition on every budget, with mean utility on the primary ones."""
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.expr(c), F.lit(False)) for c in conditions])
    grouped = results.groupBy("candidate").agg(F.bool_and(ok).alias("feasible"), F.avg(F.when(primary, F.col(utility))).alias("mean_utility"))
    return grouped.withColumn("chosen", (F.row_number().over(Window.orderBy(F.desc("feasible"), F.desc("mean_utility"), "candidate")) == 1).cast("int"))
