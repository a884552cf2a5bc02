"""Weighted probability metrics, grouped and exact at any size.

Everything that needs an order over scores (average precision, ROC area) goes
through the sliced running totals, so no task ever sorts all rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import scan
from tidewatch.session import materialize

# Lower edges of the thirteen calibration bins.
CALIBRATION_EDGES = (0.0, 1e-6, 3e-6, 1e-5, 3e-5, 1e-4, 3e-4, 1e-3, 3e-3, 1e-2, 3e-2, 1e-1, 3e-1)


def _clean(df: DataFrame, p: str, y: str, w: str | None, by: tuple[str, ...], n: str | None = None) -> DataFrame:
    weight = f"CAST({w} AS DOUBLE)" if w else "1.0D"
    return df.selectExpr(*by, f"greatest(least(CAST({p} AS DOUBLE), 1 - 1e-12D), 1e-12D) AS _p", f"CAST({y} AS INT) AS _y",
                         f"{weight} AS _w", f"{n or '1L'} AS _n").filter("_p IS NOT NULL AND NOT isnan(_p) AND _w > 0")


def rows_alike(df: DataFrame, p: str, y: str, w: str | None, by: tuple[str, ...] = (), n: str | None = None) -> DataFrame:
    """Rows of one group with equal score and label as one (``by``, p, y, w, n): every metric is a sum over them.  A row may stand for ``n`` rows.

    Written once, so that the metrics do not each make the rows anew; rows that all differ are written as they are, without more.
    """
    return materialize(_clean(df, p, y, w, by, n).groupBy(*by, F.col("_p").alias("p"), F.col("_y").alias("y")).agg(F.sum("_w").alias("w"), F.sum("_n").alias("n")), "rows-alike")


def calibration_bin(p: str = "_p") -> Column:
    """Index of the calibration bin of a probability."""
    return F.expr(" + ".join(f"int({p} >= {e!r}D)" for e in CALIBRATION_EDGES[1:]))


def base_metrics(df: DataFrame, p: str, y: str, w: str | None = None, by: tuple[str, ...] = (), n: str | None = None) -> DataFrame:
    """Rows, prevalence, mean probability, Brier score and skill, log-loss; ECE parts by bin.

    One aggregate by (group, bin) serves all of them.  A row may stand for ``n`` rows, whose weights it sums.
    """
    bins = _clean(df, p, y, w, by, n).withColumn("_bin", calibration_bin()).groupBy(*by, "_bin").agg(*[F.expr(e) for e in (
        "sum(_n) AS n", "sum(_n * _y) AS pos", "sum(_w) AS sw", "sum(_w * _y) AS swy", "sum(_w * _p) AS swp",
        "sum(_w * (_p - _y) * (_p - _y)) AS sb", "sum(-_w * (_y * ln(_p) + (1 - _y) * ln(1 - _p))) AS sl")])
    out = bins.groupBy(*by).agg(*[F.expr(e) for e in (
        "sum(n) AS rows_n", "sum(pos) AS positives", "sum(sw) AS weight", "sum(swy) / sum(sw) AS prevalence", "sum(swp) / sum(sw) AS mean_probability",
        "sum(sb) / sum(sw) AS brier", "sum(sl) / sum(sw) AS log_loss", "sum(abs(swy - swp)) / sum(sw) AS ece",
        "max(abs(swy - swp) / sw) AS max_gap", "count(1) AS bins")])
    return out.withColumn("brier_skill", F.expr("CASE WHEN prevalence * (1 - prevalence) > 0 THEN 1 - brier / (prevalence * (1 - prevalence)) END"))


def ranking_metrics(df: DataFrame, p: str, y: str, w: str | None = None, by: tuple[str, ...] = (), bounded: bool = False) -> DataFrame:
    """Step-wise average precision and ROC area with half credit for ties; NULL for one-class groups."""
    ladder = scan.running_totals(_clean(df, p, y, w, by), "_p", {"wp": F.expr("_w * _y"), "wn": F.expr("_w * (1 - _y)")}, by, descending=True, bounded=bounded)
    return ladder.groupBy(*by).agg(
        F.expr("CASE WHEN max(wp_total) > 0 AND max(wn_total) > 0 THEN sum(wp * (wp_cum / (wp_cum + wn_cum))) / max(wp_total) END AS average_precision"),
        F.expr("CASE WHEN max(wp_total) > 0 AND max(wn_total) > 0 THEN sum(wn * (wp_cum - wp / 2)) / (max(wp_total) * max(wn_total)) END AS roc_auc"))


def probability_metrics(df: DataFrame, p: str, y: str, w: str | None = None, by: tuple[str, ...] = (), bounded: bool = False, n: str | None = None) -> DataFrame:
    """All probability metrics; ``bounded`` as in the running totals (say, one group per entity).  A row may stand for ``n`` rows, whose weights ``w`` sums."""
    if bounded:
        base, ranks = base_metrics(df, p, y, w, by, n), ranking_metrics(df, p, y, w, by, bounded)
    else:
        base, ranks = metrics_alike(rows_alike(df, p, y, w, by, n), by)
    return _joined(base, ranks, by)


def metrics_alike(alike: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Base and ranking metrics of :func:`rows_alike`."""
    return base_metrics(alike, "p", "y", "w", by, "n"), ranking_metrics(alike, "p", "y", "w", by)


def _joined(base: DataFrame, ranks: DataFrame, by: tuple[str, ...]) -> DataFrame:
    if by:
        return base.join(ranks, list(by), "left")
    one = F.lit(1).alias("_one")
    return base.select("*", one).join(ranks.select("*", one), "_one").drop("_one")


def horizon_metrics(df: DataFrame, f: str, y: str, mask: str, w: str, horizons: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """Metrics of the cumulative risk at several steps, each on its uncensored rows."""
    long = df.select(*by, F.col(w).alias("_weight"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("horizon"), F.element_at(f, k).alias("p"),
                 (F.array_max(F.slice(y, 1, k)) > 0).cast("int").alias("hit"),
                 ((F.array_max(F.slice(y, 1, k)) > 0) | (F.element_at(mask, k) > 0)).alias("known")) for k in horizons])).alias("z"))
    known = long.select(*by, "_weight", "z.*").filter("known")
    return probability_metrics(known, "p", "hit", "_weight", (*by, "horizon"))


def brier_change(df: DataFrame, base: str, extra: str, y: str, w: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Brier change split into movement cost and residual correction, with the mechanism named."""
    s = df.selectExpr(*by, f"{w} AS w", f"{y} AS y", f"{extra} - {base} AS d", f"{base} - {y} AS r").groupBy(*by).agg(*[F.expr(e) for e in (
        "sum(w * d * d) / sum(w) AS movement_cost", "2 * sum(w * d * r) / sum(w) AS residual_correction", "sum(w * abs(d)) / sum(w) AS mean_absolute_shift",
        "try_divide(sum(CASE WHEN y = 1 THEN w * d END), sum(CASE WHEN y = 1 THEN w END)) AS shift_positive",
        "try_divide(sum(CASE WHEN y = 0 THEN w * d END), sum(CASE WHEN y = 0 THEN w END)) AS shift_negative")])
    s = s.withColumn("brier_delta", F.col("movement_cost") + F.col("residual_correction"))
    return s.withColumn("mechanism", F.expr("""CASE WHEN brier_delta < 0 THEN 'net_residual_correction'
        WHEN residual_correction < 0 THEN 'directionally_useful_but_movement_cost_dominates' ELSE 'wrong_direction_or_redundant_shift' END"""))


def condition_metrics(df: DataFrame, conditions: dict[str, str], models: list[str], base: str, y: str, w: str, minimum_rows: int = 100) -> DataFrame:
    """Metrics of every model under every named condition, with differences to the base model.

    Rows reach the conditions they satisfy through one explode; the sums are
    additive, so this is one grouped pass whatever the number of conditions,
    and rows with the same conditions, score and label are summed before it.
    """
    # The conditions that a row satisfies, as bits of a few long numbers.
    names = list(conditions)
    flags = [F.when(F.coalesce(F.expr(c), F.lit(False)), F.lit(1 << i % 62).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, c in enumerate(conditions.values())]
    met = F.array(*[reduce(Column.__add__, flags[k : k + 62]) for k in range(0, len(flags), 62)])
    named = F.array_compact(F.array(*[F.when(F.getbit(F.col("_met")[i // 62], F.lit(i % 62)) == 1, F.lit(n)) for i, n in enumerate(names)]))
    stack = f"stack({len(models)}, " + ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in models) + ") AS (model, p)"
    kept = [c for c in df.columns if c in {y, w}]
    # Rows that agree in all conditions, score and label go through the explode as one.
    sets = rows_alike(df.withColumn("_met", met).selectExpr("_met", *kept, stack), "p", y, w, ("_met", "model"))
    alike = materialize(sets.withColumn("condition", F.explode(named)).groupBy("condition", "model", "p", "y").agg(F.sum("w").alias("w"), F.sum("n").alias("n")), "conditions")
    m = _joined(*metrics_alike(alike, ("condition", "model")), ("condition", "model")).filter(F.col("rows_n") >= minimum_rows)
    total = df.agg(F.count(F.lit(1))).scalar()
    ref = m.filter(F.col("model") == base).select("condition", *[F.col(c).alias(f"base_{c}") for c in ("average_precision", "log_loss", "brier", "ece")])
    joined = m.join(ref, "condition")
    return joined.withColumns({f"delta_{c}": F.col(c) - F.col(f"base_{c}") for c in ("average_precision", "log_loss", "brier", "ece")}).withColumn(
        "coverage", F.col("rows_n") / total)


def signal_audit(df: DataFrame, signal: str, near: str, hard: str, seen: str) -> DataFrame:
    return df.agg(*[F.expr(e) for e in (
        "count(1) AS rows_n", f"avg(CAST({signal} > 0 AS INT)) AS positive_share", f"avg(CASE WHEN {near} THEN {signal} END) AS near_mean",
        f"avg(CASE WHEN {hard} THEN {signal} END) AS hard_mean", f"avg(CASE WHEN {near} THEN CAST({signal} > 0 AS INT) END) AS near_positive_share",
        f"avg(CASE WHEN {hard} THEN CAST({signal} > 0 AS INT) END) AS hard_positive_share",
        f"coalesce(max(CASE WHEN NOT ({seen}) THEN abs({signal}) END), 0) AS unseen_max")])


def student_t(p: float, df: int) -> float:
    """Quantile of Student's t: bisection on the distribution function, which has a finite sum for whole degrees of freedom."""
    def below(x: float) -> float:
        angle = math.atan(x / math.sqrt(df))
        term, total = 1.0, 0.0
        if df % 2:
            term = math.cos(angle)
            for k in range(1, df - 1, 2):
                total += term
                term *= math.cos(angle) ** 2 * (k + 1) / (k + 2)
            return 0.5 + (angle + math.sin(angle) * total) / math.pi
        for k in range(0, df - 1, 2):
            total += term
            term *= math.cos(angle) ** 2 * (k + 1) / (k + 2)
        return 0.5 + math.sin(angle) * total / 2

    lo, hi = 0.0, 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return (lo + hi) / 2


def paired_seed_differences(metrics: DataFrame, control: str, directions: dict[str, str]) -> DataFrame:
    """Mean, spread and t interval of per-seed metric differences against a control model."""
    stack = f"stack({len(directions)}, " + ", ".join(f"'{m}', {m}, '{d}'" for m, d in directions.items()) + ") AS (metric, value, favourable)"
    long = metrics.selectExpr("model", "seed", stack)
    ref = long.filter(F.col("model") == control).select("seed", "metric", F.col("value").alias("ref"))
    d = long.filter(F.col("model") != control).join(ref, ["seed", "metric"]).withColumn("d", F.col("value") - F.col("ref"))
    g = d.groupBy("model", "metric", "favourable").agg(
        F.count(F.lit(1)).alias("seeds"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("sd"),
        F.sum(F.when(F.col("favourable") == "higher", F.col("d") > 0).otherwise(F.col("d") < 0).cast("int")).alias("improved"))
    # One row per (model, metric); the seeds of a comparison are a handful, so their counts come to the driver as one short list.
    counts = [r[0] for r in d.groupBy("model", "metric").agg(F.count(F.lit(1)).alias("n")).select("n").distinct().collect() if r[0] > 1]
    quantile = F.lit(None).cast("double")
    for n in counts:
        quantile = F.when(F.col("seeds") == n, F.lit(student_t(0.975, n - 1))).otherwise(quantile)
    half = F.when(F.col("seeds") > 1, quantile * F.col("sd") / F.sqrt("seeds"))
    return g.withColumns({"low": F.col("mean_difference") - half, "high": F.col("mean_difference") + half})


def gate_decision(comparisons: DataFrame, original: str, ablation: str, placebos: list[str], minimum_lead: float = 0.1) -> DataFrame:
    """Pass only when the original beats its ablation and every placebo with positive lower bounds."""
    c = comparisons.filter(F.col("model_a") == original)
    rule = (f"bool_and(model_b <> '{ablation}' OR metric <> 'utility' OR low > 0) AND bool_or(model_b = '{ablation}' AND metric = 'utility') "
            f"AND coalesce(bool_or(model_b = '{ablation}' AND metric = 'common_lead' AND estimate >= {minimum_lead} AND low > 0), false)")
    listed = ", ".join(f"'{p}'" for p in placebos)
    other = (f"count_if(model_b IN ({listed}) AND metric = 'utility') = {len(placebos)} "
             f"AND coalesce(bool_and(NOT (model_b IN ({listed}) AND metric = 'utility') OR (estimate > 0 AND low > 0)), false)")
    out = c.agg(F.expr(f"CAST({rule} AS INT) AS primary_passed"), F.expr(f"CAST({other} AS INT) AS placebo_passed"))
    return out.withColumn("passed", F.col("primary_passed") * F.col("placebo_passed"))


def reproduce_anchors(observed: DataFrame, anchors: DataFrame, keys: list[str], tolerance: float = 5e-4) -> DataFrame:
    joined = anchors.join(observed.groupBy(*keys).agg(F.avg("value").alias("observed")), keys, "left")
    return joined.withColumn("difference", F.abs(F.col("observed") - F.col("expected"))).withColumn(
        "status", F.when(F.col("difference") <= tolerance, "PASS").otherwise("FAIL"))
