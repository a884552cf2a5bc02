"""Hazard trajectories as ARRAY<DOUBLE> columns, folded on the JVM."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def first_event_probability(h: Column | str) -> Column:
    """h[k] times the survival of all earlier steps."""
    hazards = _c(h)
    start = F.struct(F.lit(1.0).alias("alive"), F.array().cast("array<double>").alias("p"))
    return F.aggregate(hazards, start, lambda acc, x: F.struct(
        (acc["alive"] * (1 - x)).alias("alive"), F.concat(acc["p"], F.array(acc["alive"] * x)).alias("p")), lambda acc: acc["p"])


def survival(h: Column | str, steps: int | None = None) -> Column:
    hazards = _c(h) if steps is None else F.slice(_c(h), 1, steps)
    return F.aggregate(hazards, F.lit(1.0), lambda acc, x: acc * (1 - x))


def risk_at(h: Column | str, steps: int | None = None) -> Column:
    """Probability of at least one event within the first ``steps`` steps (all when not given).

    With a known number of steps the product is written out, which compiles to
    straight-line code; a fold over the array would be interpreted.
    """
    if steps is None:
        return 1 - survival(h)
    alive = F.lit(1.0)
    for k in range(steps):
        alive = alive * (F.lit(1.0) - _c(h)[k])
    return F.lit(1.0) - alive


def cumulative(h: Column | str) -> Column:
    """Cumulative incidence after each step."""
    start = F.struct(F.lit(1.0).alias("alive"), F.array().cast("array<double>").alias("f"))
    return F.aggregate(_c(h), start, lambda acc, x: F.struct(
        (acc["alive"] * (1 - x)).alias("alive"), F.concat(acc["f"], F.array(1 - acc["alive"] * (1 - x))).alias("f")), lambda acc: acc["f"])


def lead_values(horizon: int, step_minutes: int, kind: str = "linear") -> list[float]:
    """Value of an alarm by lead time, one number per step of the horizon."""
    # Knots (lead hours, value) of the utilities; values are linear in between.
    knots = {"hit_only": [(0.0, 1.0)], "saturating_3h": [(0.0, 0.0), (3.0, 3.0)],
             "business_piecewise": [(0.0, 0.0), (0.5, 0.25), (2.0, 0.75), (4.0, 1.0)]}
    hours = [k * step_minutes / 60.0 for k in range(1, horizon + 1)]
    if kind == "linear":
        return hours
    if kind not in knots:
        raise ValueError(f"unknown lead utility {kind}")
    xs, ys = zip(*knots[kind])
    return [float(v) for v in np.interp(hours, xs, ys)]


def lead_weights(horizon: int, step_minutes: int, kind: str = "linear") -> Column:
    return F.array(*[F.lit(v) for v in lead_values(horizon, step_minutes, kind)])


def trajectory_value(h: Column | str, step_minutes: int, horizon: int, kind: str = "linear") -> Column:
    """Expected lead value: first-event probabilities times lead weights over the first ``horizon`` steps.

    Written as the nested form v_k = h_k w_k + (1 - h_k) v_(k+1), linear in the horizon.
    """
    value = F.lit(0.0)
    for k, w in reversed(list(enumerate(lead_values(horizon, step_minutes, kind)))):
        value = _c(h)[k] * F.lit(w) + (F.lit(1.0) - _c(h)[k]) * value
    return value


def hazards_from_eta(eta: Column | str, shift: float, slope: float) -> Column:
    """Per-step cloglog hazards from an array of linear scores, clipped below one."""
    return F.transform(_c(eta), lambda e: F.least(
        -F.expm1(-F.exp(F.greatest(F.least(F.lit(shift) + F.lit(slope) * e, F.lit(15.0)), F.lit(-30.0)))), F.lit(1 - 1e-7)))


def label_at(y: Column | str, mask: Column | str, k: int) -> tuple[Column, Column]:
    """Event by step k, and whether that is known (event seen or step k uncensored)."""
    event = F.coalesce(F.array_max(F.slice(_c(y), 1, k)), F.lit(0)) > 0
    return event.cast("int"), (event | (F.element_at(_c(mask), k) > 0)).cast("int")


def audit(df: DataFrame, h: str, f: str, key: str, entity: str, t: str, horizon: int = 36, step_minutes: int = 10,
          contract: tuple[int, int] | None = None) -> DataFrame:
    """One row of violation counts over all trajectories, duplicates included.

    A curve must agree with its hazards at every step.  ``contract`` is the (horizon, step minutes) the trajectories have to come
    in; without one any grid may pass.
    """
    odd = "x IS NULL OR isnan(x) OR abs(x) = double('Infinity')"
    checks = df.selectExpr(
        f"exists({h}, x -> {odd}) OR exists({f}, x -> {odd}) AS missing",
        f"exists({h}, x -> x < 0 OR x > 1) AS bad_h", f"exists({f}, x -> x < 0 OR x > 1) AS bad_f",
        f"exists(sequence(2, size({f})), k -> element_at({f}, k) < element_at({f}, k - 1) - 1e-9D) AS falling",
        # Step by step: what is left after step k is what was left before times one minus the hazard of step k.
        f"""aggregate(arrays_zip({h}, {f}), struct(1.0D AS left, false AS off), (a, z) -> struct(
            a.left * (1 - z.`0`) AS left, a.off OR coalesce(abs(z.`1` - (1 - a.left * (1 - z.`0`))) > 2e-6D, false) AS off)).off AS incoherent""".replace("z.`0`", f"z.{h}").replace("z.`1`", f"z.{f}"),
        f"size({h}) <> {horizon} OR size({f}) <> {horizon} AS short")
    counts = checks.agg(F.count(F.lit(1)).alias("rows_n"), *[F.expr(f"count_if({c})").alias(c) for c in checks.columns])
    # A key's copies are pre-counted, so repeated keys never meet in one big group.
    dup_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).scalar()
    dup_time = df.groupBy(entity, t).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).scalar()
    out = counts.withColumns({"duplicate_keys": dup_key, "duplicate_times": dup_time})
    bad = " + ".join([*checks.columns, "duplicate_keys", "duplicate_times"])
    kept = contract is None or contract == (horizon, step_minutes)
    return out.withColumn("passed", F.expr(f"CAST({bad} = 0 AND {str(kept).lower()} AS INT)"))


def nll_components(df: DataFrame, h: str, y: str, mask: str, weight: str, by: list[str]) -> DataFrame:
    """Weighted discrete-hazard log-likelihood over uncensored steps."""
    per = df.selectExpr(*by, f"{weight} AS w", f"""aggregate(zip_with(zip_with({h}, {y}, (p, l) -> struct(p, l)), {mask}, (q, m) -> struct(q.p AS p, q.l AS l, m)),
        struct(0.0D AS loss, 0.0D AS bins), (a, z) -> struct(
            a.loss - z.m * (z.l * ln(greatest(least(z.p, 1 - 1e-7D), 1e-7D)) + (1 - z.l) * ln(1 - greatest(least(z.p, 1 - 1e-7D), 1e-7D))) AS loss,
            a.bins + z.m AS bins)) AS z""")
    return per.groupBy(*by).agg(F.expr("sum(w * z.loss) AS loss_sum"), F.expr("sum(w * z.bins) AS bin_weight")).withColumn(
        "nll", F.try_divide("loss_sum", "bin_weight"))
