"""Running totals, ranks and exact quantiles over a total order without one big sort.

A global window would send every row to one task.  Here rows are reduced to
distinct order values, cut into value slices of similar size, totalled per
slice, and each slice runs on its own with the total of the slices before it.
Slice bounds are picked, group by group, from a sample of the distinct values
that is compared like the values themselves, so text keys and groups of
different range are cut as evenly as numbers; the number of slices follows the
number of distinct values.  Bounds only steer the balance, the results are exact
whatever they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values a slice should hold, and values in a group's sample (so slices at most).
SLICE_VALUES = 50_000
SAMPLE = 1024
#: Bounds are searched in two steps: every so-many-th first, then those up to the next.  One step would look at all bounds for every value.
STRIDE = 32


def _bounds(distinct: DataFrame, order: str, by: tuple[str, ...], slice_values: int) -> DataFrame:
    """Per group the ascending slice bounds: every so-many-th value of a hashed sample of at most ``SAMPLE`` values."""
    spread = F.xxhash64(order)
    sample = distinct.groupBy(*by, F.pmod(spread, F.lit(SAMPLE)).alias("_p")).agg(
        F.min_by(order, spread).alias("_v"), F.count(F.lit(1)).alias("_n"))
    picked = sample.groupBy(*by).agg(F.sort_array(F.collect_list("_v")).alias("_s"), F.sum("_n").alias("_n"))
    return picked.selectExpr(*[f"`{c}` AS `_by_{c}`" for c in by], f"""transform(
        filter(sequence(1, least({SAMPLE}, CAST(ceil(_n / {slice_values}) AS INT))), i -> i > 1),
        i -> _s[CAST((i - 1) * size(_s) / least({SAMPLE}, CAST(ceil(_n / {slice_values}) AS INT)) AS INT)]) AS _bounds""")


def running_totals(df: DataFrame, order: str, sums: dict[str, Column], by: tuple[str, ...] = (),
                   descending: bool = False, slice_values: int = SLICE_VALUES, bounded: bool = False) -> DataFrame:
    """Distinct ``order`` values with each sum, its inclusive running total ``<name>_cum``
    and its group total ``<name>_total``.

    ``bounded`` states that every group is small by construction (an entity of a
    dense panel, the replicates of a bootstrap); such groups are ordered directly.
    """
    if bounded and not by:
        raise ValueError("only grouped totals can be bounded")
    distinct = df.groupBy(*by, order).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    key = F.desc(order) if descending else F.asc(order)
    upto = (Window.unboundedPreceding, 0)
    if bounded:
        inside = Window.partitionBy(*by).orderBy(key).rowsBetween(*upto)
        return distinct.withColumns({f"{n}_cum": F.sum(n).over(inside) for n in sums} | {
            f"{n}_total": F.sum(n).over(Window.partitionBy(*by)) for n in sums})
    bounds = _bounds(distinct, order, by, slice_values).withColumn("_coarse", F.expr(f"filter(_bounds, (b, i) -> i % {STRIDE} = 0)"))
    if by:
        same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
        located = distinct.join(bounds, same).drop(*[f"_by_{c}" for c in by])
    else:
        located = distinct.withColumn("_b", bounds.select(F.struct("_bounds", "_coarse")).scalar()).select("*", "_b.*").drop("_b")
    near = f"greatest(size(filter(_coarse, b -> b < `{order}`)) - 1, 0) * {STRIDE}"
    above = f"(_near + size(filter(slice(_bounds, _near + 1, {STRIDE}), b -> b < `{order}`)))"
    cut = located.withColumn("_near", F.expr(near)).withColumn("_slice", F.expr(f"coalesce({'-' if descending else ''}{above}, 0)")).drop("_bounds", "_coarse", "_near")
    per_slice = cut.groupBy(*by, "_slice").agg(*[F.sum(n).alias(f"_s_{n}") for n in sums])
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(*by, "_slice", *[
        F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums], *[
        F.sum(f"_s_{n}").over(Window.partitionBy(*by)).alias(f"{n}_total") for n in sums])
    inside = Window.partitionBy(*by, "_slice").orderBy(key).rowsBetween(*upto)
    local = cut.withColumns({f"_l_{n}": F.sum(n).over(inside) for n in sums})
    return local.join(carried, [*by, "_slice"]).select(
        *by, order, *sums, *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(f"{n}_cum") for n in sums],
        *[f"{n}_total" for n in sums])


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Linear-interpolation quantiles per group, exact for any group size."""
    cum = running_totals(df.filter(F.col(value).isNotNull()), value, {"n": F.lit(1)}, by)
    picks = []
    for name, p in probs.items():
        spot = f"{p}D * (n_total - 1)"
        hit = "max(CASE WHEN n_cum - n <= {0} AND {0} < n_cum THEN {1} END)"
        picks.append(f"{hit.format(f'floor({spot})', value)} AS {name}_lo")
        picks.append(f"{hit.format(f'ceil({spot})', value)} AS {name}_hi")
        picks.append(f"max({spot} - floor({spot})) AS {name}_w")
    out = cum.groupBy(*by).agg(*[F.expr(x) for x in picks])
    return out.selectExpr(*by, *[f"{n}_lo + ({n}_hi - {n}_lo) * {n}_w AS {n}" for n in probs])


def distribution_summary(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, sample std (0 for one row), min, p25, median, p75, p90, max."""
    moments = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.when(F.count(value) > 1, F.stddev_samp(value)).when(F.count(value) == 1, 0.0).alias("std"),
        F.min(value).alias("minimum"), F.max(value).alias("maximum"))
    quantiles = exact_quantiles(df, value, {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}, by)
    if by:
        return moments.join(quantiles, list(by), "left")
    one = F.lit(1).alias("_one")
    return moments.select("*", one).join(quantiles.select("*", one), "_one", "left").drop("_one")


def average_ranks(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Average rank of every distinct value (ties share their mean rank)."""
    cum = running_totals(df.filter(F.col(value).isNotNull()), value, {"n": F.lit(1)}, by)
    return cum.select(*by, value, (F.col("n_cum") - F.col("n") + (F.col("n") + 1) / 2.0).alias(f"{value}_rank"))
