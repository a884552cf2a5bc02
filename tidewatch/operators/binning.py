"""Tumbling bins, grid completion and grouped summaries.

Raw logs are reduced to one row per (entity, bin) before anything is ordered
or windowed.  That reduction is a partial/final hash aggregate, so an entity
holding a third of the raw rows is spread over all map tasks; afterwards an
entity owns at most one row per calendar bin, whatever the raw volume was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.clock import floor_to
from tidewatch.functions.scalar import safe_ratio


def bin_sensors(readings: DataFrame, step: int, means: list[str], minima: list[str],
                maxima: list[str], flags: list[str], positive: Column) -> DataFrame:
    """One row per (entity, bin): row/minute counts, sums, counts, extremes, flag minutes."""
    aggs = [
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_distinct(floor_to("t", 60)).alias("observed_minutes"),
        F.sum(positive.cast("int")).alias("positive_minutes"),
    ]
    aggs += [a for c in means for a in (F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_count"))]
    aggs += [F.min(c).alias(f"{c}_min") for c in minima]
    aggs += [F.max(c).alias(f"{c}_max") for c in maxima]
    aggs += [F.sum(c).alias(f"{c}_minutes") for c in flags]
    return readings.groupBy("entity", floor_to("t", step).alias("bin_start")).agg(*aggs)


def derive_bin_features(binned: DataFrame, step: int, means: list[str], flags: list[str]) -> DataFrame:
    """Coverage, means and flag fractions; zero denominators give NULL."""
    minutes = step // 60
    observed = F.least(F.col("observed_minutes"), F.lit(minutes))
    out = binned.withColumn("observed_minutes", observed)
    return out.withColumns({
        "issue_time": F.col("bin_start") + step,
        "coverage_fraction": F.col("observed_minutes") / F.lit(float(minutes)),
        **{f"{c}_mean": safe_ratio(f"{c}_sum", f"{c}_count") for c in means},
        **{f"{c}_fraction": safe_ratio(f"{c}_minutes", "observed_minutes") for c in flags},
    })


def dense_grid(entities: DataFrame, lo: Column, hi: Column, step: int, t: str = "t") -> DataFrame:
    """Every entity on every bin of ``[lo, hi]`` (both bin starts)."""
    return entities.withColumn(t, F.explode(F.sequence(lo, hi, F.lit(step).cast("bigint"))))


def complete_panel(binned: DataFrame, lo: Column, hi: Column, step: int,
                   zero: list[str], t: str = "t", entities: DataFrame | None = None) -> DataFrame:
    """Left-join binned rows onto the dense grid; listed counts become 0, the rest stay NULL.

    Both sides are placed by entity into a stated number of partitions, so the windows that follow reuse the exchange.
    Entity ids are few bytes and the grid grows only after their exchange; a number left to the adaptive planner would be sized by the
    ids, put them into one partition and with them the whole grid.
    """
    places = int(binned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = binned.repartition(places, "entity")
    ids = (placed if entities is None else entities.select("entity").repartition(places, "entity")).select("entity").distinct()
    joined = dense_grid(ids, lo, hi, step, t).join(placed, ["entity", t], "left")
    return joined.fillna(0, subset=zero)


def count_by_type(events: DataFrame, step: int, types: dict[str, str], kind: str = "event_type") -> DataFrame:
    """Conditional counts per (entity, bin); ``types`` maps output column to type value."""
    return events.groupBy("entity", floor_to("t", step).alias("t")).agg(
        *[F.sum(F.when(F.col(kind) == value, 1).otherwise(0)).alias(name) for name, value in types.items()]
    )


def frequent_entities(events: DataFrame, minimum: int, top: int | None = None) -> DataFrame:
    """Entities with at least ``minimum`` rows, busiest first, ties by key."""
    counted = events.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= minimum)
    return counted if top is None else counted.orderBy(F.desc("n"), "entity").limit(top)


def grid_cell(region: Column, lat: Column, lon: Column, size: float) -> Column:
    def edge(c: Column) -> Column:
        return F.format_string("%.4f", F.floor(c / F.lit(size)) * F.lit(size))

    return F.concat_ws("|", F.coalesce(region, F.lit("NA")), edge(lat), edge(lon))


def unpivot_stats(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """count / mean / population std / min / max of several columns in one aggregate, long form."""
    stats = df.groupBy(*by).agg(*[
        F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"),
                 F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c)
        for c in columns
    ])
    return stats.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in columns
    ])).alias("x")).select(*by, "x.feature", "x.s.*")
