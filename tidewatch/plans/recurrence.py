"""Flagship: hourly recurrence panel with causal features and forward labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalar import calendar_terms_simple
from tidewatch.operators import temporal
from tidewatch.plans.registry import cte, query
from tidewatch.plans.standins import HORIZON, panel

BASE = ("event_count", "view_count", "cart_count", "remove_count")
WINDOWS = (6, 24, 168)


def causal_recurrence_features(p: DataFrame, horizon: int, base=BASE, windows=WINDOWS) -> DataFrame:
    """Lagged counts, rolling sums of the past, bins since last event, prior rate, labels."""
    def over(frame: str) -> str:
        return f"OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN {frame})"

    everything = over("UNBOUNDED PRECEDING AND 1 PRECEDING")
    cols = []
    for c in base:
        cols.append(f"coalesce(lag({c}) OVER (PARTITION BY entity ORDER BY t), 0) AS {c}_lag1")
        # Differences of one running total: a sliding frame would re-add its rows for every row.
        cols += [f"{c}_before - coalesce(lag({c}_before, {k}) OVER (PARTITION BY entity ORDER BY t), 0) AS {c}_past_{k}" for k in windows]
    numbered = p.selectExpr("*", "row_number() OVER (PARTITION BY entity ORDER BY t) AS rn",
                            *[f"coalesce(sum({c}) {everything}, 0) AS {c}_before" for c in base])
    windowed = numbered.selectExpr(
        "*", *cols, "event_count_before AS prior_n",
        f"rn - last(CASE WHEN event_count > 0 THEN rn END, true) {everything} AS since")
    out = windowed.selectExpr(
        "*", "CAST(since IS NULL AS INT) AS since_event_missing", "least(coalesce(since, 10000), 10000) AS since_event_bins",
        "CASE WHEN rn > 1 THEN prior_n / (rn - 1) ELSE 0.0D END AS prior_event_rate").withColumns(calendar_terms_simple("t"))
    return temporal.with_horizon_label(out, "event_count", horizon)


def _features_sql() -> str:
    parts = []
    for c in BASE:
        parts.append(f"coalesce(lag({c}) OVER w,0) AS {c}_lag1")
        for k in WINDOWS:
            parts.append(f"coalesce(sum({c}) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING),0) AS {c}_past_{k}")
    return (f"SELECT *, {', '.join(parts)}, CASE WHEN rn>1 THEN prior_n*1.0/(rn-1) ELSE 0 END AS prior_event_rate,"
            " CASE WHEN prev IS NULL THEN 1 ELSE 0 END AS since_event_missing, least(coalesce(rn-prev,10000),10000) AS since_event_bins,"
            " sin(hr*2*pi()/24) AS hour_sin, cos(hr*2*pi()/24) AS hour_cos, sin(doy*2*pi()/365.25) AS day_of_year_sin,"
            " cos(doy*2*pi()/365.25) AS day_of_year_cos FROM (SELECT *,"
            " max(CASE WHEN event_count>0 THEN rn END) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,"
            " sum(event_count) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_n,"
            " hour(make_timestamp(t*1000000)) AS hr, dayofyear(make_timestamp(t*1000000)) AS doy"
            " FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t) AS rn FROM labelled))"
            " WINDOW w AS (PARTITION BY entity ORDER BY t)")


cte("features", _features_sql(), "labelled")

_OUT = ("entity:i t:i event_count:i view_count:i cart_count:i remove_count:i "
        + " ".join(f"{c}_lag1:i " + " ".join(f"{c}_past_{k}:i" for k in WINDOWS) for c in BASE)
        + " since_event_missing:i since_event_bins:i prior_event_rate:f hour_sin:f hour_cos:f "
          "day_of_year_sin:f day_of_year_cos:f future:i observed:i")


@query("wf_hourly_recurrence", _OUT,
       "SELECT * FROM features WHERE entity IN (SELECT entity FROM rd WHERE event_type='purchase' GROUP BY 1 HAVING count(*)>=2)",
       "features rd")
def wf_hourly_recurrence(spark, root):
    return causal_recurrence_features(panel(spark, root, minimum=2), HORIZON)


@query("wn8_past_rolling_sums", "entity:i t:i event_count_lag1:i event_count_past_6:i event_count_past_24:i event_count_past_168:i view_count_past_24:i",
       "SELECT * FROM features", "features")
def wn8(spark, root):
    return causal_recurrence_features(panel(spark, root), HORIZON)


@query("wn9_bins_since_event", "entity:i t:i since_event_missing:i since_event_bins:i", "SELECT * FROM features", "features")
def wn9(spark, root):
    return causal_recurrence_features(panel(spark, root), HORIZON)


@query("wn10_prior_event_rate", "entity:i t:i prior_event_rate:f", "SELECT * FROM features", "features")
def wn10(spark, root):
    return causal_recurrence_features(panel(spark, root), HORIZON)


@query("wn11_horizon_label", "entity:i t:i future:i observed:i", "SELECT * FROM labelled", "labelled")
def wn11(spark, root):
    return temporal.with_horizon_label(panel(spark, root), "event_count", HORIZON)


@query("ev17_bin_event_table", "event_id:s entity:i onset:i event_order:i",
       """SELECT entity || '-E' || lpad(CAST(event_order AS VARCHAR),6,'0') AS event_id, entity, t AS onset, event_order
       FROM (SELECT entity, t, row_number() OVER (PARTITION BY entity ORDER BY t) AS event_order FROM panel WHERE event_count>0)""", "panel")
def ev17(spark, root):
    return bin_event_table(panel(spark, root))


def bin_event_table(p: DataFrame) -> DataFrame:
    """Every bin with a positive count is one event, numbered in time order."""
    e = p.filter(F.col("event_count") > 0).withColumn("event_order", F.row_number().over(temporal.by_clock()))
    return e.select(
        F.concat(F.col("entity").cast("string"), F.lit("-E"), F.lpad(F.col("event_order").cast("string"), 6, "0")).alias("event_id"),
        "entity", F.col("t").alias("onset"), "event_order")


@query("wn12_chronological_masks", "entity:i t:i fold:s",
       """SELECT entity, t, CASE WHEN t+21600<=lo+10*86400 THEN 'train' WHEN t>=lo+10*86400 AND t+21600<=lo+20*86400 THEN 'selection'
       WHEN t>=lo+20*86400 AND t+21600<=lo+28*86400 THEN 'test' ELSE 'embargo' END AS fold FROM panel, bounds""", "panel bounds")
def wn12(spark, root):
    from tidewatch.plans.standins import grid_bounds, readings

    lo = grid_bounds(readings(spark, root))["lo"]
    return chronological_folds(panel(spark, root), lo + 10 * 86400, lo + 20 * 86400, lo + 28 * 86400, HORIZON * 3600)


def chronological_folds(p: DataFrame, train_end, selection_end, test_end, horizon: int) -> DataFrame:
    """Time split with an embargo of one horizon before each cut."""
    done = F.col("t") + horizon
    return p.withColumn("fold", F.when(done <= train_end, "train")
                        .when((F.col("t") >= train_end) & (done <= selection_end), "selection")
                        .when((F.col("t") >= selection_end) & (done <= test_end), "test").otherwise("embargo"))
