"""Views of the given tables in the engine's vocabulary, with their oracle CTEs.

``events`` plays the sensor/event log: ``user_id`` is the entity, ``value`` the
reading.  Further sensor channels are fixed arithmetic on ``event_id`` so both
engines derive identical numbers from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.clock import to_clock
from tidewatch.operators import binning, temporal
from tidewatch.plans.registry import cte
from tidewatch.session import table

HOUR = 3600

# Event types standing in for the panel's count columns.
PANEL_TYPES = {"event_count": "purchase", "view_count": "view", "cart_count": "click", "remove_count": "error"}


def readings(spark: SparkSession, root: str) -> DataFrame:
    base = table(spark, root, "events").selectExpr(
        "user_id AS entity", "event_id", "event_type", "unix_micros(CAST(ts AS TIMESTAMP)) AS us",
        "CAST(round(value * 100) AS BIGINT) AS cents", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k")
    return base.selectExpr(
        "*", "us DIV 1000000 AS t",
        "CASE WHEN event_type IN ('purchase', 'error') THEN cents ELSE 0 END AS thickness_c",
        "CASE WHEN event_id % 11 <> 0 THEN (event_id * 37) % 300 - 150 END AS temp_d",
        "(event_id * 53) % 500 + 500 AS rh_d",
        "CASE WHEN event_id % 13 <> 0 THEN (event_id * 97) % 20000 + 100 END AS vis",
        "CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS fog", "(event_id * 13) % 360 AS wind")


cte("rd", """SELECT *, CASE WHEN event_type IN ('purchase','error') THEN cents ELSE 0 END AS thickness_c,
 CASE WHEN event_id % 11 <> 0 THEN (event_id*37)%300-150 END AS temp_d, (event_id*53)%500+500 AS rh_d,
 CASE WHEN event_id % 13 <> 0 THEN (event_id*97)%20000+100 END AS vis,
 CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS fog, (event_id*13)%360 AS wind
 FROM (SELECT user_id AS entity, event_id, event_type, epoch_us(ts)//1000000 AS t, epoch_us(ts) AS us,
 CAST(round(value*100) AS BIGINT) AS cents, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events)""")


def grid_bounds(df: DataFrame, step: int = HOUR):
    """First and last bin start as one scalar subquery (no driver round trip)."""
    return df.agg(F.struct(
        F.min(F.col("t") - F.pmod("t", F.lit(step))).alias("lo"),
        F.max(F.col("t") - F.pmod("t", F.lit(step))).alias("hi"),
    )).scalar()


def panel(spark: SparkSession, root: str, minimum: int = 1) -> DataFrame:
    """Dense hourly panel of event counts per user."""
    r = readings(spark, root).select("entity", "t", "event_type")
    counts = binning.count_by_type(r, HOUR, PANEL_TYPES)
    if minimum > 1:
        buyers = binning.frequent_entities(r.filter(F.col("event_type") == "purchase"), minimum)
        counts = counts.join(buyers.select("entity"), "entity", "left_semi")
    bounds = grid_bounds(r)
    return binning.complete_panel(counts, bounds["lo"], bounds["hi"], HOUR, list(PANEL_TYPES))


cte("bounds", "SELECT min(t)//3600*3600 AS lo, max(t)//3600*3600 AS hi FROM rd", "rd")
cte("counts", """SELECT entity, t//3600*3600 AS t, count(*) FILTER (event_type='purchase') AS event_count,
 count(*) FILTER (event_type='view') AS view_count, count(*) FILTER (event_type='click') AS cart_count,
 count(*) FILTER (event_type='error') AS remove_count FROM rd GROUP BY 1,2""", "rd")
cte("panel", """SELECT g.entity, g.t, coalesce(event_count,0) AS event_count, coalesce(view_count,0) AS view_count,
 coalesce(cart_count,0) AS cart_count, coalesce(remove_count,0) AS remove_count
 FROM (SELECT entity, unnest(range(lo, hi+1, 3600)) AS t FROM (SELECT DISTINCT entity FROM rd), bounds) g
 LEFT JOIN counts c ON c.entity=g.entity AND c.t=g.t""", "counts bounds")

HORIZON = 6


def scored(spark: SparkSession, root: str) -> DataFrame:
    """Panel rows with a causal score in [0, 1] and the future-event label.

    The score mixes purchases of the past day with fixed arithmetic noise; about
    one row in 53 has no score, which exercises every reset rule.
    """
    p = temporal.with_horizon_label(panel(spark, root), "event_count", HORIZON)
    p = p.selectExpr("*", "coalesce(sum(event_count) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before")
    noisy = p.selectExpr(
        "* EXCEPT (_before)", "_before - coalesce(lag(_before, 24) OVER (PARTITION BY entity ORDER BY t), 0) AS past24",
        "pmod(entity * 7919 + (t DIV 3600) * 104729, 997) AS noise")
    return noisy.selectExpr("*", """CASE WHEN pmod(entity * 31 + (t DIV 3600) * 17, 53) <> 0
        THEN round((noise * 60 + least(past24, 4) * 9970) / 99700.0D, 6) END AS score""")


cte("labelled", """SELECT *, CASE WHEN sum(event_count) OVER f > 0 THEN 1 ELSE 0 END AS future,
 CASE WHEN count(*) OVER f = 6 THEN 1 ELSE 0 END AS observed FROM panel
 WINDOW f AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)""", "panel")
cte("scored", """SELECT *, CASE WHEN (entity*31 + (t//3600)*17) % 53 <> 0
 THEN round((noise*60 + least(past24,4)*9970)/99700.0, 6) END AS score FROM (SELECT *,
 coalesce(sum(event_count) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING),0) AS past24,
 (entity*7919 + (t//3600)*104729) % 997 AS noise FROM labelled)""", "labelled")


def purchase_events(spark: SparkSession, root: str) -> DataFrame:
    """Raw purchase onsets: one row per (entity, clock second)."""
    r = readings(spark, root).filter(F.col("event_type") == "purchase")
    return r.groupBy("entity", F.col("t").alias("onset")).agg(
        F.max("event_id").alias("event_id"), F.max("cents").alias("cents"), F.count(F.lit(1)).alias("n"))


cte("onsets", """SELECT entity, t AS onset, max(event_id) AS event_id, max(cents) AS cents, count(*) AS n
 FROM rd WHERE event_type='purchase' GROUP BY 1,2""", "rd")


def catalog_view(spark: SparkSession, root: str) -> DataFrame:
    """Stations: customers with fixed-arithmetic coordinates and their nation."""
    c = table(spark, root, "customer")
    n = table(spark, root, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    return c.join(n, "c_nationkey").select(
        F.col("c_custkey").alias("station"), F.col("n_name").alias("city"), F.col("n_regionkey").alias("region"),
        (F.lit(115.0) + F.pmod(F.col("c_custkey") * 7919, F.lit(100003)) / F.lit(20000.0)).alias("lon"),
        (F.lit(24.0) + F.pmod(F.col("c_custkey") * 104729, F.lit(99991)) / F.lit(25000.0)).alias("lat"),
        F.pmod(F.col("c_custkey") * 31, F.lit(2000)).cast("double").alias("elevation"),
        F.when(F.pmod("c_custkey", F.lit(5)) != 0, 1).otherwise(0).alias("seen"),
    )


cte("stations", """SELECT c_custkey AS station, n_name AS city, n_regionkey AS region,
 115.0::DOUBLE + ((c_custkey*7919)%100003)/20000.0::DOUBLE AS lon, 24.0::DOUBLE + ((c_custkey*104729)%99991)/25000.0::DOUBLE AS lat,
 CAST((c_custkey*31)%2000 AS DOUBLE) AS elevation, CASE WHEN c_custkey%5<>0 THEN 1 ELSE 0 END AS seen
 FROM customer JOIN nation ON c_nationkey=n_nationkey""")


# --- episodes and risk timeline ----------------------------------------------

from tidewatch.operators import episodes, risk  # noqa: E402

EPISODE_RULES = episodes.EpisodeRules(merge_gap_seconds=10800, cooldown_seconds=7200, cold_limit=8.0,
                                      minimum_rows=1, step=HOUR, bucket=600)
RISK_RULES = risk.RiskRules(step=HOUR, history_bins=6, lookback_bins=2, minimum_history_bins=0.15,
                            minimum_history_coverage=0.002, minimum_label_coverage=0.0025, cooldown=7200,
                            temperature_c=5.0, humidity_pct=70.0, visibility_m=5000.0)


def sensor_rows(spark: SparkSession, root: str) -> DataFrame:
    r = readings(spark, root)
    return r.selectExpr("entity", "t", "us", "event_id", "thickness_c / 100.0D AS thickness", "temp_d / 10.0D AS temp",
                        "rh_d / 10.0D AS rh", "CAST(vis AS DOUBLE) AS vis", "fog", "fog AS exposed", "wind")


def episode_events(spark: SparkSession, root: str) -> DataFrame:
    return episodes.extract_events(sensor_rows(spark, root), "thickness", 0.0, EPISODE_RULES, ["us", "event_id"])


cte("pos", """SELECT entity, t, thickness_c/100.0 AS thickness, temp_d/10.0 AS temp, rh_d/10.0 AS rh, vis, fog FROM (SELECT *,
 row_number() OVER (PARTITION BY entity, t ORDER BY us DESC, event_id DESC) AS rn FROM rd WHERE thickness_c>0) WHERE rn=1""", "rd")
cte("ep0", """SELECT *, sum(brk) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT *,
 CASE WHEN t - lag(t) OVER (PARTITION BY entity ORDER BY t) <= 10860 THEN 0 ELSE 1 END AS brk FROM pos)""", "pos")
cte("ep1", """SELECT entity, grp AS event_sequence, min(t) AS onset, max(t) AS ending, count(*) AS positive_rows,
 max(thickness) AS max_value, min(temp) AS min_temp, max(temp) AS max_temp, max(rh) AS max_rh, min(vis) AS min_vis, max(fog) AS fog_supported,
 sum(fog) AS exposed_rows, min(t) FILTER (thickness=mx) AS peak_at, (max(t)-min(t))//60+1 AS elapsed_minutes
 FROM (SELECT *, max(thickness) OVER (PARTITION BY entity, grp) AS mx FROM ep0) GROUP BY 1,2""", "ep0")
cte("ep2", """SELECT *, CASE WHEN min_temp<=8 THEN 1 ELSE 0 END AS cold_plausible, 1 AS duration_pass,
 CASE WHEN prev IS NULL OR onset//3600*3600 >= prev+7200 THEN 1 ELSE 0 END AS cooldown_pass, onset//3600*3600 AS reference_issue
 FROM (SELECT *, lag(ending) OVER (PARTITION BY entity ORDER BY onset) AS prev FROM ep1)""", "ep1")
cte("ep", """SELECT *, CASE WHEN valid=1 THEN sum(valid) OVER (PARTITION BY entity ORDER BY onset ROWS UNBOUNDED PRECEDING) ELSE 0 END AS recurrent_index,
 CASE WHEN valid=1 THEN '' WHEN cold_plausible=0 THEN 'warm_or_missing_temperature' ELSE 'prediction_time_within_cooldown' END AS exclusion_reason,
 printf('%d-E%04d', entity, event_sequence) AS event_id FROM (SELECT *, cold_plausible*cooldown_pass AS valid FROM ep2)""", "ep2")
cte("epv", """SELECT *, CASE WHEN event_order=1 THEN 'first' WHEN event_order=2 THEN 'second' ELSE 'third_plus' END AS order_group,
 CASE WHEN event_order=1 THEN 'first' ELSE 'recurrent' END AS recurrence, (onset-pe)/3600.0 AS gap_hours, (onset-po)/3600.0 AS onset_gap_hours,
 year(make_timestamp(onset*1000000)) AS onset_year, month(make_timestamp(onset*1000000)) AS onset_month,
 CASE WHEN month(make_timestamp(onset*1000000)) IN (12,1,2) THEN 'winter' WHEN month(make_timestamp(onset*1000000)) IN (3,4,5) THEN 'spring'
 WHEN month(make_timestamp(onset*1000000)) IN (6,7,8) THEN 'summer' ELSE 'autumn' END AS season
 FROM (SELECT *, row_number() OVER w AS event_order, lag(ending) OVER w AS pe, lag(onset) OVER w AS po FROM ep WHERE valid=1
 WINDOW w AS (PARTITION BY entity ORDER BY onset))""", "ep")


def sensor_timeline(spark: SparkSession, root: str) -> DataFrame:
    """Dense hourly sensor bins; ``t`` is the right edge of the bin."""
    r = sensor_rows(spark, root)
    binned = binning.bin_sensors(r, HOUR, ["temp", "rh", "vis"], ["temp", "vis"], ["rh"], ["fog"], F.col("thickness") > 0)
    b = grid_bounds(r)
    full = binning.complete_panel(binned, b["lo"], b["hi"], HOUR, ["raw_rows", "observed_minutes", "positive_minutes"], t="bin_start")
    full = binning.derive_bin_features(full, HOUR, ["temp", "rh", "vis"], ["fog"])
    return full.withColumns({"t": F.col("issue_time"), "coverage": F.col("coverage_fraction"),
                             "label_coverage": F.least(F.col("raw_rows"), F.lit(60)) / 60.0})


cte("bins", """SELECT entity, t//3600*3600 AS bin_start, count(*) AS raw_rows, count(DISTINCT t//60) AS observed_minutes,
 sum(CASE WHEN thickness_c>0 THEN 1 ELSE 0 END) AS positive_minutes, sum(temp_d) AS temp_ds, count(temp_d) AS temp_count, min(temp_d)/10.0 AS temp_min,
 sum(rh_d) AS rh_ds, max(rh_d)/10.0 AS rh_max, sum(vis) AS vis_sum, count(vis) AS vis_count, min(vis) AS vis_min, sum(fog) AS fog_minutes
 FROM rd GROUP BY 1,2""", "rd")
cte("tl", """SELECT g.entity, g.bin_start, g.bin_start+3600 AS t, coalesce(observed_minutes,0) AS observed_minutes, coalesce(positive_minutes,0) AS positive_minutes,
 coalesce(raw_rows,0) AS raw_rows, temp_min, rh_max, vis_min, temp_ds/10.0/temp_count AS temp_mean, rh_ds/10.0/raw_rows AS rh_mean,
 vis_sum*1.0/vis_count AS vis_mean, fog_minutes*1.0/observed_minutes AS fog_fraction, least(coalesce(observed_minutes,0),60)/60.0 AS coverage,
 least(coalesce(raw_rows,0),60)/60.0 AS label_coverage
 FROM (SELECT entity, unnest(range(lo, hi+1, 3600)) AS bin_start FROM (SELECT DISTINCT entity FROM rd), bounds) g
 LEFT JOIN bins b ON b.entity=g.entity AND b.bin_start=g.bin_start""", "bins bounds")
cte("rec", """SELECT r.entity, r.t, count(*) FILTER (e.ending<=r.t) AS ended_n, max(e.ending) FILTER (e.ending<=r.t) AS last_end,
 arg_max(e.elapsed_minutes, e.ending) FILTER (e.ending<=r.t) AS last_minutes, arg_max(e.max_value, e.ending) FILTER (e.ending<=r.t) AS last_value,
 count(*) FILTER (e.onset<r.t) AS begun, count(*) FILTER (e.onset<r.t AND e.onset>=r.t-604800) AS past7,
 count(*) FILTER (e.onset<r.t AND e.onset>=r.t-2592000) AS past30, count(*) FILTER (e.onset>=r.t AND e.onset<r.t+3600) AS w1,
 count(*) FILTER (e.onset>=r.t AND e.onset<r.t+10800) AS w3, count(*) FILTER (e.onset>=r.t AND e.onset<r.t+21600) AS w6
 FROM tl r LEFT JOIN ep e ON e.entity=r.entity AND e.valid=1 GROUP BY 1,2""", "tl ep")
cte("phys", """SELECT r.entity, r.t, count(*) FILTER ((e.onset<r.t AND r.t<=e.ending) OR (e.ending<r.t AND r.t<e.ending+7200)) AS blocks,
 max(e.ending) FILTER (e.ending<=r.t) AS any_end FROM tl r LEFT JOIN ep e ON e.entity=r.entity GROUP BY 1,2""", "tl ep")
cte("hist", """SELECT *, max(e3) OVER b2 AS exposure_recent, avg(e3) OVER b2 AS exposure_fraction,
 CASE WHEN count(*) OVER b6=6 THEN avg(ob) OVER b6 END AS history_bins, CASE WHEN count(*) OVER b6=6 THEN avg(coverage) OVER b6 END AS history_coverage,
 lead(label_coverage) OVER (PARTITION BY entity ORDER BY t) AS next_label
 FROM (SELECT *, greatest(e1,e2) AS e3, CASE WHEN observed_minutes>=1 THEN 1 ELSE 0 END AS ob FROM (SELECT *,
 CASE WHEN temp_min<=5 AND rh_max>=70 THEN 1 ELSE 0 END AS e1, CASE WHEN vis_min<5000 OR fog_fraction>0 THEN 1 ELSE 0 END AS e2 FROM tl))
 WINDOW b2 AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW),
 b6 AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""", "tl")
_HZ = {1: "w1", 3: "w3", 6: "w6"}
cte("risk0", """SELECT h.*, rec.* EXCLUDE (entity,t), CASE WHEN blocks=0 AND positive_minutes=0 THEN 1 ELSE 0 END AS physical_at_risk,
 (h.t-any_end)/3600.0 AS time_since_last_hours,
 CASE WHEN history_bins>=0.15 AND history_coverage>=0.002 THEN 1 ELSE 0 END AS history_valid,
 CASE WHEN next_label>=0.0025 THEN 1 ELSE 0 END AS step_label_valid,
 """ + ", ".join(f"CASE WHEN count(*) OVER f{k}={k} AND sum(label_coverage) OVER f{k}/{k}>=0.0025 THEN 1 ELSE 0 END AS lv{k}, CASE WHEN count(*) OVER f{k}={k} THEN sum(label_coverage) OVER f{k}/{k} END AS lf{k}" for k in _HZ) + """
 FROM hist h JOIN rec USING (entity,t) JOIN phys USING (entity,t) WINDOW """ + ", ".join(
    f"f{k} AS (PARTITION BY h.entity ORDER BY h.t ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)" for k in _HZ), "hist rec phys")
cte("risk1", """SELECT *, physical_at_risk*history_valid*step_label_valid AS risk_set,
 CASE WHEN w1>0 THEN physical_at_risk*history_valid*step_label_valid ELSE 0 END AS hazard_label FROM risk0""", "risk0")
cte("risk", """SELECT *, CASE WHEN risk_set=1 THEN sp ELSE 0 END AS spell_index, CASE WHEN risk_set=1 THEN sum(risk_set) OVER (PARTITION BY entity, sp ORDER BY t ROWS UNBOUNDED PRECEDING) ELSE 0 END AS spell_step
 FROM (SELECT *, sum(ent) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS sp FROM (SELECT *,
 CASE WHEN risk_set=1 AND coalesce(lag(risk_set) OVER (PARTITION BY entity ORDER BY t),0)=0 THEN 1 ELSE 0 END AS ent FROM risk1))""", "risk1")


def risk_rows(spark: SparkSession, root: str) -> DataFrame:
    return risk.risk_timeline(sensor_timeline(spark, root), episode_events(spark, root), RISK_RULES)
