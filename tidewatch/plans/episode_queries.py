"""Event-table queries (sessionization, validity, recurrence structure)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import episodes, risk, scan
from tidewatch.plans.registry import cte, query
from tidewatch.session import materialize
from tidewatch.plans.standins import episode_events, risk_rows, sensor_rows


@query("ev1_gap_sessions", "entity:i event_sequence:i onset:i ending:i positive_rows:i", "SELECT * FROM ep1", "ep1")
def ev1(spark, root):
    return episode_events(spark, root)


@query("ev2_event_measures", "entity:i onset:i elapsed_minutes:i max_value:f min_temp:f max_rh:f min_vis:f fog_supported:i", "SELECT * FROM ep1", "ep1")
def ev2(spark, root):
    return episode_events(spark, root)


@query("ev3_validity_flags", "entity:i onset:i cold_plausible:i duration_pass:i cooldown_pass:i valid:i recurrent_index:i reference_issue:i", "SELECT * FROM ep", "ep")
def ev3(spark, root):
    return episode_events(spark, root)


@query("ev4_exclusion_reason", "entity:i onset:i exclusion_reason:s", "SELECT * FROM ep", "ep")
def ev4(spark, root):
    return episode_events(spark, root)


@query("ev5_event_ids", "entity:i onset:i event_id:s", "SELECT * FROM ep", "ep")
def ev5(spark, root):
    return episode_events(spark, root)


@query("ev6_event_eligibility", "event_id:s eligible:i eligibility_reason:s",
       """SELECT event_id, CASE WHEN valid=1 AND risk_set=1 AND hazard_label=1 THEN 1 ELSE 0 END AS eligible,
       CASE WHEN valid<>1 THEN 'not_a_target_event' WHEN risk_set IS NULL THEN 'reference_time_outside_timeline' WHEN risk_set=1 AND hazard_label=1 THEN ''
       ELSE coalesce(nullif(concat_ws(';', CASE WHEN physical_at_risk<>1 THEN 'not_physically_at_risk' END, CASE WHEN history_valid<>1 THEN 'insufficient_history_coverage' END,
       CASE WHEN step_label_valid<>1 THEN 'incomplete_next_step_label' END),''),'risk_set_exclusion') END AS eligibility_reason
       FROM ep LEFT JOIN risk1 r ON r.entity=ep.entity AND r.t=ep.reference_issue""", "ep risk1")
def ev6(spark, root):
    return risk.event_eligibility(episode_events(spark, root), risk_rows(spark, root))


@query("ev7_peak_and_support", "entity:i onset:i peak_at:i max_temp:f exposed_rows:i cold:i freezing:i supported:i",
       """SELECT *, CASE WHEN min_temp<=2 THEN 1 ELSE 0 END AS cold, CASE WHEN min_temp<=0 THEN 1 ELSE 0 END AS freezing,
       CASE WHEN exposed_rows>0 THEN 1 ELSE 0 END AS supported FROM ep1""", "ep1")
def ev7(spark, root):
    return with_support_flags(episode_events(spark, root))


def with_support_flags(events):
    return events.withColumns({
        "cold": F.coalesce(F.col("min_temp") <= 2, F.lit(False)).cast("int"),
        "freezing": F.coalesce(F.col("min_temp") <= 0, F.lit(False)).cast("int"),
        "supported": (F.col("exposed_rows") > 0).cast("int"),
    })


def station_event_summary(events):
    """Per-entity event counts, burden, medians and sample-size flags.

    An entity's events are bounded by the calendar over the merge gap, so the
    built-in exact percentile stays small here.
    """
    e = with_support_flags(events)
    cold = F.col("cold") == 1
    return e.groupBy("entity").agg(
        F.count(F.lit(1)).alias("all_events"), F.sum("cold").alias("cold_events"), F.sum("freezing").alias("freezing_events"),
        F.array_join(F.array_sort(F.collect_set(F.year(F.timestamp_seconds("onset")).cast("string"))), ",").alias("active_years"),
        F.sum("positive_rows").alias("positive_rows"), F.sum(F.when(cold, F.col("positive_rows")).otherwise(0)).alias("cold_rows"),
        F.percentile("elapsed_minutes", F.lit(0.5)).alias("median_minutes"), F.percentile("elapsed_minutes", F.lit(0.9)).alias("p90_minutes"),
        F.percentile(F.when(cold, F.col("elapsed_minutes")), F.lit(0.5)).alias("median_cold_minutes"),
        F.max("max_value").alias("max_value"), F.max(F.when(cold, F.col("max_value"))).alias("max_cold_value"),
    ).withColumns({f"enough_{k}": (F.col("cold_events") >= k).cast("int") for k in (5, 10, 20)})


@query("ev8_station_event_summary", "entity:i all_events:i cold_events:i freezing_events:i active_years:s positive_rows:i cold_rows:i median_minutes:f p90_minutes:f median_cold_minutes:f max_value:f max_cold_value:f enough_5:i enough_10:i enough_20:i",
       """SELECT *, CAST(cold_events>=5 AS INT) AS enough_5, CAST(cold_events>=10 AS INT) AS enough_10, CAST(cold_events>=20 AS INT) AS enough_20 FROM (
       SELECT entity, count(*) AS all_events, count(*) FILTER (min_temp<=2) AS cold_events, count(*) FILTER (min_temp<=0) AS freezing_events,
       string_agg(DISTINCT year(make_timestamp(onset*1000000))::VARCHAR, ',') AS active_years, sum(positive_rows) AS positive_rows,
       coalesce(sum(positive_rows) FILTER (min_temp<=2),0) AS cold_rows, quantile_cont(elapsed_minutes,0.5) AS median_minutes, quantile_cont(elapsed_minutes,0.9) AS p90_minutes,
       quantile_cont(elapsed_minutes,0.5) FILTER (min_temp<=2) AS median_cold_minutes, max(max_value) AS max_value, max(max_value) FILTER (min_temp<=2) AS max_cold_value
       FROM ep1 GROUP BY 1)""", "ep1")
def ev8(spark, root):
    return station_event_summary(episode_events(spark, root))


@query("ev8_year_event_summary", "year:i all_events:i cold_events:i stations:i cold_stations:i positive_rows:i",
       """SELECT year(make_timestamp(onset*1000000)) AS year, count(*) AS all_events, count(*) FILTER (min_temp<=2) AS cold_events, count(DISTINCT entity) AS stations,
       count(DISTINCT CASE WHEN min_temp<=2 THEN entity END) AS cold_stations, sum(positive_rows) AS positive_rows FROM ep1 GROUP BY 1""", "ep1")
def ev8_year(spark, root):
    e = with_support_flags(episode_events(spark, root))
    return e.groupBy(F.year(F.timestamp_seconds("onset")).alias("year")).agg(
        F.count(F.lit(1)).alias("all_events"), F.sum("cold").alias("cold_events"), F.count_distinct("entity").alias("stations"),
        F.count_distinct(F.when(F.col("cold") == 1, F.col("entity"))).alias("cold_stations"), F.sum("positive_rows").alias("positive_rows"))


@query("ev8_station_year_summary", "entity:i year:i all_events:i cold_events:i positive_rows:i cold_rows:i median_minutes:f max_value:f",
       """SELECT entity, year(make_timestamp(onset*1000000)) AS year, count(*) AS all_events, count(*) FILTER (min_temp<=2) AS cold_events, sum(positive_rows) AS positive_rows,
       coalesce(sum(positive_rows) FILTER (min_temp<=2),0) AS cold_rows, quantile_cont(elapsed_minutes,0.5) AS median_minutes, max(max_value) AS max_value FROM ep1 GROUP BY 1,2""", "ep1")
def ev8_station_year(spark, root):
    e = materialize(with_support_flags(episode_events(spark, root)).withColumn("year", F.year(F.timestamp_seconds("onset"))), "events")
    counts = e.groupBy("entity", "year").agg(
        F.count(F.lit(1)).alias("all_events"), F.sum("cold").alias("cold_events"), F.sum("positive_rows").alias("positive_rows"),
        F.coalesce(F.sum(F.when(F.col("cold") == 1, F.col("positive_rows"))), F.lit(0)).alias("cold_rows"), F.max("max_value").alias("max_value"))
    return counts.join(scan.exact_quantiles(e, "elapsed_minutes", {"median_minutes": 0.5}, ("entity", "year")), ["entity", "year"], "left")


# --- resolution, persistence and the definition grid -------------------------
# Levels are rounded down to whole units so that increments repeat.

def _positives(spark, root):
    rows = sensor_rows(spark, root).withColumn("thickness", F.floor("thickness") * 1.0)
    return episodes.dedupe_positives(rows, "thickness", 0.0, ["us", "event_id"], ["temp", "rh", "vis", "fog", "exposed"])


cte("posr", """SELECT entity, t, thickness_c//100 AS lvl, temp_d/10.0 AS temp FROM (SELECT *,
 row_number() OVER (PARTITION BY entity, t ORDER BY us DESC, event_id DESC) AS rn FROM rd WHERE thickness_c//100>0) WHERE rn=1""", "rd")
cte("levels", "SELECT *, lvl - lag(lvl) OVER (PARTITION BY entity ORDER BY lvl) AS inc FROM (SELECT DISTINCT entity, lvl FROM posr)", "posr")
cte("resol", """SELECT p.entity, p.n AS records, coalesce(r.rep, q.fb, CASE WHEN q.levels=1 THEN q.low END, 0.01) AS resolution
 FROM (SELECT entity, count(*) AS n FROM posr GROUP BY 1) p JOIN (SELECT entity, quantile_cont(inc,0.1) AS fb, count(*) AS levels, min(lvl) AS low FROM levels GROUP BY 1) q USING (entity)
 LEFT JOIN (SELECT c.entity, min(inc) AS rep FROM (SELECT entity, inc, count(*) AS times FROM levels WHERE inc IS NOT NULL GROUP BY 1,2) c
 JOIN (SELECT entity, count(*) AS n FROM levels GROUP BY 1) l USING (entity) WHERE times>=greatest(3,ceil(n*0.01)) GROUP BY 1) r USING (entity)""", "posr levels")


@query("ev9_instrument_resolution", "entity:i records:i resolution:f", "SELECT * FROM resol", "resol")
def ev9(spark, root):
    return episodes.instrument_resolution(_positives(spark, root), "thickness").withColumnRenamed("rows", "records")


cte("persist", """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY entity, g) AS sz FROM (SELECT *, sum(b) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS g
 FROM (SELECT p.*, CASE WHEN t-lag(t) OVER (PARTITION BY p.entity ORDER BY t)<=7200 THEN 0 ELSE 1 END AS b FROM posr p JOIN resol r ON r.entity=p.entity WHERE lvl>resolution+1e-12))) WHERE sz>=2""", "posr resol")


@query("ev10_persistent_records", "entity:i kept:i first_t:i last_t:i",
       "SELECT entity, count(*) AS kept, min(t) AS first_t, max(t) AS last_t FROM persist GROUP BY 1", "persist")
def ev10(spark, root):
    p = _positives(spark, root)
    res = episodes.instrument_resolution(p, "thickness").select("entity", "resolution")
    above = p.join(res, "entity").filter(F.col("thickness") > F.col("resolution") + 1e-12)
    kept = episodes.persistent_buckets(episodes.collapse(above, "thickness", 600), 2, 7200)
    return kept.groupBy("entity").agg(F.sum("n").alias("kept"), F.min("lo").alias("first_t"), F.max("hi").alias("last_t"))


_GRID_SQL = """SELECT printf('merge%d_cool%dh_temp%d_%s', m, c, x, CASE WHEN r='positive' THEN r ELSE 'resolution_persistent_3' END) AS definition_id,
 m AS merge_minutes, c AS cooldown_hours, x AS cold_limit, r AS rule, CASE WHEN m=10 AND c=1 AND x=2 AND r='positive' THEN 1 ELSE 0 END AS is_reference
 FROM (SELECT unnest([10,30,60]) AS m), (SELECT unnest([1,3,6]) AS c), (SELECT unnest([2,0]) AS x), (SELECT unnest(['positive','resolution_persistent']) AS r)"""
# Minutes are stretched 18-fold here: the log has a reading every few hours.
_SCALE = 1080
cte("gridrows", "SELECT 'positive' AS rule, entity, t, lvl, temp FROM posr UNION ALL SELECT 'resolution_persistent', entity, t, lvl, temp FROM persist", "posr persist")
cte("gridep", f"""SELECT rule, m, entity, g, min(t) AS onset, max(t) AS ending, count(*) AS positive_rows, min(temp) AS min_temp FROM (SELECT *,
 sum(b) OVER (PARTITION BY rule, m, entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN t-lag(t) OVER (PARTITION BY rule, m, entity ORDER BY t)<=(m+1)*{_SCALE} THEN 0 ELSE 1 END AS b
 FROM (SELECT *, unnest([10,30,60]) AS m FROM gridrows))) GROUP BY 1,2,3,4""", "gridrows")
cte("gridev", f"""SELECT rule, m AS merge_minutes, c AS cooldown_hours, x AS cold_limit, entity, onset, ending, positive_rows,
 CASE WHEN min_temp<=x AND (prev IS NULL OR onset//600*600>=prev+c*60*{_SCALE}) THEN 1 ELSE 0 END AS valid FROM (SELECT *, lag(ending) OVER (PARTITION BY rule, m, entity ORDER BY onset) AS prev FROM gridep),
 (SELECT unnest([1,3,6]) AS c), (SELECT unnest([2,0]) AS x)""", "gridep")


def _grid_events(spark, root):
    return episodes.evaluate_definitions(_positives(spark, root), "thickness", bucket=600, persistence=2, persistence_gap=7200, scale=_SCALE)


@query("ev11_definition_grid", "definition_id:s merge_minutes:i cooldown_hours:i cold_limit:i rule:s is_reference:i cold_positives:i",
       f"SELECT g.*, (SELECT count(*) FROM posr WHERE temp<=g.cold_limit) AS cold_positives FROM ({_GRID_SQL}) g", "posr")
def ev11(spark, root):
    # Each definition with the positive rows its cold limit lets through.
    limits = F.explode(F.array(*[F.lit(x) for x in episodes.GRID_COLD_LIMITS])).alias("cold_limit")
    cold = _positives(spark, root).select("temp", limits).groupBy("cold_limit").agg(F.count_if(F.col("temp") <= F.col("cold_limit")).alias("cold_positives"))
    return episodes.definition_grid(spark).join(cold, "cold_limit", "left").fillna(0, ["cold_positives"])


@query("ev12_definition_events", "rule:s merge_minutes:i cooldown_hours:i cold_limit:i entity:i all_events:i valid_events:i recurrent_events:i",
       f"""SELECT d.rule, d.merge_minutes, d.cooldown_hours, d.cold_limit, e.entity, count(g.onset) AS all_events, coalesce(sum(valid),0) AS valid_events, greatest(coalesce(sum(valid),0)-1,0) AS recurrent_events
       FROM ({_GRID_SQL}) d CROSS JOIN (SELECT DISTINCT entity FROM posr) e LEFT JOIN gridev g ON g.rule=d.rule AND g.merge_minutes=d.merge_minutes AND g.cooldown_hours=d.cooldown_hours AND g.cold_limit=d.cold_limit AND g.entity=e.entity
       GROUP BY 1,2,3,4,5""", "gridev posr")
def ev12(spark, root):
    p = _positives(spark, root)
    keys = ["rule", "merge_minutes", "cooldown_hours", "cold_limit", "entity"]
    counted = _grid_events(spark, root).groupBy(*keys).agg(F.count(F.lit(1)).alias("all_events"), F.sum("valid").alias("valid_events"))
    axes = F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(m).alias("merge_minutes"), F.lit(c).alias("cooldown_hours"), F.lit(x).alias("cold_limit"))
        for r in episodes.GRID_RULES for m in episodes.GRID_MERGE_MINUTES
        for c in episodes.GRID_COOLDOWN_HOURS for x in episodes.GRID_COLD_LIMITS]))
    every = p.select("entity").distinct().select("entity", axes.alias("d")).select("entity", "d.*")
    joined = every.join(counted, keys, "left").fillna(0, ["all_events", "valid_events"])
    return joined.withColumn("recurrent_events", F.greatest(F.col("valid_events") - 1, F.lit(0)))


@query("ev13_definition_summary", "rule:s merge_minutes:i cooldown_hours:i cold_limit:i events:i stations:i recurrent_stations:i third_plus:i p25_gap:f median_gap:f p75_gap:f",
       """SELECT *, (SELECT count(*) FROM (SELECT 1)) AS one FROM (SELECT rule, merge_minutes, cooldown_hours, cold_limit, count(*) AS events, count(DISTINCT entity) AS stations,
       count(DISTINCT CASE WHEN o>=2 THEN entity END) AS recurrent_stations, count(*) FILTER (o>=3) AS third_plus, quantile_cont(gap,0.25) AS p25_gap, quantile_cont(gap,0.5) AS median_gap, quantile_cont(gap,0.75) AS p75_gap
       FROM (SELECT *, row_number() OVER w AS o, (onset-lag(ending) OVER w)/3600.0 AS gap FROM gridev WHERE valid=1 WINDOW w AS (PARTITION BY rule, merge_minutes, cooldown_hours, cold_limit, entity ORDER BY onset)) GROUP BY 1,2,3,4)""", "gridev")
def ev13(spark, root):
    keys = ("rule", "merge_minutes", "cooldown_hours", "cold_limit")
    # Read twice below: written once so the sessionization is not repeated.
    v = materialize(episodes.order_valid_events(_grid_events(spark, root), (*keys, "entity")), "definition-events")
    counts = v.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("entity").alias("stations"),
        F.count_distinct(F.when(F.col("event_order") >= 2, F.col("entity"))).alias("recurrent_stations"),
        F.sum((F.col("event_order") >= 3).cast("int")).alias("third_plus"))
    gaps = scan.exact_quantiles(v, "gap_hours", {"p25_gap": .25, "median_gap": .5, "p75_gap": .75}, keys)
    return counts.join(gaps, list(keys), "left")


@query("ev13_year_summary", "rule:s merge_minutes:i cooldown_hours:i cold_limit:i year:i events:i stations:i recurrent_events:i",
       """SELECT rule, merge_minutes, cooldown_hours, cold_limit, year(make_timestamp(onset*1000000)) AS year, count(*) AS events, count(DISTINCT entity) AS stations, count(*) FILTER (o>=2) AS recurrent_events
       FROM (SELECT *, row_number() OVER (PARTITION BY rule, merge_minutes, cooldown_hours, cold_limit, entity ORDER BY onset) AS o FROM gridev WHERE valid=1) GROUP BY 1,2,3,4,5""", "gridev")
def ev13_year(spark, root):
    keys = ("rule", "merge_minutes", "cooldown_hours", "cold_limit")
    v = episodes.order_valid_events(_grid_events(spark, root), (*keys, "entity"))
    return v.groupBy(*keys, F.year(F.timestamp_seconds("onset")).alias("year")).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("entity").alias("stations"), F.sum((F.col("event_order") >= 2).cast("int")).alias("recurrent_events"))


@query("ev14_event_order", "event_id:s event_order:i order_group:s recurrence:s gap_hours:f onset_gap_hours:f onset_month:i season:s", "SELECT * FROM epv", "epv")
def ev14(spark, root):
    return episodes.order_valid_events(episode_events(spark, root))


ORDER_GROUPS = {
    "first": "event_order = 1", "second": "event_order = 2", "third_plus": "event_order >= 3",
    "recurrent": "event_order >= 2", "all": "event_order >= 1",
}


def explode_groups(df, groups: dict[str, str], name: str):
    """Long form over overlapping groups: one copy of the row per matching predicate."""
    return df.withColumn(name, F.explode(F.array_compact(F.array(*[F.when(F.expr(p), F.lit(g)) for g, p in groups.items()]))))


@query("ev15_order_group_summary", "event_group:s event_count:i station_count:i year_count:i duration_median:f value_median:f",
       """SELECT event_group, count(*) AS event_count, count(DISTINCT entity) AS station_count, count(DISTINCT onset_year) AS year_count,
       quantile_cont(elapsed_minutes,0.5) AS duration_median, quantile_cont(max_value::DOUBLE,0.5) AS value_median FROM (SELECT *, unnest(list_filter([
       CASE WHEN event_order=1 THEN 'first' END, CASE WHEN event_order=2 THEN 'second' END, CASE WHEN event_order>=3 THEN 'third_plus' END,
       CASE WHEN event_order>=2 THEN 'recurrent' END, 'all'], lambda x: x IS NOT NULL)) AS event_group FROM epv) GROUP BY 1""", "epv")
def ev15(spark, root):
    e = explode_groups(episodes.order_valid_events(episode_events(spark, root)), ORDER_GROUPS, "event_group")
    counts = e.groupBy("event_group").agg(F.count(F.lit(1)).alias("event_count"), F.count_distinct("entity").alias("station_count"),
                                          F.count_distinct("onset_year").alias("year_count"))
    minutes = scan.exact_quantiles(e, "elapsed_minutes", {"duration_median": .5}, ("event_group",))
    values = scan.exact_quantiles(e, "max_value", {"value_median": .5}, ("event_group",))
    return counts.join(minutes, "event_group").join(values, "event_group")


# Orders spread over seven years serve as events for the season rules.
def _order_events(spark, root):
    from tidewatch.functions.clock import to_clock
    from tidewatch.session import table

    o = table(spark, root, "orders")
    return o.groupBy(F.col("o_custkey").alias("entity"), to_clock("o_orderdate").alias("onset")).agg(
        F.max("o_orderkey").alias("event_id")).withColumns({"ending": F.col("onset") + 3600, "valid": F.lit(1)})


cte("oev", "SELECT o_custkey AS entity, epoch_us(o_orderdate)//1000000 AS onset, max(o_orderkey) AS event_id FROM orders GROUP BY 1,2")
cte("oseas", """SELECT *, row_number() OVER (PARTITION BY entity ORDER BY sy, onset) AS global_order, row_number() OVER (PARTITION BY entity, sy ORDER BY onset) AS season_order,
 CASE WHEN make_timestamp(sy,11,1,0,0,0) < make_timestamp(lo*1000000) THEN 1 ELSE 0 END AS left_censored,
 CASE WHEN make_timestamp(sy+1,4,30,23,59,59) > make_timestamp(hi*1000000) THEN 1 ELSE 0 END AS right_censored
 FROM (SELECT *, CASE WHEN month(make_timestamp(onset*1000000))>=11 THEN year(make_timestamp(onset*1000000)) ELSE year(make_timestamp(onset*1000000))-1 END AS sy FROM oev),
 (SELECT min(onset) AS lo, max(onset)+3600 AS hi FROM oev)""", "oev")


def _seasonal(spark, root):
    v = _order_events(spark, root)
    span = v.agg(F.struct(F.min("onset").alias("lo"), F.max("ending").alias("hi"))).scalar()
    return episodes.seasonal_orders(v, span["lo"], span["hi"])


@query("ev16_seasonal_orders", "entity:i onset:i season_start_year:i global_order:i season_order:i left_censored:i right_censored:i complete_season:i outside_season:i",
       """SELECT *, sy AS season_start_year, (1-left_censored)*(1-right_censored) AS complete_season,
       CASE WHEN month(make_timestamp(onset*1000000)) BETWEEN 5 AND 10 THEN -1 ELSE sy END AS outside_season FROM oseas""", "oseas")
def ev16(spark, root):
    return _seasonal(spark, root).withColumn("outside_season", episodes.season_year("onset", outside=True))


@query("ev16_station_seasons", "entity:i season_start_year:i event_count:i first_onset:i last_onset:i recurrent_count:i left_censored:i right_censored:i",
       "SELECT entity, sy AS season_start_year, count(*) AS event_count, min(onset) AS first_onset, max(onset) AS last_onset, count(*)-1 AS recurrent_count, max(left_censored) AS left_censored, max(right_censored) AS right_censored FROM oseas GROUP BY 1,2", "oseas")
def ev16b(spark, root):
    return _seasonal(spark, root).groupBy("entity", "season_start_year").agg(
        F.count(F.lit(1)).alias("event_count"), F.min("onset").alias("first_onset"), F.max("onset").alias("last_onset"),
        (F.count(F.lit(1)) - 1).alias("recurrent_count"), F.max("left_censored").alias("left_censored"), F.max("right_censored").alias("right_censored"))


@query("ev18_previous_interval", "event_id:s previous_end:f previous_gap_hours:f",
       "SELECT event_id, prev AS previous_end, (onset-prev)/3600.0 AS previous_gap_hours FROM ep", "ep")
def ev18(spark, root):
    e = episode_events(spark, root)
    meta = e.select("event_id", F.lag("ending").over(Window.partitionBy("entity").orderBy("onset")).alias("previous_end"), "onset")
    meta = meta.withColumn("previous_gap_hours", (F.col("onset") - F.col("previous_end")) / 3600.0).drop("onset")
    return e.select("event_id").join(meta, "event_id", "left")
