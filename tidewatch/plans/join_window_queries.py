"""Joins, as-of lookups, neighbour signals and window operators."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidewatch.functions.clock import DAY, to_clock
from tidewatch.operators import episodes, joins, risk, scan, temporal
from tidewatch.operators.temporal import EventClock, event_clocks
from tidewatch.plans.registry import cte, query
from tidewatch.plans.standins import (HOUR, RISK_RULES, catalog_view, episode_events, grid_bounds, panel, purchase_events,
                                      readings, risk_rows, scored, sensor_timeline)
from tidewatch.session import table


@query("jn1_complete_grid", "entity:i t:i event_count:i view_count:i cart_count:i remove_count:i", "SELECT * FROM panel", "panel")
def jn1(spark, root):
    return panel(spark, root)


@query("jn2_asof_last_event", "event_id:i entity:i t:i last_onset:f last_cents:f seen:i",
       """SELECT r.event_id, r.entity, r.t, max(o.onset) AS last_onset, arg_max(o.cents, o.onset) AS last_cents, count(o.onset) AS seen
       FROM (SELECT * FROM rd WHERE event_type<>'purchase') r LEFT JOIN onsets o ON o.entity=r.entity AND o.onset<=r.t GROUP BY 1,2,3""", "rd onsets")
def jn2(spark, root):
    rows = readings(spark, root).filter("event_type <> 'purchase'").select("entity", "t", "event_id")
    out = event_clocks(rows, purchase_events(spark, root), [EventClock("last", F.col("onset"), True, ("onset", "cents"))])
    return out.selectExpr("event_id", "entity", "t", "last_last.onset AS last_onset", "last_last.cents AS last_cents", "last_n AS seen")


@query("jn3_range_counts", "event_id:i entity:i t:i past_7d:i past_1d:i next_6h:i",
       """SELECT r.event_id, r.entity, r.t, count(*) FILTER (o.onset>=r.t-604800 AND o.onset<r.t) AS past_7d, count(*) FILTER (o.onset>=r.t-86400 AND o.onset<r.t) AS past_1d,
       count(*) FILTER (o.onset>=r.t AND o.onset<r.t+21600) AS next_6h FROM rd r LEFT JOIN onsets o ON o.entity=r.entity GROUP BY 1,2,3""", "rd onsets")
def jn3(spark, root):
    rows = readings(spark, root).select("entity", "t", "event_id")
    return range_counts(rows, purchase_events(spark, root), {"past_7d": (-7 * DAY, 0), "past_1d": (-DAY, 0), "next_6h": (0, 21600)})


def range_counts(rows, events, windows: dict[str, tuple[int, int]], slice_seconds: int | None = 30 * DAY):
    """Events with onset in ``[t + lo, t + hi)`` for each named window, in one ordered pass."""
    shifts = sorted({s for w in windows.values() for s in w})
    clocks = [EventClock(f"c{i}", F.col("onset") - s) for i, s in enumerate(shifts)]
    out = event_clocks(rows, events, clocks, slice_seconds=slice_seconds)
    named = {n: F.col(f"c{shifts.index(hi)}_n") - F.col(f"c{shifts.index(lo)}_n") for n, (lo, hi) in windows.items()}
    return out.withColumns(named).drop(*[f"c{i}_n" for i in range(len(shifts))])


@query("jn4_interval_anti_join", "entity:i t:i physical_at_risk:i time_since_last_hours:f", "SELECT * FROM risk0", "risk0")
def jn4(spark, root):
    return risk.with_event_state(sensor_timeline(spark, root), episode_events(spark, root), RISK_RULES)


@query("jn5_next_event_index", "entity:i t:i next_event_index:i current_event_order:i", "SELECT entity, t, begun+1 AS next_event_index, ended_n+1 AS current_event_order FROM rec", "rec")
def jn5(spark, root):
    return risk.with_event_state(sensor_timeline(spark, root), episode_events(spark, root), RISK_RULES)


@query("jn6_seasonal_prior_count", "entity:i onset:i season_start_year:i prior:i next_order:i state:i",
       """SELECT r.entity, r.onset, r.sy AS season_start_year, count(o.onset) AS prior, count(o.onset)+1 AS next_order, CASE WHEN count(o.onset)>0 THEN 1 ELSE 0 END AS state
       FROM oseas r LEFT JOIN oseas o ON o.entity=r.entity AND o.sy=r.sy AND o.onset<=r.onset GROUP BY 1,2,3""", "oseas")
def jn6(spark, root):
    from tidewatch.plans.episode_queries import _order_events

    e = _order_events(spark, root).withColumn("season_start_year", episodes.season_year("onset")).select("entity", "onset", "season_start_year")
    out = event_clocks(e.withColumn("t", F.col("onset")), e, [EventClock("prior", F.col("onset"), True)], keys=("entity", "season_start_year"))
    return out.selectExpr("entity", "onset", "season_start_year", "prior_n AS prior", "prior_n + 1 AS next_order", "CAST(prior_n > 0 AS INT) AS state")


cte("knn", """SELECT * FROM (SELECT t.station AS target_station, s.station AS source_station, d.km AS distance_km,
 s.elevation-t.elevation AS rise, CASE WHEN s.city=t.city THEN 1 ELSE 0 END AS same_city, s.seen AS s_seen, t.seen AS t_seen,
 row_number() OVER (PARTITION BY t.station ORDER BY d.km, s.station) AS distance_rank FROM stations t JOIN stations s ON s.station<>t.station,
 LATERAL (SELECT round(2*6371.0088*asin(sqrt(pow(sin((radians(t.lat)-radians(s.lat))/2),2)+cos(radians(s.lat))*cos(radians(t.lat))*pow(sin((radians(t.lon)-radians(s.lon))/2),2))),4) AS km) d) WHERE distance_rank<=4""", "stations")


def _edges(spark, root):
    return joins.nearest_neighbours(catalog_view(spark, root), "station", 4)


@query("jn7_nearest_neighbours", "target_station:i source_station:i distance_rank:i distance_km:f rise:f same_city:i", "SELECT * FROM knn", "knn")
def jn7(spark, root):
    return _edges(spark, root).selectExpr("target_station", "source_station", "distance_rank", "distance_km", "source_elevation - target_elevation AS rise",
                                          "CAST(source_city = target_city AS INT) AS same_city")


@query("jn8_lagged_edges", "feature:s source_station:i target_station:i lag_minutes:i distance_km:f distance_rank:i",
       """SELECT printf('graph::%d->%d::lag%dm', source_station, target_station, lag) AS feature, source_station, target_station, lag AS lag_minutes, distance_km, distance_rank
       FROM (SELECT *, unnest([60,120]) AS lag FROM knn WHERE s_seen=1 AND t_seen=1 AND distance_rank<=3 AND distance_km<=100)""", "knn")
def jn8(spark, root):
    return joins.lag_features(_edges(spark, root), catalog_view(spark, root), "station", [60, 120], 3, 100.0)


@query("jn9_shifted_lookup", "entity:i t:i back6:f ahead6:f partner:f",
       """SELECT s.entity, s.t, coalesce(b.past24,0) AS back6, coalesce(a.past24,0) AS ahead6, coalesce(p.past24,0) AS partner FROM scored s
       LEFT JOIN scored b ON b.entity=s.entity AND b.t=s.t-21600 LEFT JOIN scored a ON a.entity=s.entity AND a.t=s.t+21600
       JOIN (SELECT entity, coalesce(lead(entity) OVER (ORDER BY entity), min(entity) OVER ()) AS nxt FROM (SELECT DISTINCT entity FROM scored)) m ON m.entity=s.entity
       LEFT JOIN scored p ON p.entity=m.nxt AND p.t=s.t""", "scored")
def jn9(spark, root):
    rows = scored(spark, root).selectExpr("entity", "t", "CAST(past24 AS DOUBLE) AS past24")
    partners = joins.cyclic_partners(readings(spark, root))
    out = joins.shifted_lookup(joins.shifted_lookup(rows, "past24", -21600, "back6"), "past24", 21600, "ahead6")
    return joins.shifted_lookup(out, "past24", 0, "partner", partners)


# Neighbour edges among the panel's users: the station catalog restricted to user ids.
def _user_edges(spark, root):
    users = readings(spark, root).select(F.col("entity").alias("station")).distinct()
    e = joins.nearest_neighbours(catalog_view(spark, root).join(users, "station", "left_semi"), "station", 3)
    lagged = e.withColumn("lag_minutes", F.explode(F.array(F.lit(60), F.lit(120))))
    return lagged.selectExpr("source_station AS source_entity", "target_station AS target_entity", "lag_minutes",
                             "format_string('graph::%s->%s::lag%dm', CAST(source_station AS STRING), CAST(target_station AS STRING), lag_minutes) AS feature")


cte("uknn", """SELECT * FROM (SELECT t.station AS dst, s.station AS src, row_number() OVER (PARTITION BY t.station ORDER BY round(2*6371.0088*asin(sqrt(pow(sin((radians(t.lat)-radians(s.lat))/2),2)+cos(radians(s.lat))*cos(radians(t.lat))*pow(sin((radians(t.lon)-radians(s.lon))/2),2))),4), s.station) AS rk
 FROM stations t JOIN stations s ON s.station<>t.station WHERE t.station IN (SELECT entity FROM rd) AND s.station IN (SELECT entity FROM rd)) WHERE rk<=3""", "stations rd")
cte("sig", "SELECT *, max(past24*0.25) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolled FROM scored", "scored")
cte("nbr", """SELECT e.dst AS entity, s.t+lag*60 AS t, printf('graph::%d->%d::lag%dm', e.src, e.dst, lag) AS feature, s.rolled AS value
 FROM (SELECT *, unnest([60,120]) AS lag FROM uknn) e JOIN sig s ON s.entity=e.src WHERE s.rolled>0""", "uknn sig")


@query("jn10_neighbour_signals", "entity:i t:i feature:s value:f", "SELECT n.* FROM nbr n JOIN panel p ON p.entity=n.entity AND p.t=n.t", "nbr panel")
def jn10(spark, root):
    s = scored(spark, root).selectExpr("entity", "t", "past24 * 0.25D AS signal")
    return joins.neighbour_signals(s, s, _user_edges(spark, root), 3, HOUR)


@query("jn11_validated_join", "o_orderkey:i c_name:s segment:s", "SELECT o_orderkey, c_name, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey=c_custkey")
def jn11(spark, root):
    c = table(spark, root, "customer").selectExpr("c_custkey AS o_custkey", "c_name", "c_mktsegment AS segment")
    return joins.validated_join(table(spark, root, "orders"), c, ["o_custkey"], "inner")


@query("jn13_semi_join", "l_orderkey:i l_linenumber:i", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal>5000)")
def jn13(spark, root):
    s = table(spark, root, "supplier").filter("s_acctbal > 5000").selectExpr("s_suppkey AS l_suppkey")
    return table(spark, root, "lineitem").join(s, "l_suppkey", "left_semi")


cte("wkblocks", "SELECT lo//86400*86400 + unnest([1,3])*604800 AS b FROM bounds", "bounds")


@query("jn14_purged_training", "entity:i t:i event_count:i", "SELECT entity, t, event_count FROM panel p WHERE NOT EXISTS (SELECT 1 FROM wkblocks w WHERE p.t>=w.b-108000 AND p.t<w.b+604800+108000)", "panel wkblocks")
def jn14(spark, root):
    lo = grid_bounds(readings(spark, root), DAY)["lo"]
    p = panel(spark, root)
    starts = spark.range(1).select(F.explode(F.array(F.lit(1), F.lit(3))).alias("i")).withColumn("block_start", lo + F.col("i") * 7 * DAY)
    blocks = starts.withColumn("block_end", F.col("block_start") + 7 * DAY)
    return joins.purge(p, blocks, 30 * HOUR, DAY)


@query("jn15_seed_ensemble", "entity:i t:i score:f", "SELECT entity, t, (score + noise/997.0 + 0.5)/3 AS score FROM scored WHERE score IS NOT NULL", "scored")
def jn15(spark, root):
    long = scored(spark, root).filter("score IS NOT NULL").selectExpr("entity", "t", "stack(3, 1, score, 2, noise / 997.0D, 3, 0.5D) AS (seed, p)")
    return joins.seed_mean(long, ["entity", "t"], "p", 3).withColumnRenamed("p", "score")


cte("loose", """SELECT entity, min(t) AS onset FROM (SELECT *, sum(brk) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY entity ORDER BY t) <= 21660 THEN 0 ELSE 1 END AS brk
 FROM (SELECT entity, t, row_number() OVER (PARTITION BY entity, t ORDER BY us DESC, event_id DESC) AS rn FROM rd WHERE thickness_c>500) WHERE rn=1)) GROUP BY entity, grp""", "rd")
cte("onsetpairs", """SELECT *, row_number() OVER (PARTITION BY entity ORDER BY shift, ref, cand) AS n FROM (SELECT DISTINCT r.entity, r.onset AS ref, c.onset AS cand, abs(c.onset-r.onset) AS shift FROM ep r JOIN loose c ON c.entity=r.entity AND abs(c.onset-r.onset)<=10800)""", "ep loose")
cte("onsetpass", """/*RECURSIVE*/ SELECT entity, 0::BIGINT AS n, 0::BIGINT AS ref, 0::BIGINT AS cand, 0::BIGINT AS shift, false AS taken, []::BIGINT[] AS refs, []::BIGINT[] AS cands FROM (SELECT DISTINCT entity FROM onsetpairs) UNION ALL
 SELECT entity, n, ref, cand, shift, free, CASE WHEN free THEN list_append(refs, ref) ELSE refs END, CASE WHEN free THEN list_append(cands, cand) ELSE cands END
 FROM (SELECT p.*, g.refs, g.cands, NOT list_contains(g.refs, p.ref) AND NOT list_contains(g.cands, p.cand) AS free FROM onsetpass g JOIN onsetpairs p ON p.entity=g.entity AND p.n=g.n+1)""", "onsetpairs")


@query("jn16_greedy_onset_match", "entity:i ref:i cand:i shift:i", "SELECT entity, ref, cand, shift FROM onsetpass WHERE taken", "onsetpass")
def jn16(spark, root):
    strict = episode_events(spark, root)
    from tidewatch.plans.standins import EPISODE_RULES, sensor_rows
    import dataclasses

    loose = episodes.extract_events(sensor_rows(spark, root), "thickness", 5.0, dataclasses.replace(EPISODE_RULES, merge_gap_seconds=21600), ["us", "event_id"])
    return episodes.greedy_match(strict, loose, 3 * HOUR)


@query("jn17_dimension_join", "o_orderkey:i c_name:s nation:s region:s",
       "SELECT o_orderkey, c_name, n_name AS nation, r_name AS region FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey")
def jn17(spark, root):
    t = lambda n: table(spark, root, n)
    return (t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("o_orderkey", "c_name", "n_name AS nation", "r_name AS region"))


@query("jn18_union_tagged", "method:s entity:i t:i score:f gate:f",
       "SELECT 'base' AS method, entity, t, score, CAST(NULL AS DOUBLE) AS gate FROM scored WHERE future=1 UNION ALL SELECT 'gated', entity, t, CAST(NULL AS DOUBLE), noise/997.0 FROM scored WHERE past24>0", "scored")
def jn18(spark, root):
    s = scored(spark, root)
    a = s.filter("future = 1").selectExpr("'base' AS method", "entity", "t", "score")
    b = s.filter("past24 > 0").selectExpr("'gated' AS method", "entity", "t", "noise / 997.0D AS gate")
    return a.unionByName(b, allowMissingColumns=True)


@query("jn19_complete_lookup", "entity:i t:i event_count:i weight:f", "SELECT entity, t, event_count, 1+noise/997.0 AS weight FROM scored", "scored")
def jn19(spark, root):
    w = scored(spark, root).selectExpr("entity", "t", "1 + noise / 997.0D AS weight")
    return joins.complete_lookup(panel(spark, root), w, ["entity", "t"])


@query("jn20_interval_pivot", "entity:i n:i purchase_low:f purchase_high:f view_low:f view_high:f",
       """SELECT entity, count(*) AS n, min(cents) FILTER (event_type='purchase')/100.0 AS purchase_low, max(cents) FILTER (event_type='purchase')/100.0 AS purchase_high,
       min(cents) FILTER (event_type='view')/100.0 AS view_low, max(cents) FILTER (event_type='view')/100.0 AS view_high FROM rd GROUP BY 1""", "rd")
def jn20(spark, root):
    r = readings(spark, root)
    long = r.groupBy("entity", "event_type").agg((F.min("cents") / 100.0).alias("low"), (F.max("cents") / 100.0).alias("high"))
    wide = joins.intervals_wide(long, ["entity"], "event_type", ["purchase", "view"], ["low", "high"])
    return r.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).join(wide, "entity", "left")


# --- windows -----------------------------------------------------------------

@query("wn1_lag_differences", "entity:i t:i temp_change:f vis_change_2:f",
       "SELECT entity, t, temp_mean-lag(temp_mean) OVER w AS temp_change, vis_mean-lag(vis_mean,2) OVER w AS vis_change_2 FROM tl WINDOW w AS (PARTITION BY entity ORDER BY t)", "tl")
def wn1(spark, root):
    return sensor_timeline(spark, root).withColumns({"temp_change": temporal.lag_diff("temp_mean", 1), "vis_change_2": temporal.lag_diff("vis_mean", 2)})


@query("wn2_recent_exposure", "entity:i t:i exposure_recent:i exposure_fraction:f", "SELECT * FROM hist", "hist")
def wn2(spark, root):
    return risk.with_history(sensor_timeline(spark, root), RISK_RULES)


@query("wn3_history_validity", "entity:i t:i history_bins:f history_coverage:f history_valid:i",
       "SELECT *, CASE WHEN history_bins>=0.15 AND history_coverage>=0.002 THEN 1 ELSE 0 END AS history_valid FROM hist", "hist")
def wn3(spark, root):
    return risk.with_history(sensor_timeline(spark, root), RISK_RULES)


@query("wn4_forward_sum", "entity:i t:i ahead:f complete:i",
       "SELECT entity, t, CASE WHEN count(*) OVER f=6 THEN sum(raw_rows) OVER f END AS ahead, CASE WHEN count(*) OVER f=6 THEN 1 ELSE 0 END AS complete FROM tl WINDOW f AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)", "tl")
def wn4(spark, root):
    total, complete = temporal.forward_sum("raw_rows", 6)
    return sensor_timeline(spark, root).withColumns({"ahead": total, "complete": complete})


@query("wn5_next_label_valid", "entity:i t:i step_label_valid:i", "SELECT * FROM risk0", "risk0")
def wn5(spark, root):
    return risk.with_history(sensor_timeline(spark, root), RISK_RULES)


@query("wn6_multi_horizon_labels", "entity:i t:i within_1h:i within_3h:i within_6h:i valid_1h:i valid_3h:i valid_6h:i hard_1h:i hard_6h:i fraction_6h:f",
       """SELECT entity, t, CAST(w1>0 AS INT) AS within_1h, CAST(w3>0 AS INT) AS within_3h, CAST(w6>0 AS INT) AS within_6h, lv1 AS valid_1h, lv3 AS valid_3h, lv6 AS valid_6h,
       risk_set*exposure_recent*lv1*CAST(w1=0 AS INT) AS hard_1h, risk_set*exposure_recent*lv6*CAST(w6=0 AS INT) AS hard_6h, lf6 AS fraction_6h FROM risk1""", "risk1")
def wn6(spark, root):
    return risk_rows(spark, root).selectExpr("entity", "t", "onset_within_3600 AS within_1h", "onset_within_10800 AS within_3h", "onset_within_21600 AS within_6h",
                                             "label_valid_3600 AS valid_1h", "label_valid_10800 AS valid_3h", "label_valid_21600 AS valid_6h",
                                             "hard_negative_3600 AS hard_1h", "hard_negative_21600 AS hard_6h", "label_fraction_21600 AS fraction_6h")


@query("wn7_risk_spells", "entity:i t:i risk_set:i hazard_label:i spell_index:i spell_step:i hours_since_entry:f", "SELECT *, spell_step*1.0 AS hours_since_entry FROM risk", "risk")
def wn7(spark, root):
    return risk_rows(spark, root)


cte("binrows", "SELECT entity, t//3600*3600 AS t, count(*) AS n FROM rd GROUP BY 1,2", "rd")


@query("wn13_contiguous_history", "entity:i t:i history_ok:i",
       """SELECT entity, t, CASE WHEN row_number() OVER (PARTITION BY entity, g ORDER BY t)>=2 THEN 1 ELSE 0 END AS history_ok FROM (SELECT *, sum(b) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS g
       FROM (SELECT *, CASE WHEN t-lag(t) OVER (PARTITION BY entity ORDER BY t)=3600 THEN 0 ELSE 1 END AS b FROM binrows))""", "binrows")
def wn13(spark, root):
    rows = readings(spark, root).groupBy("entity", F.expr("t DIV 3600 * 3600").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return temporal.contiguous_run(rows, HOUR, 2)


@query("wn13b_scorable_rows", "entity:i t:i split:s",
       """SELECT entity, t, split FROM (SELECT *, CASE WHEN t<lo+15*86400 THEN 'train' ELSE 'test' END AS split, row_number() OVER (PARTITION BY entity ORDER BY t) AS rn FROM risk, bounds) WHERE risk_set=1 AND rn>=4""", "risk bounds")
def wn13b(spark, root):
    lo = grid_bounds(readings(spark, root))["lo"]
    r = temporal.contiguous_run(risk_rows(spark, root), HOUR, 4)
    return r.withColumn("split", F.when(F.col("t") < lo + 15 * DAY, "train").otherwise("test")).filter("risk_set = 1 AND history_ok = 1")


@query("wn14_multistep_targets", "entity:i t:i labels:s mask:s event_step:i",
       """SELECT entity, t, array_to_string(list_transform(range(6), lambda i: CASE WHEN i=es THEN 1 ELSE 0 END), '') AS labels,
       array_to_string(list_transform(range(6), lambda i: CASE WHEN i<n THEN 1 ELSE 0 END), '') AS mask, es AS event_step FROM (
       SELECT entity, t, CASE WHEN ev IS NOT NULL AND ev<coalesce(stop,6) THEN ev ELSE -1 END AS es, CASE WHEN ev IS NOT NULL AND ev<coalesce(stop,6) THEN ev+1 ELSE coalesce(stop,6) END AS n
       FROM (SELECT a.entity, a.t, min(k) FILTER (b.hazard_label=1) AS ev, min(k) FILTER (b.risk_set IS DISTINCT FROM 1) AS stop
       FROM (SELECT entity, t, unnest(range(6)) AS k FROM risk1) a LEFT JOIN risk1 b ON b.entity=a.entity AND b.t=a.t+a.k*3600 GROUP BY 1,2))""", "risk1")
def wn14(spark, root):
    r = risk_rows(spark, root).select("entity", "t", "risk_set", "hazard_label")
    return temporal.multistep_targets(r, "risk_set", "hazard_label", 6, HOUR).withColumns({
        "labels": F.array_join("labels", ""), "mask": F.array_join("mask", "")})


@query("wn15_history_summary", "entity:i t:i event_count_last:i event_count_mean:f event_count_max:i view_count_mean:f view_count_min:i",
       """SELECT entity, t, event_count AS event_count_last, avg(event_count) OVER w AS event_count_mean, max(event_count) OVER w AS event_count_max, avg(view_count) OVER w AS view_count_mean, min(view_count) OVER w AS view_count_min
       FROM panel WINDOW w AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 143 PRECEDING AND CURRENT ROW)""", "panel")
def wn15(spark, root):
    return temporal.history_summary(panel(spark, root), ["event_count", "view_count"], 144)


@query("wn17_time_quality", "entity:i duplicate_adjacent:i out_of_order:i missing_minutes:i first_minute:i last_minute:i",
       """SELECT entity, count(*) FILTER (m=p) AS duplicate_adjacent, count(*) FILTER (m<p) AS out_of_order, coalesce(sum((m-p)//60-1) FILTER (m-p>60),0) AS missing_minutes, min(m) AS first_minute, max(m) AS last_minute
       FROM (SELECT entity, t//60*60 AS m, lag(t//60*60) OVER (PARTITION BY entity ORDER BY (event_id*7919)%10007, event_id) AS p FROM rd) GROUP BY 1""", "rd")
def wn17(spark, root):
    return temporal.time_quality(readings(spark, root), "((event_id * 7919) % 10007) * 1000000000 + event_id", "((event_id * 7919) % 10007) DIV 1000")


@query("wn18_calendar_blocks", "o_orderkey:i block:i",
       "SELECT o_orderkey, lo + ((d-lo)//86400)//7*7*86400 AS block FROM (SELECT o_orderkey, epoch_us(o_orderdate)//1000000 AS d FROM orders), (SELECT epoch_us(date_trunc('year', min(o_orderdate)))//1000000 AS lo FROM orders)")
def wn18(spark, root):
    o = table(spark, root, "orders")
    origin = o.agg(F.unix_timestamp(F.date_trunc("year", F.min("o_orderdate")).cast("timestamp"))).scalar()
    return o.withColumn("t", to_clock("o_orderdate")).withColumn("_o", origin).withColumn("block", temporal.block_start("t", F.col("_o"), 7))


@query("wn19_block_permutation", "entity:i t:i shifted:i",
       """SELECT a.entity, a.t, b.event_count AS shifted FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t)-1 AS rn, count(*) OVER (PARTITION BY entity) AS n FROM panel) a
       JOIN (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t)-1 AS rn FROM panel) b ON b.entity=a.entity AND a.rn=(b.rn+168)%a.n""", "panel")
def wn19(spark, root):
    p = panel(spark, root).withColumn("season", episodes.season_year("t"))
    return temporal.circular_shift(p, "event_count", 168, ("entity", "season"), "shifted")


def entity_terciles(counts, value: str):
    """Rank entities by (value, key) and cut the ranks at the two inner terciles."""
    before = scan.running_totals(counts, value, {"n": F.lit(1)}).select(value, (F.col("n_cum") - F.col("n")).alias("_below"), F.col("n_total").alias("_n"))
    within = scan.running_totals(counts, "entity", {"k": F.lit(1)}, (value,)).select(value, "entity", F.col("k_cum").alias("_in"))
    ranked = within.join(before, value).withColumn("rank", F.col("_below") + F.col("_in"))
    cut = (F.col("_n") - 1) / 3.0
    return ranked.select("entity", value, "rank", F.when(F.col("rank") <= 1 + cut, "low").when(F.col("rank") <= 1 + 2 * cut, "medium").otherwise("high").alias("tercile"))


@query("wn20_event_strata", "event_id:s interval_stratum:s alignment:s tercile:s",
       """SELECT event_id, CASE WHEN onset-po<21600 THEN 'lt_6h' WHEN onset-po<86400 THEN '6_to_24h' WHEN onset-po<259200 THEN '24_to_72h' WHEN onset-po IS NOT NULL THEN 'gt_72h' ELSE 'nan' END AS interval_stratum,
       CASE WHEN onset%600=0 THEN 'aligned' ELSE 'unaligned' END AS alignment, CASE WHEN rk<=1+(n-1)/3.0 THEN 'low' WHEN rk<=1+2*(n-1)/3.0 THEN 'medium' ELSE 'high' END AS tercile
       FROM epv JOIN (SELECT entity, row_number() OVER (ORDER BY c, entity) AS rk, count(*) OVER () AS n FROM (SELECT entity, count(*) AS c FROM epv GROUP BY 1)) USING (entity)""", "epv")
def wn20(spark, root):
    e = episodes.order_valid_events(episode_events(spark, root))
    levels = entity_terciles(e.groupBy("entity").agg(F.count(F.lit(1)).alias("events")), "events")
    gap = F.col("onset_gap_hours")
    return e.join(levels.select("entity", "tercile"), "entity").withColumns({
        "interval_stratum": F.when(gap < 6, "lt_6h").when(gap < 24, "6_to_24h").when(gap < 72, "24_to_72h").when(gap.isNotNull(), "gt_72h").otherwise("nan"),
        "alignment": F.when(F.col("onset") % 600 == 0, "aligned").otherwise("unaligned")})


@query("wn21_source_signal", "entity:i t:i signal:f",
       """SELECT s.entity, s.t, CASE WHEN event_count=0 AND s.eta IS NOT NULL THEN greatest(0,least((s.eta-q1)/greatest(q2-q1,0.1),3)) ELSE 0 END AS signal
       FROM (SELECT *, 4*score-2 AS eta FROM scored) s JOIN (SELECT entity, quantile_cont(4*score-2,0.5) AS q1, quantile_cont(4*score-2,0.95) AS q2 FROM scored, bounds WHERE event_count=0 AND t<lo+15*86400 GROUP BY 1) q USING (entity)""", "scored bounds")
def wn21(spark, root):
    lo = grid_bounds(readings(spark, root))["lo"]
    s = scored(spark, root).withColumn("eta", F.expr("4 * score - 2"))
    fit = (F.col("event_count") == 0) & (F.col("t") < F.col("_lo") + 15 * DAY)
    return temporal.source_signal(s.withColumn("_lo", lo), "eta", fit, (F.col("event_count") == 0) & F.col("eta").isNotNull(), 0.5, 0.95, 3.0)
