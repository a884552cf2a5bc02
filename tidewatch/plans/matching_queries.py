"""Event matching, budget audits and eligibility queries."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from tidewatch.operators import controller, joins, matching, scan
from tidewatch.plans.episode_queries import ORDER_GROUPS, explode_groups
from tidewatch.plans.policy_queries import BUDGETS, RULES, capped_alarms, controller_inputs, controller_result
from tidewatch.plans.registry import cte, query
from tidewatch.plans.standins import HOUR, episode_events, purchase_events, risk_rows, scored
from tidewatch.session import materialize

HORIZON_S = 6 * HOUR

# Alarmed rows, their segments with onset resets, and event windows.
cte("alarmed", """SELECT entity, t, score, observed, future, noise, past24, event_count, used - coalesce(lag(used) OVER (PARTITION BY entity, ms ORDER BY t),0) AS alarm FROM (SELECT *, c+least(0,min(allowance-c) OVER w) AS used
 FROM (SELECT *, sum(candidate) OVER (PARTITION BY entity, ms ORDER BY t ROWS UNBOUNDED PRECEDING) AS c FROM cand) WINDOW w AS (PARTITION BY entity, ms ORDER BY t ROWS UNBOUNDED PRECEDING))""", "cand")
cte("segrows", """SELECT *, sum(b) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING)-1 AS segment FROM (SELECT *, CASE WHEN t-pt<=3600 AND NOT EXISTS (SELECT 1 FROM onsets o WHERE o.entity=a.entity AND o.onset>a.pt AND o.onset<=a.t) THEN 0 ELSE 1 END AS b
 FROM (SELECT *, lag(t) OVER (PARTITION BY entity ORDER BY t) AS pt FROM alarmed WHERE alarm=1) a)""", "alarmed onsets")
cte("segs", "SELECT entity, segment, min(t) AS start, max(t) AS stop, count(*) AS bins FROM segrows GROUP BY 1,2", "segrows")
cte("win", """SELECT entity, onset, event_id, (onset-1)//3600*3600 AS window_end, (onset-1)//3600*3600-18000 AS window_start FROM onsets""", "onsets")
cte("avail", """SELECT w.entity, w.onset, w.event_id, w.window_start, w.window_end, count(s.t) AS available_bins, coalesce(sum(s.observed),0) AS observed_bins, coalesce((w.onset-min(s.t))/3600.0,0) AS available_hours,
 CASE WHEN count(s.t)=6 THEN 1 ELSE 0 END AS evaluable, CASE WHEN count(s.t)>0 THEN 1 ELSE 0 END AS operational
 FROM win w LEFT JOIN scored s ON s.entity=w.entity AND s.t>=w.window_start AND s.t<=w.window_end GROUP BY 1,2,3,4,5""", "win scored")
cte("segcand", """SELECT s.entity, s.segment, s.start, s.stop, list(e.onset ORDER BY e.onset) FILTER (e.onset IS NOT NULL) AS cands FROM segs s LEFT JOIN avail e ON e.entity=s.entity AND e.operational=1 AND e.onset>s.start AND e.onset<=s.stop+21600 GROUP BY 1,2,3,4""", "segs avail")
cte("greedy", """/*RECURSIVE*/ SELECT entity, -1::BIGINT AS segment, -1::BIGINT AS last_hit, CAST(NULL AS BIGINT) AS hit, CAST(NULL AS BIGINT) AS start FROM (SELECT DISTINCT entity FROM segcand) UNION ALL
 SELECT entity, segment, coalesce(h, last_hit), h, start FROM (SELECT s.entity, s.segment, g.last_hit, s.start, list_filter(s.cands, lambda x: x>g.last_hit)[1] AS h FROM greedy g JOIN segcand s ON s.entity=g.entity AND s.segment=g.segment+1)""", "segcand")
cte("hits", "SELECT entity, segment, hit AS onset, start FROM greedy WHERE hit IS NOT NULL", "greedy")
cte("records", """SELECT a.*, h.segment, CASE WHEN h.segment IS NULL THEN 0 ELSE 1 END AS hit, (a.onset-greatest(h.start,a.onset-21600))/3600.0 AS lead_hours, CASE WHEN h.start<a.onset-21600 THEN 1 ELSE 0 END AS carry_in
 FROM avail a LEFT JOIN hits h ON h.entity=a.entity AND h.onset=a.onset""", "avail hits")
cte("classified", """SELECT r.*, tr AS true_alarm, CASE WHEN tr=0 AND observed=1 THEN 1 ELSE 0 END AS false_alarm, CASE WHEN tr=0 AND observed=0 THEN 1 ELSE 0 END AS unsettled_alarm FROM (
 SELECT s.*, CASE WHEN h.onset IS NOT NULL AND s.t>=h.onset-21600 AND s.t<h.onset THEN 1 ELSE 0 END AS tr FROM segrows s LEFT JOIN hits h ON h.entity=s.entity AND h.segment=s.segment) r""", "segrows hits")


def strict(spark, root):
    rows = materialize(capped_alarms(spark, root), "alarms")
    return matching.strict_match(rows, purchase_events(spark, root), "alarm", HOUR, HORIZON_S)


@query("mt1_alarm_segments", "entity:i segment:i start:i stop:i bins:i", "SELECT * FROM segs", "segs")
def mt1(spark, root):
    return matching.segments_of(matching.alarm_rows(capped_alarms(spark, root), "alarm", HOUR, purchase_events(spark, root)))


@query("mt2_pre_event_window", "event_id:i entity:i onset:i window_start:i window_end:i available_bins:i observed_bins:i available_hours:f evaluable:i operational:i", "SELECT * FROM avail", "avail")
def mt2(spark, root):
    return matching.window_availability(purchase_events(spark, root), scored(spark, root), HOUR, HORIZON_S)


@query("mt3_strict_matching", "event_id:i entity:i hit:i lead_hours:f carry_in:i", "SELECT event_id, entity, hit, CASE WHEN hit=1 THEN lead_hours END AS lead_hours, carry_in FROM records", "records")
def mt3(spark, root):
    return strict(spark, root)[0]


@query("mt4_alarm_classes", "entity:i t:i segment:i true_alarm:i false_alarm:i unsettled_alarm:i reserved_alarm:i", "SELECT *, false_alarm+unsettled_alarm AS reserved_alarm FROM classified", "classified")
def mt4(spark, root):
    return strict(spark, root)[1]


_METRICS = """count(*) AS target_events, sum(evaluable) AS events, count(*) FILTER (evaluable=1 AND hit=1) AS hits, count(*) FILTER (evaluable=1 AND hit=1)*1.0/sum(evaluable) AS hit_rate,
 avg(lead_hours) FILTER (evaluable=1 AND hit=1) AS mean_lead, quantile_cont(lead_hours,0.5) FILTER (evaluable=1 AND hit=1) AS median_lead, coalesce(sum(lead_hours) FILTER (evaluable=1 AND hit=1)/sum(evaluable),0) AS utility,
 sum(operational) AS op_events, count(*) FILTER (operational=1 AND hit=1) AS op_hits, avg(lead_hours) FILTER (operational=1 AND hit=1) AS op_mean_lead,
 quantile_cont(lead_hours,0.5) FILTER (operational=1 AND hit=1) AS op_median_lead, coalesce(sum(lead_hours) FILTER (operational=1 AND hit=1)/sum(operational),0) AS op_utility, count(*) FILTER (evaluable=1 AND carry_in=1) AS carry_in_hits"""
_METRIC_OUT = "target_events:i events:i hits:i hit_rate:f mean_lead:f median_lead:f utility:f op_events:i op_hits:i op_mean_lead:f op_median_lead:f op_utility:f carry_in_hits:i"


@query("mt5_queue_metrics", _METRIC_OUT, f"SELECT {_METRICS} FROM records", "records")
def mt5(spark, root):
    return matching.queue_metrics(materialize(strict(spark, root)[0], "records"))


cte("obsseg", """SELECT entity, segment, min(t) AS start, max(t) AS stop FROM (SELECT *, sum(b) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING)-1 AS segment FROM (SELECT *, CASE WHEN t-lag(t) OVER (PARTITION BY entity ORDER BY t)<=3600 THEN 0 ELSE 1 END AS b FROM alarmed WHERE alarm=1 AND observed=1)) GROUP BY 1,2""", "alarmed")
cte("simpleq", "SELECT o.entity, o.onset, o.event_id, CASE WHEN EXISTS (SELECT 1 FROM scored s WHERE s.entity=o.entity AND s.observed=1 AND s.t>=o.onset-21600 AND s.t<o.onset) THEN 1 ELSE 0 END AS evaluable FROM onsets o", "onsets scored")
cte("simplecand", "SELECT s.entity, s.segment, s.start, list(e.onset ORDER BY e.onset) FILTER (e.onset IS NOT NULL) AS cands FROM obsseg s LEFT JOIN simpleq e ON e.entity=s.entity AND e.evaluable=1 AND e.onset>s.start AND e.onset<=s.stop+21600 GROUP BY 1,2,3", "obsseg simpleq")
cte("greedy2", """/*RECURSIVE*/ SELECT entity, -1::BIGINT AS segment, -1::BIGINT AS last_hit, CAST(NULL AS BIGINT) AS hit, CAST(NULL AS BIGINT) AS start FROM (SELECT DISTINCT entity FROM simplecand) UNION ALL
 SELECT entity, segment, coalesce(h, last_hit), h, start FROM (SELECT s.entity, s.segment, g.last_hit, s.start, list_filter(s.cands, lambda x: x>g.last_hit)[1] AS h FROM greedy2 g JOIN simplecand s ON s.entity=g.entity AND s.segment=g.segment+1)""", "simplecand")


@query("mt6_simple_matching", "event_id:i entity:i evaluable:i hit:i lead_hours:f",
       "SELECT q.event_id, q.entity, q.evaluable, CASE WHEN g.hit IS NULL THEN 0 ELSE 1 END AS hit, CASE WHEN g.hit IS NOT NULL THEN (q.onset-greatest(g.start,q.onset-21600))/3600.0 END AS lead_hours FROM simpleq q LEFT JOIN greedy2 g ON g.entity=q.entity AND g.hit=q.onset", "simpleq greedy2")
def mt6(spark, root):
    m = matching.simple_match(capped_alarms(spark, root), purchase_events(spark, root), "alarm", HOUR, HORIZON_S)
    return m.withColumn("lead_hours", F.when(F.col("hit") == 1, F.col("lead_hours")))


cte("finalep", """SELECT w.entity, w.event_id, w.onset, max(CASE WHEN s.t IS NULL THEN 0 ELSE 1 END) AS evaluable, list(s.t ORDER BY s.t) FILTER (s.score>=0.45) AS al FROM onsets w LEFT JOIN scored s ON s.entity=w.entity AND s.t>=w.onset-21600 AND s.t<w.onset GROUP BY 1,2,3""", "onsets scored")


@query("mt7_final_episode_matching", "event_id:i entity:i evaluable:i hit:i lead_hours:f last_lead_hours:f",
       """SELECT event_id, entity, evaluable, CASE WHEN ok THEN 1 ELSE 0 END AS hit, CASE WHEN ok THEN (onset-first_t)/3600.0 END AS lead_hours, CASE WHEN ok THEN (onset-last_t)/3600.0 END AS last_lead_hours FROM (
       SELECT *, coalesce(len(ep)>=1 AND onset-list_max(ep)<=10800, false) AS ok, list_min(ep) AS first_t, list_max(ep) AS last_t FROM (
       SELECT *, list_filter(al, lambda x: x >= coalesce(list_max(list_filter(al, lambda y, i: i>1 AND y-al[i-1]>3600)), -1)) AS ep FROM finalep))""", "finalep")
def mt7(spark, root):
    return matching.final_episode_match(scored(spark, root), purchase_events(spark, root), F.coalesce(F.col("score"), F.lit(0.0)) >= 0.45, HOUR, HORIZON_S, 1, HOUR, 3 * HOUR)


cte("monthly", """SELECT p.entity, p.month, p.observed_rows, coalesce(alarm_bins,0) AS alarm_bins, coalesce(false_bins,0) AS false_bins, coalesce(unsettled_bins,0) AS unsettled_bins FROM
 (SELECT entity, strftime(make_timestamp(t*1000000),'%Y-%m') AS month, count(*) AS observed_rows FROM alarmed GROUP BY 1,2) p LEFT JOIN
 (SELECT entity, strftime(make_timestamp(t*1000000),'%Y-%m') AS month, count(*) AS alarm_bins, sum(false_alarm) AS false_bins, sum(unsettled_alarm) AS unsettled_bins FROM classified GROUP BY 1,2) c USING (entity, month)""", "alarmed classified")


def month_table(spark, root):
    rows = materialize(capped_alarms(spark, root), "alarms")
    _, classified = matching.strict_match(rows, purchase_events(spark, root), "alarm", HOUR, HORIZON_S)
    return matching.month_budget(rows, classified, 20.0, HOUR)


@query("mt8_month_budget", "entity:i month:s observed_rows:i alarm_bins:i false_bins:i unsettled_bins:i reserved_bins:i utilization:f exceeded:i reserved_exceeded:i",
       "SELECT *, false_bins+unsettled_bins AS reserved_bins, alarm_bins/20.0 AS utilization, CAST(false_bins>20 AS INT) AS exceeded, CAST(false_bins+unsettled_bins>20 AS INT) AS reserved_exceeded FROM monthly", "monthly")
def mt8(spark, root):
    return month_table(spark, root)


@query("mt8_budget_summary", "station_months:i exceedance_rate:f mean_false_hours:f p95_false_hours:f max_false_hours:f mean_reserved_utilization:f p95_utilization:f",
       """SELECT count(*) AS station_months, avg(CAST(false_bins>20 AS INT)) AS exceedance_rate, avg(false_bins) AS mean_false_hours, quantile_cont(false_bins,0.95) AS p95_false_hours, max(false_bins) AS max_false_hours,
       avg((false_bins+unsettled_bins)/20.0) AS mean_reserved_utilization, quantile_cont(alarm_bins/20.0,0.95) AS p95_utilization FROM monthly""", "monthly")
def mt8s(spark, root):
    return matching.budget_summary(materialize(month_table(spark, root), "months"))


@query("mt9_monthly_false_hours", "model:s months:i mean_false:f total_false:f max_false:f mean_alarm:f over_share:f",
       """SELECT model, count(*) AS months, avg(f) AS mean_false, sum(f) AS total_false, max(f) AS max_false, avg(a) AS mean_alarm, avg(CAST(f>20 AS INT)) AS over_share FROM (
       SELECT model, entity, strftime(make_timestamp(t*1000000),'%Y-%m') AS month, sum(al) AS a, sum(al*(1-future)) AS f FROM (SELECT entity, t, future, unnest(['a','b']) AS model, unnest([CASE WHEN score>=0.5 THEN 1 ELSE 0 END, CASE WHEN score>=0.55 THEN 1 ELSE 0 END]) AS al FROM scored) GROUP BY 1,2,3) GROUP BY 1""", "scored")
def mt9(spark, root):
    return monthly_false_hours(scored(spark, root), {"a": "coalesce(score >= 0.5, false)", "b": "coalesce(score >= 0.55, false)"}, "future", HOUR, 20.0)


def monthly_false_hours(rows, alarms: dict[str, str], label: str, step: int, budget: float):
    """Alarm and false hours per entity-month for several alarm rules, then their distribution per rule."""
    per = rows.groupBy("entity", F.expr("date_format(timestamp_seconds(t), 'yyyy-MM')").alias("month")).agg(*[x for n, rule in alarms.items() for x in (
        F.expr(f"count_if({rule}) AS a_{n}"), F.expr(f"count_if({rule} AND {label} = 0) AS f_{n}"))])
    hours = step / 3600.0
    long = per.selectExpr("entity", "month", f"stack({len(alarms)}, " + ", ".join(f"'{n}', a_{n} * {hours}D, f_{n} * {hours}D" for n in alarms) + ") AS (model, a, f)")
    return long.groupBy("model").agg(F.count(F.lit(1)).alias("months"), F.avg("f").alias("mean_false"), F.sum("f").alias("total_false"), F.max("f").alias("max_false"),
                                     F.avg("a").alias("mean_alarm"), F.avg((F.col("f") > budget + 1e-9).cast("int")).alias("over_share"))


@query("mt10_entity_alarm_summary", "entity:i months:i alarm_bins:i false_bins:i hard_bins:i hard_hits:i",
       """SELECT entity, count(DISTINCT strftime(make_timestamp(t*1000000),'%Y-%m')) AS months, sum(alarm) AS alarm_bins, count(*) FILTER (alarm=1 AND future=0) AS false_bins, count(*) FILTER (past24>0 AND future=0) AS hard_bins, count(*) FILTER (alarm=1 AND past24>0 AND future=0) AS hard_hits FROM alarmed GROUP BY 1""", "alarmed")
def mt10(spark, root):
    return capped_alarms(spark, root).groupBy("entity").agg(*[F.expr(x) for x in (
        "count(DISTINCT date_format(timestamp_seconds(t), 'yyyy-MM')) AS months", "sum(alarm) AS alarm_bins", "count_if(alarm = 1 AND future = 0) AS false_bins",
        "count_if(past24 > 0 AND future = 0) AS hard_bins", "count_if(alarm = 1 AND past24 > 0 AND future = 0) AS hard_hits")])


@query("mt11_metrics_by_order_group", "event_group:s target_events:i hits:i op_hits:i utility:f op_utility:f",
       f"""SELECT event_group, {_METRICS} FROM (SELECT *, unnest(list_filter([CASE WHEN o=1 THEN 'first' END, CASE WHEN o=2 THEN 'second' END, CASE WHEN o>=3 THEN 'third_plus' END, CASE WHEN o>=2 THEN 'recurrent' END, 'all'], lambda x: x IS NOT NULL)) AS event_group
       FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY onset) AS o FROM records)) GROUP BY 1""", "records")
def mt11(spark, root):
    r = materialize(strict(spark, root)[0], "records").selectExpr("*", "row_number() OVER (PARTITION BY entity ORDER BY onset) AS event_order")
    return matching.queue_metrics(explode_groups(r, ORDER_GROUPS, "event_group"), ("event_group",))


cte("why", """SELECT w.entity, w.event_id, count(*) FILTER (r.risk_set IS NULL) AS missing_bins, count(*) FILTER (r.physical_at_risk=0) AS physical_excluded, count(*) FILTER (r.history_valid=0) AS history_excluded,
 count(*) FILTER (r.step_label_valid=0) AS label_excluded, count(*) FILTER (r.risk_set=1) AS valid_bins FROM (SELECT entity, event_id, (onset-1)//3600*3600-18000 + unnest(range(6))*3600 AS t FROM ep WHERE valid=1) w LEFT JOIN risk1 r ON r.entity=w.entity AND r.t=w.t GROUP BY 1,2""", "ep risk1")


@query("mt12_window_reasons", "event_id:s entity:i missing_bins:i physical_excluded:i history_excluded:i label_excluded:i valid_bins:i primary_reason:s all_reasons:s",
       """SELECT *, CASE WHEN missing_bins>0 THEN 'prediction_grid_missing' WHEN history_excluded>0 THEN 'incomplete_24h_history' WHEN label_excluded>0 THEN 'incomplete_next_step_label' WHEN physical_excluded>0 THEN 'outside_physical_risk_or_cooldown' ELSE '' END AS primary_reason,
       concat_ws(';', CASE WHEN missing_bins>0 THEN 'prediction_grid_missing' END, CASE WHEN history_excluded>0 THEN 'incomplete_24h_history' END, CASE WHEN label_excluded>0 THEN 'incomplete_next_step_label' END, CASE WHEN physical_excluded>0 THEN 'outside_physical_risk_or_cooldown' END) AS all_reasons FROM why""", "why")
def mt12(spark, root):
    return matching.window_reasons(episode_events(spark, root).filter("valid = 1"), risk_rows(spark, root), HOUR, HORIZON_S)


def eligibility_funnel(records, by: list[str]):
    """Events surviving each stage per group."""
    return records.groupBy(*by).agg(*[F.expr(x) for x in (
        "count(1) AS targets", "count_if(operational = 1) AS operational_n", "count_if(evaluable = 1) AS standardized_n",
        "count_if(hit = 1) AS hits", "avg(available_hours) AS mean_available", "count_if(exclusion_reason = 'incomplete_legal_prediction_window') AS incomplete_n")])


@query("mt13_eligibility_funnel", "month:i recurrence:s targets:i operational_n:i standardized_n:i hits:i mean_available:f incomplete_n:i",
       """SELECT month(make_timestamp(onset*1000000)) AS month, CASE WHEN o=1 THEN 'first' ELSE 'recurrent' END AS recurrence, count(*) AS targets, sum(operational) AS operational_n, sum(evaluable) AS standardized_n, sum(hit) AS hits, avg(available_hours) AS mean_available,
       count(*) FILTER (operational=1 AND evaluable=0) AS incomplete_n FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY onset) AS o FROM records) GROUP BY 1,2""", "records")
def mt13(spark, root):
    r = strict(spark, root)[0].selectExpr("*", "month(timestamp_seconds(onset)) AS month", "CASE WHEN row_number() OVER (PARTITION BY entity ORDER BY onset) = 1 THEN 'first' ELSE 'recurrent' END AS recurrence")
    return eligibility_funnel(r, ["month", "recurrence"])


_ORDERED = "SELECT *, row_number() OVER w AS o, (onset - lag(onset) OVER w)/3600.0 AS gap FROM records WINDOW w AS (PARTITION BY entity ORDER BY onset)"


def ordered_records(spark, root):
    w = "OVER (PARTITION BY entity ORDER BY onset)"
    return materialize(strict(spark, root)[0].selectExpr("*", f"row_number() {w} AS o", f"(onset - lag(onset) {w}) / 3600.0D AS gap"), "ordered-records")


@query("mt13_eligibility_bias", "queue:s included:i events:i entities:i recurrent_rate:f mean_order:f median_gap:f mean_gap:f mean_available:f",
       f"""SELECT queue, included, count(*) AS events, count(DISTINCT entity) AS entities, avg(CAST(o>1 AS INT)) AS recurrent_rate, avg(o) AS mean_order, quantile_cont(gap,0.5) AS median_gap, avg(gap) AS mean_gap, avg(available_hours) AS mean_available
       FROM (SELECT *, unnest(['complete','operational']) AS queue, unnest([evaluable, operational]) AS included FROM ({_ORDERED})) GROUP BY 1,2""", "records")
def mt13_bias(spark, root):
    """What the events inside and outside each queue look like."""
    spread = materialize(ordered_records(spark, root).selectExpr("*", "stack(2, 'complete', CAST(evaluable AS INT), 'operational', CAST(operational AS INT)) AS (queue, included)"), "queues")
    sums = spread.groupBy("queue", "included").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("entity").alias("entities"), F.avg((F.col("o") > 1).cast("int")).alias("recurrent_rate"), F.avg("o").alias("mean_order"),
        F.avg("gap").alias("mean_gap"), F.avg("available_hours").alias("mean_available"))
    return sums.join(scan.exact_quantiles(spread, "gap", {"median_gap": 0.5}, ("queue", "included")), ["queue", "included"], "left")


@query("mt13_entity_seasons", "entity:i season:i evaluable:i operational:i events:i",
       """SELECT entity, year(d) - CAST(month(d)<11 AS INT) AS season, evaluable, operational, count(*) AS events FROM (SELECT *, make_timestamp(onset*1000000) AS d FROM records) GROUP BY 1,2,3,4""", "records")
def mt13_seasons(spark, root):
    r = strict(spark, root)[0].withColumn("season", F.expr("year(timestamp_seconds(onset)) - CAST(month(timestamp_seconds(onset)) < 11 AS INT)"))
    return r.groupBy("entity", "season", "evaluable", "operational").agg(F.count(F.lit(1)).alias("events"))


def matching_ctes(name: str, rows: str, needs: str) -> str:
    """Register ``<name>_records``: the strict contract for several alarm columns at once; ``rows`` yields (key, entity, t, alarm, observed)."""
    cte(f"{name}_rows", rows, needs)
    cte(f"{name}_segrows", f"""SELECT *, sum(b) OVER (PARTITION BY key, entity ORDER BY t ROWS UNBOUNDED PRECEDING)-1 AS segment FROM (SELECT *, CASE WHEN t-pt<=3600 AND NOT EXISTS (SELECT 1 FROM onsets o WHERE o.entity=a.entity AND o.onset>a.pt AND o.onset<=a.t) THEN 0 ELSE 1 END AS b
 FROM (SELECT *, lag(t) OVER (PARTITION BY key, entity ORDER BY t) AS pt FROM {name}_rows WHERE alarm=1) a)""", f"{name}_rows onsets")
    cte(f"{name}_avail", f"""SELECT k.key, w.entity, w.onset, w.event_id, CASE WHEN count(r.t)=6 THEN 1 ELSE 0 END AS evaluable, CASE WHEN count(r.t)>0 THEN 1 ELSE 0 END AS operational
 FROM win w CROSS JOIN (SELECT DISTINCT key FROM {name}_rows) k LEFT JOIN {name}_rows r ON r.key=k.key AND r.entity=w.entity AND r.t>=w.window_start AND r.t<=w.window_end GROUP BY 1,2,3,4""", f"win {name}_rows")
    cte(f"{name}_segcand", f"""SELECT s.key, s.entity, s.segment, s.start, list(e.onset ORDER BY e.onset) FILTER (e.onset IS NOT NULL) AS cands FROM (SELECT key, entity, segment, min(t) AS start, max(t) AS stop FROM {name}_segrows GROUP BY 1,2,3) s
 LEFT JOIN {name}_avail e ON e.key=s.key AND e.entity=s.entity AND e.operational=1 AND e.onset>s.start AND e.onset<=s.stop+21600 GROUP BY 1,2,3,4""", f"{name}_segrows {name}_avail")
    cte(f"{name}_greedy", f"""/*RECURSIVE*/ SELECT key, entity, -1::BIGINT AS segment, -1::BIGINT AS last_hit, CAST(NULL AS BIGINT) AS hit, CAST(NULL AS BIGINT) AS start FROM (SELECT DISTINCT key, entity FROM {name}_segcand) UNION ALL
 SELECT key, entity, segment, coalesce(h, last_hit), h, start FROM (SELECT s.key, s.entity, s.segment, g.last_hit, s.start, list_filter(s.cands, lambda x: x>g.last_hit)[1] AS h FROM {name}_greedy g JOIN {name}_segcand s ON s.key=g.key AND s.entity=g.entity AND s.segment=g.segment+1)""", f"{name}_segcand")
    cte(f"{name}_records", f"""SELECT a.*, CASE WHEN h.hit IS NULL THEN 0 ELSE 1 END AS hit, (a.onset-greatest(h.start,a.onset-21600))/3600.0 AS lead_hours
 FROM {name}_avail a LEFT JOIN (SELECT * FROM {name}_greedy WHERE hit IS NOT NULL) h ON h.key=a.key AND h.entity=a.entity AND h.hit=a.onset""", f"{name}_avail {name}_greedy")
    return f"{name}_records"


matching_ctes("cost", "SELECT c.kind || '@' || CAST(c.budget AS INT) AS key, c.entity, c.t, c.alarm, s.observed FROM (SELECT 'coupled' AS kind, * FROM ctl_trace UNION ALL SELECT 'uncoupled', * FROM ctl_uncoupled_trace) c JOIN scored s ON s.entity=c.entity AND s.t=c.t",
              "ctl_trace ctl_uncoupled_trace scored")


@query("mt14_coupling_cost", "budget:f coupled_hits:i uncoupled_hits:i utility_cost:f relative_cost:f hit_cost:f",
       """SELECT budget, ch AS coupled_hits, uh AS uncoupled_hits, ul/un - cl/cn AS utility_cost, CASE WHEN ul<>0 THEN (ul/un - cl/cn)/(ul/un) END AS relative_cost, uh*1.0/un - ch*1.0/cn AS hit_cost FROM (
       SELECT CAST(split_part(key,'@',2) AS DOUBLE) AS budget, sum(hit*operational) FILTER (key LIKE 'coupled%') AS ch, sum(hit*operational) FILTER (key LIKE 'uncoupled%') AS uh, sum(operational) FILTER (key LIKE 'coupled%') AS cn, sum(operational) FILTER (key LIKE 'uncoupled%') AS un,
       coalesce(sum(lead_hours) FILTER (key LIKE 'coupled%' AND hit=1),0) AS cl, coalesce(sum(lead_hours) FILTER (key LIKE 'uncoupled%' AND hit=1),0) AS ul FROM cost_records GROUP BY 1)""", "cost_records")
def mt14(spark, root):
    """What nesting the budgets costs, budget by budget; both controllers run in one pass."""
    events = purchase_events(spark, root)
    inputs = materialize(controller_inputs(spark, root, RULES).select(*controller.INPUTS, "observed"), "inputs")
    rules = {"coupled": RULES, "uncoupled": dataclasses.replace(RULES, couple=False)}
    # All candidates decide on the same rows, so an event's window is looked up once and only alarms are matched.
    alarms = controller.trace_of(controller.run_controllers(inputs, events, BUDGETS, rules, trace="alarms"))
    observed = inputs.select("entity", "t", "observed")
    # The candidate becomes part of the entity's key, so all are matched in the same pass.
    name = F.concat_ws("@", "method", F.col("budget").cast("int").cast("string"))
    rows = materialize(alarms.join(observed, ["entity", "t"]).select(F.concat_ws("#", name, F.col("entity").cast("string")).alias("entity"), "t", "alarm", "observed"), "coupling")
    names = F.explode(F.array(*[F.lit(f"{m}@{int(b)}") for m in rules for b in BUDGETS]))
    queue = matching.window_availability(events.select("entity", "event_id", "onset"), observed, HOUR, HORIZON_S).withColumn("_name", names)
    queue = materialize(queue.withColumns({c: F.concat_ws("#", "_name", F.col(c).cast("string")) for c in ("entity", "event_id")}).drop("_name"), "coupling-events")
    records = matching.strict_match(rows, queue.select("entity", "event_id", "onset"), "alarm", HOUR, HORIZON_S, queue=queue)[0]
    key = F.substring_index("entity", "#", 1)
    tagged = records.withColumns({"method": F.substring_index(key, "@", 1), "budget": F.substring_index(key, "@", -1).cast("double")})
    wide = tagged.groupBy("budget").pivot("method", ["coupled", "uncoupled"]).agg(
        F.sum(F.col("hit") * F.col("operational")).alias("hits"), F.sum("operational").alias("n"),
        F.sum(F.when(F.col("hit") == 1, F.col("lead_hours")).otherwise(0.0)).alias("lead"))
    u, c = "(uncoupled_lead / uncoupled_n)", "(coupled_lead / coupled_n)"
    return wide.selectExpr("budget", "coupled_hits", "uncoupled_hits", f"{u} - {c} AS utility_cost", f"try_divide({u} - {c}, {u}) AS relative_cost",
                           "uncoupled_hits / uncoupled_n - coupled_hits / coupled_n AS hit_cost")


@query("mt15_case_trace", "entity:i t:i budget:f score:f alarm:i occupied:i capacity:i next_onset:f",
       """SELECT c.entity, c.t, c.budget, c.score, c.alarm, c.occupied, c.capacity, o.next_onset FROM ctl_trace c
       JOIN (SELECT entity FROM ctl_trace WHERE alarm=1 GROUP BY 1 ORDER BY count(*) DESC, entity DESC LIMIT 1) z ON z.entity=c.entity
       LEFT JOIN (SELECT entity, onset//3600*3600 AS t, min(onset) AS next_onset FROM onsets GROUP BY 1,2) o ON o.entity=c.entity AND o.t=c.t""", "ctl_trace onsets")
def mt15(spark, root):
    trace = controller.trace_of(controller_result(spark, root))
    busiest = trace.filter("alarm = 1").groupBy("entity").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", F.col("entity").alias("e")))["e"]).scalar()
    case = trace.withColumn("_case", busiest).filter("entity = _case")
    nxt = purchase_events(spark, root).select("entity", "onset", F.floor(F.col("onset") / HOUR).alias("cell"))
    inside = nxt.groupBy("entity", F.expr("cell * 3600").alias("t")).agg(F.min("onset").alias("next_onset"))
    return case.join(inside, ["entity", "t"], "left")


@query("jn12_paired_methods", "event_id:i entity:i hit_a:i hit_b:i lead_a:f lead_b:f",
       """SELECT a.event_id, a.entity, a.hit AS hit_a, CASE WHEN g.hit IS NULL THEN 0 ELSE 1 END AS hit_b, CASE WHEN a.hit=1 THEN a.lead_hours END AS lead_a, CASE WHEN g.hit IS NOT NULL THEN (q.onset-greatest(g.start,q.onset-21600))/3600.0 END AS lead_b
       FROM records a JOIN simpleq q ON q.event_id=a.event_id LEFT JOIN greedy2 g ON g.entity=q.entity AND g.hit=q.onset WHERE a.evaluable=1 AND q.evaluable=1""", "records simpleq greedy2")
def jn12(spark, root):
    return paired(method_records(spark, root), "strict", "simple")


def method_records(spark, root):
    """Event records of two contracts on the same alarms, tagged by method."""
    rows = materialize(capped_alarms(spark, root), "alarms")
    keep = ["event_id", "entity", "onset", "evaluable", "hit", "lead_hours"]
    a, _ = matching.strict_match(rows, purchase_events(spark, root), "alarm", HOUR, HORIZON_S)
    b = matching.simple_match(rows, purchase_events(spark, root), "alarm", HOUR, HORIZON_S)
    both = a.select(*keep, F.lit("strict").alias("method")).unionByName(b.select(*keep, F.lit("simple").alias("method")))
    return both.withColumn("lead_hours", F.when(F.col("hit") == 1, F.col("lead_hours")))


def paired(records, a: str, b: str, queue: str = "evaluable"):
    """Events both methods can be judged on, side by side."""
    def side(name: str, tag: str):
        part = records.filter((F.col("method") == name) & (F.col(queue) == 1))
        return part.select("event_id", "entity", F.col("hit").alias(f"hit_{tag}"), F.col("lead_hours").alias(f"lead_{tag}"))

    return joins.validated_join(side(a, "a"), side(b, "b"), ["event_id", "entity"], "inner", one_to_one=True)
