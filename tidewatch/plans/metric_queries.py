"""Probability metrics, conditional screens, resampling, sampling and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import scalar, trajectory
from tidewatch.functions.clock import DAY
from tidewatch.operators import audits, bootstrap, episodes, matching, metrics, policies, sampling, scan, temporal
from tidewatch.plans.aggregate_queries import _two_scores
from tidewatch.plans.episode_queries import explode_groups
from tidewatch.plans.matching_queries import HORIZON_S, capped_alarms, method_records, paired, strict
from tidewatch.plans.policy_queries import FIXED, CAP, trajectories
from tidewatch.plans.registry import cte, query
from tidewatch.plans.standins import (HORIZON, HOUR, RISK_RULES, catalog_view, episode_events, grid_bounds, panel, purchase_events, readings,
                                      risk_rows, scored, sensor_timeline)
from tidewatch.session import materialize, table

# --- probability metrics --------------------------------------------------------

_EDGES = "[0.0,1e-6,3e-6,1e-5,3e-5,1e-4,3e-4,1e-3,3e-3,1e-2,3e-2,1e-1,3e-1]"


def _metric_sql(source: str, by: str) -> str:
    """Independent oracle of base and ranking metrics over (by, p, y, w)."""
    g = f"{by}," if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    on = f"USING ({by})" if by else "ON true"
    clean = f"(SELECT *, greatest(least(p,1-1e-12),1e-12) AS q FROM ({source}))"
    return f"""SELECT * FROM (SELECT {g} count(*) AS rows_n, sum(y) AS positives, sum(w) AS weight, sum(w*y)/sum(w) AS prevalence, sum(w*q)/sum(w) AS mean_probability, sum(w*(q-y)*(q-y))/sum(w) AS brier,
 sum(-w*(y*ln(q)+(1-y)*ln(1-q)))/sum(w) AS log_loss, CASE WHEN sum(w*y)>0 AND sum(w*y)<sum(w) THEN 1-(sum(w*(q-y)*(q-y))/sum(w))/((sum(w*y)/sum(w))*(1-sum(w*y)/sum(w))) END AS brier_skill FROM {clean} {group}) a
 JOIN (SELECT {g} sum(abs(sy-sq))/sum(sw) AS ece, max(abs(sy-sq)/sw) AS max_gap, count(*) AS bins FROM (SELECT {g} len(list_filter({_EDGES}, lambda e: e<=q)) AS b, sum(w*y) AS sy, sum(w*q) AS sq, sum(w) AS sw FROM {clean} GROUP BY {g} b) {group}) b {on}
 LEFT JOIN (SELECT {g} CASE WHEN max(tp)>0 AND max(tn)>0 THEN sum(wp*cp/(cp+cn))/max(tp) END AS average_precision, CASE WHEN max(tp)>0 AND max(tn)>0 THEN sum(wn*(cp-wp/2))/(max(tp)*max(tn)) END AS roc_auc FROM (
 SELECT *, sum(wp) OVER ({part} ORDER BY q DESC) AS cp, sum(wn) OVER ({part} ORDER BY q DESC) AS cn, sum(wp) OVER ({part}) AS tp, sum(wn) OVER ({part}) AS tn FROM (SELECT {g} q, sum(w*y)*1.0 AS wp, sum(w*(1-y))*1.0 AS wn FROM {clean} GROUP BY {g} q)) {group}) c {on}"""


@query("mx1_weighted_scores", "rows_n:i positives:i weight:f prevalence:f mean_probability:f log_loss:f brier:f brier_skill:f", _metric_sql("SELECT extra AS p, label AS y, weight AS w FROM two", ""), "two")
def mx1(spark, root):
    return metrics.base_metrics(_two_scores(spark, root), "extra", "label", "weight")


@query("mx2_calibration_error", "ece:f max_gap:f bins:i", _metric_sql("SELECT pow(extra,4) AS p, label AS y, weight AS w FROM two", ""), "two")
def mx2(spark, root):
    return metrics.base_metrics(_two_scores(spark, root).withColumn("p", F.pow("extra", F.lit(4))), "p", "label", "weight")


@query("mx3_average_precision", "average_precision:f", _metric_sql("SELECT extra AS p, label AS y, weight AS w FROM two", ""), "two")
def mx3(spark, root):
    return metrics.ranking_metrics(_two_scores(spark, root), "extra", "label", "weight")


@query("mx4_roc_area", "roc_auc:f", _metric_sql("SELECT extra AS p, label AS y, weight AS w FROM two", ""), "two")
def mx4(spark, root):
    return metrics.ranking_metrics(_two_scores(spark, root), "extra", "label", "weight")


_M_OUT = "rows_n:i positives:i prevalence:f brier:f log_loss:f ece:f max_gap:f average_precision:f roc_auc:f"


@query("mx5_metrics_by_group", "entity:i " + _M_OUT, _metric_sql("SELECT entity, extra AS p, label AS y, weight AS w FROM two", "entity"), "two")
def mx5(spark, root):
    return metrics.probability_metrics(_two_scores(spark, root), "extra", "label", "weight", ("entity",), bounded=True)


STRATA = {"quiet": "past24 = 0", "active": "past24 > 0", "busy": "past24 >= 2", "everything": "1 = 1"}


@query("mx5b_overlapping_strata", "stratum:s " + _M_OUT, _metric_sql(
    """SELECT unnest(list_filter([CASE WHEN past24=0 THEN 'quiet' END, CASE WHEN past24>0 THEN 'active' END, CASE WHEN past24>=2 THEN 'busy' END, 'everything'], lambda x: x IS NOT NULL)) AS stratum,
    score AS p, future AS y, 1.0 AS w FROM scored WHERE score IS NOT NULL""", "stratum"), "scored")
def mx5b(spark, root):
    s = scored(spark, root).filter("score IS NOT NULL").select("score", "future", "past24")
    return metrics.probability_metrics(explode_groups(s, STRATA, "stratum"), "score", "future", None, ("stratum",))


@query("mx5_label_agreement", "source:s rows_n:i positives:i brier:f log_loss:f average_precision:f roc_auc:f", _metric_sql(
    "SELECT source, (n_chars%997)/997.0 AS p, quality AS y, 1.0+toxic AS w FROM documents JOIN labels USING (doc_id)", "source"))
def mx5l(spark, root):
    d = table(spark, root, "documents").select("doc_id", "source", "n_chars").join(table(spark, root, "labels"), "doc_id")
    d = d.selectExpr("source", "(n_chars % 997) / 997.0D AS p", "quality", "1.0D + toxic AS w")
    return metrics.probability_metrics(d, "p", "quality", "w", ("source",))


cte("curve", """SELECT horizon, f AS p, CASE WHEN list_max(y[1:horizon])>0 THEN 1 ELSE 0 END AS yy, weight AS w FROM (SELECT *, unnest([1,3,6]) AS horizon, unnest([1-list_product(list_transform(h[1:1], lambda x: 1-x)), 1-list_product(list_transform(h[1:3], lambda x: 1-x)), 1-list_product(list_transform(h[1:6], lambda x: 1-x))]) AS f FROM traj)
 WHERE list_max(y[1:horizon])>0 OR mask[horizon]>0""", "traj")


@query("mx6_horizon_curve", "horizon:i " + _M_OUT, _metric_sql("SELECT horizon, p, yy AS y, w FROM curve", "horizon"), "curve")
def mx6(spark, root):
    d = trajectories(spark, root).withColumn("f", trajectory.cumulative("h"))
    return metrics.horizon_metrics(d, "f", "y", "mask", "weight", [1, 3, 6])


@query("mx7_brier_change", "entity:i movement_cost:f residual_correction:f brier_delta:f shift_positive:f shift_negative:f mean_absolute_shift:f mechanism:s",
       """SELECT *, CASE WHEN brier_delta<0 THEN 'net_residual_correction' WHEN residual_correction<0 THEN 'directionally_useful_but_movement_cost_dominates' ELSE 'wrong_direction_or_redundant_shift' END AS mechanism FROM (
       SELECT entity, sum(weight*pow(extra-base,2))/sum(weight) AS movement_cost, 2*sum(weight*(extra-base)*(base-label))/sum(weight) AS residual_correction, sum(weight*pow(extra-base,2))/sum(weight)+2*sum(weight*(extra-base)*(base-label))/sum(weight) AS brier_delta,
       sum(weight*(extra-base)) FILTER (label=1)/sum(weight) FILTER (label=1) AS shift_positive, sum(weight*(extra-base)) FILTER (label=0)/sum(weight) FILTER (label=0) AS shift_negative, sum(weight*abs(extra-base))/sum(weight) AS mean_absolute_shift FROM two GROUP BY 1)""", "two")
def mx7(spark, root):
    return metrics.brier_change(_two_scores(spark, root), "base", "extra", "label", "weight", ("entity",))


# --- recurrence features and named conditions ------------------------------------

def feature_frame(spark, root):
    """Risk rows with recurrence covariates joined to the two scores of the same hour."""
    r = risk_rows(spark, root).selectExpr(
        "entity", "t", "gap_hours", "previous_missing", "previous_severity", "previous_duration_hours", "previous_max", "current_event_order",
        "events_past_7d", "events_past_30d", "hard_negative_21600 AS hard_negative", "exposure_e1", "exposure_e2", "exposure_e3", "onset_within_21600 AS label",
        "next_event_index - 1 AS seasonal_prior")
    s = scored(spark, root).filter("score IS NOT NULL").selectExpr("entity", "t", "noise / 997.0D AS base", "score AS extra")
    return r.join(s, ["entity", "t"])


cte("ff", """SELECT r.entity, r.t, CASE WHEN last_end IS NOT NULL THEN (r.t-last_end)/3600.0 END AS gap_hours, CASE WHEN last_end IS NULL THEN 1 ELSE 0 END AS previous_missing,
 ln(1+last_minutes/60.0)*ln(1+last_value) AS previous_severity, last_minutes/60.0 AS previous_duration_hours, last_value AS previous_max, ended_n+1 AS current_event_order, past7 AS events_past_7d, past30 AS events_past_30d,
 risk_set*exposure_recent*lv6*CAST(w6=0 AS INT) AS hard_negative, e1 AS exposure_e1, e2 AS exposure_e2, e3 AS exposure_e3, CAST(w6>0 AS INT) AS label, begun AS seasonal_prior, s.noise/997.0 AS base, s.score AS extra
 FROM risk1 r JOIN scored s ON s.entity=r.entity AND s.t=r.t WHERE s.score IS NOT NULL""", "risk1 scored")


def named_conditions() -> dict[str, str]:
    """Row conditions by name; q50/q90/q99 and the *_q75 limits are fitted columns."""
    gap = {"gap_le_24h": "gap_hours <= 24", "gap_1_to_7d": "gap_hours > 24 AND gap_hours <= 168",
           "gap_7_to_30d": "gap_hours > 168 AND gap_hours <= 720", "gap_gt_30d": "gap_hours > 720"}
    high = {"previous_severity_high": "previous_severity >= severity_q75", "previous_duration_long": "previous_duration_hours >= duration_q75",
            "previous_value_high": "previous_max >= value_q75"}
    band = {"base_low": "base <= q50", "base_middle": "base > q50 AND base <= q90", "base_high": "base > q90 AND base <= q99", "base_extreme": "base > q99"}
    prior = {"season_first": "seasonal_prior = 0", "season_recurrent": "seasonal_prior >= 1", "season_after_one": "seasonal_prior = 1", "season_after_two_plus": "seasonal_prior >= 2"}
    have = "previous_missing = 0"
    out = {"all_rows": "1 = 1", **prior, "previous_available": have, **{n: f"{have} AND {c}" for n, c in gap.items()},
           "load_7d": "events_past_7d > 0", "load_30d": "events_past_30d > 0", **{n: f"{have} AND {c}" for n, c in high.items()},
           "hard_negative": "hard_negative = 1", "cold_humid": "exposure_e1 = 1", "fog_low_visibility": "exposure_e2 = 1", "any_exposure": "exposure_e3 = 1", **band,
           "recurrent_and_base_middle": f"seasonal_prior >= 1 AND {band['base_middle']}", "recurrent_and_base_high": f"seasonal_prior >= 1 AND {band['base_high']}",
           "recent_7d_and_hard_negative": f"{have} AND gap_hours <= 168 AND hard_negative = 1"}
    week = f"{have} AND {gap['gap_1_to_7d']}"
    extra = {**{f"and_{n}": c for n, c in high.items()}, "and_season_second": "seasonal_prior = 1", "and_season_third_plus": "seasonal_prior >= 2",
             "and_cold_humid": "exposure_e1 = 1", "and_fog": "exposure_e2 = 1", "and_base_high": "base > q90"}
    return out | {f"gap_1_7d_{n}": f"{week} AND {c}" for n, c in extra.items()}


def with_fitted_limits(df):
    """Quantile limits of the base score and the previous event, attached as columns (one scalar row)."""
    q = scan.exact_quantiles(df, "base", {"q50": .5, "q90": .9, "q99": .99})
    known = df.filter("previous_missing = 0")
    parts = [q.agg(F.first(F.struct("q50", "q90", "q99"))).scalar()]
    names = (("previous_severity", "severity_q75"), ("previous_duration_hours", "duration_q75"), ("previous_max", "value_q75"))
    limits = [scan.exact_quantiles(known, c, {n: .75}).scalar() for c, n in names]
    out = df.withColumn("_q", parts[0]).withColumns({n: lim for (_, n), lim in zip(names, limits)})
    return out.select(*df.columns, "_q.*", *[n for _, n in names])


_LIMITS = """(SELECT quantile_cont(base,0.5) AS q50, quantile_cont(base,0.9) AS q90, quantile_cont(base,0.99) AS q99 FROM ff), (SELECT quantile_cont(previous_severity,0.75) AS severity_q75,
 quantile_cont(previous_duration_hours,0.75) AS duration_q75, quantile_cont(previous_max::DOUBLE,0.75) AS value_q75 FROM ff WHERE previous_missing=0)"""
cte("cond", f"SELECT *, unnest(list_filter([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{n}{chr(39)} END' for n, c in named_conditions().items())}], lambda x: x IS NOT NULL)) AS condition FROM ff, {_LIMITS}", "ff")


@query("pf23_named_conditions", "condition:s n:i positives:i mean_base:f", "SELECT condition, count(*) AS n, sum(label) AS positives, avg(base) AS mean_base FROM cond GROUP BY 1", "cond")
def pf23(spark, root):
    f = with_fitted_limits(materialize(feature_frame(spark, root), "features"))
    return explode_groups(f, named_conditions(), "condition").groupBy("condition").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.avg("base").alias("mean_base"))


RECURRENCE_TERMS = ("order_2", "order_3plus", "log_gap", "hinge_1", "hinge_2", "hinge_3", "load_7d", "load_30d", "duration_log", "value_log", "severity", "order_2_by_gap", "order_3plus_by_gap")


def recurrence_design(df):
    """Event order, log gap with hinges at its quartiles, loads and order-by-gap interactions."""
    knots = scan.exact_quantiles(df.filter("previous_missing = 0").withColumn("lg", F.log1p("gap_hours")), "lg", {"k1": .25, "k2": .5, "k3": .75})
    out = df.withColumn("_k", knots.agg(F.first(F.struct("k1", "k2", "k3"))).scalar()).selectExpr(
        "*", "CAST(current_event_order = 2 AS INT) AS order_2", "CAST(current_event_order >= 3 AS INT) AS order_3plus",
        "CASE WHEN previous_missing = 1 THEN 0.0D ELSE log1p(greatest(gap_hours, 0)) END AS log_gap",
        "log1p(events_past_7d) AS load_7d", "log1p(events_past_30d) AS load_30d",
        *[f"CASE WHEN previous_missing = 1 THEN 0.0D ELSE {e} END AS {n}" for n, e in (
            ("duration_log", "log1p(previous_duration_hours)"), ("value_log", "log1p(previous_max)"), ("severity", "greatest(previous_severity, 0)"))])
    return out.selectExpr("*", *[f"greatest(log_gap - coalesce(_k.k{i}, 0), 0) AS hinge_{i}" for i in (1, 2, 3)],
                          "order_2 * log_gap AS order_2_by_gap", "order_3plus * log_gap AS order_3plus_by_gap").drop("_k")


cte("design", """SELECT *, greatest(log_gap-k1,0) AS hinge_1, greatest(log_gap-k2,0) AS hinge_2, greatest(log_gap-k3,0) AS hinge_3, order_2*log_gap AS order_2_by_gap, order_3plus*log_gap AS order_3plus_by_gap FROM (SELECT *, CASE WHEN current_event_order=2 THEN 1 ELSE 0 END AS order_2, CASE WHEN current_event_order>=3 THEN 1 ELSE 0 END AS order_3plus,
 CASE WHEN previous_missing=1 THEN 0 ELSE ln(1+gap_hours) END AS log_gap, ln(1+events_past_7d) AS load_7d, ln(1+events_past_30d) AS load_30d, CASE WHEN previous_missing=1 THEN 0 ELSE ln(1+previous_duration_hours) END AS duration_log,
 CASE WHEN previous_missing=1 THEN 0 ELSE ln(1+previous_max) END AS value_log, CASE WHEN previous_missing=1 THEN 0 ELSE greatest(previous_severity,0) END AS severity FROM ff), (SELECT quantile_cont(ln(1+gap_hours),0.25) AS k1, quantile_cont(ln(1+gap_hours),0.5) AS k2, quantile_cont(ln(1+gap_hours),0.75) AS k3 FROM ff WHERE previous_missing=0)""", "ff")


@query("pf24_recurrence_terms", "entity:i t:i " + " ".join(f"{n}:f" for n in RECURRENCE_TERMS), "SELECT * FROM design", "design")
def pf24(spark, root):
    return recurrence_design(materialize(feature_frame(spark, root), "features"))


def seasonal_design(df):
    """Weather, seasonal state, and state interactions as plain columns."""
    return df.selectExpr("*", "CAST(seasonal_prior >= 1 AS INT) AS state", "least(seasonal_prior + 1, 5) AS next_order").selectExpr(
        "*", *[f"state * {c} AS state_by_{c}" for c in ("exposure_e1", "exposure_e2", "events_past_7d")], "state * coalesce(ln(1 + gap_hours), 0) AS state_by_gap")


@query("pf25_seasonal_terms", "entity:i t:i state:i next_order:i state_by_exposure_e1:i state_by_exposure_e2:i state_by_events_past_7d:i state_by_gap:f",
       "SELECT *, s AS state, s*exposure_e1 AS state_by_exposure_e1, s*exposure_e2 AS state_by_exposure_e2, s*events_past_7d AS state_by_events_past_7d, s*coalesce(ln(1+gap_hours),0) AS state_by_gap FROM (SELECT *, CASE WHEN seasonal_prior>=1 THEN 1 ELSE 0 END AS s, least(seasonal_prior+1,5) AS next_order FROM ff)", "ff")
def pf25(spark, root):
    return seasonal_design(feature_frame(spark, root))


_COND_METRIC = _metric_sql("SELECT condition || '#' || m AS cm, CASE m WHEN 'base' THEN base ELSE extra END AS p, label AS y, 1.0 AS w FROM cond, (SELECT unnest(['base','extra']) AS m)", "cm")
_DELTAS = f"""SELECT e.cm[:-7] AS condition, e.rows_n, e.positives, e.rows_n*1.0/(SELECT count(*) FROM ff) AS coverage, e.log_loss-b.log_loss AS delta_log_loss, e.brier-b.brier AS delta_brier, e.ece-b.ece AS delta_ece, e.average_precision-b.average_precision AS delta_average_precision
 FROM cm e JOIN cm b ON b.cm = e.cm[:-7] || '#base' WHERE e.cm LIKE '%#extra' AND e.rows_n>=100"""
cte("cm", _COND_METRIC, "cond")


def _condition_table(spark, root):
    f = with_fitted_limits(materialize(feature_frame(spark, root), "features")).withColumn("w", F.lit(1.0))
    return metrics.condition_metrics(f, named_conditions(), ["base", "extra"], "base", "label", "w").filter("model = 'extra'")


@query("mx8_conditional_metrics", "condition:s rows_n:i positives:i coverage:f delta_log_loss:f delta_brier:f delta_ece:f delta_average_precision:f", _DELTAS, "cm ff")
def mx8(spark, root):
    return _condition_table(spark, root)


@query("mx15_coherent_gain", "condition:s delta_log_loss:f delta_brier:f gain:i",
       f"SELECT *, CASE WHEN delta_log_loss<0 AND delta_brier<0 THEN 1 ELSE 0 END AS gain FROM ({_DELTAS}) WHERE positives>=20 AND coverage BETWEEN 0.005 AND 0.95 ORDER BY round(delta_log_loss,9), condition LIMIT 8", "cm ff")
def mx15(spark, root):
    c = _condition_table(spark, root).withColumn("gain", F.expr("CAST(delta_log_loss < 0 AND delta_brier < 0 AS INT)"))
    return c.filter("positives >= 20 AND coverage BETWEEN 0.005 AND 0.95").orderBy(F.round("delta_log_loss", 9), "condition").limit(8)


_GATES = {"season_recurrent": "seasonal_prior >= 1", "load_7d": "events_past_7d > 0", "any_exposure": "exposure_e3 = 1"}


@query("mx9_blend_gate_search", "candidate:s delta_log_loss:f delta_brier:f delta_average_precision:f eligible:i best:i", f"""SELECT *, CASE WHEN row_number() OVER (ORDER BY eligible DESC, round(delta_log_loss,9), candidate)=1 THEN 1 ELSE 0 END AS best FROM (
       SELECT c.cand AS candidate, c.log_loss-b.log_loss AS delta_log_loss, c.brier-b.brier AS delta_brier, c.average_precision-b.average_precision AS delta_average_precision,
       CASE WHEN c.log_loss<b.log_loss AND c.brier<b.brier AND c.average_precision-b.average_precision>=-1e-4 THEN 1 ELSE 0 END AS eligible FROM ({_metric_sql('''SELECT g || '@' || (CAST(a*100 AS INT)) AS cand, CASE WHEN (g='season_recurrent' AND seasonal_prior>=1) OR (g='load_7d' AND events_past_7d>0) OR (g='any_exposure' AND exposure_e3=1) THEN (1-a)*base+a*extra ELSE base END AS p, label AS y, 1.0 AS w
       FROM ff, (SELECT unnest(['season_recurrent','load_7d','any_exposure']) AS g), (SELECT unnest([0.25,0.5,0.75,1.0])::DOUBLE AS a)''', 'cand')}) c, ({_metric_sql('SELECT base AS p, label AS y, 1.0 AS w FROM ff', '')}) b)""", "ff")
def mx9(spark, root):
    f = materialize(feature_frame(spark, root).select("label", "base", "extra", "seasonal_prior", "events_past_7d", "exposure_e3"), "features")
    arms = F.array(*[F.struct(F.lit(f"{g}@{int(a * 100)}").alias("candidate"), scalar.blend("base", "extra", a, F.expr(c)).alias("p"))
                     for g, c in _GATES.items() for a in (0.25, 0.5, 0.75, 1.0)], F.struct(F.lit("").alias("candidate"), F.col("base").alias("p")))
    long = f.select("label", F.explode(arms).alias("x")).select("label", "x.*")
    m = materialize(metrics.probability_metrics(long, "p", "label", None, ("candidate",)), "gates")
    ref = m.filter("candidate = ''").agg(F.first(F.struct("log_loss", "brier", "average_precision"))).scalar()
    d = m.filter("candidate <> ''").withColumn("_b", ref).selectExpr("candidate", "log_loss - _b.log_loss AS delta_log_loss", "brier - _b.brier AS delta_brier", "average_precision - _b.average_precision AS delta_average_precision")
    d = d.withColumn("eligible", F.expr("CAST(delta_log_loss < 0 AND delta_brier < 0 AND delta_average_precision >= -1e-4 AS INT)"))
    return d.selectExpr("*", "CAST(row_number() OVER (ORDER BY eligible DESC, round(delta_log_loss, 9), candidate) = 1 AS INT) AS best")


_LIN = "1/(1+exp(-(-3.0+0.8*least({a},4)+0.05*{b})))"


@query("mx10_permutation_importance", "feature:s delta_log_loss:f delta_average_precision:f", f"""SELECT c.m AS feature, c.log_loss-b.log_loss AS delta_log_loss, c.average_precision-b.average_precision AS delta_average_precision
       FROM ({_metric_sql(f"SELECT m, CASE m WHEN 'past24' THEN {_LIN.format(a='sa', b='view_count')} ELSE {_LIN.format(a='past24', b='sb')} END AS p, future AS y, 1.0 AS w FROM shifted, (SELECT unnest(['past24','view_count']) AS m)", 'm')}) c,
       ({_metric_sql(f"SELECT {_LIN.format(a='past24', b='view_count')} AS p, future AS y, 1.0 AS w FROM shifted", '')}) b""", "shifted")
def mx10(spark, root):
    s = scored(spark, root).select("entity", "t", "past24", "view_count", "future").withColumn("season", episodes.season_year("t"))
    for c in ("past24", "view_count"):
        s = temporal.circular_shift(s, c, 168, ("entity", "season"), f"{c}_moved")

    def risk(a, b):
        return scalar.logit_risk(F.expr(f"-3.0D + 0.8D * least({a}, 4) + 0.05D * {b}"))

    arms = F.array(*[F.struct(F.lit(n).alias("feature"), risk(a, b).alias("p")) for n, a, b in (
        ("", "past24", "view_count"), ("past24", "past24_moved", "view_count"), ("view_count", "past24", "view_count_moved"))])
    m = materialize(metrics.probability_metrics(s.select("future", F.explode(arms).alias("x")).select("future", "x.*"), "p", "future", None, ("feature",)), "importance")
    ref = m.filter("feature = ''").agg(F.first(F.struct("log_loss", "average_precision"))).scalar()
    return m.filter("feature <> ''").withColumn("_b", ref).selectExpr("feature", "log_loss - _b.log_loss AS delta_log_loss", "average_precision - _b.average_precision AS delta_average_precision")


cte("shifted", """SELECT a.*, b.past24 AS sa, b.view_count AS sb FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t)-1 AS rn, count(*) OVER (PARTITION BY entity) AS n FROM scored) a
 JOIN (SELECT entity, past24, view_count, row_number() OVER (PARTITION BY entity ORDER BY t)-1 AS rn FROM scored) b ON b.entity=a.entity AND a.rn=(b.rn+168)%a.n""", "scored")


@query("mx11_signal_audit", "rows_n:i positive_share:f near_mean:f hard_mean:f near_positive_share:f hard_positive_share:f unseen_max:f",
       """SELECT count(*) AS rows_n, avg(CAST(past24>0 AS INT)) AS positive_share, avg(past24) FILTER (future=1) AS near_mean, avg(past24) FILTER (future=0 AND view_count>0) AS hard_mean, avg(CAST(past24>0 AS INT)) FILTER (future=1) AS near_positive_share,
       avg(CAST(past24>0 AS INT)) FILTER (future=0 AND view_count>0) AS hard_positive_share, coalesce(max(abs(past24)) FILTER (entity%5=0),0) AS unseen_max FROM scored""", "scored")
def mx11(spark, root):
    s = scored(spark, root).selectExpr("*", "CAST(past24 AS DOUBLE) AS signal")
    return metrics.signal_audit(s, "signal", "future = 1", "future = 0 AND view_count > 0", "entity % 5 <> 0")


def _seed_metrics(spark, root):
    long = _two_scores(spark, root).selectExpr("label", "weight", "entity % 5 AS seed", "stack(2, 'base', base, 'extra', extra) AS (model, p)")
    return metrics.base_metrics(long, "p", "label", "weight", ("model", "seed"))


@query("mx12_paired_seeds", "model:s metric:s seeds:i mean_difference:f sd:f low:f high:f improved:i",
       f"""SELECT 'extra' AS model, metric, count(*) AS seeds, avg(d) AS mean_difference, stddev_samp(d) AS sd, avg(d)-2.776445*stddev_samp(d)/sqrt(5) AS low, avg(d)+2.776445*stddev_samp(d)/sqrt(5) AS high, count(*) FILTER (d<0) AS improved FROM (
       SELECT unnest(['brier','log_loss']) AS metric, unnest([e.brier-b.brier, e.log_loss-b.log_loss]) AS d FROM ({_metric_sql("SELECT entity%5 AS seed, extra AS p, label AS y, weight AS w FROM two", "seed")}) e JOIN ({_metric_sql("SELECT entity%5 AS seed, base AS p, label AS y, weight AS w FROM two", "seed")}) b USING (seed)) GROUP BY 1,2""", "two")
def mx12(spark, root):
    return metrics.paired_seed_differences(_seed_metrics(spark, root), "base", {"brier": "lower", "log_loss": "lower"})


cte("gatecmp", """SELECT 'original' AS model_a, 'm' || (entity%4) AS model_b, metric, avg(d) AS estimate, avg(d)-stddev_samp(d) AS low FROM (SELECT entity, unnest(['utility','common_lead']) AS metric, unnest([label*extra, (label+0.2)*extra]) AS d FROM two) GROUP BY 1,2,3""", "two")


@query("mx13_gate_decision", "primary_passed:i placebo_passed:i passed:i", """SELECT p AS primary_passed, q AS placebo_passed, p*q AS passed FROM (SELECT CASE WHEN count(*) FILTER (model_b='m0' AND metric='utility' AND low>0)=1 AND count(*) FILTER (model_b='m0' AND metric='common_lead' AND low>0 AND estimate>=0.1)=1 THEN 1 ELSE 0 END AS p,
       CASE WHEN count(*) FILTER (model_b IN ('m1','m2','m3') AND metric='utility' AND low>0 AND estimate>0)=3 THEN 1 ELSE 0 END AS q FROM gatecmp)""", "gatecmp")
def mx13(spark, root):
    long = _two_scores(spark, root).selectExpr("'original' AS model_a", "concat('m', entity % 4) AS model_b", "stack(2, 'utility', label * extra, 'common_lead', (label + 0.2D) * extra) AS (metric, d)")
    cmp = long.groupBy("model_a", "model_b", "metric").agg(F.avg("d").alias("estimate"), (F.avg("d") - F.stddev_samp("d")).alias("low"))
    return metrics.gate_decision(cmp, "original", "m0", ["m1", "m2", "m3"])


@query("mx14_anchor_reproduction", "model:s observed:f expected:f status:s",
       "SELECT m AS model, avg(v) AS observed, round(avg(v),3)+d AS expected, CASE WHEN abs(avg(v)-round(avg(v),3)-d)<=5e-4 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT unnest(['base','extra']) AS m, unnest([base,extra]) AS v, unnest([0.0,0.01])::DOUBLE AS d FROM two) GROUP BY m, d", "two")
def mx14(spark, root):
    long = _two_scores(spark, root).selectExpr("stack(2, 'base', base, 'extra', extra) AS (model, value)")
    anchors = long.groupBy("model").agg((F.round(F.avg("value"), 3) + F.when(F.col("model") == "extra", 0.01).otherwise(0.0)).alias("expected"))
    return metrics.reproduce_anchors(long, anchors, ["model"])


# --- resampling -------------------------------------------------------------------

#: Replicates of an interval.
R = 5000


def _h(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})),1,15) AS BIGINT)"


def event_sums(records, by: tuple[str, ...] = ()):
    return records.groupBy(*by, "entity").agg(*[F.expr(e) for e in (
        "count_if(evaluable = 1) AS n", "count_if(evaluable = 1 AND hit = 1) AS hits", "coalesce(sum(CASE WHEN evaluable = 1 AND hit = 1 THEN lead_hours END), 0) AS lead")])


_DRAWS = """SELECT r AS replicate, {h} % n + 1 AS rank FROM (SELECT unnest(range({R})) AS r), (SELECT n, unnest(range(n)) AS j FROM (SELECT count(DISTINCT entity) AS n FROM {src}))"""


def _boot_sql(src: str, salt: str, sums: list[str], ratios: dict[str, str]) -> str:
    draws = _DRAWS.format(h=_h(f"'{salt}'", "r", "j"), R=R, src=src)
    total = ", ".join(f"sum({s}) AS {s}" for s in sums)
    long = " UNION ALL ".join(f"SELECT '{m}' AS metric, replicate, CAST({e} AS DOUBLE) AS value FROM t" for m, e in ratios.items())
    pts = " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({e} AS DOUBLE) AS estimate FROM (SELECT {total} FROM {src})" for m, e in ratios.items())
    return f"""SELECT metric, quantile_cont(value,0.025) AS low, quantile_cont(value,0.5) AS middle, quantile_cont(value,0.975) AS high, any_value(estimate) AS estimate,
 least(1.0, 2*least(avg(CAST(value<=0 AS INT)), avg(CAST(value>=0 AS INT)))) AS p_value, count(value) AS replicates FROM (WITH t AS (SELECT replicate, {total} FROM ({draws}) d JOIN (SELECT *, dense_rank() OVER (ORDER BY entity) AS rank FROM {src}) s USING (rank) GROUP BY 1) {long}) JOIN ({pts}) USING (metric) GROUP BY 1"""


cte("esums", "SELECT entity, count(*) FILTER (evaluable=1) AS n, count(*) FILTER (evaluable=1 AND hit=1) AS hits, coalesce(sum(lead_hours) FILTER (evaluable=1 AND hit=1),0) AS lead FROM records GROUP BY 1", "records")
_EV_RATIO = {"hit_rate": "hits*1.0/nullif(n,0)", "mean_lead": "lead/nullif(hits,0)", "utility": "lead/nullif(n,0)"}


@query("bs1_cluster_bootstrap", "metric:s estimate:f low:f middle:f high:f replicates:i", _boot_sql("esums", "bs1", ["n", "hits", "lead"], _EV_RATIO), "esums")
def bs1(spark, root):
    sums = materialize(event_sums(strict(spark, root)[0]), "sums")
    return bootstrap.cluster_bootstrap(sums, ["n", "hits", "lead"], _EV_RATIO, R, "bs1")


cte("pairs", """SELECT a.event_id, a.entity, a.hit AS hit_a, CASE WHEN g.hit IS NULL THEN 0 ELSE 1 END AS hit_b, CASE WHEN a.hit=1 THEN a.lead_hours ELSE 0 END AS lead_a, CASE WHEN g.hit IS NOT NULL THEN (q.onset-greatest(g.start,q.onset-21600))/3600.0 ELSE 0 END AS lead_b
 FROM records a JOIN simpleq q ON q.event_id=a.event_id LEFT JOIN greedy2 g ON g.entity=q.entity AND g.hit=q.onset WHERE a.evaluable=1 AND q.evaluable=1""", "records simpleq greedy2")
cte("psums", """SELECT entity, count(*) AS n, sum(hit_a) AS ha, sum(hit_b) AS hb, sum(lead_a) AS la, sum(lead_b) AS lb, sum(hit_a*hit_b) AS shared, sum(hit_a*hit_b*(lead_a-lead_b)) AS cl FROM pairs GROUP BY 1""", "pairs")


def pair_sums(pairs):
    return pairs.fillna(0.0, ["lead_a", "lead_b"]).groupBy("entity").agg(*[F.expr(e) for e in (
        "count(1) AS n", "sum(hit_a) AS ha", "sum(hit_b) AS hb", "sum(lead_a) AS la", "sum(lead_b) AS lb", "sum(hit_a * hit_b) AS shared", "sum(hit_a * hit_b * (lead_a - lead_b)) AS cl")])


_PAIR = ["n", "ha", "hb", "la", "lb", "shared", "cl"]
_PAIR_RATIO = {"hit_rate": "(ha-hb)*1.0/nullif(n,0)", "mean_lead": "coalesce(la/nullif(ha,0),0)-coalesce(lb/nullif(hb,0),0)", "utility": "(la-lb)/nullif(n,0)"}


@query("bs2_paired_bootstrap", "metric:s estimate:f low:f high:f p_value:f p_holm:f", f"""SELECT *, least(1.0, max((4-rk)*p_value) OVER (ORDER BY rk ROWS UNBOUNDED PRECEDING)) AS p_holm FROM (SELECT *, row_number() OVER (ORDER BY p_value, metric) AS rk FROM ({_boot_sql("psums", "bs2", _PAIR, _PAIR_RATIO)}))""", "psums")
def bs2(spark, root):
    sums = materialize(pair_sums(paired(method_records(spark, root), "strict", "simple")), "sums")
    return bootstrap.holm(bootstrap.cluster_bootstrap(sums, _PAIR, _PAIR_RATIO, R, "bs2"), "p_value")


_PAIR_EVENT = {"delta_hit_rate": "(ha-hb)*1.0/nullif(n,0)", "delta_utility": "(la-lb)/nullif(n,0)", "delta_common_lead": "cl/nullif(shared,0)"}


@query("bs3_paired_event_differences", "metric:s estimate:f low:f high:f replicates:i", _boot_sql("psums", "bs3", _PAIR, _PAIR_EVENT), "psums")
def bs3(spark, root):
    sums = materialize(pair_sums(paired(method_records(spark, root), "strict", "simple")), "sums")
    return bootstrap.cluster_bootstrap(sums, _PAIR, _PAIR_EVENT, R, "bs3")


cte("asums", """SELECT entity, count(DISTINCT strftime(make_timestamp(t*1000000),'%Y-%m')) AS months, count(*) FILTER (alarm=1 AND future=0) AS fa, count(*) FILTER (score>=0.58 AND future=0) AS fb, count(*) FILTER (past24>0 AND future=0) AS hard,
 count(*) FILTER (alarm=1 AND past24>0 AND future=0) AS hha, count(*) FILTER (score>=0.58 AND past24>0 AND future=0) AS hhb FROM alarmed GROUP BY 1""", "alarmed")
_ALARM_RATIO = {"delta_hard_negative_rate": "(hha-hhb)*1.0/nullif(hard,0)", "delta_false_hours": "(fa-fb)*1.0/nullif(months,0)"}


@query("bs4_paired_alarm_ratios", "metric:s estimate:f low:f high:f", _boot_sql("asums", "bs4", ["months", "fa", "fb", "hard", "hha", "hhb"], _ALARM_RATIO), "asums")
def bs4(spark, root):
    sums = materialize(capped_alarms(spark, root).groupBy("entity").agg(*[F.expr(e) for e in (
        "count(DISTINCT date_format(timestamp_seconds(t), 'yyyy-MM')) AS months", "count_if(alarm = 1 AND future = 0) AS fa", "count_if(score >= 0.58 AND future = 0) AS fb",
        "count_if(past24 > 0 AND future = 0) AS hard", "count_if(alarm = 1 AND past24 > 0 AND future = 0) AS hha", "count_if(score >= 0.58 AND past24 > 0 AND future = 0) AS hhb")]), "sums")
    return bootstrap.cluster_bootstrap(sums, ["months", "fa", "fb", "hard", "hha", "hhb"], _ALARM_RATIO, R, "bs4")


cte("lsums", """SELECT entity, sum(weight) AS sw, sum(weight*(-(label*ln(x)+(1-label)*ln(1-x)))) AS la, sum(weight*(-(label*ln(b)+(1-label)*ln(1-b)))) AS lb, sum(weight*pow(x-label,2)) AS ba, sum(weight*pow(b-label,2)) AS bb
 FROM (SELECT *, greatest(least(base,1-1e-12),1e-12) AS b, greatest(least(extra,1-1e-12),1e-12) AS x FROM two) GROUP BY 1""", "two")
_LOSS = ["sw", "la", "lb", "ba", "bb"]
_LOSS_RATIO = {"delta_log_loss": "(la-lb)/sw", "delta_brier": "(ba-bb)/sw"}


def loss_sums(df, by: tuple[str, ...] = ()):
    """Per-entity weighted loss sums of two scores."""
    return df.selectExpr(*by, "entity", "weight", "label", "greatest(least(base, 1 - 1e-12D), 1e-12D) AS b", "greatest(least(extra, 1 - 1e-12D), 1e-12D) AS x").groupBy(*by, "entity").agg(*[F.expr(e) for e in (
        "sum(weight) AS sw", "sum(weight * (-(label * ln(x) + (1 - label) * ln(1 - x)))) AS la", "sum(weight * (-(label * ln(b) + (1 - label) * ln(1 - b)))) AS lb",
        "sum(weight * (x - label) * (x - label)) AS ba", "sum(weight * (b - label) * (b - label)) AS bb")])


@query("bs5_paired_probability_losses", "metric:s estimate:f low:f high:f", _boot_sql("lsums", "bs5", _LOSS, _LOSS_RATIO), "lsums")
def bs5(spark, root):
    return bootstrap.cluster_bootstrap(materialize(loss_sums(_two_scores(spark, root)), "sums"), _LOSS, _LOSS_RATIO, R, "bs5")


def paired_intervals(draws):
    """Interval of the difference of the two scores' values, replicate by replicate."""
    d = draws.groupBy("replicate").pivot("model", ["base", "extra"]).agg(F.first("value")).selectExpr("replicate", "'delta' AS metric", "extra - base AS value")
    return bootstrap.intervals(d)


_DRAWN = f"""SELECT replicate, rank, count(*) AS copies FROM ({_DRAWS.format(h=_h("'{salt}'", "r", "j"), R=R, src="two")}) GROUP BY 1, 2"""


# A ladder per replicate is too much for SQL at 5,000 of them; the operator is held against single draws on a small table.
@query("bs5_paired_average_precision", "low:f middle:f high:f replicates:i")
def bs5ap(spark, root):
    return paired_intervals(bootstrap.average_precision_draws(materialize(_two_scores(spark, root), "scores"), ["base", "extra"], "label", "weight", R, "ap"))


cte("ecedraws", _DRAWN.format(salt="ece"), "two")
cte("ececells", f"""SELECT rank, m, b, sum(w) AS sw, sum(w*y) AS sy, sum(w*p) AS sp FROM (SELECT rank, m, y, w, p, len(list_filter({_EDGES}, lambda e: e<=p)) AS b FROM (SELECT rank, y, w, m, greatest(least(q,1-1e-12),1e-12) AS p FROM (
 SELECT dense_rank() OVER (ORDER BY entity) AS rank, label AS y, weight AS w, unnest(['base','extra']) AS m, unnest([base,extra]) AS q FROM two))) GROUP BY 1,2,3""", "two")


@query("bs5_paired_calibration_error", "low:f middle:f high:f replicates:i", """SELECT quantile_cont(d,0.025) AS low, quantile_cont(d,0.5) AS middle, quantile_cont(d,0.975) AS high, count(*) AS replicates FROM (SELECT replicate, max(e) FILTER (m='extra')-max(e) FILTER (m='base') AS d FROM (
       SELECT replicate, m, sum(abs(sy-sp))/sum(sw) AS e FROM (SELECT replicate, m, b, sum(copies*sw) AS sw, sum(copies*sy) AS sy, sum(copies*sp) AS sp FROM ecedraws JOIN ececells USING (rank) GROUP BY 1,2,3) GROUP BY 1,2) GROUP BY 1)""", "ecedraws ececells")
def bs5ece(spark, root):
    return paired_intervals(bootstrap.calibration_error_draws(materialize(_two_scores(spark, root), "scores"), ["base", "extra"], "label", "weight", R, "ece"))


cte("csums", """SELECT cohort, entity, sum(weight) AS sw, sum(weight*(-(label*ln(x)+(1-label)*ln(1-x)))) AS la, sum(weight*(-(label*ln(b)+(1-label)*ln(1-b)))) AS lb FROM (SELECT *, CASE WHEN entity%5=0 THEN 'unseen' ELSE 'seen' END AS cohort, greatest(least(base,1-1e-12),1e-12) AS b, greatest(least(extra,1-1e-12),1e-12) AS x FROM two) GROUP BY 1,2""", "two")


@query("bs6_paired_loss_by_cohort", "cohort:s estimate:f low:f high:f better:f", f"""SELECT cohort, any_value(e) AS estimate, quantile_cont(v,0.025) AS low, quantile_cont(v,0.975) AS high, avg(CAST(v<0 AS INT)) AS better FROM (SELECT cohort, replicate, (sum(la)-sum(lb))/sum(sw) AS v FROM ({_DRAWS.format(h=_h("'bs6'", "r", "j"), R=R, src="csums")}) d
       JOIN (SELECT *, dense_rank() OVER (ORDER BY entity) AS rank FROM csums) USING (rank) GROUP BY 1,2) JOIN (SELECT cohort, (sum(la)-sum(lb))/sum(sw) AS e FROM csums GROUP BY 1) USING (cohort) GROUP BY 1""", "csums")
def bs6(spark, root):
    sums = materialize(loss_sums(_two_scores(spark, root).withColumn("cohort", F.expr("CASE WHEN entity % 5 = 0 THEN 'unseen' ELSE 'seen' END")), ("cohort",)), "sums")
    draws = bootstrap.ratio_draws(bootstrap.replicate_totals(sums, _LOSS, R, "bs6", by=("cohort",)), {"delta": "(la - lb) / sw"}, ("cohort",))
    better = draws.groupBy("cohort").agg(F.avg((F.col("value") < 0).cast("int")).alias("better"))
    return bootstrap.intervals(draws, ("cohort",)).join(bootstrap.point(sums, _LOSS, {"delta": "(la - lb) / sw"}, ("cohort",)), "cohort").join(better, "cohort")


cte("fsums", """SELECT entity, count(*) FILTER (o=1 AND evaluable=1) AS n1, count(*) FILTER (o=1 AND evaluable=1 AND hit=1) AS h1, count(*) FILTER (o>=2 AND evaluable=1) AS n2, count(*) FILTER (o>=2 AND evaluable=1 AND hit=1) AS h2 FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY onset) AS o FROM records) GROUP BY 1""", "records")


@query("bs7_first_vs_recurrent", "metric:s estimate:f low:f high:f replicates:i", _boot_sql("fsums", "bs7", ["n1", "h1", "n2", "h2"], {"sensitivity_difference": "h2*1.0/nullif(n2,0)-h1*1.0/nullif(n1,0)"}), "fsums")
def bs7(spark, root):
    r = strict(spark, root)[0].selectExpr("*", "row_number() OVER (PARTITION BY entity ORDER BY onset) AS o")
    sums = materialize(r.groupBy("entity").agg(*[F.expr(e) for e in ("count_if(o = 1 AND evaluable = 1) AS n1", "count_if(o = 1 AND evaluable = 1 AND hit = 1) AS h1",
                                                                    "count_if(o >= 2 AND evaluable = 1) AS n2", "count_if(o >= 2 AND evaluable = 1 AND hit = 1) AS h2")]), "sums")
    return bootstrap.cluster_bootstrap(sums, ["n1", "h1", "n2", "h2"], {"sensitivity_difference": "h2*1.0/nullif(n2,0)-h1*1.0/nullif(n1,0)"}, R, "bs7")


@query("bs8_holm_adjustment", "family:i metric:s p:f p_holm:f",
       """SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, max((n-rk+1)*p) OVER (PARTITION BY family ORDER BY rk ROWS UNBOUNDED PRECEDING)) END AS p_holm FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p NULLS LAST) AS rk, count(p) OVER (PARTITION BY family) AS n
       FROM (SELECT entity%7 AS family, event_type AS metric, CASE WHEN count(*)%11<>0 THEN (sum(cents)%1009)/4000.0 END AS p FROM rd GROUP BY 1,2))""", "rd")
def bs8(spark, root):
    p = readings(spark, root).groupBy(F.expr("entity % 7 AS family"), F.col("event_type").alias("metric")).agg(
        F.expr("CASE WHEN count(1) % 11 <> 0 THEN (sum(cents) % 1009) / 4000.0D END AS p"))
    return bootstrap.holm(p, "p", ("family",))


@query("bs9_block_subsample", "entity:i block:i",
       f"SELECT entity, block FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY {_h(chr(39)+'bs9'+chr(39), 'entity', 'block')}, block) AS r, count(*) OVER (PARTITION BY entity) AS n FROM (SELECT DISTINCT entity, t//86400 AS block FROM rd)) WHERE r<=greatest(1,ceil(n*0.5))", "rd")
def bs9(spark, root):
    blocks = readings(spark, root).selectExpr("entity", "t DIV 86400 AS block").distinct()
    return bootstrap.block_subsample(blocks, 0.5, "bs9")


# --- sampling, folds, hold-outs -----------------------------------------------------

cte("strata", "SELECT *, CASE WHEN future=1 THEN 0 WHEN past24>0 THEN 1 ELSE 2 END AS stratum FROM scored", "scored")


def _strata(spark, root):
    return sampling.with_strata(scored(spark, root), "future = 1", "past24 > 0").select("entity", "t", "stratum", "future")


@query("sp1_weighted_sample", "entity:i t:i stratum:i sample_weight:f",
       """SELECT entity, t, stratum, 1/p AS sample_weight FROM (SELECT s.*, CASE stratum WHEN 0 THEN 1.0 WHEN 1 THEN least(1.0,1500.0/n) ELSE least(1.0,2500.0/n) END AS p FROM strata s JOIN (SELECT stratum, count(*) AS n FROM strata GROUP BY 1) USING (stratum))
       WHERE stratum=0 OR CAST('0x' || substr(md5(concat_ws('|',entity,t,'7')),1,8) AS BIGINT)/4294967296.0 < p""", "strata")
def sp1(spark, root):
    return sampling.weighted_sample(_strata(spark, root), {1: 1500, 2: 2500}, ["entity", "t"], 7)


def _quota_sql(goal: str, salt: str, strata: str = "stratum") -> str:
    return f"""SELECT entity, t, stratum, n*1.0/goal AS sample_weight FROM (SELECT *, {goal} AS goal FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_h(f"'{salt}'", 'entity', 't')}) AS rk, count(*) OVER (PARTITION BY stratum) AS n FROM (SELECT entity, t, {strata} AS stratum FROM strata)),
 (SELECT count(*) FILTER (stratum=0) AS n0, count(*) FILTER (stratum=1) AS n1, count(*) FILTER (stratum=2) AS n2 FROM strata)) WHERE rk<=goal"""


@query("sp2_stratified_subsample", "entity:i t:i stratum:i sample_weight:f", _quota_sql("CASE stratum WHEN 0 THEN (CASE WHEN n0<=3000 THEN n0 ELSE 1500 END) WHEN 1 THEN least(n1,(6000-CASE WHEN n0<=3000 THEN n0 ELSE 1500 END)//2) ELSE 6000-(CASE WHEN n0<=3000 THEN n0 ELSE 1500 END)-least(n1,(6000-CASE WHEN n0<=3000 THEN n0 ELSE 1500 END)//2) END", "sp2"), "strata")
def sp2(spark, root):
    return sampling.stratified_subsample(_strata(spark, root), ["entity", "t"], 6000, "sp2")


@query("sp3_uniform_negatives", "entity:i t:i stratum:i sample_weight:f", _quota_sql("CASE stratum WHEN 0 THEN least(n0,6000) ELSE least(n1+n2,6000-least(n0,6000)) END", "sp3", "CASE WHEN stratum=0 THEN 0 ELSE 2 END"), "strata")
def sp3(spark, root):
    return sampling.uniform_negative_subsample(_strata(spark, root), ["entity", "t"], 6000, "sp3")


def _day_blocks(spark, root):
    lo = grid_bounds(readings(spark, root), DAY)["lo"]
    p = panel(spark, root).select("entity", "t", "event_count").withColumn("_lo", lo)
    return p.withColumn("block", F.expr("_lo + (t - _lo) DIV 172800 * 172800")).drop("_lo")


def _folds(spark, root, k=5):
    blocks = _day_blocks(spark, root).groupBy("block").agg(F.count(F.lit(1)).alias("rows_n"), F.sum("event_count").cast("bigint").alias("events"))
    return sampling.balanced_folds(blocks, k)


cte("blk", "SELECT d + (t-d)//172800*172800 AS block, count(*) AS rows_n, sum(event_count)::BIGINT AS events FROM panel, (SELECT lo//86400*86400 AS d FROM bounds) GROUP BY 1", "panel bounds")
cte("blkord", "SELECT *, row_number() OVER (ORDER BY events=0, events DESC, rows_n DESC, block) AS n FROM blk", "blk")
cte("fold", """/*RECURSIVE*/ SELECT 0::BIGINT AS n, 0::BIGINT AS block, [0,0,0,0,0]::BIGINT[] AS ev, [0,0,0,0,0]::BIGINT[] AS ro, [0,0,0,0,0]::BIGINT[] AS bl, 0::BIGINT AS fold UNION ALL
 SELECT n, block, list_transform(ev, lambda x, i: CASE WHEN i=f+1 THEN x+events ELSE x END), list_transform(ro, lambda x, i: CASE WHEN i=f+1 THEN x+rows_n ELSE x END), list_transform(bl, lambda x, i: CASE WHEN i=f+1 THEN x+1 ELSE x END), f FROM (
 SELECT b.n, b.block, b.events, b.rows_n, f.ev, f.ro, f.bl, list_sort(list_transform(range(5), lambda i: CASE WHEN b.events>0 THEN [f.ev[i+1], f.ro[i+1], f.bl[i+1], i] ELSE [f.ro[i+1], f.bl[i+1], f.ev[i+1], i] END))[1][4] AS f FROM fold f JOIN blkord b ON b.n=f.n+1)""", "blkord")


@query("sp4_balanced_folds", "block:i fold:i", "SELECT block, fold FROM fold WHERE n>0", "fold")
def sp4(spark, root):
    return _folds(spark, root)


@query("sp5_fold_mapping", "entity:i t:i block:i fold:i", "SELECT p.entity, p.t, f.block, f.fold FROM panel p, bounds, fold f WHERE f.n>0 AND f.block = lo//86400*86400 + (p.t-lo//86400*86400)//172800*172800", "panel bounds fold")
def sp5(spark, root):
    return sampling.map_folds(_day_blocks(spark, root), _folds(spark, root))


cte("rowfold", "SELECT p.entity, p.t, f.block, f.fold FROM panel p, bounds, fold f WHERE f.n>0 AND f.block = lo//86400*86400 + (p.t-lo//86400*86400)//172800*172800", "panel bounds fold")


@query("sp6_purged_splits", "held:i role:s n:i", """SELECT held, role, count(*) AS n FROM (SELECT r.entity, r.t, h.held, CASE WHEN r.fold=h.held THEN 'validation' WHEN EXISTS (SELECT 1 FROM fold b WHERE b.n>0 AND b.fold=h.held AND r.t>=b.block-108000 AND r.t<b.block+172800+108000) THEN 'purged' ELSE 'train' END AS role
       FROM rowfold r, (SELECT unnest(range(5)) AS held) h) GROUP BY 1,2""", "rowfold fold")
def sp6(spark, root):
    rows = sampling.map_folds(_day_blocks(spark, root), _folds(spark, root))
    return sampling.purged_splits(rows, 5, 172800, 108000).groupBy("held", "role").agg(F.count(F.lit(1)).alias("n"))


@query("sp7_spatial_holdouts", "station:i city:s events:i fold:i", "SELECT station, city, events, fold FROM hold", "hold")
def sp7(spark, root):
    return sampling.spatial_holdouts(_stations_with_events(spark, root), 5)


@query("sp7_region_holdouts", "held:s held_stations:i held_events:i train_stations:i train_events:i", """SELECT city AS held, count(*) AS held_stations, sum(events) AS held_events,
       (SELECT count(*) FROM hold) - count(*) AS train_stations, (SELECT sum(events) FROM hold) - sum(events) AS train_events FROM hold GROUP BY 1""", "hold")
def sp7_regions(spark, root):
    return sampling.leave_one_region_out(_stations_with_events(spark, root))


def _stations_with_events(spark, root):
    e = table(spark, root, "orders").groupBy(F.col("o_custkey").alias("station")).agg(F.count(F.lit(1)).alias("events"))
    s = catalog_view(spark, root).select("station", F.concat(F.lit("R"), F.col("region").cast("string")).alias("city"))
    return s.join(e, "station", "left").fillna(0, ["events"])


cte("hold", """SELECT station, city, events, ((CASE WHEN p//5%2=0 THEN p%5 ELSE 4-p%5 END) + turn - 1)%5 AS fold FROM (
 SELECT station, city, events, row_number() OVER (PARTITION BY city ORDER BY events DESC, station) - 1 AS p FROM
 (SELECT station, 'R' || region AS city, coalesce(c,0) AS events FROM stations LEFT JOIN (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1) ON o_custkey=station)) JOIN
 (SELECT 'R' || region AS city, row_number() OVER (ORDER BY sum(coalesce(c,0)) DESC, 'R' || region) AS turn FROM stations LEFT JOIN (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1) ON o_custkey=station GROUP BY region) USING (city)""", "stations")


# --- audits -------------------------------------------------------------------------

@query("va1_timeline_contract", "entity:i rows_n:i expected_rows:i duplicates:i gaps:i misaligned:i passed:i",
       "SELECT entity, count(*) AS rows_n, max((hi-lo)//3600+1) AS expected_rows, 0 AS duplicates, 0 AS gaps, 0 AS misaligned, 1 AS passed FROM tl, bounds GROUP BY 1", "tl bounds")
def va1(spark, root):
    b = grid_bounds(readings(spark, root))
    return audits.timeline_contract(sensor_timeline(spark, root).select("entity", "t"), HOUR, ((b["hi"] - b["lo"]) / HOUR + 1).cast("bigint"))


cte("faulty_tl", """SELECT entity, CASE WHEN entity%3=0 AND (t//3600)%89=0 THEN t+60 ELSE t END AS t FROM tl, (SELECT unnest([1,2]) AS copy) WHERE NOT (entity%3=0 AND (t//3600)%101=0) AND (copy=1 OR entity%3=0 AND (t//3600)%97=0)""", "tl")


@query("va1_timeline_faults", "entity:i rows_n:i duplicates:i gaps:i misaligned:i other_years:i passed:i",
       """SELECT *, CAST(rows_n=want AND duplicates=0 AND gaps=0 AND misaligned=0 AND other_years=0 AS INT) AS passed FROM (SELECT entity, count(*) AS rows_n, count(*) FILTER (d=0) AS duplicates, count(*) FILTER (d<>0 AND d<>3600) AS gaps, count(*) FILTER (t%3600<>0) AS misaligned,
       count(*) FILTER (year(make_timestamp((t-3600)*1000000)) <> y) AS other_years, any_value(want) AS want FROM (SELECT *, t - lag(t) OVER (PARTITION BY entity ORDER BY t) AS d FROM faulty_tl),
       (SELECT (hi-lo)//3600+1 AS want, year(make_timestamp(lo*1000000)) + CAST(lo%7200=0 AS INT) AS y FROM bounds) GROUP BY 1)""", "faulty_tl bounds")
def va1_faults(spark, root):
    # Planted by fixed arithmetic in every third entity: rows dropped, doubled and shifted by a minute; and a year that is right or wrong with the calendar's start.
    b = grid_bounds(readings(spark, root))
    h = F.floor(F.col("t") / HOUR)
    third = F.col("entity") % 3 == 0
    times = F.when(third & (h % 101 == 0), F.lit(0)).when(third & (h % 97 == 0), F.lit(2)).otherwise(F.lit(1))
    rows = sensor_timeline(spark, root).select("entity", "t", F.explode(F.array_repeat(F.lit(1), times)).alias("_copy"))
    rows = rows.select("entity", F.when(third & (h % 89 == 0), F.col("t") + 60).otherwise(F.col("t")).alias("t"))
    year = F.year(F.timestamp_seconds(b["lo"])) + (b["lo"] % 7200 == 0).cast("int")
    return audits.timeline_contract(rows, HOUR, ((b["hi"] - b["lo"]) / HOUR + 1).cast("bigint"), year)


@query("va2_risk_invariants", "rule:s violations:i", "SELECT unnest(['" + "','".join(audits.RISK_INVARIANTS) + "']) AS rule, 0 AS violations FROM (SELECT count(*) FROM risk1)", "risk1")
def va2(spark, root):
    return audits.violations(risk_rows(spark, root), audits.RISK_INVARIANTS)


@query("va3_reconciliation", "check_name:s observed:i expected:i status:s",
       """SELECT 'timeline_rows' AS check_name, count(*) AS observed, count(*) AS expected, 'PASS' AS status FROM tl UNION ALL SELECT 'raw_rows', count(*), count(*), 'PASS' FROM rd UNION ALL SELECT 'unique_event_ids', count(*), count(*), 'PASS' FROM ep
       UNION ALL SELECT 'targets_are_candidates', 0, 0, 'PASS' UNION ALL SELECT 'eligible_equals_positive', (SELECT count(*) FROM ep JOIN risk1 r ON r.entity=ep.entity AND r.t=ep.reference_issue AND r.risk_set=1 AND r.hazard_label=1 WHERE valid=1), (SELECT sum(hazard_label) FROM risk1),
       CASE WHEN (SELECT count(*) FROM ep JOIN risk1 r ON r.entity=ep.entity AND r.t=ep.reference_issue AND r.risk_set=1 AND r.hazard_label=1 WHERE valid=1)=(SELECT sum(hazard_label) FROM risk1) THEN 'PASS' ELSE 'FAIL' END""", "tl rd ep risk1")
def va3(spark, root):
    from tidewatch.operators import risk as risk_ops

    # Timeline and episodes are read by several checks and by the risk table: each is built once.
    tl = materialize(sensor_timeline(spark, root), "timeline")
    ev = materialize(episode_events(spark, root), "episodes")
    rr = materialize(risk_ops.risk_timeline(tl, ev, RISK_RULES), "risk")
    b = grid_bounds(readings(spark, root))
    one = lambda d: d.scalar()
    n_entities = one(readings(spark, root).agg(F.count_distinct("entity")))
    return audits.reconcile({
        "timeline_rows": (one(tl.agg(F.count(F.lit(1)))), n_entities * ((b["hi"] - b["lo"]) / HOUR + 1)),
        "raw_rows": (one(tl.agg(F.sum("raw_rows"))), one(readings(spark, root).agg(F.count(F.lit(1))))),
        "unique_event_ids": (one(ev.agg(F.count_distinct("event_id"))), one(ev.agg(F.count(F.lit(1))))),
        "targets_are_candidates": (one(ev.agg(F.expr("count_if(valid = 1 AND (candidate_event <> 1 OR cooldown_pass <> 1))"))), F.lit(0)),
        "eligible_equals_positive": (one(risk_ops.event_eligibility(ev, rr).agg(F.sum("eligible"))), one(rr.agg(F.sum("hazard_label")))),
    }, spark).withColumnRenamed("check", "check_name")


@query("va4_key_sets", "part:s rows_n:i duplicates:i shared_keys:i",
       """SELECT fold AS part, count(*) AS rows_n, 0 AS duplicates, 0 AS shared_keys FROM (SELECT CASE WHEN t+21600<=lo+10*86400 THEN 'train' WHEN t>=lo+10*86400 AND t+21600<=lo+20*86400 THEN 'selection' WHEN t>=lo+20*86400 AND t+21600<=lo+28*86400 THEN 'test' ELSE 'embargo' END AS fold FROM panel, bounds) WHERE fold<>'embargo' GROUP BY 1""", "panel bounds")
def va4(spark, root):
    from tidewatch.plans.recurrence import chronological_folds

    lo = grid_bounds(readings(spark, root))["lo"]
    p = chronological_folds(panel(spark, root), lo + 10 * DAY, lo + 20 * DAY, lo + 28 * DAY, HORIZON * HOUR)
    return audits.key_audit({f: p.filter(F.col("fold") == f) for f in ("train", "selection", "test")}, ["entity", "t"])


cte("folds3", """SELECT entity, t, CASE WHEN t+21600<=lo+10*86400 THEN 'train' WHEN t>=lo+10*86400 AND t+21600<=lo+20*86400 THEN 'selection' WHEN t>=lo+20*86400 AND t+21600<=lo+28*86400 THEN 'test' ELSE 'embargo' END AS fold FROM panel, bounds""", "panel bounds")


def _three_folds(spark, root):
    from tidewatch.plans.recurrence import chronological_folds

    lo = grid_bounds(readings(spark, root))["lo"]
    p = materialize(chronological_folds(panel(spark, root), lo + 10 * DAY, lo + 20 * DAY, lo + 28 * DAY, HORIZON * HOUR).select("entity", "t", "fold"), "folds")
    return p, {f: p.filter(F.col("fold") == f) for f in ("train", "selection", "test")}


@query("va4_key_faults", "part:s rows_n:i duplicates:i shared_keys:i",
       """SELECT * FROM (WITH parts AS (SELECT fold AS part, entity, t FROM folds3 WHERE fold<>'embargo' UNION ALL SELECT 'train', entity, t FROM folds3 WHERE fold='selection' AND (t//3600)%37=0 UNION ALL SELECT 'test', entity, t FROM folds3 WHERE fold='test' AND (t//3600)%41=0),
       per AS (SELECT part, entity, t, count(*) AS n FROM parts GROUP BY 1,2,3), seen AS (SELECT *, count(*) OVER (PARTITION BY entity, t) AS k FROM per)
       SELECT part, sum(n) AS rows_n, sum(n-1) AS duplicates, count(*) FILTER (k>1) AS shared_keys FROM seen GROUP BY 1)""", "folds3")
def va4_faults(spark, root):
    # Planted: selection rows that also train, test rows that stand twice.
    _, parts = _three_folds(spark, root)
    h = F.floor(F.col("t") / HOUR)
    parts["train"] = parts["train"].unionByName(parts["selection"].filter(h % 37 == 0))
    parts["test"] = parts["test"].unionByName(parts["test"].filter(h % 41 == 0))
    return audits.key_audit(parts, ["entity", "t"])


@query("va4_fold_coverage", "keys_n:i uncovered:i", "SELECT count(*) AS keys_n, count(*) FILTER (fold='embargo') AS uncovered FROM folds3", "folds3")
def va4_coverage(spark, root):
    p, parts = _three_folds(spark, root)
    return audits.uncovered_keys(p, parts, ["entity", "t"])


@query("va6_prefix_leaks", "prefix_differences:i future_differences:i rows_checked:i",
       """SELECT * FROM (WITH s AS (SELECT entity, t, score, t < lo+20*86400 AS past FROM scored, bounds), m AS (SELECT entity, max(score) AS a, max(score) FILTER (past) AS b, max(CASE WHEN past THEN score ELSE 100.0+coalesce(score,0.0) END) AS c FROM s GROUP BY 1)
       SELECT 2*count(*) FILTER ((score>=0.9*a) IS DISTINCT FROM (score>=0.9*b)) AS prefix_differences, 2*count(*) FILTER ((score>=0.9*a) IS DISTINCT FROM (score>=0.9*c)) AS future_differences, count(*) AS rows_checked FROM s JOIN m USING (entity) WHERE past)""", "scored bounds")
def va6_leaks(spark, root):
    # A rule that looks at an entity's whole future: its peak score.
    s = materialize(scored(spark, root).select("entity", "t", "score"), "scores")
    cut = grid_bounds(readings(spark, root))["lo"] + 20 * DAY
    return audits.prefix_invariance(s, cut, "score", lambda d: d.selectExpr("*", "score >= 0.9D * max(score) OVER (PARTITION BY entity) AS flag"), ["flag"])


@query("va5_label_audit", "rows_n:i stored:i recomputed:i mismatches:i", "SELECT count(*) AS rows_n, sum(future) AS stored, sum(future) AS recomputed, 0 AS mismatches FROM labelled WHERE observed=1", "labelled")
def va5(spark, root):
    from tidewatch.operators.temporal import EventClock, event_clocks
    from tidewatch.plans.recurrence import bin_event_table

    p = panel(spark, root)
    rows = temporal.with_horizon_label(p, "event_count", HORIZON).select("entity", "t", "future", "observed")
    # Onsets in (t, t + H]: seen by t + H inclusive minus seen by t inclusive.
    out = event_clocks(rows, bin_event_table(p), [EventClock("now", F.col("onset"), True), EventClock("later", F.col("onset") - HORIZON * HOUR, True)], slice_seconds=None)
    again = out.filter("observed = 1").selectExpr("future", "CAST(later_n - now_n > 0 AS INT) AS recomputed")
    return again.agg(F.expr("count(1) AS rows_n"), F.expr("sum(future) AS stored"), F.expr("sum(recomputed) AS recomputed"), F.expr("count_if(future <> recomputed) AS mismatches"))


@query("va6_prefix_invariance", "prefix_differences:i future_differences:i rows_checked:i", "SELECT 0 AS prefix_differences, 0 AS future_differences, count(*) AS rows_checked FROM panel, bounds WHERE t < lo+20*86400", "panel bounds")
def va6(spark, root):
    s = materialize(scored(spark, root).select("entity", "t", "score"), "scores")
    cut = grid_bounds(readings(spark, root))["lo"] + 20 * DAY
    return audits.prefix_invariance(s, cut, "score", lambda d: policies.apply_policy(d, "score", FIXED, CAP), ["candidate", "allowance", "alarm"])


@query("va7_queue_contract", "period:s complete:i operational:i events:i status:s",
       "SELECT strftime(make_timestamp(onset*1000000),'%Y-%m') AS period, sum(evaluable) AS complete, sum(operational) AS operational, count(*) AS events, 'PASS' AS status FROM avail GROUP BY 1", "avail")
def va7(spark, root):
    q = matching.window_availability(purchase_events(spark, root), scored(spark, root), HOUR, HORIZON_S).withColumn("period", F.expr("date_format(timestamp_seconds(onset), 'yyyy-MM')"))
    # The agreed counts follow from the calendar: complete unless the panel starts inside the window.
    lo = grid_bounds(readings(spark, root))["lo"]
    p = purchase_events(spark, root).withColumn("_lo", lo).selectExpr("date_format(timestamp_seconds(onset), 'yyyy-MM') AS period", "(onset - 1) DIV 3600 * 3600 AS w", "_lo")
    want = p.groupBy("period").agg(F.expr("count_if(w - 18000 >= _lo) AS want_complete"), F.expr("count_if(w >= _lo) AS want_operational"))
    return audits.queue_contract(q, want)
