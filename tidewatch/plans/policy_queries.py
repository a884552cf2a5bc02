"""Alarm policies, selections, trajectories and the reserved-capacity controller."""

from __future__ import annotations



from pyspark.sql import functions as F

from tidewatch.functions import clock, trajectory
from tidewatch.operators import controller, policies, scan, selection
from tidewatch.plans.controller_oracle import controller_cte
from tidewatch.plans.registry import cte, query
from tidewatch.plans.standins import HOUR, purchase_events, scored
from tidewatch.session import materialize

# --- oracle building blocks --------------------------------------------------

cte("srows", """SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t) AS rn, epoch_us(date_trunc('month', make_timestamp(t*1000000)))//1000000 AS ms,
 epoch_us(date_trunc('month', make_timestamp(t*1000000)) + INTERVAL 1 MONTH)//1000000 AS me FROM scored""", "scored")
cte("ema", """/*RECURSIVE*/ SELECT entity, rn, t, score AS level FROM srows WHERE rn=1 UNION ALL
 SELECT s.entity, s.rn, s.t, CASE WHEN s.score IS NULL THEN NULL WHEN e.level IS NULL THEN s.score ELSE 0.4*s.score+(1-0.4)*e.level END
 FROM ema e JOIN srows s ON s.entity=e.entity AND s.rn=e.rn+1""", "srows")
cte("roll", """SELECT *, lag(q) OVER (PARTITION BY entity ORDER BY t) AS threshold FROM (SELECT *,
 CASE WHEN count(score) OVER w >= 24 THEN quantile_cont(score, 0.9) OVER w END AS q FROM srows
 WINDOW w AS (PARTITION BY entity ORDER BY t RANGE BETWEEN 864000 PRECEDING AND CURRENT ROW))""", "srows")
cte("cand", """SELECT *, CASE WHEN score>=0.5 THEN 1 ELSE 0 END AS candidate,
 CAST(least(40, floor(40.0*(t-ms)/(me-ms))+4) AS BIGINT) AS allowance FROM srows""", "srows")
cte("cap", """/*RECURSIVE*/ SELECT entity, rn, t, ms, CAST(CASE WHEN candidate=1 AND allowance>0 THEN 1 ELSE 0 END AS BIGINT) AS used,
 CAST(CASE WHEN candidate=1 AND allowance>0 THEN 1 ELSE 0 END AS BIGINT) AS alarm FROM cand WHERE rn=1 UNION ALL
 SELECT c.entity, c.rn, c.t, c.ms, CASE WHEN c.ms<>r.ms THEN 0 ELSE r.used END + CASE WHEN c.candidate=1 AND CASE WHEN c.ms<>r.ms THEN 0 ELSE r.used END < c.allowance THEN 1 ELSE 0 END,
 CASE WHEN c.candidate=1 AND CASE WHEN c.ms<>r.ms THEN 0 ELSE r.used END < c.allowance THEN 1 ELSE 0 END
 FROM cap r JOIN cand c ON c.entity=r.entity AND c.rn=r.rn+1""", "cand")

CAP = policies.SafeBudget(60, 40.0, 4.0)
FIXED = policies.CandidatePolicy("fixed_threshold", threshold=0.5)


def slim(spark, root):
    """Only what a policy needs, so little travels to the Python workers."""
    return scored(spark, root).select("entity", "t", "score")


def capped_alarms(spark, root):
    """Scored rows with fixed-threshold candidates under the paced monthly cap."""
    return policies.apply_policy(scored(spark, root), "score", FIXED, CAP)


@query("al1_causal_ema", "entity:i t:i smoothed:f", "SELECT entity, t, level AS smoothed FROM ema", "ema")
def al1(spark, root):
    return policies.causal_ema(slim(spark, root), "score", 0.4)


@query("al2_fixed_candidates", "entity:i t:i smoothed:f candidate:i", "SELECT entity, t, level AS smoothed, CASE WHEN level>=0.35 THEN 1 ELSE 0 END AS candidate FROM ema", "ema")
def al2(spark, root):
    return policies.candidates(slim(spark, root), "score", policies.CandidatePolicy("fixed_threshold", threshold=0.35, ema_alpha=0.4))


@query("al2_rolling_candidates", "entity:i t:i threshold:f candidate:i", "SELECT entity, t, threshold, CASE WHEN score>=threshold THEN 1 ELSE 0 END AS candidate FROM roll", "roll")
def al2b(spark, root):
    rule = policies.CandidatePolicy("rolling_quantile", rolling_quantile=0.9, history_seconds=864000, minimum_history_rows=24)
    return policies.candidates(slim(spark, root), "score", rule)


@query("wn16_past_only_quantile", "entity:i t:i threshold:f", "SELECT entity, t, threshold FROM roll", "roll")
def wn16(spark, root):
    return policies.rolling_threshold(slim(spark, root), "score", 0.9, 864000, 24)


_HYST = """/*RECURSIVE*/ SELECT entity, 0::BIGINT AS rn, 0::BIGINT AS t, 0 AS run, 0 AS onn, 0 AS hold, 0 AS alarm FROM (SELECT DISTINCT entity FROM srows) UNION ALL
 SELECT entity, rn, t, CASE WHEN level IS NULL THEN 0 WHEN on1=1 AND level<0.24 AND hold1=0 THEN 0 ELSE run1 END,
 CASE WHEN level IS NULL THEN 0 WHEN on1=1 AND level<0.24 AND hold1=0 THEN 0 ELSE on1 END,
 CASE WHEN level IS NULL THEN 0 WHEN on1=0 THEN hold1 WHEN level>=0.24 THEN greatest(hold1,2) WHEN hold1>0 THEN hold1-1 ELSE 0 END,
 CASE WHEN level IS NULL THEN 0 ELSE on1 END
 FROM (SELECT *, CASE WHEN onn=0 AND run1>=2 THEN 1 ELSE onn END AS on1, CASE WHEN onn=0 AND run1>=2 THEN 2 ELSE hold END AS hold1
 FROM (SELECT s.entity, s.rn, s.t, s.level, h.onn, h.hold, CASE WHEN s.level>=0.3 THEN h.run+1 ELSE 0 END AS run1 FROM hyst h JOIN emat s ON s.entity=h.entity AND s.rn=h.rn+1))"""
cte("emat", "SELECT * FROM ema", "ema")
cte("hyst", _HYST, "emat srows")
HYSTERESIS = policies.CandidatePolicy("hysteresis", threshold=0.3, ema_alpha=0.4, off_ratio=0.8, minimum_run=2, hold_bins=3)


@query("al3_hysteresis", "entity:i t:i candidate:i", "SELECT entity, t, alarm AS candidate FROM hyst WHERE rn>0", "hyst")
def al3(spark, root):
    return policies.candidates(slim(spark, root), "score", HYSTERESIS)


@query("al4_paced_monthly_cap", "entity:i t:i allowance:i candidate:i alarm:i", "SELECT c.entity, c.t, c.allowance, c.candidate, cap.alarm FROM cand c JOIN cap USING (entity, rn)", "cand cap")
def al4(spark, root):
    return capped_alarms(spark, root)


@query("al5_policy_by_entity", "entity:i t:i smoothed:f threshold:f candidate:i allowance:i alarm:i",
       """SELECT entity, t, level AS smoothed, 0.3 AS threshold, candidate, allowance, used - coalesce(lag(used) OVER (PARTITION BY entity, ms ORDER BY t),0) AS alarm FROM (SELECT *,
       c + least(0, min(allowance-c) OVER w) AS used FROM (SELECT c.entity, c.t, c.ms, c.allowance, h.alarm AS candidate, e.level, sum(h.alarm) OVER (PARTITION BY c.entity, c.ms ORDER BY c.t ROWS UNBOUNDED PRECEDING) AS c
       FROM cand c JOIN hyst h USING (entity, rn) JOIN ema e USING (entity, rn)) WINDOW w AS (PARTITION BY entity, ms ORDER BY t ROWS UNBOUNDED PRECEDING))""", "cand hyst ema")
def al5(spark, root):
    return policies.apply_policy(slim(spark, root), "score", HYSTERESIS, CAP)


cte("latchin", "SELECT *, CASE WHEN score>threshold THEN 1 ELSE 0 END AS candidate, CAST(least(30, floor(30.0*(t-ms)/(me-ms))+3) AS BIGINT) AS allowance FROM roll", "roll")
cte("latch", """/*RECURSIVE*/ SELECT entity, 0::BIGINT AS rn, 0::BIGINT AS t, 0::BIGINT AS ms, 0::BIGINT AS used, 0 AS streak, 0 AS latched, 0 AS alarm FROM (SELECT DISTINCT entity FROM srows) UNION ALL
 SELECT entity, rn, t, ms, used + a, streak1, CASE WHEN latched>0 AND used>=allowance THEN 0 WHEN latched>0 THEN latched-1 WHEN a=1 THEN 2 ELSE 0 END, a
 FROM (SELECT *, CASE WHEN latched>0 AND used<allowance THEN 1 WHEN latched>0 THEN 0 WHEN streak1>=2 AND used<allowance THEN 1 ELSE 0 END AS a
 FROM (SELECT s.entity, s.rn, s.t, s.ms, s.allowance, CASE WHEN s.ms<>l.ms THEN 0 ELSE l.used END AS used, CASE WHEN s.ms<>l.ms THEN 0 ELSE l.latched END AS latched,
 CASE WHEN s.candidate=1 THEN CASE WHEN s.ms<>l.ms THEN 0 ELSE l.streak END + 1 ELSE 0 END AS streak1 FROM latch l JOIN latchin s ON s.entity=l.entity AND s.rn=l.rn+1))""", "latchin srows")
LATCHED = policies.LatchedBudget(60, 30.0, 864000, 0.9, 24, 3.0, 2, 3)


@query("al6_latched_budget", "entity:i t:i threshold:f candidate:i alarm:i",
       "SELECT i.entity, i.t, i.threshold, i.candidate, l.alarm FROM latchin i JOIN latch l USING (entity, rn)", "latchin latch")
def al6(spark, root):
    return policies.latched_alarms(slim(spark, root), "score", LATCHED)


cte("shape0", "SELECT e.*, sum(CASE WHEN level IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY rn) AS g FROM ema e", "ema")


def _shape_sql(name: str, v: float) -> str:
    return (f"CASE WHEN level IS NULL THEN 0 ELSE max(f_{name}) OVER (PARTITION BY entity, g, level IS NULL ORDER BY rn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS {name}")


_SHAPES = {"a2": 0.45, "a5": 0.4, "a10": 0.33}
cte("shape", "SELECT entity, t, " + ", ".join(_shape_sql(n, v) for n, v in _SHAPES.items()) + " FROM (SELECT *, " + ", ".join(
    f"CASE WHEN level>={v} AND lag(level) OVER (PARTITION BY entity, g, level IS NULL ORDER BY rn)>={v} THEN 1 ELSE 0 END AS f_{n}" for n, v in _SHAPES.items()) + " FROM shape0)", "shape0")
SHAPE = policies.AlertShape(0.4, 2, 2, 2)


@query("al7_nested_alert_shape", "entity:i t:i a2:i a5:i a10:i", "SELECT * FROM shape", "shape")
def al7(spark, root):
    return policies.nested_alerts(slim(spark, root), "score", _SHAPES, SHAPE)


@query("al8_nesting_audit", "lower:f upper:f low_bins:i high_bins:i violations:i nested:i",
       """SELECT 2 AS lower, 5 AS upper, sum(a2) AS low_bins, sum(a5) AS high_bins, count(*) FILTER (a2=1 AND a5=0) AS violations, CAST(count(*) FILTER (a2=1 AND a5=0)=0 AS INT) AS nested FROM shape
       UNION ALL SELECT 5, 10, sum(a5), sum(a10), count(*) FILTER (a5=1 AND a10=0), CAST(count(*) FILTER (a5=1 AND a10=0)=0 AS INT) FROM shape""", "shape")
def al8(spark, root):
    nested = policies.nested_alerts(slim(spark, root), "score", _SHAPES, SHAPE)
    return policies.nesting_audit(nested, {"a2": 2.0, "a5": 5.0, "a10": 10.0})


@query("al10_capacity_bins", "entity:i hours:f capacity:i", "SELECT entity, sum(cents)%7000/1000.0 AS hours, CAST(floor((sum(cents)%7000/1000.0*60+1e-10)/10) AS BIGINT) AS capacity FROM rd GROUP BY 1", "rd")
def al10(spark, root):
    from tidewatch.plans.standins import readings

    per = readings(spark, root).groupBy("entity").agg((F.sum("cents") % 7000 / 1000.0).alias("hours"))
    return per.withColumn("capacity", F.floor((F.col("hours") * 60 + 1e-10) / 10))


# --- trajectories ------------------------------------------------------------

H = 6


#: Hazards of the next steps, from a row's score and noise.
HAZARD = "array(" + ", ".join(f"score * (({k} * 37 + noise) % 11 + 1) / 60.0D" for k in range(1, H + 1)) + ")"


def trajectories(spark, root):
    """Scored rows with a six-step hazard array, its labels and censor mask."""
    s = scored(spark, root).filter("score IS NOT NULL")

    def steps(expression: str) -> str:
        return "array(" + ", ".join(expression.replace("$k", str(k)) for k in range(1, H + 1)) + ")"

    return s.selectExpr(
        "*", f"{HAZARD} AS h",
        steps(f"CAST(future = 1 AND $k = noise % {H} + 1 AS INT)") + " AS y",
        steps(f"CAST((future = 0 OR $k <= noise % {H} + 1) AND (observed = 1 OR $k < 4) AS INT)") + " AS mask",
        "1.0D + pmod(t DIV 3600, 3) AS weight", "entity * 100000 + pmod(t DIV 3600, 100000) AS row_id")


cte("traj", f"""SELECT *, list_transform(range(1,7), lambda k: score*((k*37+noise)%11+1)/60.0) AS h,
 list_transform(range(1,7), lambda k: CASE WHEN future=1 AND k=noise%{H}+1 THEN 1 ELSE 0 END) AS y,
 list_transform(range(1,7), lambda k: CASE WHEN (future=0 OR k<=noise%{H}+1) AND (observed=1 OR k<4) THEN 1 ELSE 0 END) AS mask,
 1.0+(t//3600)%3 AS weight, entity*100000+(t//3600)%100000 AS row_id FROM scored WHERE score IS NOT NULL""", "scored")
cte("steps", f"""SELECT *, hk*coalesce(prod/(1-hk),0) AS p, 1-prod AS fk FROM (SELECT entity, t, row_id, weight, k, h[k] AS hk, y[k] AS yk, mask[k] AS mk,
 product(1-h[k]) OVER (PARTITION BY entity, t ORDER BY k ROWS UNBOUNDED PRECEDING) AS prod FROM traj, (SELECT unnest(range(1,7)) AS k))""", "traj")


@query("tr1_first_event_probability", "entity:i t:i p1:f p3:f p6:f total:f",
       "SELECT entity, t, max(p) FILTER (k=1) AS p1, max(p) FILTER (k=3) AS p3, max(p) FILTER (k=6) AS p6, sum(p) AS total FROM steps GROUP BY 1,2", "steps")
def tr1(spark, root):
    d = trajectories(spark, root).withColumn("p", trajectory.first_event_probability("h"))
    return d.selectExpr("entity", "t", "p[0] AS p1", "p[2] AS p3", "p[5] AS p6", "aggregate(p, 0.0D, (a, x) -> a + x) AS total")


@query("tr2_cumulative_risk", "entity:i t:i f1:f f3:f f6:f risk3:f risk6:f",
       "SELECT entity, t, max(fk) FILTER (k=1) AS f1, max(fk) FILTER (k=3) AS f3, max(fk) FILTER (k=6) AS f6, max(fk) FILTER (k=3) AS risk3, max(fk) FILTER (k=6) AS risk6 FROM steps GROUP BY 1,2", "steps")
def tr2(spark, root):
    d = trajectories(spark, root).withColumns({"f": trajectory.cumulative("h"), "risk3": trajectory.risk_at("h", 3), "risk6": trajectory.risk_at("h")})
    return d.selectExpr("entity", "t", "f[0] AS f1", "f[2] AS f3", "f[5] AS f6", "risk3", "risk6")


_W = {"linear": "k*1.0", "hit_only": "1.0", "saturating_3h": "least(k*1.0,3.0)",
      "business_piecewise": "CASE WHEN k<0.5 THEN 0.5*k WHEN k<2 THEN 0.25+0.5*(k-0.5)/1.5 WHEN k<4 THEN 0.75+0.25*(k-2)/2.0 ELSE 1.0 END"}


@query("tr3_lead_weights", "kind:s step:i weight:f rows_n:i total:f",
       "SELECT kind, k AS step, w AS weight, count(*) AS rows_n, sum(w) AS total FROM (SELECT noise%6+1 AS k FROM scored) JOIN (" +
       " UNION ALL ".join(f"SELECT '{n}' AS kind, k, {e} AS w FROM (SELECT unnest(range(1,7)) AS k)" for n, e in _W.items()) + ") USING (k) GROUP BY 1,2,3", "scored")
def tr3(spark, root):
    # Every row asks for the weight of its own step under each kind.
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), trajectory.lead_weights(H, 60, k).alias("w")) for k in _W])
    rows = scored(spark, root).select((F.col("noise") % H + 1).cast("int").alias("step"), F.explode(kinds).alias("x"))
    rows = rows.select("x.kind", "step", F.element_at("x.w", F.col("step")).alias("weight"))
    return rows.groupBy("kind", "step", "weight").agg(F.count(F.lit(1)).alias("rows_n"), F.sum("weight").alias("total"))


@query("tr4_trajectory_value", "entity:i t:i linear:f hit_only:f saturating_3h:f business_piecewise:f short_linear:f",
       "SELECT entity, t, " + ", ".join(f"sum(p*({e})) AS {n}" for n, e in _W.items()) + ", sum(p*k) FILTER (k<=4) AS short_linear FROM steps GROUP BY 1,2", "steps")
def tr4(spark, root):
    return trajectories(spark, root).select("entity", "t", *[trajectory.trajectory_value("h", 60, H, k).alias(k) for k in _W],
                                            trajectory.trajectory_value("h", 60, 4).alias("short_linear"))


@query("tr5_hazards_from_eta", "entity:i t:i h1:f h6:f risk:f",
       """SELECT entity, t, max(hk) FILTER (k=1) AS h1, max(hk) FILTER (k=6) AS h6, 1-product(1-hk) AS risk FROM (SELECT entity, t, k,
       least(1-exp(-exp(greatest(least(-0.5+0.9*(4*score-3+k*0.1),15),-30))),1-1e-7) AS hk FROM traj, (SELECT unnest(range(1,7)) AS k)) GROUP BY 1,2""", "traj")
def tr5(spark, root):
    d = trajectories(spark, root).selectExpr("entity", "t", f"transform(sequence(1, {H}), k -> 4 * score - 3 + k * 0.1D) AS eta")
    d = d.withColumn("hz", trajectory.hazards_from_eta("eta", -0.5, 0.9))
    return d.select("entity", "t", F.element_at("hz", 1).alias("h1"), F.element_at("hz", 6).alias("h6"), trajectory.risk_at("hz").alias("risk"))


_TR6 = "rows_n:i missing:i bad_h:i bad_f:i falling:i incoherent:i short:i duplicate_keys:i duplicate_times:i passed:i"
_PLAIN = """SELECT *, list_transform(range(1,7), lambda k: 1-list_product(list_transform(h[1:k], lambda x: 1-x))) AS f FROM traj"""
_FAULTY = f"""SELECT entity, t, h, list_transform(f, lambda x, i: CASE WHEN noise%97=0 AND i=3 THEN 0.0 WHEN noise%89=0 AND score>0 AND i=4 THEN x+0.01 WHEN noise%83=0 AND i=2 THEN 'inf'::DOUBLE ELSE x END) AS f FROM ({_PLAIN})"""


def _tr6_sql(source: str, key: str) -> str:
    bad = ["missing", "bad_h", "bad_f", "falling", "incoherent", "short"]
    return f"""SELECT *, CAST({'+'.join(bad)}+duplicate_keys+duplicate_times=0 AS INT) AS passed FROM (SELECT count(*) AS rows_n, {', '.join(f'count(*) FILTER ({b}) AS {b}' for b in bad)},
       (SELECT coalesce(sum(n-1),0) FROM (SELECT count(*) AS n FROM traj GROUP BY {key})) AS duplicate_keys, 0 AS duplicate_times FROM (
       SELECT len(list_filter(list_concat(h,f), lambda x: isinf(x) OR isnan(x)))>0 AS missing, len(list_filter(h, lambda x: x<0 OR x>1))>0 AS bad_h, len(list_filter(f, lambda x: x<0 OR x>1))>0 AS bad_f,
       len(list_filter(range(2,7), lambda k: f[k]<f[k-1]-1e-9))>0 AS falling,
       len(list_filter(range(1,7), lambda k: abs(f[k]-(1-list_product(list_transform(h[1:k], lambda x: 1-x))))>2e-6))>0 AS incoherent, len(h)<>6 OR len(f)<>6 AS short FROM ({source})))"""


@query("tr6_trajectory_audit", _TR6, _tr6_sql(_FAULTY, "entity%7, t"), "traj")
def tr6(spark, root):
    d = trajectories(spark, root).withColumn("f0", trajectory.cumulative("h"))
    # Faults planted by fixed arithmetic in middle steps: a fall, a curve that disagrees with its hazards, an infinity.
    d = d.selectExpr("entity", "t", "h", "struct(entity % 7 AS e, t AS t) AS key", """transform(f0, (x, i) -> CASE WHEN noise % 97 = 0 AND i = 2 THEN 0.0D
        WHEN noise % 89 = 0 AND score > 0 AND i = 3 THEN x + 0.01D WHEN noise % 83 = 0 AND i = 1 THEN double('Infinity') ELSE x END) AS f""")
    return trajectory.audit(d, "h", "f", "key", "entity", "t", H, 60)


@query("tr6_clean_trajectories", _TR6, _tr6_sql(_PLAIN, "entity, t"), "traj")
def tr6_clean(spark, root):
    d = trajectories(spark, root).withColumns({"f": trajectory.cumulative("h"), "key": F.struct("entity", "t")})
    return trajectory.audit(d, "h", "f", "key", "entity", "t", H, 60, contract=(H, 60))


@query("tr7_censored_labels", "entity:i t:i event3:i known3:i event6:i known6:i",
       "SELECT entity, t, list_max(y[1:3]) AS event3, greatest(list_max(y[1:3]), mask[3]) AS known3, list_max(y) AS event6, greatest(list_max(y), mask[6]) AS known6 FROM traj", "traj")
def tr7(spark, root):
    e3, k3 = trajectory.label_at("y", "mask", 3)
    e6, k6 = trajectory.label_at("y", "mask", 6)
    return trajectories(spark, root).select("entity", "t", e3.alias("event3"), k3.alias("known3"), e6.alias("event6"), k6.alias("known6"))


@query("tr8_hazard_loglik", "entity:i nll:f bin_weight:f",
       """SELECT entity, sum(weight*mk*-(yk*ln(q)+(1-yk)*ln(1-q)))/sum(weight*mk) AS nll, sum(weight*mk) AS bin_weight FROM (SELECT *, greatest(least(hk,1-1e-7),1e-7) AS q FROM steps) GROUP BY 1""", "steps")
def tr8(spark, root):
    return trajectory.nll_components(trajectories(spark, root), "h", "y", "mask", "weight", ["entity"])


# --- selections ---------------------------------------------------------------

cte("negladder", "SELECT score, row_number() OVER (ORDER BY score DESC) AS rk FROM scored WHERE future=0 AND score IS NOT NULL", "scored")


@query("tk1_top_k_neighbours", "target_station:i source_station:i distance_rank:i", "SELECT * FROM knn WHERE distance_rank<=2", "knn")
def tk1(spark, root):
    from tidewatch.operators import joins
    from tidewatch.plans.standins import catalog_view

    return joins.nearest_neighbours(catalog_view(spark, root), "station", 2)


@query("tk2_offline_best_rows", "entity:i t:i top2:i top10:i",
       """SELECT entity, t, CAST(score IS NOT NULL AND rk<=2 AS INT) AS top2, CAST(score IS NOT NULL AND rk<=10 AS INT) AS top10 FROM (SELECT *, row_number() OVER (PARTITION BY entity, ms ORDER BY score DESC NULLS LAST, t) AS rk FROM srows)""", "srows")
def tk2(spark, root):
    return selection.oracle_mask(scored(spark, root), "score", {"top2": 2, "top10": 10})


@query("tk3_budget_threshold", "threshold:f budget_bins:i negatives:i alarms:i false_alarms:i",
       """SELECT th AS threshold, b AS budget_bins, neg AS negatives, (SELECT count(*) FROM scored WHERE score>th) AS alarms, (SELECT count(*) FROM scored WHERE score>th AND future=0) AS false_alarms
       FROM (SELECT (SELECT score FROM negladder WHERE rk=b+1) AS th, b, neg FROM (SELECT CAST(floor(5.0*count(*)) AS BIGINT) AS b, (SELECT count(*) FROM negladder) AS neg FROM (SELECT DISTINCT entity, ms FROM srows)))""", "negladder srows scored")
def tk3(spark, root):
    s = scored(spark, root)
    found = selection.budget_threshold(s, "score", "future", 5.0, 60)
    limit = found.select("threshold").scalar()
    used = s.withColumn("_lim", limit).agg(F.expr("count_if(score > _lim) AS alarms"), F.expr("count_if(score > _lim AND future = 0) AS false_alarms"))
    return found.withColumns({"alarms": used.select("alarms").scalar(), "false_alarms": used.select("false_alarms").scalar()})


def candidate_table(spark, root):
    """Candidate results per budget and threshold quantile, computed from the alarms they raise."""
    grid = F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(q).alias("threshold"))
                               for b in (2.0, 5.0, 10.0) for q in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)])).alias("g")
    s = scored(spark, root).filter("score IS NOT NULL")
    counts = s.groupBy("score", "future", F.pmod("entity", F.lit(3)).alias("strategy")).agg(F.count(F.lit(1)).alias("n"))
    months = s.select("entity", clock.month_key("t").alias("m")).distinct().agg(F.count(F.lit(1))).scalar()
    long = counts.select("*", grid).select("*", "g.*").groupBy("strategy", "budget", "threshold").agg(
        F.expr("coalesce(sum(CASE WHEN score >= threshold AND future = 1 THEN n END), 0) AS hits"),
        F.expr("coalesce(sum(CASE WHEN future = 1 THEN n END), 0) AS positives"),
        F.expr("coalesce(sum(CASE WHEN score >= threshold AND future = 0 THEN n END), 0) AS false_bins"),
        F.expr("coalesce(sum(CASE WHEN score >= threshold THEN n END), 0) AS alarms"))
    return long.withColumn("_m", months).selectExpr("strategy", "budget", "threshold", "alarms", "hits * 1.0D / positives AS hit_rate", "false_bins * 3.0D / _m AS false_hours",
                                                    "hits * threshold / positives AS utility", "CAST(false_bins * 3.0D / _m <= budget * 20 AS INT) AS budget_met")


cte("candtab", """SELECT strategy, budget, threshold, alarms, hits*1.0/positives AS hit_rate, false_bins*3.0/m AS false_hours, hits*threshold/positives AS utility, CASE WHEN false_bins*3.0/m<=budget*20 THEN 1 ELSE 0 END AS budget_met
 FROM (SELECT entity%3 AS strategy, budget, threshold, count(*) FILTER (score>=threshold AND future=1) AS hits, count(*) FILTER (future=1) AS positives, count(*) FILTER (score>=threshold AND future=0) AS false_bins, count(*) FILTER (score>=threshold) AS alarms
 FROM scored, (SELECT unnest([2.0,5.0,10.0])::DOUBLE AS budget), (SELECT unnest([0.3,0.4,0.5,0.6,0.7,0.8])::DOUBLE AS threshold) WHERE score IS NOT NULL GROUP BY 1,2,3), (SELECT count(*) AS m FROM (SELECT DISTINCT entity, ms FROM srows WHERE score IS NOT NULL))""", "scored srows")


@query("tk4_lexicographic_choice", "strategy:i budget:f threshold:f utility:f false_hours:f budget_met:i",
       "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, budget ORDER BY budget_met DESC, round(utility,9) DESC, round(hit_rate,9) DESC, false_hours, threshold) AS r FROM candtab) WHERE r=1", "candtab")
def tk4(spark, root):
    return selection.best_rows(candidate_table(spark, root), ["strategy", "budget"], [
        F.desc(F.round("utility", 9)), F.desc(F.round("hit_rate", 9)), F.asc("false_hours"), F.asc("threshold")], F.col("budget_met") == 1)


@query("tk5_best_within_tie", "strategy:i threshold:f utility:f alarms:i",
       "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY alarms, threshold DESC) AS r FROM (SELECT *, max(utility) OVER (PARTITION BY strategy) AS top FROM candtab WHERE budget=5) WHERE utility>=top-0.03) WHERE r=1", "candtab")
def tk5(spark, root):
    return selection.best_within_tie(candidate_table(spark, root).filter("budget = 5"), ["strategy"], "utility", 0.03, [F.asc("alarms"), F.desc("threshold")])


@query("tk6_matched_comparison", "strategy:i budget:f threshold:f false_hours:f target:f gap:f",
       """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY budget, strategy ORDER BY round(gap,9), threshold) AS r FROM (SELECT c.*, t.target, abs(c.false_hours-t.target) AS gap FROM candtab c JOIN
       (SELECT budget, min(mx) AS target FROM (SELECT budget, strategy, max(false_hours) AS mx FROM candtab WHERE budget_met=1 GROUP BY 1,2) GROUP BY 1) t USING (budget) WHERE budget_met=1)) WHERE r=1""", "candtab")
def tk6(spark, root):
    return selection.matched_comparison(candidate_table(spark, root), ["budget"], "strategy", "false_hours", F.col("budget_met") == 1, [F.asc("threshold")])


@query("tk7_monotone_threshold_path", "budget:f threshold:f",
       """SELECT unnest([2.0,5.0,10.0]) AS budget, unnest(p) AS threshold FROM (SELECT [a.threshold,b.threshold,c.threshold] AS p FROM (SELECT * FROM candtab WHERE strategy=0 AND budget=2 AND budget_met=1) a
       JOIN (SELECT * FROM candtab WHERE strategy=0 AND budget=5 AND budget_met=1) b ON a.threshold>=b.threshold JOIN (SELECT * FROM candtab WHERE strategy=0 AND budget=10 AND budget_met=1) c ON b.threshold>=c.threshold
       ORDER BY round(a.utility+b.utility+c.utility,9) DESC, round(a.hit_rate+b.hit_rate+c.hit_rate,9) DESC, a.threshold DESC, b.threshold DESC, c.threshold DESC LIMIT 1)""", "candtab")
def tk7(spark, root):
    return selection.monotone_path(candidate_table(spark, root).filter("strategy = 0").withColumns({
        "utility": F.round("utility", 9), "hit_rate": F.round("hit_rate", 9)}), [2.0, 5.0, 10.0], ["utility", "hit_rate"])


cte("modeltab", """SELECT m AS model, m+1 AS declared, avg(-(future*ln(q)+(1-future)*ln(1-q))) AS log_loss, avg(pow(q-future,2)) AS brier, corr(q, future) AS average_precision
 FROM (SELECT future, unnest([0,1,2,3]) AS m, greatest(least(unnest([score, 0.8*score, 0.5*score+0.05, 0.3*score+0.02]),1-1e-6),1e-6) AS q FROM scored WHERE score IS NOT NULL) GROUP BY 1""", "scored")


@query("tk8_guarded_model_choice", "model:i log_loss:f average_precision:f",
       "SELECT * FROM modeltab WHERE log_loss <= (SELECT log_loss FROM modeltab WHERE model=1)+0.05 ORDER BY round(average_precision,9) DESC, log_loss, brier, declared LIMIT 1", "modeltab")
def tk8(spark, root):
    s = scored(spark, root).filter("score IS NOT NULL").selectExpr("future", "stack(4, 0, score, 1, 0.8D * score, 2, 0.5D * score + 0.05D, 3, 0.3D * score + 0.02D) AS (model, raw)")
    s = s.selectExpr("future", "model", "greatest(least(raw, 1 - 1e-6D), 1e-6D) AS q")
    models = s.groupBy("model").agg(F.expr("avg(-(future * ln(q) + (1 - future) * ln(1 - q))) AS log_loss"), F.expr("avg((q - future) * (q - future)) AS brier"),
                                    F.round(F.corr("q", F.col("future").cast("double")), 9).alias("average_precision")).withColumn("declared", F.col("model") + 1)
    return selection.guarded_choice(models, 1, 0.05)


@query("tk9_feasible_everywhere", "candidate:i feasible:i mean_utility:f chosen:i",
       """SELECT *, CASE WHEN row_number() OVER (ORDER BY feasible DESC, round(mean_utility,9) DESC, candidate)=1 THEN 1 ELSE 0 END AS chosen FROM (
       SELECT CAST(strategy*10+threshold*10 AS BIGINT) AS candidate, CAST(bool_and(budget_met=1 AND alarms>0) AS INT) AS feasible, avg(utility) FILTER (budget>=5) AS mean_utility FROM candtab GROUP BY 1)""", "candtab")
def tk9(spark, root):
    t = candidate_table(spark, root).withColumns({"candidate": F.round(F.col("strategy") * 10 + F.col("threshold") * 10).cast("bigint"), "utility": F.round("utility", 9)})
    return selection.feasible_everywhere(t, ["budget_met = 1", "alarms > 0"], F.col("budget") >= 5, "utility").withColumn("feasible", F.col("feasible").cast("int"))


@query("tk10_competition_rank", "entity:i n:i place:i", "SELECT entity, n, rank() OVER (ORDER BY n DESC) AS place FROM (SELECT entity, count(*) AS n FROM rd GROUP BY 1)", "rd")
def tk10(spark, root):
    from tidewatch.operators import scan
    from tidewatch.plans.standins import readings

    per = readings(spark, root).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    places = scan.running_totals(per, "n", {"k": F.lit(1)}, descending=True).select("n", (F.col("k_cum") - F.col("k") + 1).alias("place"))
    return per.join(places, "n")


# --- controller ----------------------------------------------------------------

RULES = controller.ControllerRules(step_minutes=60, horizon_steps=H, score_threshold=0.6)
BUDGETS = (5.0, 10.0, 20.0)


def _oracle(name: str, rules: controller.ControllerRules, budgets: tuple[float, ...] = BUDGETS, given: dict[int, str] | None = None) -> str:
    controller_cte(name, rules, budgets, trajectory.lead_values(rules.horizon_steps, rules.step_minutes, "linear" if rules.utility == "risk" else rules.utility), given)
    return name


_oracle("ctl", RULES)
_MONTHS = "entity, month, budget, capacity, actions, confirmed, unsettled, released, locked, peak_pending, peak_occupied, rejected_capacity, hard_budget_met"
_TOTALS = "SELECT budget, sum(actions) AS actions, sum(confirmed) AS confirmed, sum(released) AS released, sum(unsettled) AS unsettled, max(peak_occupied) AS peak, min(hard_budget_met) AS hard_budget_met FROM {}_months GROUP BY 1"


def controller_inputs(spark, root, rules=RULES):
    return controller.with_decision_inputs(trajectories(spark, root), "h", rules)


def controller_result(spark, root, rules=RULES, budgets=BUDGETS):
    """One pass over the panel; written once because trace and audit are read separately."""
    rows = controller_inputs(spark, root, rules)
    return materialize(controller.run_controller(rows, purchase_events(spark, root), budgets, rules), "controller")


@query("al9_reserved_capacity_trace", "entity:i t:i budget:f score:f bar:f desired:i alarm:i confirmed:i pending:i occupied:i capacity:i",
       "SELECT * FROM ctl_trace", "ctl_trace")
def al9(spark, root):
    return controller.trace_of(controller.run_controller(controller_inputs(spark, root), purchase_events(spark, root), BUDGETS, RULES))


@query("al9_reserved_capacity_months", "entity:i month:s budget:f capacity:i actions:i confirmed:i unsettled:i released:i locked:i peak_pending:i peak_occupied:i rejected_capacity:i hard_budget_met:i",
       f"SELECT {_MONTHS} FROM ctl_months", "ctl_months")
def al9m(spark, root):
    return controller.months_of(controller.run_controller(controller_inputs(spark, root), purchase_events(spark, root), BUDGETS, RULES, trace="none"))


@query("al9_budget_invariants", "over_capacity:i nesting_violations:i months:i unmet:i",
       "SELECT 0 AS over_capacity, 0 AS nesting_violations, (SELECT count(*)*3 FROM (SELECT DISTINCT entity, ms FROM srows WHERE score IS NOT NULL)) AS months, 0 AS unmet", "srows")
def al9i(spark, root):
    result = controller_result(spark, root)
    trace, months = controller.trace_of(result), controller.months_of(result)
    wide = controller.alarms_wide(trace, BUDGETS)
    audit = policies.nesting_audit(wide, {"alarm_5h": 5.0, "alarm_10h": 10.0, "alarm_20h": 20.0}).agg(F.sum("violations")).scalar()
    over = trace.agg(F.expr("count_if(occupied > capacity)")).scalar()
    return months.agg(F.count(F.lit(1)).alias("months"), F.expr("count_if(hard_budget_met = 0) AS unmet")).withColumns({"over_capacity": over, "nesting_violations": audit})


def _variant(name: str):
    def run(spark, root):
        rules = controller.variants(RULES)[name]
        result = controller.run_controller(controller_inputs(spark, root, rules), purchase_events(spark, root), BUDGETS, rules, trace="none")
        return controller.months_of(result).groupBy("budget").agg(
            F.sum("actions").alias("actions"), F.sum("confirmed").alias("confirmed"), F.sum("released").alias("released"),
            F.sum("unsettled").alias("unsettled"), F.max("peak_occupied").alias("peak"), F.min("hard_budget_met").alias("hard_budget_met"))

    return run


for _name in controller.variants(RULES):
    if _name != "dynamic":
        _cte = _oracle(f"ctl_{_name}", controller.variants(RULES)[_name])
        query(f"al11_variant_{_name}", "budget:f actions:i confirmed:i released:i unsettled:i peak:i hard_budget_met:i", _TOTALS.format(_cte), f"{_cte}_months")(_variant(_name))


_oracle("ctl_guarded", RULES, (5.0, 20.0), {0: "score >= 0.6", 1: "score >= 0.5"})


@query("al11_guarded_candidates", "budget:f actions:i confirmed:i unsettled:i hard_budget_met:i", "SELECT budget, sum(actions) AS actions, sum(confirmed) AS confirmed, sum(unsettled) AS unsettled, min(hard_budget_met) AS hard_budget_met FROM ctl_guarded_months GROUP BY 1", "ctl_guarded_months")
def al11_guard(spark, root):
    rows = controller_inputs(spark, root).withColumns({"c5": (F.col("score") >= 0.6).cast("int"), "c20": (F.col("score") >= 0.5).cast("int")})
    result = controller.run_controller(rows, purchase_events(spark, root), (5.0, 20.0), RULES, given={5.0: "c5", 20.0: "c20"}, trace="none")
    return controller.months_of(result).groupBy("budget").agg(F.sum("actions").alias("actions"), F.sum("confirmed").alias("confirmed"),
                                                              F.sum("unsettled").alias("unsettled"), F.min("hard_budget_met").alias("hard_budget_met"))


def policy_grid(df, score: str, quantiles: list[float], budget: policies.SafeBudget):
    """Every distinct score-quantile threshold as a candidate, all in one pass.

    The thresholds are one exact-quantile row that travels as a scalar array; the
    candidate becomes part of the entity key of the capped policy.
    """
    from tidewatch.operators import scan

    found = scan.exact_quantiles(df.filter(F.col(score).isNotNull()), score, {f"q{i}": q for i, q in enumerate(quantiles)})
    grid = found.select(F.array_distinct(F.array(*[F.round(f"q{i}", 9) for i in range(len(quantiles))]))).scalar()
    keyed = df.withColumn("threshold", F.explode(grid)).select(
        F.struct("entity", "threshold").alias("entity"), "t",
        F.coalesce(F.col(score) >= F.col("threshold"), F.lit(False)).cast("bigint").alias("candidate"))
    return policies.paced_cap(keyed, "candidate", budget)


@query("al12_policy_grid", "threshold:f alarms:i candidates:i",
       """SELECT threshold, sum(alarm) AS alarms, sum(candidate) AS candidates FROM (SELECT *, used-coalesce(lag(used) OVER (PARTITION BY threshold, entity, ms ORDER BY t),0) AS alarm FROM (SELECT *, c+least(0,min(allowance-c) OVER w) AS used
       FROM (SELECT *, sum(candidate) OVER (PARTITION BY threshold, entity, ms ORDER BY t ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT s.*, q.threshold, CASE WHEN s.score>=q.threshold THEN 1 ELSE 0 END AS candidate FROM cand s,
       (SELECT DISTINCT round(unnest(quantile_cont(score,[0.8,0.9,0.95,0.95])),9) AS threshold FROM scored) q)) WINDOW w AS (PARTITION BY threshold, entity, ms ORDER BY t ROWS UNBOUNDED PRECEDING))) GROUP BY 1""".replace("s.*,", "s.entity, s.t, s.ms, s.allowance,"), "cand scored")
def al12(spark, root):
    capped = policy_grid(scored(spark, root), "score", [0.8, 0.9, 0.95, 0.95], CAP)
    return capped.groupBy(F.col("entity.threshold").alias("threshold")).agg(F.sum("alarm").alias("alarms"), F.sum("candidate").alias("candidates"))


#: What the crossed grid varies beside the threshold.
GRID_QUANTILES, GRID_RUNS, GRID_HOLDS, GRID_CAPS = (0.8, 0.9, 0.95, 0.95), (1, 2), (1, 3), (20.0, 40.0)
cte("gridrules", f"SELECT threshold, run, hold FROM (SELECT DISTINCT round(unnest(quantile_cont(score,{list(GRID_QUANTILES)})),9) AS threshold FROM scored), (SELECT unnest({list(GRID_RUNS)}) AS run), (SELECT unnest({list(GRID_HOLDS)}) AS hold)", "scored")
cte("gridrows", "SELECT entity, t, ms, me, score, row_number() OVER (PARTITION BY entity ORDER BY t) AS rn FROM cand", "cand")
cte("gridstates", """/*RECURSIVE*/ SELECT g.threshold, g.run, g.hold, e.entity, 0::BIGINT AS rn, 0::BIGINT AS t, 0 AS streak, 0 AS lit, 0 AS weak, 0 AS candidate FROM gridrules g, (SELECT DISTINCT entity FROM gridrows) e UNION ALL
 SELECT threshold, run, hold, entity, rn, t, CASE WHEN score IS NULL OR (lit1=1 AND weak1>=hold) THEN 0 ELSE streak1 END, CASE WHEN score IS NULL OR weak1>=hold THEN 0 ELSE lit1 END, CASE WHEN lit1=0 THEN 0 ELSE weak1 END, CASE WHEN score IS NULL THEN 0 ELSE lit1 END
 FROM (SELECT *, CASE WHEN lit1=0 THEN 0 WHEN score>=0.8*threshold THEN 0 ELSE weak+1 END AS weak1 FROM (SELECT *, CASE WHEN lit=1 OR streak1>=run THEN 1 ELSE 0 END AS lit1 FROM (
 SELECT h.threshold, h.run, h.hold, r.entity, r.rn, r.t, r.score, h.lit, h.weak, CASE WHEN r.score>=h.threshold THEN h.streak+1 ELSE 0 END AS streak1 FROM gridstates h JOIN gridrows r ON r.entity=h.entity AND r.rn=h.rn+1)))""", "gridrules gridrows")


def crossed_grid(df, score: str, quantiles=GRID_QUANTILES, runs=GRID_RUNS, holds=GRID_HOLDS) -> dict[str, policies.CandidatePolicy]:
    """Whole policies: distinct score-quantile thresholds x minimum runs x holds, those with equal settings once."""
    found = scan.exact_quantiles(df.filter(F.col(score).isNotNull()), score, {f"q{i}": q for i, q in enumerate(quantiles)}).first()
    thresholds = sorted({round(found[f"q{i}"], 9) for i in range(len(quantiles))})
    settings = {policies.CandidatePolicy("hysteresis", threshold=x, minimum_run=r, hold_bins=h) for x in thresholds for r in runs for h in holds}
    return {f"{p.threshold!r}/{p.minimum_run}/{p.hold_bins}": p for p in sorted(settings, key=lambda p: (p.threshold, p.minimum_run, p.hold_bins))}


@query("al12_crossed_grid", "threshold:f run:i hold:i hours:f candidates:i alarms:i",
       f"""SELECT threshold, run, hold, hours, sum(candidate) AS candidates, sum(alarm) AS alarms FROM (SELECT *, used-coalesce(lag(used) OVER (PARTITION BY threshold, run, hold, hours, entity, ms ORDER BY t),0) AS alarm FROM (SELECT *, c+least(0,min(allowance-c) OVER w) AS used
       FROM (SELECT *, sum(candidate) OVER (PARTITION BY threshold, run, hold, hours, entity, ms ORDER BY t ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT s.threshold, s.run, s.hold, s.entity, s.t, s.candidate, r.ms, hours, CAST(least(hours, floor(hours*(r.t-r.ms)/(r.me-r.ms))+4) AS BIGINT) AS allowance
       FROM gridstates s JOIN gridrows r ON r.entity=s.entity AND r.rn=s.rn, (SELECT unnest({list(GRID_CAPS)}) AS hours) WHERE s.rn>0)) WINDOW w AS (PARTITION BY threshold, run, hold, hours, entity, ms ORDER BY t ROWS UNBOUNDED PRECEDING))) GROUP BY 1,2,3,4""", "gridstates gridrows")
def al12_crossed(spark, root):
    """Every whole policy under every cap; policies are columns of one frame, whose windows they share."""
    rows = materialize(slim(spark, root), "grid-rows")
    named = crossed_grid(rows, "score")
    caps = {f"{h:g}": policies.SafeBudget(60, h, 4.0) for h in GRID_CAPS}
    parts = F.split("policy", "/")
    totals = policies.capped_totals(policies.candidates_many(rows, "score", named), list(named), caps)
    return totals.select(parts[0].cast("double").alias("threshold"), parts[1].cast("int").alias("run"), parts[2].cast("int").alias("hold"), F.col("cap").cast("double").alias("hours"), "candidates", "alarms")


@query("al13_warm_up_rows", "entity:i t:i threshold:f candidate:i",
       "SELECT entity, t, threshold, CASE WHEN score>=threshold THEN 1 ELSE 0 END AS candidate FROM roll, bounds WHERE t>=lo+20*86400", "roll bounds")
def al13(spark, root):
    from tidewatch.plans.standins import grid_bounds, readings

    rule = policies.CandidatePolicy("rolling_quantile", rolling_quantile=0.9, history_seconds=864000, minimum_history_rows=24)
    kept_from = grid_bounds(readings(spark, root))["lo"] + 20 * 86400
    return policies.candidates(slim(spark, root), "score", rule).withColumn("_lo", kept_from).filter(F.col("t") >= F.col("_lo"))
