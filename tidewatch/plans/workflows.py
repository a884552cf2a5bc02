"""Composed workflows: each is one call that chains the operators end to end."""

from __future__ import annotations

import dataclasses
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import scalar, trajectory
from tidewatch.functions.clock import DAY
from tidewatch.operators import (audits, bootstrap, controller, episodes, hazards, joins, matching, metrics, models, policies,
                                 sampling, scan, selection, structured, temporal)
from tidewatch.operators.policies import capacity_bins
from tidewatch.plans.cleaning import assert_no_leakage, standardize
from tidewatch.plans.matching_queries import HORIZON_S, monthly_false_hours, paired
from tidewatch.plans.metric_queries import (R, _condition_table, _day_blocks, _folds, feature_frame, loss_sums, pair_sums,
                                            seasonal_design)
from tidewatch.plans.model_queries import BOOST, BOOST_ROUNDS, LOCAL, STABILITY_REPLICATES, boosted_scores, fit_path, graph_problem, stability_fits, structured_rows, training_rows
from tidewatch.plans import policy_queries
from tidewatch.plans.policy_queries import BUDGETS, CAP, RULES, controller_inputs, trajectories
from tidewatch.plans.recurrence import bin_event_table, causal_recurrence_features
from tidewatch.plans.registry import query
from tidewatch.plans.standins import (HORIZON, HOUR, catalog_view, episode_events, grid_bounds, panel, purchase_events, readings,
                                      risk_rows, scored)
from tidewatch.session import materialize


# --- shared steps -------------------------------------------------------------------

def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_candidate(alarms: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Make the candidate part of the entity key, so every candidate is judged in the same pass."""
    key = F.concat_ws("#", "candidate", F.col("entity").cast("string"))
    names = alarms.select("candidate").distinct()
    spread = events.withColumn("_c", names.agg(F.collect_set("candidate")).scalar()).withColumn("candidate", F.explode("_c")).drop("_c")
    return (alarms.withColumn("entity", key), spread.withColumns({
        "entity": key, "event_id": F.concat_ws("#", "candidate", F.col("event_id").cast("string"))}))


def evaluate(alarms: DataFrame, events: DataFrame, budget: float, panel: DataFrame | None = None, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Strict-contract records and one metrics row per candidate.

    ``alarms`` holds (candidate, entity, t, alarm, observed).  Where every candidate decides on each row of one ``panel``, what an event's
    window and an entity's months hold is counted there once, and candidates are spread over the counts and not over the rows.  With the
    ``names`` of all candidates, ``alarms`` need then hold no more than the rows with an alarm.
    """
    name = F.substring_index("entity", "#", 1)
    onsets = events.select("entity", "event_id", "onset")
    if panel is None:
        rows, spread = with_candidate(alarms, onsets)
        rows = materialize(rows.select("entity", "t", "alarm", "observed"), "candidate-alarms")
        records, classified = matching.strict_match(rows, spread.select("entity", "event_id", "onset"), "alarm", HOUR, HORIZON_S)
        present = matching.month_rows(rows)
    else:
        # The key that with_candidate() makes, less the candidate: rows and events without an entity meet as well.
        key = F.concat_ws("#", F.lit(""), F.col("entity").cast("string"))
        panel = panel.select(key.alias("entity"), "t", "observed")
        each = materialize(matching.window_availability(onsets.withColumn("entity", key), panel, HOUR, HORIZON_S), "windows")
        rows = materialize(alarms.filter("alarm = 1").select(F.concat("candidate", key).alias("entity"), "t", "alarm", "observed"), "candidate-alarms")
        found = alarms.select("candidate").distinct().agg(F.collect_set("candidate")).scalar() if names is None else F.array(*[F.lit(n) for n in names]).cast("array<string>")

        def spread_over(frame: DataFrame) -> DataFrame:
            return frame.withColumn("_c", found).withColumn("_c", F.explode("_c")).withColumn("entity", F.concat("_c", "entity"))

        queue = materialize(spread_over(each).withColumn("event_id", F.concat_ws("#", "_c", F.col("event_id").cast("string"))).drop("_c"), "candidate-windows")
        present = spread_over(matching.month_rows(panel)).drop("_c")
        records, classified = matching.strict_match(rows, queue.select("entity", "event_id", "onset"), "alarm", HOUR, HORIZON_S, queue=queue)
    records = materialize(records.withColumn("candidate", name), "records")
    months = matching.month_budget(rows, classified, budget, HOUR, present).withColumn("candidate", name).groupBy("candidate").agg(
        F.avg("false_hours").alias("false_hours"), F.avg("alarm_hours").alias("alarm_hours"), F.avg("exceeded").alias("exceed_rate"),
        F.max("reserved_hours").alias("max_reserved_hours"))
    return records, matching.queue_metrics(records, ("candidate",)).join(months, "candidate")


def final_episode_metrics(rows: DataFrame, events: DataFrame, alarm: str) -> tuple[DataFrame, DataFrame]:
    """Final-episode records and their summary for one 0/1 alarm column."""
    records = matching.final_episode_match(rows, events, F.coalesce(F.col(alarm), F.lit(0)) == 1, HOUR, HORIZON_S, 1, HOUR, 3 * HOUR)
    summary = records.agg(F.expr("sum(evaluable) AS events"), F.expr("sum(hit) AS hits"), F.expr("try_divide(sum(hit), sum(evaluable)) AS hit_rate"),
                          F.avg("lead_hours").alias("mean_lead"), F.expr("coalesce(try_divide(sum(lead_hours), sum(evaluable)), 0) AS utility"))
    return records, summary


def at_budget(rows: DataFrame, score: str, hours: float, judged: DataFrame | None = None) -> DataFrame:
    """Alarm column of a score at its false-alarm budget threshold, on the ``judged`` ones where not all rows are needed."""
    limit = selection.budget_threshold(rows, score, "future", hours, 60).select(F.struct("threshold", "everything")).scalar()
    out = (rows if judged is None else judged).withColumn("_lim", limit)
    return out.withColumn("alarm", F.expr(f"CAST(coalesce({score} IS NOT NULL AND (_lim.everything = 1 OR {score} > _lim.threshold), false) AS INT)")).drop("_lim")


# --- workflows ------------------------------------------------------------------------

@query("wf1_timeline_build", "entity:i rows_n:i risk_rows:i positives:i hard_6h:i events:i targets:i eligible:i",
       """SELECT r.*, coalesce(events,0) AS events, coalesce(targets,0) AS targets, coalesce(eligible,0) AS eligible FROM (SELECT entity, count(*) AS rows_n, sum(risk_set) AS risk_rows, sum(hazard_label) AS positives, sum(risk_set*exposure_recent*lv6*CAST(w6=0 AS INT)) AS hard_6h FROM risk1 GROUP BY 1) r
       LEFT JOIN (SELECT ep.entity, count(*) AS events, sum(valid) AS targets, sum(CASE WHEN valid=1 AND risk_set=1 AND hazard_label=1 THEN 1 ELSE 0 END) AS eligible FROM ep LEFT JOIN risk1 k ON k.entity=ep.entity AND k.t=ep.reference_issue GROUP BY 1) e USING (entity)""", "risk1 ep")
def wf1(spark, root):
    from tidewatch.operators.risk import event_eligibility

    risk = materialize(risk_rows(spark, root), "risk")
    events = event_eligibility(episode_events(spark, root), risk)
    rows = risk.groupBy("entity").agg(F.count(F.lit(1)).alias("rows_n"), F.sum("risk_set").alias("risk_rows"), F.sum("hazard_label").alias("positives"), F.sum("hard_negative_21600").alias("hard_6h"))
    per = events.groupBy("entity").agg(F.count(F.lit(1)).alias("events"), F.sum("valid").alias("targets"), F.sum("eligible").alias("eligible"))
    return rows.join(per, "entity", "left").fillna(0)


@query("wf2_sample_table", "entity:i t:i stratum:i sample_weight:f z_gap:f",
       """SELECT entity, t, stratum, 1/p AS sample_weight, greatest(-5,least(5,(coalesce(g,m)-m)/sd)) AS z_gap FROM (SELECT *, CASE stratum WHEN 0 THEN 1.0 WHEN 1 THEN least(1.0,500.0/ns) ELSE least(1.0,800.0/ns) END AS p FROM (SELECT *, count(*) OVER (PARTITION BY stratum) AS ns FROM (
       SELECT r.entity, r.t, (r.t-r.last_end)/3600.0 AS g, CASE WHEN w6>0 THEN 0 WHEN exposure_recent*lv6=1 THEN 1 ELSE 2 END AS stratum, m, sd FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t) AS rn FROM risk1) r, (SELECT avg((t-last_end)/3600.0) AS m, stddev_pop((t-last_end)/3600.0) AS sd FROM risk1 WHERE risk_set=1) WHERE risk_set=1 AND rn>=4)))
       WHERE stratum=0 OR CAST('0x' || substr(md5(concat_ws('|',entity,t,'11')),1,8) AS BIGINT)/4294967296.0 < p""", "risk1")
def wf2(spark, root):
    assert_no_leakage(["gap_hours"])
    risk = temporal.contiguous_run(risk_rows(spark, root), HOUR, 4)
    risk = materialize(risk.select("entity", "t", "risk_set", "history_ok", "gap_hours", "onset_within_21600", "hard_negative_21600"), "risk")
    scaled = standardize(risk, risk.filter("risk_set = 1"), ["gap_hours"], 5.0).filter("risk_set = 1 AND history_ok = 1")
    strata = sampling.with_strata(scaled, "onset_within_21600 = 1", "hard_negative_21600 = 1")
    return sampling.weighted_sample(strata, {1: 500, 2: 800}, ["entity", "t"], 11).withColumnRenamed("z_gap_hours", "z_gap")


@query("wf3_baseline_operating_points", "model:s hours:f cohort:s events:i hits:i hit_rate:f mean_lead:f utility:f")
def wf3(spark, root):
    """Fitted on the training span, calibrated and thresholds set on the calibration span, judged after it, for all entities and by cohort."""
    lo = grid_bounds(readings(spark, root))["lo"]
    days = (14, 21)
    rows = materialize(spans(training_rows(spark, root), lo, days, ("train", "calibration", "judged")), "baseline-spans")
    train, held, judged = (rows.filter(F.col("span") == n) for n in ("train", "calibration", "judged"))
    events = materialize(span_events(spark, root, lo, days, 1), "judged-events")
    parts = []
    for link in ("cloglog", "logit"):
        fit = models.fit_glm(train.filter(f"NOT {UNSEEN}"), LOCAL, "future", "weight", link)
        cal = models.calibrate(held.withColumn("eta", fit.eta()), "eta", "future", "weight", link)
        line = F.lit(cal.intercept) + F.lit(cal.values[0]) * fit.eta()
        risk = scalar.cloglog_risk(line) if link == "cloglog" else scalar.logit_risk(line)
        for hours in (10.0, 40.0):
            alarms = materialize(threshold_alarms(held.withColumn("risk", risk), judged.withColumn("risk", risk), "risk", hours), "baseline-alarms")
            for cohort, condition in (("all", "true"), ("seen", f"NOT {UNSEEN}"), ("unseen", UNSEEN)):
                _, summary = final_episode_metrics(alarms.filter(condition), events.filter(condition), "alarm")
                parts.append(summary.withColumns({"model": F.lit(link), "hours": F.lit(hours), "cohort": F.lit(cohort)}))
    return union(parts)


def paired_records(named: dict[str, DataFrame]) -> DataFrame:
    keep = ["event_id", "entity", "onset", "evaluable", "hit", "lead_hours"]
    return materialize(union([r.select(*keep, F.lit(n).alias("method")) for n, r in named.items()]), "paired")


PAIR_COLUMNS = ["n", "ha", "hb", "la", "lb", "shared", "cl"]
PAIR_RATIOS = {"delta_hit_rate": "(ha-hb)/nullif(n,0)", "delta_utility": "(la-lb)/nullif(n,0)", "delta_common_lead": "cl/nullif(shared,0)"}


def compare(records: DataFrame, a: str, b: str, replicates: int = R) -> DataFrame:
    sums = materialize(pair_sums(paired(records, a, b)), "pair-sums")
    return bootstrap.cluster_bootstrap(sums, PAIR_COLUMNS, PAIR_RATIOS, replicates, f"{a}-{b}").withColumns({"model_a": F.lit(a), "model_b": F.lit(b)})


#: Days from the first bin on: training, selection of the penalty, calibration with the alarm threshold; what comes after is judged only.
GRAPH_SPANS = (12, 17, 21)
#: Entities that no fit sees; they have no term of their own and are judged as a cohort.
UNSEEN = "entity % 5 = 0"


def spans(rows: DataFrame, lo, days: tuple[int, ...] = GRAPH_SPANS, names: tuple[str, ...] = ("train", "selection", "calibration", "judged")) -> DataFrame:
    """Rows with their ``span``; those whose horizon reaches into the next one are in none."""
    marked, span, start = rows.withColumn("_lo", lo), F.lit(None).cast("string"), F.col("_lo")
    for name, end in zip(names, (*days, None), strict=True):
        stop = None if end is None else F.col("_lo") + end * DAY
        inside = F.col("t") >= start if stop is None else (F.col("t") >= start) & (F.col("t") + HORIZON * HOUR < stop)
        span, start = F.when(inside, name).otherwise(span), stop
    return marked.withColumn("span", span).drop("_lo").filter("span IS NOT NULL")


def span_events(spark, root, lo, days: tuple[int, ...], first: int, last: int | None = None) -> DataFrame:
    """Purchase onsets from the end of span ``first`` on, up to that of ``last``."""
    events = purchase_events(spark, root).withColumn("_lo", lo)
    kept = events.filter(F.col("onset") >= F.col("_lo") + days[first] * DAY)
    return (kept if last is None else kept.filter(F.col("onset") < F.col("_lo") + days[last] * DAY)).drop("_lo")


def threshold_alarms(limits: DataFrame, judged: DataFrame, score: str, hours: float) -> DataFrame:
    """Alarms on ``judged`` above the budget threshold of ``limits``, rows of an earlier span."""
    limit = selection.budget_threshold(limits, score, "future", hours, 60).select(F.struct("threshold", "everything")).scalar()
    out = judged.withColumn("_lim", limit)
    return out.withColumn("alarm", F.expr(f"CAST(coalesce({score} IS NOT NULL AND (_lim.everything = 1 OR {score} > _lim.threshold), false) AS INT)")).drop("_lim")


@query("wf4_graph_increment", "l1:f cohort:s budget:f metric:s estimate:f low:f high:f")
def wf4(spark, root):
    """Neighbour terms against none: the penalty is chosen on the selection span, scores are calibrated and thresholds set on the
    calibration span, and the last span is judged, at several budgets, for all entities and for those that the fit has seen."""
    rows, names = structured_rows(spark, root)
    lo = grid_bounds(readings(spark, root))["lo"]
    base = training_rows(spark, root).select("entity", "t", "future", "weight")
    cut = materialize(spans(rows, lo).join(base, ["entity", "t"]), "graph-spans")
    packed, barrier, path = fit_path(cut.filter(f"span = 'train' AND NOT {UNSEEN}"), names)
    effects = {s.name: structured.entity_terms(packed, s) for s in (barrier, *path)}

    def scored_rows(part: DataFrame, fits) -> DataFrame:
        lines = structured.linear_score(part, ["entity", "t", "future", "weight"], {s.name: s.values for s in fits})
        for s in fits:
            own = effects[s.name].withColumnRenamed("effect", "_own")
            lines = lines.join(own, "entity", "left").withColumn(s.name, F.col(f"`{s.name}`") + F.coalesce("_own", F.lit(0.0))).drop("_own")
        return lines

    # Selection: of the penalties that do not lose log-loss against the barrier, the one with the largest warning utility.
    selected = materialize(scored_rows(cut.filter("span = 'selection'"), (barrier, *path)), "selection-scores")
    known = span_events(spark, root, lo, GRAPH_SPANS, 0, 1)
    candidates = []
    for s in (barrier, *path):
        risk = selected.select("entity", "t", "future", "weight", scalar.cloglog_risk(F.col(f"`{s.name}`")).alias("risk"))
        loss = metrics.base_metrics(risk, "risk", "future", "weight").select("log_loss").scalar()
        _, summary = final_episode_metrics(at_budget(risk, "risk", 20.0), known, "alarm")
        candidates.append(summary.select(F.lit(s.name).alias("name"), F.coalesce("utility", F.lit(0.0)).alias("utility"), loss.alias("log_loss")))
    table = materialize(union(candidates), "penalties")
    limit = table.filter("name = 'barrier'").agg(F.max("log_loss")).scalar() + 0.001
    allowed = table.filter("name <> 'barrier'").withColumns({"grp": F.lit(1), "_limit": limit})
    choice = selection.best_rows(allowed, ["grp"], [F.desc(F.round("utility", 9)), F.asc("log_loss")], F.col("log_loss") <= F.col("_limit")).first()["name"]
    chosen = next(s for s in path if s.name == choice)

    held = materialize(scored_rows(cut.filter("span = 'calibration'"), (barrier, chosen)), "calibration-scores")
    judged = materialize(scored_rows(cut.filter("span = 'judged'"), (barrier, chosen)), "judged-scores")
    lines = {}
    for s in (barrier, chosen):
        eta = F.col(f"`{s.name}`")
        cal = models.calibrate(held.withColumn("eta", eta), "eta", "future", "weight")
        lines[s.name] = scalar.cloglog_risk(F.lit(cal.intercept) + F.lit(cal.values[0]) * eta)
    events = span_events(spark, root, lo, GRAPH_SPANS, 2)
    parts = []
    for hours in (10.0, 20.0):
        records = {}
        for s in (barrier, chosen):
            limits, rows_ = (x.select("entity", "t", "future", lines[s.name].alias("risk")) for x in (held, judged))
            records["local" if s is barrier else "graph"] = final_episode_metrics(threshold_alarms(limits, rows_, "risk", hours), events, "alarm")[0]
        paired_all = paired_records(records)
        for cohort, condition in (("all", "true"), ("seen", f"NOT {UNSEEN}")):
            parts.append(compare(paired_all.filter(condition), "graph", "local").withColumns({"cohort": F.lit(cohort), "budget": F.lit(hours)}))
    return union(parts).withColumn("l1", F.lit(float(choice.split("=")[1])))


LATCHED_GRID = tuple(round(0.82 + 0.02 * k, 2) for k in range(9))


def latched_rule(quantile: float, hours: float = 30.0) -> policies.LatchedBudget:
    return policies.LatchedBudget(60, hours, 10 * DAY, quantile, 24, 3.0, 2, 2)


def latched_names(quantiles: tuple[float, ...]) -> dict[str, float]:
    return {f"q{int(round(q * 100))}": q for q in quantiles}


def latched_candidates(rows: DataFrame, score: str, quantiles: tuple[float, ...] = LATCHED_GRID, hours: float = 30.0) -> DataFrame:
    """(candidate, entity, t, future, observed, alarm): every quantile's latched alarms, their thresholds from one ordered window."""
    named = latched_names(quantiles)
    keep = [c for c in ("entity", "t", "future", "observed", "span") if c in rows.columns]
    staged = materialize(policies.rolling_thresholds(rows.select(*keep, score), score, named, 10 * DAY, 24), "thresholds")
    parts = [policies.latched_on(staged.select(*keep, score, F.col(n).alias("threshold")), score, latched_rule(q, hours)).select(*keep, "alarm", F.lit(n).alias("candidate")) for n, q in named.items()]
    return union(parts)


def episode_table(rows: DataFrame, events: DataFrame, budget: float = 30.0) -> DataFrame:
    """One row per candidate: monthly false hours and final-episode metrics."""
    tagged, spread = with_candidate(rows, events.select("entity", "event_id", "onset"))
    tagged = materialize(tagged, "candidate-rows")
    records = matching.final_episode_match(tagged, spread, F.col("alarm") == 1, HOUR, HORIZON_S, 1, HOUR, 3 * HOUR).withColumn("candidate", F.substring_index("entity", "#", 1))
    summary = records.groupBy("candidate").agg(F.expr("sum(evaluable) AS events"), F.expr("sum(hit) AS hits"), F.expr("coalesce(try_divide(sum(hit), sum(evaluable)), 0) AS hit_rate"),
                                               F.expr("coalesce(try_divide(sum(lead_hours), sum(evaluable)), 0) AS utility"))
    months = tagged.groupBy("candidate", "entity", F.expr("date_format(timestamp_seconds(t), 'yyyy-MM') AS month")).agg(F.expr("count_if(alarm = 1 AND future = 0) AS false_hours"))
    spent = months.groupBy("candidate").agg(F.count(F.lit(1)).alias("months"), F.avg("false_hours").alias("mean_false"), F.max("false_hours").alias("max_false"), F.avg((F.col("false_hours") > budget).cast("int")).alias("over"))
    return summary.join(spent, "candidate")


@query("wf5_stability_pipeline", "quantile:s span:s months:i mean_false:f max_false:f hits:i events:i utility:f")
def wf5(spark, root):
    """Stable neighbour terms are refitted on the training span and calibrated after it; the budget quantile is chosen on the calibration span,
    and every later span is judged on its own."""
    rows, names = structured_rows(spark, root, replicates=STABILITY_REPLICATES)
    lo = grid_bounds(readings(spark, root))["lo"]
    base = training_rows(spark, root).select("entity", "t", "future", "weight")
    order = ("train", "calibration", "first", "second")
    cut = materialize(spans(rows, lo, (12, 18, 24), order).join(base, ["entity", "t"]), "stable-spans")
    train = cut.filter("span = 'train'")
    stable = models.selection_frequency(stability_fits(spark, train, names)).filter("stable = 1")
    place = models.places(spark, names)
    kept = np.zeros(len(names), dtype=bool)  # terms, as the coefficients are
    kept[place.join(stable.filter("feature LIKE 'graph::%'"), "feature").select("i").toArrow().column(0).to_numpy()] = True
    problem = graph_problem("stable", names)
    problem.upper = np.where(np.fromiter((n.startswith("graph::") for n in names), bool, len(names)) & ~kept, 0.0, problem.upper)
    packed = structured.pack(train)
    (fit,) = structured.solve(packed, [problem])
    lines = structured.linear_score(cut, ["entity", "t", "future", "weight", "span"], {"eta": fit.values}).join(structured.entity_terms(packed, fit), "entity", "left")
    scored_ = materialize(lines.withColumn("eta", F.col("eta") + F.coalesce("effect", F.lit(0.0))), "stable-scores")
    cal = models.calibrate(scored_.filter("span = 'calibration'"), "eta", "future", "weight")
    risk = scored_.withColumn("risk", scalar.cloglog_risk(F.lit(cal.intercept) + F.lit(cal.values[0]) * F.col("eta"))).withColumn("observed", F.lit(1))
    alarms = materialize(latched_candidates(materialize(risk, "stable-risk"), "risk"), "stable-alarms")
    development = episode_table(alarms.filter("span = 'calibration'"), span_events(spark, root, lo, (12, 18, 24), 0, 1)).withColumn("grp", F.lit(1))
    chosen = selection.best_rows(development, ["grp"], [F.desc(F.round("utility", 9)), F.desc(F.round("hit_rate", 9)), F.asc("mean_false"), F.asc("candidate")], F.col("mean_false") <= 30).select("candidate")
    parts = []
    for name, first, last in (("first", 1, 2), ("second", 2, None)):
        mine = alarms.filter(F.col("span") == name).join(F.broadcast(chosen), "candidate", "left_semi")
        parts.append(episode_table(mine, span_events(spark, root, lo, (12, 18, 24), first, last)).withColumn("span", F.lit(name)))
    return union(parts).withColumnRenamed("candidate", "quantile")


@query("wf6_placebo_gate", "model_a:s model_b:s metric:s estimate:f low:f high:f passed:i")
def wf6(spark, root):
    s = materialize(scored(spark, root).filter("observed = 1").selectExpr("entity", "t", "future", "4 * coalesce(score, 0) - 4 AS local_eta", "CAST(past24 AS DOUBLE) * 0.3D AS contribution"), "gate")
    partners = joins.cyclic_partners(s)
    shifts = {"extra_lag": (-6 * HOUR, None), "shift_7d": (-7 * DAY, None), "permuted": (0, partners), "future_control": (6 * HOUR, None)}
    # Arms lie beside each other, so rows are written once; alarms are looked at in the events' windows only, and thresholds come from all rows.
    arms = {"original": F.col("contribution"), "ablation": F.lit(0.0)} | {n: F.col(f"moved_{n}") for n in shifts}
    wide = s
    for n, (d, m) in shifts.items():
        wide = joins.shifted_lookup(wide, "contribution", d, f"moved_{n}", m, source=s)
    risks = [scalar.calibrated_cloglog_risk(F.col("local_eta") + moved, 0.0, 1.0, 6).alias(f"risk_{n}") for n, moved in arms.items()]
    risk = materialize(wide.select("entity", "t", "future", *risks), "arms")
    events = materialize(purchase_events(spark, root), "onsets")
    judged = materialize(matching.window_rows(risk, events, HOUR, HORIZON_S), "judged")
    named = {n: final_episode_metrics(at_budget(risk, f"risk_{n}", 20.0, judged), events, "alarm")[0] for n in arms}
    records = paired_records(named)
    table = materialize(union([compare(records, "original", n) for n in arms if n != "original"]), "gate-table")
    tagged = table.withColumn("metric", F.expr("CASE metric WHEN 'delta_utility' THEN 'utility' WHEN 'delta_common_lead' THEN 'common_lead' ELSE metric END"))
    verdict = metrics.gate_decision(tagged, "original", "ablation", ["extra_lag", "shift_7d", "permuted"])
    return table.withColumn("passed", verdict.select("passed").scalar())


@query("wf7_frozen_budget_scores", "model:s months:i mean_false:f hits:i events:i utility:f")
def wf7(spark, root):
    s = materialize(scored(spark, root).selectExpr("entity", "t", "future", "observed", "score AS a", "noise / 997.0D AS b", "0.5D * (score + noise / 997.0D) AS c"), "scores")
    rule = policies.LatchedBudget(60, 30.0, 10 * DAY, 0.9, 24, 3.0, 2, 2)
    events = purchase_events(spark, root)
    parts = []
    for name in ("a", "b", "c"):
        rows = materialize(policies.latched_alarms(s, name, rule).filter("observed = 1"), "latched")
        audit = monthly_false_hours(rows, {name: "alarm = 1"}, "future", HOUR, 30.0).withColumn("_o", F.lit(1))
        parts.append(audit.join(final_episode_metrics(rows, events, "alarm")[1].withColumn("_o", F.lit(1)), "_o").drop("_o"))
    return union(parts)


@query("wf8_development_selection", "candidate:s span:s utility:f hit_rate:f mean_false:f feasible:i chosen:i")
def wf8(spark, root):
    """Every quantile on the development span; the best feasible one once more on the span after it, which had no say."""
    long = scored(spark, root).filter("score IS NOT NULL").selectExpr("entity", "t", "future", "observed", "stack(2, 1, score, 2, 0.5D * score + 0.5D * noise / 997) AS (seed, p)")
    mean = joins.seed_mean(long, ["entity", "t", "future", "observed"], "p", 2)
    lo = grid_bounds(readings(spark, root))["lo"]
    cut = spans(mean, lo, (20,), ("development", "frozen"))
    alarms = materialize(latched_candidates(materialize(cut, "ensemble"), "p").filter("observed = 1"), "quantile-alarms")
    development = episode_table(alarms.filter("span = 'development'"), purchase_events(spark, root).withColumn("_lo", lo).filter(F.col("onset") < F.col("_lo") + 20 * DAY).drop("_lo"))
    development = materialize(development, "development").withColumns({"grp": F.lit(1), "feasible": (F.col("mean_false") <= 25).cast("int")})
    best = selection.best_rows(development, ["grp"], [F.desc(F.round("utility", 9)), F.desc(F.round("hit_rate", 9)), F.asc("candidate")], F.col("feasible") == 1).select("candidate")
    frozen = episode_table(alarms.filter("span = 'frozen'").join(F.broadcast(best), "candidate", "left_semi"), span_events(spark, root, lo, (20,), 0))
    chosen = best.withColumn("chosen", F.lit(1))
    both = union([development.withColumn("span", F.lit("development")), frozen.withColumns({"span": F.lit("frozen"), "feasible": (F.col("mean_false") <= 25).cast("int")})])
    return both.join(F.broadcast(chosen), "candidate", "left").fillna(0, ["chosen"])


def strategy_alarms(spark, root) -> tuple[list[str], DataFrame, DataFrame]:
    """Names of the five alarm strategies, the rows that all decide on, and their alarms as one long frame."""
    s = materialize(scored(spark, root).select("entity", "t", "score", "observed"), "scores")
    safe = {
        "fixed": policies.CandidatePolicy("fixed_threshold", threshold=0.5),
        "smoothed": policies.CandidatePolicy("fixed_threshold", threshold=0.35, ema_alpha=0.4),
        "rolling": policies.CandidatePolicy("rolling_quantile", rolling_quantile=0.9, history_seconds=10 * DAY, minimum_history_rows=24),
        "hysteresis": policies.CandidatePolicy("hysteresis", threshold=0.3, ema_alpha=0.4, minimum_run=2, hold_bins=3),
    }
    keep = ["entity", "t", "alarm", "observed"]
    parts = [policies.apply_policy(s, "score", p, CAP).select(*keep, F.lit(n).alias("candidate")) for n, p in safe.items()]
    latched = policies.latched_alarms(s, "score", policies.LatchedBudget(60, 40.0, 10 * DAY, 0.9, 24, 4.0, 2, 2))
    alarms = union([*parts, latched.select(*keep, F.lit("latched").alias("candidate"))])
    return [*safe, "latched"], s.select("entity", "t", "observed"), alarms.filter("alarm = 1")


@query("wf9_utility_selected_warning", "recurrence:s events:i hits:i utility:f delta_low:f delta_high:f")
def wf9(spark, root):
    names, rows, alarms = strategy_alarms(spark, root)
    records, table = evaluate(alarms, purchase_events(spark, root), 40.0, rows, names)
    chosen = selection.best_rows(table.withColumn("grp", F.lit(1)), ["grp"], [F.desc(F.round("op_utility", 9)), F.asc("candidate")], F.col("exceed_rate") == 0)
    picked = records.join(chosen.select("candidate"), "candidate", "left_semi").selectExpr(
        "*", "CASE WHEN row_number() OVER (PARTITION BY entity ORDER BY onset) = 1 THEN 'first' ELSE 'recurrent' END AS recurrence")
    sums = materialize(picked.groupBy("recurrence", "entity").agg(F.expr("count_if(operational = 1) AS n"), F.expr("coalesce(sum(CASE WHEN hit = 1 THEN lead_hours END), 0) AS lead")), "sums")
    draws = bootstrap.ratio_draws(bootstrap.replicate_totals(sums, ["n", "lead"], R, "wf9", by=("recurrence",)), {"utility": "lead / nullif(n, 0)"}, ("recurrence",))
    spread = bootstrap.intervals(draws, ("recurrence",)).select("recurrence", F.col("low").alias("delta_low"), F.col("high").alias("delta_high"))
    base = picked.groupBy("recurrence").agg(F.expr("count_if(operational = 1) AS events"), F.expr("sum(hit) AS hits"), F.expr("coalesce(try_divide(sum(CASE WHEN hit = 1 THEN lead_hours END), count_if(operational = 1)), 0) AS utility"))
    return base.join(spread, "recurrence")


def strategy_grid(rows: DataFrame, score: str) -> dict[str, policies.CandidatePolicy]:
    """Whole policies of four strategies over quantile thresholds, runs, holds and smoothing, named ``strategy|settings``."""
    held = policy_queries.crossed_grid(rows, score, (0.85, 0.92, 0.97), (1, 2), (1, 3))
    levels = sorted({p.threshold for p in held.values()})
    grid = {f"hysteresis|{n}": dataclasses.replace(p, ema_alpha=0.4) for n, p in held.items()}
    grid |= {f"fixed|{x!r}": policies.CandidatePolicy("fixed_threshold", threshold=x) for x in levels}
    grid |= {f"smoothed|{x!r}": policies.CandidatePolicy("fixed_threshold", threshold=x, ema_alpha=0.4) for x in levels}
    grid |= {f"rolling|{q}": policies.CandidatePolicy("rolling_quantile", rolling_quantile=q, history_seconds=10 * DAY, minimum_history_rows=24) for q in (0.85, 0.92, 0.97)}
    # Names of columns have no dots.
    return {n.replace(".", "_"): p for n, p in grid.items()}


@query("wf10_strategy_comparison", "strategy:s mode:s settings:s span:s op_events:i op_hits:i op_utility:f false_hours:f exceed_rate:f incomplete:i")
def wf10(spark, root):
    """Five strategies with their grids: each picks its settings on the development span, by utility among those that keep the budget and by
    false hours matched across the strategies; both picks are judged on the span after it, with its eligibility audit."""
    lo, events = grid_bounds(readings(spark, root))["lo"], purchase_events(spark, root)
    rows = materialize(scored(spark, root).select("entity", "t", "score", "observed"), "scores")
    development = part_of(rows, lo, FROZEN_FROM, False)
    grid = strategy_grid(development, "score")
    capped = policies.capped_many(policies.candidates_many(rows, "score", grid), list(grid), {"40": CAP}, ("observed",)).select("entity", "t", "alarm", "observed", F.col("policy").alias("candidate"))
    quantiles = (0.85, 0.92, 0.97)
    latched = latched_candidates(rows, "score", quantiles, 40.0).select("entity", "t", "alarm", "observed", F.concat(F.lit("latched|"), "candidate").alias("candidate"))
    names = [*grid, *[f"latched|{n}" for n in latched_names(quantiles)]]
    # All decide on the same rows, so only alarms are written.
    alarms = materialize(union([x.filter("alarm = 1") for x in (capped, latched)]), "strategy-alarms")
    _, early = evaluate(part_of(alarms, lo, FROZEN_FROM, False), part_of(events, lo, FROZEN_FROM, False, "onset"), 40.0, development, names)
    early = materialize(early.withColumns({"grp": F.lit(1), "strategy": F.substring_index("candidate", "|", 1)}), "development-strategies")
    kept = F.col("exceed_rate") == 0
    by_utility = selection.best_rows(early, ["grp", "strategy"], [F.desc(F.round("op_utility", 9)), F.asc("false_hours"), F.asc("candidate")], kept).select("strategy", "candidate", F.lit("utility").alias("mode"))
    matched = selection.matched_comparison(early, ["grp"], "strategy", "false_hours", kept, [F.asc("candidate")]).select("strategy", "candidate", F.lit("matched").alias("mode"))
    picks = materialize(by_utility.unionByName(matched), "picks")
    picked = [r[0] for r in picks.select("candidate").distinct().collect()]  # two settings per strategy
    late_rows = part_of(alarms, lo, FROZEN_FROM, True).filter(F.col("candidate").isin(*picked))
    records, late = evaluate(late_rows, part_of(events, lo, FROZEN_FROM, True, "onset"), 40.0, part_of(rows, lo, FROZEN_FROM, True), picked)
    audit = records.groupBy("candidate").agg(F.expr("count_if(operational = 1 AND evaluable = 0) AS incomplete"))
    frozen = late.join(audit, "candidate").withColumn("span", F.lit("frozen"))
    both = union([early.withColumn("span", F.lit("development")), frozen]).drop("strategy")
    return picks.join(both, "candidate").withColumn("settings", F.expr("replace(substring(candidate, length(strategy) + 2), '_', '.')"))


def controller_candidates(spark, root, rules: dict[str, controller.ControllerRules], budgets=BUDGETS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that all configurations decide on, their alarms as one long frame, and their month audit.

    All share one pass over the rows, which move with no more than their hazards are made of; only alarms are written.
    """
    rows = materialize(scored(spark, root).filter("score IS NOT NULL").select("entity", "t", "observed", "score", "noise"), "decided-rows")
    result = materialize(controller.run_controllers(rows, purchase_events(spark, root), budgets, rules, trace="alarms", hazard=policy_queries.HAZARD), "controllers")
    return rows.select("entity", "t", "observed"), controller.alarms_of(result), controller.months_of(result)


def candidate_names(methods, budgets) -> list[str]:
    return [f"{m}@{int(b)}" for m in methods for b in budgets]


def methods_by_budget(long: DataFrame) -> DataFrame:
    return long.withColumn("candidate", F.concat_ws("@", "method", F.col("budget").cast("int").cast("string")))


def split_candidate(table: DataFrame, *columns: str) -> DataFrame:
    return table.selectExpr("substring_index(candidate, '@', 1) AS method", "CAST(substring_index(candidate, '@', -1) AS DOUBLE) AS budget", *columns)


def part_of(frame: DataFrame, lo, day: int, later: bool, clock: str = "t") -> DataFrame:
    """Rows before, or from, the ``day``-th day of the grid on."""
    marked = frame.withColumn("_cut", lo + F.lit(day * DAY))
    return marked.filter(F.col(clock) >= F.col("_cut") if later else F.col(clock) < F.col("_cut")).drop("_cut")


#: Score thresholds that the reserved-capacity experiment chooses from, and the day from which its choice is judged.
THRESHOLDS = (0.2, 0.4, 0.6, 0.8, 1.0)
FROZEN_FROM = 20


@query("wf11_reserved_capacity_experiment", "method:s budget:f span:s op_hits:i op_utility:f oracle_utility:f regret:f over:i breaks:i chosen:i delta_utility:f delta_low:f delta_high:f")
def wf11(spark, root):
    """Trajectories are audited first.  Thresholds are chosen on the development span among those that hold every budget and nest; the choice,
    its ablations and the guards are judged on the span after it, against the best alarms that the capacity allows and pair by pair."""
    rows = trajectories(spark, root)
    audited = rows.withColumn("f", trajectory.cumulative("h")).withColumn("key", F.struct("entity", "t"))
    if not trajectory.audit(audited, "h", "f", "key", "entity", "t", HORIZON, 60).first().passed:
        raise ValueError("the trajectories are not coherent")
    rules = {f"t{int(x * 100)}": dataclasses.replace(RULES, score_threshold=x) for x in THRESHOLDS}
    ablations = {n: controller.variants(RULES)[n] for n in ("static_utility", "no_release", "no_remaining_time", "risk_as_utility")}
    decided, long, months = controller_candidates(spark, root, rules | ablations)
    lo = grid_bounds(readings(spark, root))["lo"]
    events = purchase_events(spark, root)
    # Guards: no budget is ever exceeded, and alarms of a smaller budget are alarms of a larger one.  With reservations a month is fullest at an alarm.
    held = months.groupBy("method").agg(F.max((F.col("peak_occupied") > F.col("capacity")).cast("int")).alias("over"))
    wide = long.groupBy("method", "entity", "t").pivot("budget", list(BUDGETS)).agg(F.max("alarm")).toDF("method", "entity", "t", "a5", "a10", "a20").fillna(0, ["a5", "a10", "a20"])
    guards = held.join(wide.groupBy("method").agg(F.expr("count_if((a5 = 1 AND a10 = 0) OR (a10 = 1 AND a20 = 0)) AS breaks")), "method", "left").fillna(0, ["breaks"])
    guards = materialize(guards, "guards")
    # The oracle alarms on the best-scored bins of each month, as many as the budget pays; it knows the month's scores in advance.
    base = scored(spark, root).select("entity", "t", "score", "observed")
    capacities = {f"oracle{int(b)}": capacity_bins(b, 60) for b in BUDGETS}
    masks = selection.oracle_mask(base, "score", capacities)
    cells = F.explode(F.array(*[F.struct(F.col(n).alias("alarm"), F.lit(f"oracle@{n[6:]}").alias("candidate")) for n in capacities])).alias("c")
    best = materialize(masks.select("entity", "t", "observed", cells).select("entity", "t", "observed", "c.alarm", "c.candidate").filter("alarm = 1"), "oracle")
    # The oracle sees all rows, the controllers those with a score.
    judges = [(methods_by_budget(long), decided, candidate_names([*rules, *ablations], BUDGETS)), (best, materialize(base.select("entity", "t", "observed"), "all-rows"), candidate_names(["oracle"], BUDGETS))]
    tables, records = [], []
    for span, later in (("development", False), ("frozen", True)):
        for alarms, panel_, names in judges:
            found, table = evaluate(part_of(alarms, lo, FROZEN_FROM, later), part_of(events, lo, FROZEN_FROM, later, "onset"), 20.0, part_of(panel_, lo, FROZEN_FROM, later), names)
            tables.append(split_candidate(table, "op_hits", "op_utility").withColumn("span", F.lit(span)))
            records += [found] if later else []
    records = union(records)
    table = materialize(union(tables), "spans")
    developed = table.filter("span = 'development'").join(guards, "method").filter(F.col("method").isin(*rules))
    choice = selection.feasible_everywhere(developed.withColumnRenamed("method", "candidate"), ["over = 0", "breaks = 0"], F.col("budget") >= 10, "op_utility").filter("chosen = 1").first()["candidate"]
    oracle = table.filter("method = 'oracle'").select("budget", "span", F.col("op_utility").alias("oracle_utility"))
    out = table.join(oracle, ["budget", "span"]).join(guards, "method", "left").join(materialize(utility_differences(records, choice), "pairs").withColumn("span", F.lit("frozen")), ["method", "budget", "span"], "left")
    return out.withColumns({"regret": F.col("oracle_utility") - F.col("op_utility"), "chosen": (F.col("method") == choice).cast("int")})


def utility_differences(records: DataFrame, base: str) -> DataFrame:
    """(method, budget, delta_utility, delta_low, delta_high): the base method against every other at the same budget, event by event on the operational queue.

    All comparisons are groups of one bootstrap, so they share the counts of its draws.
    """
    bare = lambda c: F.expr(f"substring({c}, length(candidate) + 2)")
    flat = records.filter("operational = 1").select(
        F.substring_index("candidate", "@", 1).alias("method"), F.substring_index("candidate", "@", -1).cast("double").alias("budget"), bare("entity").alias("entity"), bare("event_id").alias("event_id"),
        "hit", F.when(F.col("hit") == 1, F.col("lead_hours")).otherwise(0.0).alias("lead"))
    flat = materialize(flat, "operational-records")
    mine = flat.filter(F.col("method") == base).select("budget", "entity", "event_id", F.col("lead").alias("la"))
    both = flat.filter(F.col("method") != base).join(mine, ["budget", "entity", "event_id"])
    by = ("method", "budget")
    sums = materialize(both.groupBy(*by, "entity").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("la").alias("la"), F.sum("lead").alias("lb")), "difference-sums")
    ratio = {"delta_utility": "(la-lb)/nullif(n,0)"}
    spread = bootstrap.intervals(bootstrap.ratio_draws(bootstrap.replicate_totals(sums, ["n", "la", "lb"], R, f"{base}-differences", by=by), ratio, by), by)
    at = bootstrap.point(sums, ["n", "la", "lb"], ratio, by).select(*by, F.col("estimate").alias("delta_utility"))
    return at.join(spread.select(*by, F.col("low").alias("delta_low"), F.col("high").alias("delta_high")), list(by))


@query("wf12_sensitivity_grid", "utility:s horizon:i budget:f alarms:i released:i confirmed:i op_hits:i op_utility:f")
def wf12(spark, root):
    """Lead utilities x horizons x dense budgets; all cells decide in one pass over the rows, and the events judge every cell."""
    budgets = (2.0, 4.0, 8.0, 12.0, 16.0)
    rules = {f"{kind}/{horizon}": dataclasses.replace(RULES, utility=kind, horizon_steps=horizon, score_threshold=0.3)
             for kind in ("linear", "hit_only", "saturating_3h", "business_piecewise") for horizon in (3, 6)}
    decided, long, audit = controller_candidates(spark, root, rules, budgets)
    months = audit.groupBy("method", "budget").agg(F.sum("actions").alias("alarms"), F.sum("released").alias("released"), F.sum("confirmed").alias("confirmed"))
    # Every cell decides on the same rows; all are judged in one pass.
    judged = split_candidate(evaluate(methods_by_budget(long), purchase_events(spark, root), 16.0, decided, candidate_names(rules, budgets))[1], "op_hits", "op_utility")
    out = materialize(months, "cell-months").join(judged, ["method", "budget"])
    return out.withColumns({"utility": F.substring_index("method", "/", 1), "horizon": F.substring_index("method", "/", -1).cast("int")})


@query("wf13_baselines_and_coupling", "method:s budget:f op_hits:i op_utility:f utility_loss:f delta_low:f delta_high:f chosen:i")
def wf13(spark, root):
    """Standard baselines, of which the best feasible one is chosen on the development span and all are judged after it; what coupling the
    budgets costs, with paired intervals against the uncoupled controller."""
    chosen = {n: controller.variants(RULES)[n] for n in ("dynamic", "uniform_pacing", "dual_mirror_descent", "switch_over", "uncoupled")}
    decided, long, months = controller_candidates(spark, root, chosen)
    lo, events = grid_bounds(readings(spark, root))["lo"], purchase_events(spark, root)
    alarms, names = methods_by_budget(long), candidate_names(chosen, BUDGETS)
    # With reservations a month is fullest at an alarm, so its peak is the most that any decision saw.
    held = months.groupBy("method", "budget").agg(F.max((F.col("peak_occupied") > F.col("capacity")).cast("int")).alias("over"))
    _, early = evaluate(part_of(alarms, lo, FROZEN_FROM, False), part_of(events, lo, FROZEN_FROM, False, "onset"), 20.0, part_of(decided, lo, FROZEN_FROM, False), names)
    developed = split_candidate(early, "op_utility").join(held, ["method", "budget"]).filter("method <> 'uncoupled'").withColumnRenamed("method", "candidate")
    best = selection.feasible_everywhere(developed, ["over = 0"], F.col("budget") >= 10, "op_utility").filter("chosen = 1").select(F.col("candidate").alias("method"), F.lit(1).alias("chosen"))
    records, late = evaluate(part_of(alarms, lo, FROZEN_FROM, True), part_of(events, lo, FROZEN_FROM, True, "onset"), 20.0, part_of(decided, lo, FROZEN_FROM, True), names)
    t = materialize(split_candidate(late, "op_hits", "op_utility"), "judged-baselines")
    free = t.filter("method = 'uncoupled'").selectExpr("budget", "op_utility AS free_utility")
    out = t.join(free, "budget").withColumn("utility_loss", F.col("free_utility") - F.col("op_utility")).join(best, "method", "left").fillna(0, ["chosen"])
    return out.join(utility_differences(records, "uncoupled").select("method", "budget", "delta_low", "delta_high"), ["method", "budget"], "left")


@query("wf14_event_log_benchmark", "candidate:s op_events:i op_hits:i op_utility:f false_hours:f max_reserved_hours:f")
def wf14(spark, root):
    scores = materialize(boosted_scores(spark, root).select("entity", "t", "fold", "future", "observed", "risk"), "boosted")
    # The threshold is fixed on the selection span; only the span after it is judged.
    limit = scan.exact_quantiles(scores.filter("fold = 'selection'"), "risk", {"q": 0.9}).scalar()
    risk = scores.filter("fold = 'test'").drop("fold")
    p = panel(spark, root)
    events = bin_event_table(p).select("entity", "event_id", "onset")
    held = risk.select("entity").distinct()
    lo = risk.agg(F.min("t")).scalar()
    events = materialize(events.withColumn("_lo", lo).filter("onset > _lo").join(held, "entity", "left_semi").select("entity", "event_id", "onset"), "events")
    fixed = policies.paced_cap(risk.withColumn("_q", limit).selectExpr("entity", "t", "observed", "CAST(risk >= _q AS BIGINT) AS candidate"), "candidate", CAP)
    keep = ["entity", "t", "alarm", "observed"]
    h = risk.withColumn("h", scalar.constant_hazard("risk", HORIZON))
    rules = dataclasses.replace(RULES, score_threshold=0.5)
    inputs = materialize(controller.with_decision_inputs(h, "h", rules), "inputs")
    trace = controller.trace_of(controller.run_controller(inputs, events, (20.0, 40.0), rules)).join(inputs.select("entity", "t", "observed"), ["entity", "t"])
    alarms = union([fixed.select(*keep, F.lit("capped_quantile").alias("candidate")),
                    trace.select(*keep, F.concat(F.lit("reserved@"), F.col("budget").cast("int").cast("string")).alias("candidate"))])
    return evaluate(alarms, events, 40.0)[1]


@query("wf15_nested_alert_selection", "budget:f threshold:f prefix_differences:i nesting_violations:i")
def wf15(spark, root):
    s = materialize(scored(spark, root).select("entity", "t", "score", "observed", "future"), "scores")
    shape = policies.AlertShape(0.4, 2, 2, 2)
    grid = {f"m{i}": v for i, v in enumerate((0.2, 0.3, 0.4, 0.5))}
    masks = materialize(policies.nested_alerts(s, "score", grid, shape), "masks")
    long = masks.selectExpr("entity", "t", "observed", f"stack({len(grid)}, " + ", ".join(f"'{n}', {n}" for n in grid) + ") AS (candidate, alarm)")
    _, table = evaluate(long, purchase_events(spark, root), 40.0, s)
    names = F.create_map(*[F.lit(x) for kv in grid.items() for x in kv])
    budgets = F.explode(F.array(*[F.lit(float(b)) for b in (100, 200, 300)])).alias("budget")
    cands = table.select("*", F.element_at(names, F.col("candidate")).alias("threshold"), budgets).selectExpr(
        "budget", "threshold", "CAST(false_hours <= budget * 2 AS INT) AS budget_met", "round(utility, 9) AS utility", "round(hit_rate, 9) AS hit_rate")
    path = selection.monotone_path(materialize(cands, "nested"), [100.0, 200.0, 300.0], ["utility", "hit_rate"])
    cut = grid_bounds(readings(spark, root))["lo"] + 20 * DAY
    check = audits.prefix_invariance(s, cut, "score", lambda d: policies.nested_alerts(d, "score", grid, shape), list(grid))
    breaks = policies.nesting_audit(masks, {n: -v for n, v in grid.items()}).agg(F.sum("violations")).scalar()
    return path.withColumns({"prefix_differences": check.select(F.col("prefix_differences") + F.col("future_differences")).scalar(), "nesting_violations": breaks})


@query("wf16_recurrence_structure", "section:s grp:s n:i value:f")
def wf16(spark, root):
    events = materialize(episode_events(spark, root), "events")
    valid = materialize(episodes.order_valid_events(events), "valid")
    orders = valid.groupBy(F.col("order_group").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.avg("elapsed_minutes").alias("value")).withColumn("section", F.lit("order"))
    gaps = scan.exact_quantiles(valid.filter("event_order >= 2"), "gap_hours", {"value": 0.5}).withColumns({"section": F.lit("gap"), "grp": F.lit("median"), "n": valid.filter("event_order >= 2").agg(F.count(F.lit(1))).scalar()})
    seasons = valid.groupBy(F.col("season").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.avg("max_value").alias("value")).withColumn("section", F.lit("season"))
    from tidewatch.plans.episode_queries import _grid_events

    grid = materialize(_grid_events(spark, root), "grid")
    key = F.format_string("%s/%d/%d/%d", "rule", "merge_minutes", "cooldown_hours", "cold_limit")
    definitions = grid.groupBy(key.alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.sum("valid").cast("double").alias("value")).withColumn("section", F.lit("definition"))
    reference = grid.filter("rule = 'positive' AND merge_minutes = 10 AND cooldown_hours = 1 AND cold_limit = 2 AND valid = 1").select("entity", "onset")
    other = grid.filter("valid = 1").withColumn("definition", key)
    ref = reference.withColumn("definition", F.explode(other.agg(F.collect_set("definition")).scalar()))
    pairs = episodes.greedy_match(ref, other, 3 * HOUR, ("definition", "entity"))
    recall = pairs.groupBy(F.col("definition").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.avg("shift").alias("value")).withColumn("section", F.lit("matched"))
    return union([orders, gaps, seasons, definitions, recall])


@query("wf17_seasonal_structure", "model:s cohort:s rows_n:i log_loss:f brier:f delta_low:f delta_high:f wald:f")
def wf17(spark, root):
    cols = {"weather": ["extra", "exposure_e1", "exposure_e2"], "state": ["extra", "exposure_e1", "exposure_e2", "state"],
            "interaction": ["extra", "exposure_e1", "exposure_e2", "state", "state_by_exposure_e1", "state_by_events_past_7d"]}
    every = sorted({c for v in cols.values() for c in v})
    f = seasonal_design(feature_frame(spark, root)).select("entity", "t", "label", *[F.col(c).cast("double").alias(c) for c in every], F.lit(1.0).alias("weight"),
                                                           F.expr("CASE WHEN entity % 5 = 0 THEN 'unseen' ELSE 'seen' END AS cohort"))
    rows = materialize(f, "seasonal")
    fold = F.pmod("entity", F.lit(2))
    unseen, wald = {}, 0.0
    for name, terms in cols.items():
        fits = [models.fit_glm(rows.filter(fold != k), terms, "label", "weight", "logit", 1e-5) for k in (0, 1)]
        unseen[name] = F.when(fold == 0, fits[0].risk()).when(fold == 1, fits[1].risk())
        if name == "interaction":
            whole = models.fit_glm(rows, terms, "label", "weight", "logit", 1e-5)
            wald = models.wald_test(whole, models.cluster_sandwich(rows, whole, "label", "weight", "entity"), terms[4:])[0]
    # The models' scores lie beside each other: no row is written once per model and brought together again.
    wide = rows.select("entity", "cohort", "label", "weight", *[p.alias(name) for name, p in unseen.items()])
    oof = wide.selectExpr("cohort", "label", "weight", f"stack({len(cols)}, " + ", ".join(f"'{n}', {n}" for n in cols) + ") AS (model, p)")
    m = metrics.base_metrics(oof, "p", "label", "weight", ("model", "cohort"))
    spread = []
    for name in ("state", "interaction"):
        sums = materialize(loss_sums(wide.withColumnsRenamed({"weather": "base", name: "extra"}), ("cohort",)), "sums")
        draws = bootstrap.ratio_draws(bootstrap.replicate_totals(sums, ["sw", "la", "lb"], R, f"wf17{name}", by=("cohort",)), {"d": "(la - lb) / sw"}, ("cohort",))
        spread.append(bootstrap.intervals(draws, ("cohort",)).select("cohort", F.lit(name).alias("model"), F.col("low").alias("delta_low"), F.col("high").alias("delta_high")))
    return m.join(union(spread), ["model", "cohort"], "left").withColumn("wald", F.lit(float(wald)))


#: Hold-outs of the grouped protocol, and seeds of the ensemble, each of which weighs the training rows anew.
HOLDOUTS, SEEDS = 5, 3


@query("wf18_unseen_entities", "protocol:s cohort:s rows_n:i log_loss:f average_precision:f gap_low:f gap_high:f")
def wf18(spark, root):
    """Entities held out by balanced groups, and region by region; every fold and seed of both is fitted in the same passes, and a
    row's scores are averaged over the seeds that did, and did not, see its entity."""
    rows = training_rows(spark, root)
    stations = rows.groupBy(F.col("entity").alias("station")).agg(F.sum("future").cast("bigint").alias("events")).join(
        catalog_view(spark, root).select("station", F.concat(F.lit("R"), F.col("region").cast("string")).alias("city")), "station")
    stations = materialize(stations, "stations")
    grouped = sampling.spatial_holdouts(stations.select("station", "city", "events"), HOLDOUTS).select(F.col("station").alias("entity"), F.concat(F.lit("group/"), F.col("fold").cast("string")).alias("held"))
    regions = stations.select(F.col("station").alias("entity"), F.concat(F.lit("region/"), "city").alias("held"))
    held = materialize(grouped.unionByName(regions), "holdouts")
    names = sorted(r[0] for r in held.select("held").distinct().collect())  # folds and regions
    # Each row with the folds that hold its entity out; it trains in all others, once per seed, with a weight of its own there.
    away = held.groupBy("entity").agg(F.sort_array(F.collect_set("held")).alias("away"))
    known = materialize(rows.join(away, "entity"), "unseen-rows")
    folds, seeds = F.array(*[F.lit(n) for n in names]), F.array(*[F.lit(k) for k in range(SEEDS)])
    # The three days of an entity are drawn together, so rows with equal features there are summed before they are weighed; and rows
    # of the same holdouts, seed and features train, and are scored, as one with the sum of their weights.
    spans = known.groupBy("entity", "away", F.expr("t DIV 259200").alias("span"), "future", *LOCAL).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    draws_of = F.transform(seeds, lambda k: -F.log(F.greatest(sampling.hash_unit("entity", "span", k, salt=18), F.lit(1e-9))))
    weighed = spans.select("away", "future", *LOCAL, "weight", "n", draws_of.alias("_d"))
    alike = materialize(weighed.groupBy("away", "future", *LOCAL).agg(F.sum("n").alias("n"), *[F.sum(F.col("weight") * F.col("_d")[k]).alias(f"w{k}") for k in range(SEEDS)]), "rows-alike")
    spread = alike.withColumn("fold", F.explode(F.array_except(folds, F.col("away")))).select(
        "fold", "future", *LOCAL, "n", F.posexplode(F.array(*[F.col(f"w{k}") for k in range(SEEDS)])).alias("seed", "w"))
    training = spread.withColumn("fit", F.concat_ws("#", "fold", F.col("seed").cast("string"))).groupBy("fit", "future", *LOCAL).agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    fits = hazards.fit_hazards(training, [hazards.Design(f"{n}#{k}", tuple(LOCAL), False, 1e-3) for n in names for k in range(SEEDS)], "future", "w", "fit", count="n")
    judged = alike.select("away", *LOCAL).distinct().withColumn("fold", F.explode(folds)).withColumn("seed", F.explode(seeds)).withColumn("fit", F.concat_ws("#", "fold", F.col("seed").cast("string")))
    of_seed = fits.eta(judged).select("away", *LOCAL, F.substring_index("fold", "/", 1).alias("protocol"), F.when(F.array_contains("away", F.col("fold")), "unseen").otherwise("seen").alias("cohort"), hazards.risk().alias("p"))
    # Scores of both cohorts beside each other, by holdouts and features; the rows meet them once per protocol.
    scores = materialize(of_seed.groupBy("protocol", "away", *LOCAL).pivot("cohort", ["seen", "unseen"]).agg(F.avg("p")), "holdout-scores")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("away", *LOCAL)]
    judged_rows = known.select("entity", "away", F.col("future").alias("label"), "weight", *LOCAL).join(
        scores.withColumnsRenamed({c: f"_{c}" for c in ("away", *LOCAL)}), same)
    pooled = materialize(judged_rows.select("protocol", "entity", "label", "weight", "seen", "unseen"), "pooled-scores")
    long = pooled.selectExpr("protocol", "label", "weight", "stack(2, 'seen', seen, 'unseen', unseen) AS (cohort, p)")
    m = metrics.probability_metrics(long, "p", "label", "weight", ("protocol", "cohort"))
    wide = pooled.filter("seen IS NOT NULL AND unseen IS NOT NULL")
    sums = materialize(loss_sums(wide.withColumnsRenamed({"seen": "base", "unseen": "extra"}), ("protocol",)), "gap-sums")
    draws = bootstrap.ratio_draws(bootstrap.replicate_totals(sums, ["sw", "la", "lb"], R, "wf18", by=("protocol",)), {"gap": "(la - lb) / sw"}, ("protocol",))
    gap = bootstrap.intervals(draws, ("protocol",)).select("protocol", F.col("low").alias("gap_low"), F.col("high").alias("gap_high"))
    return m.join(gap, "protocol")


@query("wf19_conditional_screen", "condition:s coverage:f delta_log_loss:f delta_brier:f movement_cost:f mechanism:s")
def wf19(spark, root):
    from tidewatch.plans.episode_queries import explode_groups
    from tidewatch.plans.metric_queries import named_conditions, with_fitted_limits

    table = _condition_table(spark, root)
    f = with_fitted_limits(materialize(feature_frame(spark, root), "features")).withColumn("w", F.lit(1.0))
    change = metrics.brier_change(explode_groups(f, named_conditions(), "condition"), "base", "extra", "label", "w", ("condition",))
    return table.join(change.select("condition", "movement_cost", "mechanism"), "condition")


@query("wf20_boosted_oof", "fold:i rows_n:i brier:f log_loss:f average_precision:f slope:f")
def wf20(spark, root):
    """Scores of rows that their trees have not seen, each fold calibrated on the other folds' scores."""
    # Blocks, folds and purging depend on the time alone, so they are settled on the times of the grid; rows meet them there.
    times = sampling.map_folds(_day_blocks(spark, root).filter("entity IS NOT NULL").select("t", "block").distinct(), _folds(spark, root, HOLDOUTS))
    roles = sampling.purged_splits(materialize(times, "times"), HOLDOUTS, 172800, 30 * HOUR)
    trains = roles.groupBy("t", "fold").agg(F.collect_set(F.when(F.col("role") == "train", F.col("held"))).alias("trains"))
    p = causal_recurrence_features(panel(spark, root), HORIZON).filter("observed = 1 AND entity IS NOT NULL")
    rows = p.select("t", "future", *[F.col(c).cast("double").alias(c) for c in BOOST]).join(F.broadcast(materialize(trains, "roles")), "t").drop("t")
    split = materialize(rows, "splits")
    parts = []
    for k in range(HOLDOUTS):
        # Trees see a feature through the edges between its bins, which come from the training rows; rows of the same bins are one.
        learns = F.array_contains("trains", F.lit(k))
        mine = split.filter(learns | (F.col("fold") == k)).select("fold", "future", *BOOST, learns.alias("learns"))
        edges = models.feature_edges(mine.filter("learns"), BOOST)
        alike = materialize(models.rows_of_bins(mine, edges, ["learns", "fold", "future"]), "bins")
        train = alike.filter("learns").groupBy("future", *BOOST).agg(F.sum("n").alias("n"))
        trees = models.fit_boosted_binned(train, edges, "future", "n", 20.0, BOOST_ROUNDS, 3)
        parts.append(models.score_boosted_binned(trees, alike.filter("NOT learns")).select("fold", "future", "risk", "n"))
    scores = union(parts).withColumn("eta", F.expr("ln(greatest(risk, 1e-6D) / greatest(1 - risk, 1e-6D))"))
    oof = materialize(scores.groupBy("fold", "future", "eta").agg(F.sum("n").alias("n")), "oof")
    judged = []
    for k in range(HOLDOUTS):
        cal = models.calibrate(models.rows_alike(oof.filter(F.col("fold") != k), ["eta"], "future", "n"), "eta", "future", "n", "logit")
        judged.append(oof.filter(F.col("fold") == k).withColumns({"p": cal.risk(), "slope": F.lit(float(cal.values[0]))}))
    pooled = materialize(union(judged), "calibrated-oof")
    slopes = pooled.groupBy("fold").agg(F.first("slope").alias("slope"))
    return metrics.probability_metrics(pooled, "p", "future", "n", ("fold",), n="n").join(slopes, "fold")
