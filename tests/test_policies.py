import datetime as dt
import math
import random

import pytest
from conftest import collect
from pyspark.sql import functions as F

from tidewatch.operators import controller, matching, policies, selection

EPOCH = dt.datetime(1970, 1, 1)


def at(text):
    return int((dt.datetime.fromisoformat(text) - EPOCH).total_seconds())


def panel(spark, start, stop, step=600, seed=1, null_share=0.0):
    rnd = random.Random(seed)
    rows = [("a", t, None if rnd.random() < null_share else rnd.random()) for t in range(at(start), at(stop), step)]
    return spark.createDataFrame(rows, "entity string, t bigint, score double"), rows


def month(t):
    d = EPOCH + dt.timedelta(seconds=t)
    first = dt.datetime(d.year, d.month, 1)
    nxt = dt.datetime(d.year + d.month // 12, d.month % 12 + 1, 1)
    return (first - EPOCH).total_seconds(), (nxt - EPOCH).total_seconds()


def test_paced_cap_window_equals_the_loop_over_months(spark):
    df, rows = panel(spark, "2023-12-25T00:00", "2024-01-10T00:00")
    budget = policies.SafeBudget(10, 3.0, 0.5, 1.2)
    got = [r.alarm for r in policies.apply_policy(df, "score", policies.CandidatePolicy(threshold=0.6), budget).orderBy("t").collect()]
    used, current, want = 0, None, []
    for _, t, s in rows:
        lo, hi = month(t)
        used, current = (0, lo) if lo != current else (used, current)
        allowed = min(budget.budget_bins, math.floor(budget.budget_bins * 1.2 * (t - lo) / (hi - lo)) + budget.burst_bins)
        hit = int(s >= 0.6 and used < allowed)
        used += hit
        want.append(hit)
    assert got == want and sum(want) > 0


def test_nested_shape_equals_the_state_machine(spark):
    df, rows = panel(spark, "2024-01-01T00:00", "2024-01-05T00:00", null_share=0.05)
    shape = policies.AlertShape(0.5, 2, 3, 2)
    out = policies.nested_alerts(df, "score", {"low": 0.55, "high": 0.7}, shape).orderBy("t").collect()
    for name, bar in (("low", 0.55), ("high", 0.7)):
        level, streak, left, want = None, 0, 0, []
        for _, _, s in rows:
            if s is None:
                level, streak, left = None, 0, 0
                want.append(0)
                continue
            level = s if level is None else 0.5 * s + 0.5 * level
            streak = streak + 1 if level >= bar else 0
            left = 5 if streak >= 2 else max(left - 1, 0)
            want.append(int(left > 0))
        assert [getattr(r, name) for r in out] == want
    assert all(r.high <= r.low for r in out)


def test_rolling_threshold_equals_pandas(spark):
    import pandas as pd

    df, rows = panel(spark, "2024-01-01T00:00", "2024-01-20T00:00", 3600, null_share=0.1)
    got = [r.threshold for r in policies.rolling_threshold(df, "score", 0.9, 3 * 86400, 12).orderBy("t").collect()]
    s = pd.Series([float("nan") if r[2] is None else r[2] for r in rows], index=pd.to_datetime([r[1] for r in rows], unit="s"))
    want = s.rolling("3D", min_periods=12, closed="both").quantile(0.9).shift(1)
    assert all((g is None and w != w) or abs(g - w) < 1e-12 for g, w in zip(got, want))


def test_isolated_spikes_never_latch(spark):
    rows = [("a", i * 600, 1.0 if i % 50 == 49 else 0.1) for i in range(1000)]
    df = spark.createDataFrame(rows, "entity string, t bigint, score double")
    rule = policies.LatchedBudget(minimum_history_rows=20, candidate_run=2, quantile=0.9)
    assert policies.latched_alarms(df, "score", rule).agg({"alarm": "sum"}).first()[0] == 0


def test_latched_budget_holds_per_month_and_is_prefix_invariant(spark):
    df, _ = panel(spark, "2023-12-20T00:00", "2024-01-12T00:00", seed=4)
    rule = policies.LatchedBudget(budget_hours=2.0, minimum_history_rows=50, quantile=0.8, history_seconds=5 * 86400)
    whole = policies.latched_alarms(df, "score", rule)
    per = collect(whole.selectExpr("date_format(timestamp_seconds(t), 'yyyy-MM') AS m", "alarm").groupBy("m").sum("alarm"), "m")
    assert all(0 < n <= 12 for _, n in per) and len(per) == 2
    cut = at("2024-01-03T00:00")
    part = policies.latched_alarms(df.filter(f"t < {cut}"), "score", rule)
    assert collect(whole.filter(f"t < {cut}").select("t", "alarm"), "t") == collect(part.select("t", "alarm"), "t")


def test_capacity_counts_whole_bins():
    assert [policies.capacity_bins(h, 10) for h in (0, 0.1, 1 / 6, 2.5)] == [0, 0, 1, 15]
    with pytest.raises(ValueError):
        policies.capacity_bins(-1, 10)


def rules(**changes):
    import dataclasses

    return dataclasses.replace(controller.ControllerRules(use_price=False, score_threshold=0.0), **changes)


def play(machine, times, onsets=(), seen=True, risk=0.5, utility=0.5):
    """Reference-free replay: one decision list per time."""
    out, queue = [], sorted(onsets)
    for t in times:
        while queue and queue[0] <= t:
            machine.event(queue.pop(0))
        machine.mature(t)
        lo, hi = month(t)
        out.append(machine.decide(t, (EPOCH + dt.timedelta(seconds=t)).strftime("%Y-%m"), int((hi - lo) // 600), int((t - lo) // 600),
                                  (t - lo) / (hi - lo), risk, utility, seen))
    return out


def test_release_at_onset_frees_the_bin():
    m = controller.EntityController(rules(), (1 / 6,))
    a, b = play(m, [at("2024-01-05T00:00"), at("2024-01-05T00:10")], [at("2024-01-05T00:10")])
    assert (a[0].alarm, b[0].alarm) == (1, 1)
    (row,) = m.months()
    assert (row["released"], row["peak_occupied"]) == (1, 1)


def test_one_segment_per_event():
    m = controller.EntityController(rules(dedup_bins=2), (0.5,))
    play(m, [at("2024-01-05T00:00"), at("2024-01-05T00:20"), at("2024-01-05T00:30")], [at("2024-01-05T00:30")])
    assert m.months()[0]["released"] == 1


def test_censored_reservations_stay_with_their_month():
    m = controller.EntityController(rules(), (1.0,))
    play(m, [at("2024-01-31T23:50"), at("2024-02-01T00:00")], seen=False)
    m.mature(at("2024-02-03T00:00"))
    assert [(r["month"], r["pending"]) for r in m.months()] == [("2024-01", 1), ("2024-02", 1)]


def test_mirror_descent_price_and_switch_over():
    hourly = rules(step_minutes=60, horizon_steps=6, method="dual_mirror_descent")
    m = controller.EntityController(hourly, (2.0,))
    t = at("2024-01-01T00:00")
    d = m.decide(t, "2024-01", 744, 0, 0.0, 0.5, 3.0, True)[0]
    assert d.price == pytest.approx((1 - 2 / 744) / math.sqrt(744))
    s = controller.EntityController(rules(method="switch_over", switch_high=0.75, switch_low=0.25), (5.0,))
    first, second = play(s, [at("2024-01-05T00:00"), at("2024-01-20T00:00")])
    assert [(x[0].alarm, x[0].bar) for x in (first, second)] == [(0, 0.75), (1, 0.25)]


@pytest.mark.parametrize("name", sorted(controller.variants(controller.ControllerRules())))
def test_controller_invariants_on_random_data(name):
    """Cap, nesting and the account identity hold for every variant that promises them."""
    import dataclasses

    rule = dataclasses.replace(controller.variants(controller.ControllerRules(score_threshold=0.5))[name], horizon_steps=6)
    rnd = random.Random(11)
    m = controller.EntityController(rule, (0.5, 1.0, 2.0))
    start = at("2024-01-25T00:00")
    onsets = sorted(rnd.sample(range(start, start + 1500 * 600), 25))
    made = [0, 0, 0]
    for i in range(1500):
        t = start + i * 600
        while onsets and onsets[0] <= t:
            m.event(onsets.pop(0))
        m.mature(t)
        lo, hi = month(t)
        ds = m.decide(t, str(lo), int((hi - lo) // 600), int((t - lo) // 600), (t - lo) / (hi - lo), rnd.random(), rnd.random() * 2, rnd.random() < 0.9)
        made = [n + d.alarm for n, d in zip(made, ds)]
        if rule.couple:
            assert ds[0].alarm <= ds[1].alarm <= ds[2].alarm
        if rule.reserve:
            assert all(d.occupied <= d.capacity for d in ds)
    rows = m.months()
    assert sum(r["actions"] for r in rows) == sum(made) > 0
    if rule.reserve:
        for r in rows:
            assert r["actions"] == r["confirmed"] + r["pending"] + r["locked"] + r["released"]
    again = controller.EntityController(rule, (0.5, 1.0, 2.0)).load(m.dump())
    assert again.months() == rows


def test_controller_prefix_invariance(spark):
    from pyspark.sql import functions as F

    df, _ = panel(spark, "2024-01-01T00:00", "2024-01-04T00:00")
    rule = rules(score_threshold=0.3, horizon_steps=6)
    rows = controller.with_decision_inputs(df.selectExpr("entity", "t", "array_repeat(score * 0.3D, 6) AS h", "1 AS observed"), "h", rule)
    ev = spark.createDataFrame([("a", at("2024-01-02T03:05")), ("a", at("2024-01-03T00:00"))], "entity string, onset bigint")
    whole = controller.trace_of(controller.run_controller(rows, ev, (1.0, 3.0), rule))
    cut = at("2024-01-02T12:00")
    part = controller.trace_of(controller.run_controller(rows.filter(F.col("t") < cut), ev.filter(F.col("onset") < cut), (1.0, 3.0), rule))
    assert collect(whole.filter(F.col("t") < cut), "t", "budget") == collect(part, "t", "budget")


def test_budget_threshold_counts_ties(spark):
    rows = [("a", at("2024-01-01T00:00") + i * 600, s, 0) for i, s in enumerate([0.9, 0.8, 0.8, 0.8, 0.2, 0.1])]
    df = spark.createDataFrame(rows, "entity string, t bigint, score double, y int")
    for bins, want in ((0, 0.9), (1, 0.8), (3, 0.8), (4, 0.2), (6, None)):
        got = selection.budget_threshold(df, "score", "y", bins / 6, 10).first()
        assert got.threshold == want and got.everything == int(want is None)


def test_monotone_path_never_raises_the_threshold(spark):
    rnd = random.Random(2)
    rows = [(float(b), round(t / 10, 1), 1, rnd.random(), rnd.random()) for b in (2, 5, 10) for t in range(1, 6)]
    df = spark.createDataFrame(rows, "budget double, threshold double, budget_met int, utility double, hit_rate double")
    path = [r.threshold for r in selection.monotone_path(df, [2.0, 5.0, 10.0], ["utility", "hit_rate"]).orderBy("budget").collect()]
    best = max(((a[3] + b[3] + c[3], a[4] + b[4] + c[4]), (a[1], b[1], c[1])) for a in rows[:5] for b in rows[5:10] for c in rows[10:] if a[1] >= b[1] >= c[1])
    assert tuple(path) == best[1]


H = 6 * 3600


def test_strict_grid_ends_before_the_onset(spark):
    ev = spark.createDataFrame([("a", 1, at("2024-01-01T22:30")), ("a", 2, at("2024-01-01T22:28"))], "entity string, event_id int, onset bigint")
    for r in matching.pre_event_windows(ev, 600, H).collect():
        assert r.window_end == at("2024-01-01T22:20") and r.window_end - r.window_start == 350 * 60 and r.expected_bins == 36


def test_onset_resets_split_a_segment(spark):
    t0 = at("2024-01-01T00:00")
    rows = spark.createDataFrame([("a", t0 + i * 3600, 1, 1) for i in range(5)], "entity string, t bigint, alarm int, observed int")
    ev = spark.createDataFrame([("a", 1, t0 + 2 * 3600), ("a", 2, t0 + 5 * 3600)], "entity string, event_id int, onset bigint")
    records, classes = matching.strict_match(rows, ev, "alarm", 3600, 2 * 3600)
    assert classes.select("segment").distinct().count() == 2
    assert [r.hit for r in records.collect()] == [1, 1]
    c = classes.agg({"true_alarm": "sum", "false_alarm": "sum"}).first().asDict()
    assert (c["sum(true_alarm)"], c["sum(false_alarm)"]) == (4, 1)


def test_unobserved_alarms_are_unsettled(spark):
    onset = at("2024-01-01T22:28")
    rows = spark.createDataFrame([("a", at("2024-01-01T22:00") + i * 600, 1, 0) for i in range(3)] + [("a", at("2024-01-02T08:00"), 1, 0)], "entity string, t bigint, alarm int, observed int")
    ev = spark.createDataFrame([("a", 1, onset)], "entity string, event_id int, onset bigint")
    records, classes = matching.strict_match(rows, ev, "alarm", 600, H)
    r = records.first()
    assert (r.evaluable, r.operational, r.hit) == (0, 1, 1)
    got = classes.groupBy().sum("true_alarm", "false_alarm", "unsettled_alarm").first()
    assert tuple(got) == (3, 0, 1)


def test_greedy_pairs_never_reuse(spark):
    rnd = random.Random(8)
    starts = sorted(rnd.sample(range(2000), 80))
    segs = [("a", i, s, s + rnd.randrange(3)) for i, s in enumerate(starts)]
    onsets = sorted(rnd.sample(range(2000), 60))
    s = spark.createDataFrame(segs, "entity string, segment bigint, start bigint, stop bigint")
    e = spark.createDataFrame([("a", i, o) for i, o in enumerate(onsets)], "entity string, event_id int, onset bigint")
    got = collect(matching.greedy_pairs(s, e, 15).select("segment", "event_id"), "segment")
    free, want = dict(enumerate(onsets)), []
    for _, i, start, stop in segs:
        fit = [k for k, o in free.items() if start < o <= stop + 15]
        if fit:
            k = min(fit, key=free.get)
            del free[k]
            want.append((i, k))
    assert got == want


def test_final_episode(spark):
    rows = spark.createDataFrame([("a", i * 600, s) for i, s in enumerate([0.0, 0.0, .8, .8, .8, .8])], "entity string, t bigint, score double")
    ev = spark.createDataFrame([("a", 1, 3600)], "entity string, event_id int, onset bigint")
    from pyspark.sql import functions as F

    r = matching.final_episode_match(rows, ev, F.col("score") >= 0.5, 600, H, 2, 600, 1800).first()
    assert (r.hit, r.lead_hours) == (1, pytest.approx(2 / 3))


def hysteresis_by_row(scores, on, off, run, hold):
    """Row by row: an alarm begins after ``run`` rows at ``on`` and ends with the ``hold``-th row in a row below ``off``."""
    out, streak, weak, alarmed = [], 0, 0, False
    for s in scores:
        if s is None:
            streak, alarmed = 0, False
            out.append(0)
            continue
        streak = streak + 1 if s >= on else 0
        if not alarmed and streak >= run:
            alarmed, weak = True, 0
        out.append(int(alarmed))
        weak = 0 if s >= off else weak + 1
        if alarmed and weak >= hold:
            alarmed, streak = False, 0
    return out


@pytest.mark.parametrize("run, hold, ratio", [(1, 1, 1.0), (2, 3, 0.8), (3, 1, 0.5), (1, 5, 0.9)])
def test_hysteresis_windows_and_clock_equal_the_rows(spark, run, hold, ratio):
    rnd = random.Random(run * 10 + hold)
    levels, rows = {}, []
    for e in range(4):
        levels[e] = [None if rnd.random() < 0.06 else round(rnd.random(), 2) for _ in range(300)]
        rows += [(e, i * 600, s, 1) for i, s in enumerate(levels[e])]
    policy = policies.CandidatePolicy("hysteresis", threshold=0.6, off_ratio=ratio, minimum_run=run, hold_bins=hold)
    df = spark.createDataFrame(rows, "entity int, t bigint, score double, _kept int")
    got = policies.candidates(df, "score", policy).orderBy("entity", "t").collect()
    want = [a for e in range(4) for a in hysteresis_by_row(levels[e], 0.6, 0.6 * ratio, run, hold)]
    assert [r.candidate for r in got] == want and 0 < sum(want) < len(want)
    for e in range(4):
        clock = policies.HysteresisClock()
        assert [clock.alarm(policy, math.nan if s is None else s, 0.6) for s in levels[e]] == hysteresis_by_row(levels[e], 0.6, 0.6 * ratio, run, hold)


def test_several_quantiles_share_one_window(spark):
    df, rows = panel(spark, "2024-01-01T00:00", "2024-01-12T00:00", 3600, null_share=0.2)
    both = policies.rolling_thresholds(df, "score", {"lo": 0.25, "hi": 0.9}, 2 * 86400, 8).orderBy("t").collect()
    for name, q in (("lo", 0.25), ("hi", 0.9)):
        for i, r in enumerate(both):
            seen = sorted(s for _, t, s in rows[:i] if s is not None and t >= rows[i - 1][1] - 2 * 86400)
            if i == 0 or len(seen) < 8:
                assert r[name] is None
            else:
                place = q * (len(seen) - 1)
                k = int(place)
                assert abs(r[name] - (seen[k] + (seen[min(k + 1, len(seen) - 1)] - seen[k]) * (place - k))) < 1e-12


def test_policies_under_caps_share_one_ordering_of_the_rows(spark):
    rows = spark.range(2000).selectExpr("id % 7 AS entity", "1706572800 + 3600 * (id DIV 7) AS t", "CAST(id * 37 % 11 > 4 AS BIGINT) AS `a/1`", "CAST(id % 5 > 1 AS BIGINT) AS b")
    caps = {"20": policies.SafeBudget(60, 20.0, 4.0), "40": policies.SafeBudget(60, 40.0, 4.0)}
    many = policies.capped_many(rows, ["a/1", "b"], caps)
    assert many._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    for name in ("a/1", "b"):
        for cap, rule in caps.items():
            one = policies.paced_cap(rows.selectExpr("entity", "t", f"`{name}` AS candidate"), "candidate", rule).select("entity", "t", "candidate", "alarm")
            mine = many.filter((F.col("policy") == name) & (F.col("cap") == cap)).select("entity", "t", "candidate", "alarm")
            assert one.exceptAll(mine).count() == 0 and mine.count() == 2000
    sums = many.groupBy("policy", "cap").agg(F.sum("candidate"), F.sum("alarm")).collect()
    assert sorted(map(tuple, sums)) == sorted(map(tuple, policies.capped_totals(rows, ["a/1", "b"], caps).collect()))
    assert policies.capped_totals(rows.limit(0), ["b"], caps).count() == 0


def test_rules_with_thresholds_as_numbers_share_one_parting(spark):
    rows = spark.range(1500).selectExpr("id % 5 AS entity", "3600 * (id DIV 5) AS t", "CASE WHEN id * 7 % 31 <> 0 THEN id * 37 % 101 / 100.0D END AS s")
    rules = {"a": (0.5, 1, 1, 0.8), "b": (0.5, 2, 3, 0.8), "c": (0.8, 1, 2, 0.9)}
    together = policies.hysteresis_many(rows, "s", rules)
    assert together._jdf.queryExecution().optimizedPlan().toString().count("row_number()") == 1
    apart = policies.hysteresis_many(rows.selectExpr("*", "0.5D AS x", "0.8D AS y"), "s", {n: ("x" if r[0] == 0.5 else "y", *r[1:]) for n, r in rules.items()}).drop("x", "y")
    assert together.exceptAll(apart).count() == 0 and together.filter("a = 1 AND b = 0").count() > 0
