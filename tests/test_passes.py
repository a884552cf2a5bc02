"""Steps that run once down a partition, or once over a table, instead of once per group or pass."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import matching, metrics, models, policies
from tidewatch.plans import workflows


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_greedy_pairs_of_many_entities_in_one_pass(spark):
    rng = random.Random(4)
    segments, events, want = [], [], []
    for entity in range(30):
        mine = sorted(rng.sample(range(0, 400, 10), rng.randrange(0, 9)))
        segs = [(entity, i, a, a + rng.choice((0, 5))) for i, a in enumerate(mine)]
        evs = sorted((o, f"{entity}-{o}") for o in rng.sample(range(400), rng.randrange(0, 9)))
        segments += segs
        events += [(entity, e, o) for o, e in evs] + [(entity, "none", None)]
        used = set()
        for _, seg, start, stop in segs:
            later = [(o, e) for o, e in evs if o > start and o not in used and all(o > u for u in used)]
            if later and later[0][0] <= stop + 15:
                used.add(later[0][0])
                want.append((entity, seg, start, later[0][1]))
    rng.shuffle(segments)
    rng.shuffle(events)
    pairs = matching.greedy_pairs(spark.createDataFrame(segments, "entity long, segment long, start long, stop long"), spark.createDataFrame(events, "entity long, event_id string, onset long"), 15)
    assert sorted(tuple(r) for r in pairs.collect()) == sorted(want) and want
    assert "CoGroup" not in _plan(pairs)


def _scores(spark):
    rng = random.Random(9)
    rows = [(e, 3600 * k, None if rng.random() < 0.1 else rng.random()) for e in range(7) for k in range(rng.randrange(1, 90)) if rng.random() < 0.9]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "entity long, t long, score double").repartition(3)


def test_smoothing_runs_down_a_partition(spark):
    rows, df = _scores(spark)
    smooth = policies.causal_ema(df, "score", 0.3)
    want, level, before = {}, None, None
    for e, t, value in sorted(rows, key=lambda r: r[:2]):
        level = value if e != before or level is None or value is None else 0.3 * value + (1 - 0.3) * level
        want[e, t], before = level, e
    assert {(r.entity, r.t): r.smoothed for r in smooth.collect()} == want
    assert smooth.columns == [*df.columns, "smoothed"] and "FlatMapGroups" not in _plan(smooth)


def test_latches_run_down_a_partition(spark):
    _, df = _scores(spark)
    rule = policies.LatchedBudget(60, 6.0, 86400, 0.5, 2, 2.0, 2, 3)
    staged = df.filter("score IS NOT NULL").withColumn("threshold", F.lit(0.3))
    alarms = policies.latched_on(staged, "score", rule)
    assert "FlatMapGroups" not in _plan(alarms) and not {"_first", "_month"} & set(alarms.columns)
    found = alarms.orderBy("entity", "t").collect()
    want, state, before = [], None, None
    for r in found:
        if r.entity != before:
            state, before = [0, 0, 0], r.entity
        spent, streak, latch = state
        streak, room, alarm = streak + 1 if r.score > 0.3 else 0, spent < r.allowance, 0
        if latch:
            latch, alarm = (latch - 1, 1) if room else (0, 0)
        elif room and streak >= 2:
            latch, alarm = 2, 1
        state = [spent + alarm, streak, latch]
        want.append(alarm)
    assert [r.alarm for r in found] == want and 0 < sum(want) < len(want)


def test_equal_rows_are_fitted_once(spark):
    rng = random.Random(2)
    rows = [(float(rng.randrange(3)), float(rng.randrange(2)), int(rng.random() < 0.3), 1.0 + k % 3) for k in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, y int, w double")
    alike = models.rows_alike(df, ["a", "b"], "y", "w")
    assert alike.count() == 12 and alike.agg(F.max("w")).first()[0] == 1
    whole, few = (models.fit_glm(x, ["a", "b"], "y", "w") for x in (df, alike))
    assert few.values == pytest.approx(whole.values, rel=1e-6) and few.intercept == pytest.approx(whole.intercept, rel=1e-6)


def test_candidates_of_one_panel_are_judged_as_before(spark):
    """Windows and months counted once on the panel, or candidate by candidate: the same records and table."""
    rng = random.Random(6)
    panel = spark.createDataFrame([(e, 3600 * k, int(k < 80)) for e in range(6) for k in range(90) if e != 3 or k % 4], "entity long, t long, observed int")
    events = spark.createDataFrame([(e, 100 * e + i, o) for e in range(7) for i, o in enumerate(rng.sample(range(0, 360000), 12))], "entity long, event_id long, onset long")
    alarms = panel.withColumn("candidate", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("never")))).withColumn(
        "alarm", F.when(F.col("candidate") == "never", 0).otherwise((F.xxhash64("candidate", "entity", F.expr("t DIV 7200")) % 4 == 0).cast("int")))
    before, after = workflows.evaluate(alarms, events, 4.0), workflows.evaluate(alarms, events, 4.0, panel)
    for a, b in zip(before, after):
        names = sorted(a.columns)
        rows = [sorted([round(v, 9) if isinstance(v, float) else v for v in r].__repr__() for r in x.select(*names).collect()) for x in (a, b)]
        assert rows[0] == rows[1] and rows[0]


def test_trees_over_rows_of_bins_are_those_over_the_rows(spark):
    df = spark.range(3000).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS a", "CASE WHEN id % 11 <> 0 THEN CAST(id * 13 % 5 AS DOUBLE) END AS b",
                                      "CAST(id * 31 % 40 AS DOUBLE) AS c", "CAST(id % 7 > 3 AND id * 13 % 5 > 1 AND id % 17 <> 0 AS INT) AS y")
    edges = models.feature_edges(df, ["a", "b", "c"])
    assert edges["a"] == [k + 0.5 for k in range(6)] and edges["b"] == [k + 0.5 for k in range(4)] and 25 < len(edges["c"]) < 32
    alike = models.rows_of_bins(df, edges, ["y"])
    assert alike.agg(F.sum("n")).first()[0] == 3000 and alike.count() < 2500
    trees = models.fit_boosted_binned(alike, edges, "y", "n", 3.0, 4, 3)
    plain = models.score_boosted(models.fit_boosted(models.binned(df, edges), ["a", "b", "c"], "y", 3.0, 4, 3), models.binned(df, edges), ["a", "b", "c"])
    merged = models.score_boosted_binned(trees, alike).withColumnRenamed("risk", "other")
    both = plain.join(merged, ["y", "a", "b", "c"])
    assert both.count() == 3000 and both.agg(F.max(F.abs(F.col("risk") - F.col("other")))).first()[0] < 1e-9


def test_rows_that_stand_for_several_have_the_metrics_of_all(spark):
    rows = [(0, 0.2, 0, 3), (0, 0.7, 1, 2), (0, 0.7, 0, 1), (1, 0.4, 1, 4), (1, 0.1, 0, 5)]
    counted = spark.createDataFrame(rows, "g int, p double, y int, n long")
    spread = counted.selectExpr("g", "p", "y", "explode(sequence(1L, n)) AS k").drop("k")
    found = [metrics.probability_metrics(counted, "p", "y", "n", ("g",), n="n"), metrics.probability_metrics(spread, "p", "y", None, ("g",))]
    one, other = ([[round(v, 12) if isinstance(v, float) else v for v in r] for r in f.orderBy("g").collect()] for f in found)
    assert one == other and [r[found[0].columns.index("rows_n")] for r in one] == [6, 9]
