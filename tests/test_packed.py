"""Packed fits in groups, coefficients as columns, and candidates that hand over their alarms only."""

import dataclasses
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import controller, models, structured
from tidewatch.plans import model_queries, workflows


def test_equal_rows_of_an_entity_are_one_with_their_weight():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 4, 300)
    i = np.concatenate([rng.choice([3, 5, 9], k, replace=False) for k in n])
    v, y, w = rng.integers(1, 3, len(i)).astype(float), rng.integers(0, 2, 300).astype(float), rng.random(300)
    member = rng.integers(0, 2, (2, 300)).astype(float)
    one = structured._rows_alike(y, w, n, i, v, member)
    assert len(one["y"]) < 250 and one["terms"].tolist() == [3, 5, 9] and one["w"].sum() == pytest.approx(w.sum())
    beta = np.array([0.3, -0.2, 0.1])
    owner = np.repeat(np.arange(300), n)
    eta = np.bincount(owner, weights=v * beta[np.searchsorted([3, 5, 9], i)], minlength=300)
    few = np.bincount(one["owner"], weights=one["v"] * beta[one["place"]], minlength=len(one["y"]))
    for k in range(2):
        assert (w * member[k] * np.exp(eta) * (1 + y)).sum() == pytest.approx((one["w"] * one["member"][k] * np.exp(few) * (1 + one["y"])).sum())


def test_fits_with_many_coefficients_go_in_groups(spark, monkeypatch):
    rows = [(k % 3, k, float(k % 5 == 0 or k % 7 == 0), 1.0, [(0, 1.0), (1, float(k % 4))]) for k in range(200)]
    packed = structured.pack(spark.createDataFrame(rows, "entity long, t long, y double, w double, x array<struct<i:int,v:double>>"))
    one = structured.Problem("p", np.array([0, 0.1]), np.zeros(2), np.full(2, -np.inf), np.full(2, np.inf))
    problems = [dataclasses.replace(one, name=f"p{k}", l2=np.array([0, 0.1 * (k + 1)])) for k in range(3)]
    together = structured.solve(packed, problems)
    seen, run = [], structured._pass
    monkeypatch.setattr(structured, "AT_ONCE", 4)
    monkeypatch.setattr(structured, "_pass", lambda p, some, b: seen.append(len(some)) or run(p, some, b))
    apart = structured.solve(packed, problems)
    assert max(seen) == 2 and [s.name for s in apart] == ["p0", "p1", "p2"]
    for a, b in zip(together, apart, strict=True):
        assert a.values == pytest.approx(b.values, abs=1e-12) and a.passes == b.passes


def test_coefficients_come_to_tables_as_columns(spark, monkeypatch):
    given, make = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: given.append(type(data)) or make(self, data, *a, **k))
    names = ["local::bias", "graph::1->2::lag60m"]
    frame = model_queries.coefficient_frame(spark, names, structured.Solution("s", np.array([0.5, 0.0]), 0.0, np.zeros(2), 0.0, 1, True))
    assert sorted(tuple(r) for r in frame.collect()) == [("graph::1->2::lag60m", 0.0), ("local::bias", 0.5)]
    base = spark.range(1).selectExpr("id AS entity", "0 AS label", "1.0D AS w")
    long = spark.range(1).selectExpr("id AS entity", "'graph::1->2::lag60m' AS feature", "2.0D AS value")
    rows = models.sparse_rows(base, ["entity"], {"local::bias": F.lit(1.0)}, long, names, "label", "w").first()
    assert [tuple(x) for x in rows.x] == [(0, 1.0), (1, 2.0)] and set(given) == {pa.Table}


def test_alarm_rows_suffice_where_names_are_given(spark):
    rng = random.Random(8)
    panel = spark.createDataFrame([(e, 3600 * k, int(k < 80)) for e in (1, 2, None) for k in range(90)], "entity long, t long, observed int")
    events = spark.createDataFrame([(e, 10 * i + (e or 0), o) for e in (1, 2, None) for i, o in enumerate(rng.sample(range(30000, 300000), 8))], "entity long, event_id long, onset long")
    alarms = panel.withColumn("candidate", F.explode(F.array(F.lit("a"), F.lit("never")))).withColumn(
        "alarm", F.when(F.col("candidate") == "never", 0).otherwise((F.xxhash64("entity", F.expr("t DIV 7200")) % 4 == 0).cast("int")))
    before, after = workflows.evaluate(alarms, events, 4.0), workflows.evaluate(alarms.filter("alarm = 1"), events, 4.0, panel, ["a", "never"])
    for a, b in zip(before, after):
        names = sorted(a.columns)
        rows = [sorted([round(v, 9) if isinstance(v, float) else v for v in r].__repr__() for r in x.select(*names).collect()) for x in (a, b)]
        assert rows[0] == rows[1] and rows[0]


def test_rule_sets_of_several_horizons_decide_in_one_pass(spark):
    rows = spark.createDataFrame([(e, 1704067200 + 3600 * k, int(k < 140), ((e * 7 + k * 13) % 20) / 20.0) for e in range(4) for k in range(150)], "entity long, t long, observed int, score double")
    events = spark.createDataFrame([(e, 1704067200 + 3600 * k + 100) for e in range(4) for k in range(5 + e, 140, 17)], "entity long, onset long")
    base = controller.ControllerRules(step_minutes=60, horizon_steps=3, score_threshold=0.3)
    rules = {f"{u}/{h}": dataclasses.replace(base, utility=u, horizon_steps=h) for u in ("linear", "hit_only", "risk") for h in (2, 3)}
    hazard = "array(score * 0.5D, score * 0.25D, score * 0.75D)"
    one = controller.run_controllers(rows, events, (4.0, 9.0), rules, hazard=hazard)
    for name, rule in rules.items():
        alone = controller.run_controllers(controller.with_decision_inputs(rows.withColumn("h", F.expr(hazard)), "h", rule), events, (4.0, 9.0), {name: rule})
        for part in (controller.trace_of, controller.months_of):
            a, b = (sorted(map(str, part(x).filter(F.col("method") == name).collect())) for x in (one, alone))
            assert a == b and a
    alarms = controller.alarms_of(one)
    wrong = alarms.join(rows.withColumnRenamed("observed", "known"), ["entity", "t"]).filter("observed <> known OR alarm <> 1")
    assert alarms.count() > 0 and wrong.isEmpty()
