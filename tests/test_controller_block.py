"""Entities decided side by side against the machine of one entity."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from tidewatch.functions import clock
from tidewatch.operators import controller

RULES = controller.ControllerRules(step_minutes=60, horizon_steps=5, score_threshold=0.3)
BUDGETS = (2.0, 4.0, 7.0)
START = 1706572800  # two days before a month's end


def _panel(seed: int) -> tuple[dict[int, list[tuple]], dict[int, list[int]]]:
    """Panels of unequal length with gaps and rows off the grid; onsets in rows' seconds, between them, in crowds and outside."""
    rng = random.Random(seed)
    rows, onsets = {}, {}
    for entity in range(9):
        times = [START + 3600 * k + rng.choice((0, 0, 0, 600)) for k in range(rng.choice((1, 40, 110))) if rng.random() < 0.9] or [START]
        rows[entity] = [(t, rng.random(), rng.random() * 3, int(rng.random() < 0.8), rng.choice((None, 0, 1))) for t in times]
        onsets[entity] = [t + rng.choice((-20000, 0, 1, 1800)) for t in times if rng.random() < 0.15] * rng.choice((0, 1, 2))
    onsets[99] = [START]
    return rows, onsets


def _frames(spark, rows, onsets):
    panel = spark.createDataFrame([(e, *r) for e, mine in rows.items() for r in mine], "entity long, t long, risk double, utility double, observed int, mark int")
    start, end = clock.month_start("t"), clock.month_end("t")
    panel = panel.withColumns({"month": clock.month_key("t"), "month_bins": F.floor((end - start) / 3600), "bin_index": F.floor((F.col("t") - start) / 3600),
                               "elapsed": (F.col("t") - start) / (end - start)})
    return panel.cache(), spark.createDataFrame([(e, o) for e, mine in onsets.items() for o in mine], "entity long, onset long")


def _plain(panel, onsets, rule, given):
    """The same by the machine of one entity."""
    trace, months = [], []
    held = {}
    for r in panel.orderBy("entity", "t").collect():
        held.setdefault(r.entity, []).append(r)
    for entity, mine in held.items():
        machine, todo = controller.EntityController(rule, BUDGETS), sorted(onsets[entity])
        for r in mine:
            while todo and todo[0] <= r.t:
                machine.event(todo.pop(0))
            machine.mature(r.t)
            choice = tuple(bool(r[given[b]]) if b in given else None for b in BUDGETS) if given else None
            for d in machine.decide(r.t, r.month, r.month_bins, r.bin_index, r.elapsed, r.risk, r.utility, r.observed >= 1, choice):
                trace.append((entity, r.t, *d, r.risk, r.utility))
        months += [(entity, *sorted((k, v) for k, v in m.items() if k != "last_bin")) for m in machine.months()]
    return sorted(trace), sorted(months)


def test_blocks_decide_like_one_entity_after_another(spark, monkeypatch):
    monkeypatch.setattr(controller, "BLOCK_ROWS", 60)  # several blocks, some cut within an entity
    rows, onsets = _panel(3)
    panel, events = _frames(spark, rows, onsets)
    rules = controller.variants(RULES) | {"no_reserve_kept": replace(RULES, reserve=False, release=False), "dear": replace(RULES, price_initial=0.4, price_rate=3.0, horizon_steps=9)}
    for given in ({}, {2.0: "mark", 7.0: "mark"}):
        result = controller.run_controllers(panel, events, BUDGETS, rules, given=given).cache()
        trace, months = controller.trace_of(result).collect(), controller.months_of(result).collect()
        for name, rule in rules.items():
            want_trace, want_months = _plain(panel, onsets, rule, given)
            assert sorted(tuple(r)[1:] for r in trace if r.method == name) == want_trace, name
            found = []
            for r in months:
                if r.method == name:
                    d = {k: v for k, v in r.asDict().items() if k not in ("method", "entity", "hard_budget_met", "unsettled")} | {"pending": r.unsettled}
                    found.append((r.entity, *sorted(d.items())))
            assert sorted(found) == want_months, name
            assert any(r[5] for r in want_trace), name


def test_alarms_alone_and_no_trace_at_all(spark):
    rows, onsets = _panel(5)
    panel, events = _frames(spark, rows, onsets)
    whole = controller.run_controller(panel, events, BUDGETS, RULES).cache()
    alarms = controller.trace_of(controller.run_controller(panel, events, BUDGETS, RULES, trace="alarms")).collect()
    assert alarms and sorted(alarms) == sorted(controller.trace_of(whole).filter("alarm = 1").collect())
    none = controller.run_controller(panel, events, BUDGETS, RULES, trace="none")
    assert none.filter("kind = 't'").count() == 0
    assert sorted(controller.months_of(none).collect()) == sorted(controller.months_of(whole).collect())


def test_a_task_starts_no_group_per_entity(spark):
    """One pass over a partition, not a grouped map that starts anew for each entity."""
    rows, onsets = _panel(7)
    panel, events = _frames(spark, rows, onsets)
    plan = controller.run_controller(panel, events, BUDGETS, RULES)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan
