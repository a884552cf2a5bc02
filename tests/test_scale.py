"""Behaviour that small tables alone would not show: slicing, growth, convergence, shipping."""

import math
import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import trajectory
from tidewatch.operators import bootstrap, controller, joins, metrics, models, sampling, scan, structured
from tidewatch.plans import catalog, streaming_queries
from tidewatch.plans.policy_queries import RULES, controller_inputs
from tidewatch.plans.standins import scored
from tidewatch.session import materialize, shared_dir
from tidewatch.sources import logs

ROOT = "/root/testdata/sf0.001"


def test_panel_and_controller_inputs_are_spread(spark):
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert scored(spark, ROOT).rdd.getNumPartitions() >= places > 1
    assert controller_inputs(spark, ROOT).rdd.getNumPartitions() >= places
    sizes = scored(spark, ROOT).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) > 1


def test_text_ranks_are_sliced_by_the_text(spark):
    keys = [f"station-{i:08d}" for i in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "entity string")
    bounds = scan._bounds(df.groupBy("entity").count(), "entity", (), 100).first()["_bounds"]
    assert len(bounds) == 29 and bounds == sorted(bounds)
    sizes = np.diff(np.searchsorted(keys, ["", *bounds, "z"]))
    assert sizes.max() < 400
    ranks = scan.running_totals(df, "entity", {"n": F.lit(1)}, slice_values=100)
    assert [(r.entity, r.n_cum) for r in ranks.orderBy("entity").collect()] == [(k, i + 1) for i, k in enumerate(keys)]


def test_groups_of_different_range_have_bounds_of_their_own(spark):
    rows = [("narrow", i / 1e6) for i in range(2000)] + [("wide", float(i * 1000)) for i in range(2000)] + [(None, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r["_by_g"]: len(r["_bounds"]) for r in scan._bounds(df.groupBy("g", "v").count(), "v", ("g",), 100).collect()}
    assert found == {"narrow": 19, "wide": 19, None: 0}
    for down in (False, True):
        got = scan.running_totals(df, "v", {"n": F.lit(1)}, ("g",), descending=down, slice_values=100)
        want = {}
        for g in ("narrow", "wide"):
            for i, v in enumerate(sorted((v for k, v in rows if k == g), reverse=down)):
                want[g, v] = i + 1
        assert {(r.g, r.v): r.n_cum for r in got.where("g IS NOT NULL").collect()} == want


def test_bounds_are_searched_in_two_steps(spark):
    rows = [(g, float(i)) for g in ("a", "b") for i in range(3000 if g == "a" else 40)]
    df = spark.createDataFrame(rows, "g string, v double")
    for down in (False, True):
        for by in ((), ("g",)):
            got = scan.running_totals(df, "v", {"n": F.lit(1)}, by, descending=down, slice_values=10)
            assert "_coarse" in got._jdf.queryExecution().optimizedPlan().toString()
            want = {}
            for g in ("a", "b") if by else (None,):
                total = 0
                for v in sorted({v for h, v in rows if g in (None, h)}, reverse=down):
                    total += sum(1 for h, u in rows if u == v and g in (None, h)) if v < 40 else 1
                    want[(g, v) if by else (v,)] = total
            assert {tuple(r[c] for c in (*by, "v")): r.n_cum for r in got.collect()} == want


def test_no_side_is_broadcast_by_estimate(spark):
    # The grid behind this query is estimated at the size of the few rows it is exploded from.
    plan = catalog.load()["sp3_uniform_negatives"].run(spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Broadcast" not in plan


def test_counts_of_a_block_meet_its_sums_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(bootstrap, "entity_counts", lambda *a: seen.append(a))
    sums = spark.createDataFrame([(f"s{i}", 4, 2) for i in range(9)], "entity string, n int, hits int")
    drawn = bootstrap.replicate_totals(sums, ["n", "hits"], 25, "x")
    assert not seen and "Join" not in drawn._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.n, r.hits) for r in drawn.collect()} == {(36.0, 18.0)}


def test_a_score_of_one_value_is_summed_in_chunks(spark, monkeypatch):
    df = spark.createDataFrame([(f"e{i % 5}", 0.5, int(i % 4 == 0), 1.0) for i in range(60)], "entity string, a double, y int, w double")
    whole = {r.replicate: r.value for r in bootstrap.average_precision_draws(df, ["a"], "y", "w", 9, "ap").collect()}
    monkeypatch.setattr(bootstrap, "CELLS_AT_ONCE", 2)
    again = {r.replicate: r.value for r in bootstrap.average_precision_draws(df, ["a"], "y", "w", 9, "ap").collect()}
    # With one value the precision is the share of events among the rows drawn.
    assert whole == pytest.approx(again) and all(0 < v < 1 for v in whole.values()) and len(whole) == 9


def test_gradients_hold_the_terms_that_entities_have():
    values = {"y": [1.0, 0.0], "w": [1.0, 2.0], "n": [2, 1], "i": [7, 999_999, 7], "v": [1.0, 2.0, 3.0]}
    rows = structured._Rows(pa.RecordBatch.from_pydict({k: [v] for k, v in values.items()}), 0)
    assert rows.terms.tolist() == [7, 999_999] and rows.total(np.array([1.0, 2.0, 4.0])).tolist() == [5.0, 2.0]


def test_a_pass_moves_only_the_terms_that_are_there(spark):
    packed = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 1.0], [1, 1], [0, 3], [1.0, 2.0])], "entity int, y array<double>, w array<double>, n array<int>, i array<int>, v array<double>")
    size = 200_000
    problem = structured.Problem("a", np.zeros(size), np.zeros(size), np.full(size, -np.inf), np.full(size, np.inf))
    moved = []
    as_arrow = type(packed).toArrow
    try:
        type(packed).toArrow = lambda self: moved.append(as_arrow(self)) or moved[-1]
        loss, grad, bend = structured._pass(packed, [problem], np.zeros((1, size)))
    finally:
        type(packed).toArrow = as_arrow
    assert np.flatnonzero(grad[0]).tolist() == [0, 3] == np.flatnonzero(bend[0]).tolist() and loss[0] > 0
    assert moved[0].num_rows == 6


def test_crowded_points_meet_in_smaller_cells(spark):
    side = 60
    points = spark.range(side * side).selectExpr("id AS station", "50 + (id DIV 60) * 0.001D AS lat", f"10 + (id % {side}) * 0.001D AS lon")
    size = joins._first_cell(points, 2, 0.1, 4.0)
    y, x = F.floor((F.col("lat") + 90) / size), F.floor(F.col("lon") / size)
    assert size < 0.01 and points.groupBy(y, x).count().agg(F.max("count")).first()[0] < 40
    assert joins._first_cell(points.filter("station < 4"), 2, 0.1, 4.0) == 0.1
    got = joins.nearest_neighbours(points, "station", 2)
    assert got.count() == 2 * side * side and got.agg(F.max("distance_km")).first()[0] < 0.13


def test_student_t_has_no_last_row(spark):
    for df, t in ((1, 12.7062), (2, 4.30265), (5, 2.57058), (14, 2.14479), (30, 2.04227), (1000, 1.96234)):
        assert metrics.student_t(0.975, df) == pytest.approx(t, abs=1e-4)
    rows = [(m, s, 0.1 * s + (0.01 if m == "new" else 0.0) * (s % 3)) for m in ("old", "new") for s in range(15)]
    got = metrics.paired_seed_differences(spark.createDataFrame(rows, "model string, seed int, score double"), "old", {"score": "higher"}).first()
    assert got.seeds == 15 and got.low < got.mean_difference < got.high


def test_no_row_is_too_late_for_the_pieces(spark):
    first = scored(spark, ROOT).agg(F.min("t")).first()[0]
    rows = spark.createDataFrame([(1, first + d * 86400) for d in (0, 9, 10, 25, 9_999, 10_001, 40_000)], "entity bigint, t bigint")
    assert sum(p.count() for p in streaming_queries._time_chunks(rows, spark, ROOT)) == rows.count()


@pytest.mark.parametrize("link", ["cloglog", "logit"])
@pytest.mark.parametrize("prevalence", [0.2, 0.5, 0.9])
def test_bounded_calibration_settles(spark, link, prevalence):
    rng = np.random.default_rng(3)
    y = (rng.random(4000) < prevalence).astype(float)
    eta = rng.normal(size=4000) + 0.05 * y
    df = materialize(spark.createDataFrame([(float(e), int(v)) for e, v in zip(eta, y)], "eta double, y int"), "calibration")
    fit = models.calibrate(df, "eta", "y", None, link, (0.5, 10.0))
    assert fit.values == (0.5,)
    line = fit.intercept + 0.5 * eta
    if link == "logit":
        p = 1 / (1 + np.exp(-line))
        assert p.mean() == pytest.approx(y.mean(), abs=1e-6)
    else:
        rate = np.exp(line)
        p = -np.expm1(-rate)
        assert np.mean(np.where(y > 0, rate * (1 - 1 / p), rate)) == pytest.approx(0.0, abs=1e-6)


def haversine(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return round(2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h))), 4)


def test_neighbours_wrap_round_the_globe(spark):
    rng = np.random.default_rng(5)
    points = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(120)]
    points += [(200, 0.0, 179.99), (201, 0.0, -179.99), (202, 0.0, 179.93), (203, 89.9, 10.0), (204, 89.9, -170.0), (205, -90.0, 0.0), (206, -89.95, 90.0), (207, 10.0, 180.0), (208, 10.0, -180.0)]
    got = {}
    for r in joins.nearest_neighbours(spark.createDataFrame(points, "id bigint, lat double, lon double"), "id", 3).collect():
        got.setdefault(r.target_id, []).append((r.distance_rank, r.distance_km))
    for a in points:
        want = sorted(haversine(a, b) for b in points if b[0] != a[0])[:3]
        assert [d for _, d in sorted(got[a[0]])] == pytest.approx(want, abs=0.02)


def test_few_points_still_get_what_there_is(spark):
    df = spark.createDataFrame([(1, 50.0, 8.0), (2, -50.0, -170.0)], "id bigint, lat double, lon double")
    assert joins.nearest_neighbours(df, "id", 5).count() == 2 and joins.nearest_neighbours(df.limit(0), "id", 5).count() == 0


def test_holdouts_balance_every_city(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"c{int(rng.integers(7))}", int(rng.integers(0, 50))) for i in range(400)]
    got = sampling.spatial_holdouts(spark.createDataFrame(rows, "station bigint, city string, events bigint"), 5).collect()
    assert sorted(r.station for r in got) == list(range(400))
    for city in {r.city for r in got}:
        counts = np.bincount([r.fold for r in got if r.city == city], minlength=5)
        assert counts.max() - counts.min() <= 1
    events = np.bincount([r.fold for r in got], weights=[r.events for r in got], minlength=5)
    assert events.max() - events.min() < 0.1 * events.mean()


def test_trajectory_audit_looks_at_every_step(spark):
    h = [0.1, 0.2, 0.3]
    f = [0.1, 0.28, 0.496]
    rows = [(1, 1, h, f), (2, 1, h, [0.1, 0.3, 0.496]), (3, 1, h, [0.1, float("inf"), 0.496]), (4, 1, h[:2], f[:2])]
    df = spark.createDataFrame(rows, "entity bigint, t bigint, h array<double>, f array<double>").withColumn("key", F.struct("entity", "t"))
    found = trajectory.audit(df, "h", "f", "key", "entity", "t", 3, 10).first()
    assert (found.incoherent, found.missing, found.short, found.passed) == (2, 1, 1, 0)
    assert trajectory.audit(df.where("entity = 1"), "h", "f", "key", "entity", "t", 3, 10).first().passed == 1
    assert trajectory.audit(df.where("entity = 1"), "h", "f", "key", "entity", "t", 3, 10, contract=(36, 10)).first().passed == 0


def test_subsamples_match_one_by_one(spark):
    blocks = spark.createDataFrame([(e, b) for e in range(4) for b in range(e + 1)], "entity bigint, block bigint")
    many = {(r.entity, r.block): set(r.replicates) for r in bootstrap.subsample_members(blocks, 0.5, 4, "x").collect()}
    for k in range(4):
        one = {(r.entity, r.block) for r in bootstrap.block_subsample(blocks, 0.5, f"x-{k}").collect()}
        assert one == {key for key, inside in many.items() if k in inside}


def test_stream_state_does_not_grow_with_the_months():
    machine = controller.EntityController(RULES, (5.0, 20.0))
    sizes = []
    for month in range(24):
        for step in range(60):
            now = (month * 720 + step * 12) * 3600
            machine.mature(now)
            machine.decide(now, f"m{month:02d}", 720, step * 12, step / 60, 0.9, 5.0, True)
            machine.forget_closed_months(f"m{month:02d}")
            if step % 7 == 0:
                machine.event(now + 1800)
        sizes.append(len(repr(machine.dump())))
    assert max(sizes[2:]) <= 1.2 * max(sizes[:2])


def test_a_cluster_without_a_shared_folder_is_refused():
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="share"):
        shared_dir(fake)


def test_workers_can_import_the_package_from_anywhere(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from tidewatch.session import build_session
from tidewatch.operators import policies
spark = build_session("2", 2)
rows = spark.createDataFrame([(1, 3600 * i, 0.1 * i) for i in range(9)], "entity bigint, t bigint, score double")
print("rows", policies.causal_ema(rows, "score", 0.5).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env | {"TIDEWATCH_DRIVER_MEMORY": "2g"}, capture_output=True, text=True, timeout=200)
    assert "rows 9" in out.stdout, out.stderr[-1500:]


def test_logs_are_read_in_the_encoding_their_bytes_show(spark, tmp_path):
    for year, name, encoding, first in ((2022, "山站20220101_20221231", "utf-8", "--"), (2023, "海站20230101_20231231", "gb18030", "甲")):
        folder = tmp_path / str(year)
        folder.mkdir()
        (folder / f"{name}.csv").write_bytes(f"a,b\n{first},1\n乙{'丙' * 40000},2\n".encode(encoding))
    path = f"file://{tmp_path}"
    (tmp_path / "2023" / "plain.csv").write_bytes(b"a,b\n" + b"x,1\n" * 30_000 + "丁,3\n".encode("gb18030"))  # its only wide bytes come last
    rows = logs.read_mixed_log(spark, path, ["a", "b"])
    found = {tuple(r) for r in rows.select("source_encoding", F.regexp_extract(F.url_decode("source_file"), r"/(\d{4})/", 1)).distinct().collect()}
    assert found == {("UTF-8", "2022"), ("GB18030", "2023")} and rows.where("a = '丁' AND b = '3'").count() == 1
    rows = rows.where("source_file NOT LIKE '%plain%'")
    assert rows.where("a LIKE '乙%'").count() == 2 and rows.where("a = '甲'").count() == 1
    names = rows.select(logs.station_from_path(F.url_decode("source_file"))).distinct().collect()
    assert {r[0] for r in names} == {"山站", "海站"}
    catalog = logs.source_catalog(logs.read_text_log(spark, f"{path}/2022", ["a", "b"], position=True), ["a"]).first()
    assert catalog.rows == 2 and catalog.a.startswith("乙")
