import datetime as dt
import itertools

from conftest import collect
from pyspark.sql import functions as F

from tidewatch.operators import episodes, joins, matching, risk, temporal
from tidewatch.operators.temporal import EventClock, event_clocks

T0 = int(dt.datetime(2022, 1, 1, tzinfo=dt.timezone.utc).timestamp())
RULES = episodes.EpisodeRules()
SCHEMA = "entity string, t bigint, thickness double, temp double, rh double, vis double, fog int, exposed int, seq int"


def positives(spark, rows):
    return spark.createDataFrame([("a", T0 + 60 * m, 1.0, temp, 99.0, 100.0, 1, 1, i) for i, (m, temp) in enumerate(rows)], SCHEMA)


def events(spark, rows, rules=RULES):
    return episodes.extract_events(positives(spark, rows), "thickness", 0.0, rules, ["seq"]).orderBy("onset").collect()


def test_gap_of_merge_plus_one_minute_still_merges(spark):
    found = events(spark, [(0, -1.0), (11, -0.5), (30, 8.0)])
    assert [(e.positive_rows, e.valid) for e in found] == [(2, 1), (1, 0)]
    assert found[1].exclusion_reason == "warm_or_missing_temperature"


def test_cooldown_is_tested_at_the_floored_onset(spark):
    assert events(spark, [(0, -1.0), (63, -1.0)])[1].valid == 1
    late = events(spark, [(0, -1.0), (59, -1.0)])[1]
    assert (late.valid, late.exclusion_reason) == (0, "prediction_time_within_cooldown")


def test_duplicate_timestamps_keep_the_last_row(spark):
    df = spark.createDataFrame([("a", T0, 1.0, -1.0, 9.0, 1.0, 0, 0, 1), ("a", T0, 5.0, -1.0, 9.0, 1.0, 0, 0, 2)], SCHEMA)
    e = episodes.extract_events(df, "thickness", 0.0, RULES, ["seq"]).first()
    assert (e.positive_rows, e.max_value) == (1, 5.0)


def test_buckets_equal_row_islands(spark):
    """Bucketed sessionization equals a plain scan over the rows, whatever the bucket."""
    import random

    rnd = random.Random(3)
    minutes = sorted(rnd.sample(range(5000), 600))
    expected = 1 + sum(b - a > 11 for a, b in itertools.pairwise(minutes))
    for bucket in (60, 300, 600):
        import dataclasses

        found = events(spark, [(m, -1.0) for m in minutes], dataclasses.replace(RULES, bucket=bucket))
        assert len(found) == expected


def test_bucket_wider_than_gap_is_refused(spark):
    import dataclasses

    import pytest

    with pytest.raises(ValueError):
        events(spark, [(0, 1.0)], dataclasses.replace(RULES, bucket=3600))


def test_instrument_resolution_smallest_repeated_step(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.01, 0.02, 0.03, 0.04, 0.05])], "entity string, t bigint, thickness double")
    assert episodes.instrument_resolution(df, "thickness").first().resolution == 0.01


def test_persistence_keeps_long_runs_only(spark):
    rows = positives(spark, [(0, 1.0), (1, 1.0), (2, 1.0), (10, 1.0), (20, 1.0)])
    kept = episodes.persistent_buckets(episodes.collapse(rows, "thickness", 60), 3, 120)
    assert collect(kept.select(((F.col("lo") - T0) / 60).cast("int")), "lo") == [(0,), (1,), (2,)]


def test_definition_grid_has_one_reference(spark):
    grid = episodes.definition_grid(spark)
    assert (grid.count(), grid.agg(F.sum("is_reference")).first()[0]) == (36, 1)


def test_order_gaps_skip_invalid_events(spark):
    rows = [("A", 1, 0, 3600, 1), ("A", 2, 40000, 41000, 0), ("A", 3, 172800, 180000, 1), ("B", 4, 0, 10, 1)]
    df = spark.createDataFrame(rows, "entity string, event_id int, onset bigint, ending bigint, valid int")
    got = collect(episodes.order_valid_events(df).select("entity", "event_order", "gap_hours"), "entity", "event_order")
    assert got == [("A", 1, None), ("A", 2, 47.0), ("B", 1, None)]


def test_greedy_match_equals_brute_force(spark):
    import random

    rnd = random.Random(5)
    ref = sorted(rnd.sample(range(20000), 60))
    cand = sorted(rnd.sample(range(20000), 60))
    pairs = sorted((abs(r - c), r, c) for r in ref for c in cand if abs(r - c) <= 300)
    used_r, used_c, want = set(), set(), []
    for shift, r, c in pairs:
        if r not in used_r and c not in used_c:
            used_r.add(r), used_c.add(c), want.append((r, c, shift))
    make = lambda xs: spark.createDataFrame([("e", x) for x in xs], "entity string, onset bigint")
    assert collect(episodes.greedy_match(make(ref), make(cand), 300).select("ref", "cand", "shift"), "ref") == sorted(want)


def test_recurrence_covariates(spark):
    hour = 3600
    ev = spark.createDataFrame([("s", 0, 1800, 31, 2.0, 1), ("s", 3 * hour, 3 * hour + 600, 11, 3.0, 1)],
                               "entity string, onset bigint, ending bigint, elapsed_minutes bigint, max_value double, valid int")
    rows = spark.createDataFrame([("s", t) for t in (0, 900, 1800 + hour, 3 * hour, 3 * hour + 600 + 24 * hour)], "entity string, t bigint")
    for width in (None, 7200):
        out = event_clocks(rows, ev, risk.recurrence_clocks(), slice_seconds=width).withColumns(risk.recurrence_covariates())
        got = collect(out.select("current_event_order", "previous_missing", "gap_hours", "events_past_7d"), "t")
        assert got == [(1, 1, None, 0), (1, 1, None, 1), (2, 0, 1.0, 1), (2, 0, 2.5, 1), (3, 0, 24.0, 2)]


def test_sliced_and_unsliced_clocks_agree(spark):
    import random

    rnd = random.Random(9)
    ev = spark.createDataFrame([("x", rnd.randrange(100000), i) for i in range(300)], "entity string, onset bigint, v int")
    rows = spark.createDataFrame([("x", rnd.randrange(100000)) for _ in range(400)], "entity string, t bigint")
    clocks = [EventClock("seen", F.col("onset"), True, ("onset",)), EventClock("week", F.col("onset") + 5000)]
    a = event_clocks(rows, ev, clocks, slice_seconds=None).selectExpr("t", "seen_n", "week_n", "seen_last.onset")
    b = event_clocks(rows, ev, clocks, slice_seconds=1000).selectExpr("t", "seen_n", "week_n", "seen_last.onset")
    assert collect(a, "t", "seen_n") == collect(b, "t", "seen_n")


def test_forward_sum_and_contiguity(spark):
    df = spark.createDataFrame([("a", i * 600, float(i + 1)) for i in range(4)], "entity string, t bigint, x double")
    total, complete = temporal.forward_sum("x", 2)
    assert collect(df.select(total.alias("s"), complete.alias("c")), "t") == [(5.0, 1), (7.0, 1), (None, 0), (None, 0)]
    run = spark.createDataFrame([("a", 60 * m) for m in (0, 10, 20, 40, 50, 60)], "entity string, t bigint")
    assert [r.history_ok for r in temporal.contiguous_run(run, 600, 3).orderBy("t").collect()] == [0, 0, 1, 0, 0, 1]


def test_multistep_targets_stop_at_event_and_at_risk_drop(spark):
    rows = [("e", i * 600, 1, int(i == 2)) for i in range(6)] + [("r", i * 600, int(i < 3), 0) for i in range(6)]
    df = spark.createDataFrame(rows, "entity string, t bigint, risk int, hit int")
    first = {r.entity: r for r in temporal.multistep_targets(df, "risk", "hit", 6, 600).filter("t = 0").collect()}
    assert (first["e"].labels, first["e"].mask, first["e"].event_step) == ([0, 0, 1, 0, 0, 0], [1, 1, 1, 0, 0, 0], 2)
    assert (first["r"].labels, first["r"].mask, first["r"].event_step) == ([0] * 6, [1, 1, 1, 0, 0, 0], -1)


def test_neighbour_signal_is_rolled_then_lagged(spark):
    s = spark.createDataFrame([("A", i * 600, float(i)) for i in range(6)] + [("B", i * 600, 0.0) for i in range(6)], "entity string, t bigint, signal double")
    edges = spark.createDataFrame([("A", "B", 20, "f")], "source_entity string, target_entity string, lag_minutes int, feature string")
    got = dict(collect(joins.neighbour_signals(s, s, edges, 2, 600).select("t", "value"), "t"))
    assert [got.get(i * 600, 0.0) for i in range(6)] == [0.0, 0.0, 0.0, 1.0, 2.0, 3.0]


def test_shifted_lookup_and_cyclic_partner(spark):
    rows = spark.createDataFrame([(e, i * 3600, float(v)) for e, vs in {"A": (1, 2, 3, 4), "B": (10, 20, 30, 40)}.items() for i, v in enumerate(vs)], "entity string, t bigint, c double")
    back = joins.shifted_lookup(rows, "c", -3600, "m").filter("entity = 'A'")
    assert [r.m for r in back.orderBy("t").collect()] == [0.0, 1.0, 2.0, 3.0]
    swapped = joins.shifted_lookup(rows, "c", 0, "m", joins.cyclic_partners(rows))
    assert [r.m for r in swapped.filter("entity = 'A'").orderBy("t").collect()] == [10.0, 20.0, 30.0, 40.0]


def test_nearest_neighbours_with_a_crowd_at_one_place(spark):
    import math
    import random

    rnd = random.Random(1)
    pts = [(i, 110.0, 25.0) for i in range(40)] + [(i, 110 + rnd.random() * 12, 24 + rnd.random() * 9) for i in range(40, 90)] + [(99, -60.0, -33.0)]
    df = spark.createDataFrame(pts, "station int, lon double, lat double")
    got = collect(joins.nearest_neighbours(df, "station", 3).select("target_station", "distance_rank", "source_station"), "target_station", "distance_rank")

    def km(a, b):
        la, lb = math.radians(a[2]), math.radians(b[2])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return round(2 * 6371.0088 * math.asin(math.sqrt(h)), 4)

    want = [(t[0], r + 1, s) for t in pts for r, (_, s) in enumerate(sorted((km(s, t), s[0]) for s in pts if s[0] != t[0])[:3])]
    assert got == sorted(want)


def test_purge_edges(spark):
    h = 3600
    rows = spark.createDataFrame([("a", t) for t in (100 * h - 31 * h, 100 * h - 30 * h, 110 * h, 268 * h + 30 * h - 1, 268 * h + 30 * h)], "entity string, t bigint")
    blocks = spark.createDataFrame([(100 * h, 268 * h)], "block_start bigint, block_end bigint")
    assert collect(joins.purge(rows, blocks, 30 * h, 86400).select("t"), "t") == [(69 * h,), (298 * h,)]


def test_validated_joins_fail_loudly(spark):
    import pytest

    a = spark.createDataFrame([(1, "x")], "k int, v string")
    twice = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, w double")
    with pytest.raises(Exception, match="duplicate right join key"):
        joins.validated_join(a, twice, ["k"]).collect()
    with pytest.raises(Exception, match="without a matching key"):
        joins.complete_lookup(a, spark.createDataFrame([(2, 2.0)], "k int, w double"), ["k"]).collect()


def test_final_episodes_need_the_rows_of_windows_only(spark):
    rows = spark.range(4000).selectExpr("id % 5 AS entity", "3600 * (id DIV 5) + id % 3 AS t", "CAST(id * 31 % 7 < 2 AS INT) AS a")
    events = spark.range(40).selectExpr("id % 6 AS entity", "CAST(id AS STRING) AS event_id", "id * 70001 % 2800000 AS onset")
    near = matching.window_rows(rows, events, 3600, 6 * 3600)
    assert 0 < near.count() < 700
    whole, part = (matching.final_episode_match(r, events, F.col("a") == 1, 3600, 6 * 3600, 1, 3600, 3 * 3600) for r in (rows, near))
    assert whole.count() == 40 and whole.exceptAll(part).count() == 0 and part.exceptAll(whole).count() == 0
