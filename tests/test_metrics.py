import hashlib
import random

import numpy as np
import pytest
from conftest import collect
from pyspark.sql import functions as F

from tidewatch.functions import trajectory
from tidewatch.operators import audits, bootstrap, metrics, models, sampling, scan


def test_running_totals_and_quantiles_are_exact_for_skewed_values(spark):
    import numpy as np

    rnd = random.Random(4)
    values = [0.5] * 400 + [rnd.random() ** 8 for _ in range(700)]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 1.0)], "grp string, v double")
    out = {r.grp: r for r in scan.exact_quantiles(df, "v", {"a": .05, "b": .5, "c": .999}, ("grp",)).collect()}
    for name, p in (("a", .05), ("b", .5), ("c", .999)):
        assert out["g"][name] == pytest.approx(np.quantile(values, p), abs=1e-12)
    assert out["h"].b == 1.0
    totals = collect(scan.running_totals(df.filter("grp = 'g'"), "v", {"n": F.lit(1)}, descending=True).select("n_cum", "n_total"), "n_cum")
    assert totals[-1] == (len(values), len(values))


def test_running_totals_order_text(spark):
    words = ["b#10", "a", "b#9", "zz", "é", "a#2", "b#10x"]
    got = collect(scan.running_totals(spark.createDataFrame([(w,) for w in words], "w string"), "w", {"n": F.lit(1)}, slice_values=2).select("n_cum", "w"), "n_cum")
    assert [w for _, w in got] == sorted(words, key=lambda w: w.encode())


def test_average_precision_and_roc_against_brute_force(spark):
    rnd = random.Random(6)
    rows = [(round(rnd.random(), 2), int(rnd.random() < 0.3), rnd.choice([1.0, 2.0, 3.0])) for _ in range(400)]
    got = metrics.ranking_metrics(spark.createDataFrame(rows, "p double, y int, w double"), "p", "y", "w").first()
    total = sum(w for _, y, w in rows if y)
    ap, before = 0.0, 0.0
    for cut in sorted({p for p, _, _ in rows}, reverse=True):
        tp = sum(w for p, y, w in rows if y and p >= cut)
        allw = sum(w for p, _, w in rows if p >= cut)
        ap += (tp - before) / total * tp / allw
        before = tp
    pairs = sum(w * v * (1.0 if p > q else 0.5 if p == q else 0.0) for p, y, w in rows if y for q, z, v in rows if not z)
    auc = pairs / (total * sum(w for _, y, w in rows if not y))
    assert got.average_precision == pytest.approx(ap) and got.roc_auc == pytest.approx(auc)


def test_one_class_groups_have_no_ranking_metric(spark):
    df = spark.createDataFrame([("a", 0.2, 0), ("a", 0.3, 0)], "g string, p double, y int")
    assert metrics.ranking_metrics(df, "p", "y", None, ("g",)).first().average_precision is None


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "m string, p double")
    got = dict(collect(bootstrap.holm(df, "p").select("m", "p_holm"), "m"))
    assert got == {"a": pytest.approx(0.03), "b": pytest.approx(0.06), "c": pytest.approx(0.06), "d": None}


def test_bootstrap_of_a_constant_ratio_has_no_spread(spark):
    sums = spark.createDataFrame([(f"s{i}", 4, 2) for i in range(9)], "entity string, n int, hits int")
    r = bootstrap.cluster_bootstrap(sums, ["n", "hits"], {"rate": "hits / n"}, 25, "x").first()
    assert (r.estimate, r.low, r.high, r.replicates) == (0.5, 0.5, 0.5, 25)
    vectors = bootstrap.entity_counts(bootstrap.ranked_entities(sums), 25, "x").collect()
    assert {int(n) for n in sum(np.frombuffer(v.counts, dtype=np.uint16).astype(int) for v in vectors)} == {9} and len(vectors) == 9


def drawn(entities, replicates, salt):
    """Entities of every replicate, draw by draw."""
    order = sorted(entities)
    return [[order[(int(hashlib.md5(f"{salt}|{r}|{j}".encode()).hexdigest()[:15], 16)) % len(order)] for j in range(len(order))] for r in range(replicates)]


def test_totals_and_maxima_equal_the_draws(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "ENTITY_BLOCK", 4)
    rnd = random.Random(5)
    rows = [(f"e{i:02d}", g, rnd.randint(0, 9), rnd.random()) for i in range(11) for g in ("a", "b") if rnd.random() < 0.8]
    got = bootstrap.replicate_totals(spark.createDataFrame(rows, "entity string, g string, n int, x double"), ["n"], 70, "s", ("x",), ("g",)).collect()
    want = {}
    for r, picks in enumerate(drawn({e for e, *_ in rows}, 70, "s")):
        for g in ("a", "b"):
            mine = [(n, x) for e in picks for f, h, n, x in rows if f == e and h == g]
            if mine:
                want[g, r] = (float(sum(n for n, _ in mine)), max(x for _, x in mine))
    assert {(t.g, t.replicate): (t.n, t.x) for t in got if (t.g, t.replicate) in want} == want


def precision(rows):
    rows, value, hits, all_ = sorted(rows, reverse=True), 0.0, 0.0, 0.0
    for p in sorted({p for p, *_ in rows}, reverse=True):
        here = [(y, w) for q, y, w in rows if q == p]
        hit = sum(w for y, w in here if y)
        hits, all_ = hits + hit, all_ + sum(w for _, w in here)
        value += hit * hits / all_
    return value / hits if hits else None


def calibration_error(rows):
    cells = {}
    for p, y, w in rows:
        c = cells.setdefault(sum(p >= e for e in metrics.CALIBRATION_EDGES), [0.0, 0.0])
        c[0] += w * (y - p)
        c[1] += w
    return sum(abs(c[0]) for c in cells.values()) / sum(c[1] for c in cells.values())


@pytest.mark.parametrize("slice_values", [50_000, 24])
def test_average_precision_and_calibration_draws_equal_the_draws(spark, slice_values):
    rnd = random.Random(slice_values)
    rows = [(f"e{i % 7}", round(rnd.random(), 2), round(rnd.random(), 1), int(rnd.random() < 0.3), float(rnd.randint(1, 3))) for i in range(160)]
    df = spark.createDataFrame(rows, "entity string, a double, b double, y int, w double")
    picks = drawn({e for e, *_ in rows}, 70, "ap")
    ap = {(r.model, r.replicate): r.value for r in bootstrap.average_precision_draws(df, ["a", "b"], "y", "w", 70, "ap", slice_values).collect()}
    ce = {(r.model, r.replicate): r.value for r in bootstrap.calibration_error_draws(df, ["a", "b"], "y", "w", 70, "ap").collect()}
    assert len(ap) == len(ce) == 140
    for r, chosen in enumerate(picks):
        for k, model in ((1, "a"), (2, "b")):
            mine = [(row[k], row[3], row[4]) for e in chosen for row in rows if row[0] == e]
            assert ap[model, r] == pytest.approx(precision(mine))
            assert ce[model, r] == pytest.approx(calibration_error([(min(max(p, 1e-12), 1 - 1e-12), y, w) for p, y, w in mine]))


def test_trajectory_identities_and_audit(spark):
    rnd = random.Random(3)
    rows = [(i, "a", i * 600, [rnd.random() * 0.2 for _ in range(36)]) for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, entity string, t bigint, h array<double>").withColumn("f", trajectory.cumulative("h"))
    sums = df.select(F.aggregate(trajectory.first_event_probability("h"), F.lit(0.0), lambda a, x: a + x).alias("s"),
                     trajectory.trajectory_value("h", 10, 36, "hit_only").alias("v"), F.element_at("f", -1).alias("f")).collect()
    assert all(r.s == pytest.approx(r.f) and r.v == pytest.approx(r.f) for r in sums)
    assert trajectory.audit(df, "h", "f", "id", "entity", "t").first().passed == 1
    broken = df.withColumn("id", F.when(F.col("id") == 1, 0).otherwise(F.col("id"))).withColumn(
        "f", F.when(F.col("id") == 5, F.transform("f", lambda x, i: F.when(i == 35, x - 0.9).otherwise(x))).otherwise(F.col("f")))
    r = trajectory.audit(broken, "h", "f", "id", "entity", "t").first()
    assert (r.duplicate_keys, r.falling, r.passed) == (1, 1, 0)


def test_lead_weight_kinds(spark):
    w = spark.range(1).select(trajectory.lead_weights(36, 10, "business_piecewise").alias("b"), trajectory.lead_weights(36, 10, "saturating_3h").alias("s")).first()
    assert w.b[2] == pytest.approx(0.25) and w.b[11] == pytest.approx(0.75) and w.b[35] == 1.0 and w.s[35] == 3.0


def test_quotas_fill_the_maximum():
    for have in ({0: 10, 1: 500, 2: 9000}, {0: 900, 1: 5, 2: 10}, {0: 3, 1: 4, 2: 5}, {0: 0, 1: 100, 2: 0}):
        for top in (6, 50, 1000):
            goal = sampling.quotas(have, top)
            assert sum(goal.values()) == min(top, sum(have.values())) and all(goal[k] <= have[k] for k in have)


def test_fixed_size_sample_weights_represent_everything(spark):
    df = spark.range(5000).withColumn("entity", F.col("id") % 7).withColumn("t", F.col("id")).withColumn("stratum", F.when(F.col("id") % 50 == 0, 0).when(F.col("id") % 5 == 1, 1).otherwise(2))
    got = sampling.stratified_subsample(df, ["entity", "t"], 900, "s")
    r = got.agg(F.count("*").alias("n"), F.sum("sample_weight").alias("w")).first()
    assert r.n == 900 and r.w == pytest.approx(5000)


def test_balanced_folds(spark):
    week = 7 * 86400
    rows = [(i * week, 100, e) for i, e in enumerate([20, 10, 5] + [0] * 12)]
    folds = sampling.balanced_folds(spark.createDataFrame(rows, "block bigint, rows_n bigint, events bigint"), 5)
    sizes = [n for _, n in collect(folds.groupBy("fold").count(), "fold")]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_glm_recovers_a_cloglog_model(spark):
    df = spark.range(20000).select((F.randn(1)).alias("x"), F.rand(2).alias("u")).withColumn(
        "y", (F.col("u") < 1 - F.exp(-F.exp(-1.5 + 0.8 * F.col("x")))).cast("int")).cache()
    fit = models.fit_glm(df, ["x"], "y")
    assert fit.intercept == pytest.approx(-1.5, abs=0.08) and fit.values[0] == pytest.approx(0.8, abs=0.08)
    flipped = models.calibrate(df.withColumn("bad", -F.col("x")), "bad", "y", None, "logit")
    assert flipped.values[0] == 0.0
    rate = df.agg(F.avg("y")).first()[0]
    assert df.withColumn("bad", -F.col("x")).select(flipped.risk().alias("r")).first().r == pytest.approx(rate, abs=1e-3)


def test_chi_square_tail():
    assert models._chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert models._chi2_tail(175.31, 5) == pytest.approx(5.36e-36, rel=0.01)


def test_key_audit_reports_sharing(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    got = {r.part: (r.rows_n, r.duplicates, r.shared_keys) for r in audits.key_audit({"a": a, "b": b}, ["k"]).collect()}
    assert got == {"a": (3, 1, 1), "b": (2, 0, 1)}


def test_rows_alike_are_summed_before_conditions_and_metrics(spark):
    rows = [(k % 4 / 10 + 0.1, k % 5 // 4, 1.0 + k % 2, k % 3) for k in range(600)]
    df = spark.createDataFrame(rows, "p double, y int, w double, g int")
    alike = metrics.rows_alike(df, "p", "y", "w", ("g",))
    assert alike.count() == len({(p, y, g) for p, y, _, g in rows}) and alike.agg({"n": "sum"}).first()[0] == 600
    found = {r.g: r for r in metrics.probability_metrics(df, "p", "y", "w", ("g",)).collect()}
    plain, ranks = ({r.g: r for r in part.collect()} for part in (metrics.base_metrics(df, "p", "y", "w", ("g",)), metrics.ranking_metrics(df, "p", "y", "w", ("g",))))
    for g in range(3):
        assert (found[g].rows_n, found[g].positives, found[g].bins) == (plain[g].rows_n, plain[g].positives, plain[g].bins)
        assert [found[g][c] for c in ("weight", "brier", "log_loss", "ece", "max_gap")] == pytest.approx([plain[g][c] for c in ("weight", "brier", "log_loss", "ece", "max_gap")])
        assert found[g].average_precision == pytest.approx(ranks[g].average_precision) and found[g].roc_auc == pytest.approx(ranks[g].roc_auc)
    # More conditions than a long number has bits.
    named = {"all": "1 = 1", **{f"never_{k}": "g > 9" for k in range(70)}, "last": "g = 2", "unknown": "CAST(NULL AS INT) = 1"}
    by = {r.condition: r for r in metrics.condition_metrics(df.withColumn("q", 1 - df.p), named, ["p", "q"], "p", "y", "w").filter("model = 'q'").collect()}
    assert set(by) == {"all", "last"} and by["all"].rows_n == 600 and by["last"].rows_n == 200 and by["last"].coverage == pytest.approx(1 / 3)
