"""Model fits on the given tables (rows-only checks; recovery is tested separately)."""

from __future__ import annotations

import dataclasses
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.functions import scalar
from tidewatch.functions.clock import DAY
from tidewatch.operators import bootstrap, hazards, metrics, models, sampling, structured
from tidewatch.plans.join_window_queries import _user_edges
from tidewatch.plans.metric_queries import RECURRENCE_TERMS, _day_blocks, _folds, feature_frame, recurrence_design, seasonal_design
from tidewatch.plans.recurrence import causal_recurrence_features, chronological_folds
from tidewatch.plans.policy_queries import trajectories
from tidewatch.plans.registry import cte, query
from tidewatch.plans.standins import HORIZON, HOUR, grid_bounds, panel, readings, scored
from tidewatch.session import materialize

LOCAL = ["past24", "view_count", "cart_count"]


def training_rows(spark, root):
    """Observed panel rows with local features; written once because fits pass over them repeatedly."""
    s = scored(spark, root).filter("observed = 1").selectExpr("entity", "t", "future", "CAST(past24 AS DOUBLE) AS past24", "CAST(view_count AS DOUBLE) AS view_count",
                                                              "CAST(cart_count AS DOUBLE) AS cart_count", "1.0D + pmod(t DIV 3600, 3) AS weight")
    return materialize(s, "training")


@query("ml1_weighted_glm", "link:s feature:s coefficient:f gradient_zero:i")
def ml1(spark, root):
    rows = training_rows(spark, root)
    parts = []
    for link, penalties in (("cloglog", None), ("logit", None)):
        fit = models.fit_glm(rows, LOCAL, "future", "weight", link, 0.0, penalties)
        # At the optimum the weighted score of every feature vanishes.
        p = fit.risk()
        slope = (F.col("future") - p) if link == "logit" else F.exp(fit.eta()) * (F.col("future") / p - 1)
        scores = rows.agg(F.sum(F.col("weight") * slope).alias("(intercept)"), *[F.sum(F.col("weight") * slope * F.col(c)).alias(c) for c in LOCAL])
        names = ["(intercept)", *LOCAL]
        zero = scores.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), (F.abs(F.col(f"`{n}`")) < 1.0).cast("int").alias("gradient_zero")) for n in names])).alias("x")).select("x.*")
        parts.append(fit.frame(spark).join(zero, "feature").withColumn("link", F.lit(link)))
    return parts[0].unionByName(parts[1])


@query("ml2_calibrators", "kind:s shift:f slope:f")
def ml2(spark, root):
    rows = materialize(scored(spark, root).filter("observed = 1 AND score IS NOT NULL").selectExpr("entity", "t", "future", "6 * score - 4 AS eta", "1.0D AS w"), "calibration")
    steps = trajectories(spark, root).selectExpr("weight", "y", "mask", f"transform(sequence(1, {HORIZON}), k -> 6 * score - 5 + 0.1D * k) AS etas")
    fits = {"cloglog": models.calibrate(rows, "eta", "future", "w", "cloglog"), "logit": models.calibrate(rows, "eta", "future", "w", "logit"),
            "trajectory": models.calibrate_trajectory(materialize(steps, "steps"), "etas", "y", "mask", "weight"),
            "inverted_logit": models.calibrate(rows.withColumn("bad", -F.col("eta")), "bad", "future", "w", "logit")}
    return spark.createDataFrame([(k, f.intercept, f.values[0]) for k, f in fits.items()], "kind string, shift double, slope double")


#: Replicates of the stability selection, and the share of replicates a stable term is kept in.
STABILITY_REPLICATES = 20


def structured_rows(spark, root, lags: tuple[int, ...] = (60, 120), replicates: int = 0):
    """Local score plus one sparse term per neighbour edge and lag for every training row, and the term names.

    The names come to the driver, as the coefficients do: one per edge and lag.  With ``replicates`` every row carries the
    subsamples that hold its block of days.
    """
    from tidewatch.operators import joins

    rows = training_rows(spark, root)
    edges = materialize(_user_edges(spark, root).filter(F.col("lag_minutes").isin(*lags)), "edges")
    terms = sorted(edges.select("feature").distinct().toArrow().column(0).to_pylist())
    names = ["local::bias", "local::past24", "local::view_count", *terms]
    # Signals travel with the place of their term, which is shorter than its name.
    placed = materialize(edges.join(models.places(spark, names), "feature").drop("feature").withColumnRenamed("i", "feature"), "placed-edges")
    signal = rows.selectExpr("entity", "t", "past24 * 0.25D AS signal")
    long = joins.neighbour_signals(signal, rows, placed, 3, HOUR).groupBy("entity", "t", F.col("feature").alias("i")).agg(F.sum("value").alias("value"))
    dense = {"local::bias": F.lit(1.0), "local::past24": F.col("past24"), "local::view_count": F.col("view_count")}
    extra = ()
    if replicates:
        rows = rows.withColumn("block", F.expr("t DIV 259200"))
        rows = rows.join(bootstrap.subsample_members(rows.select("entity", "block").distinct(), 0.5, replicates, "ml4"), ["entity", "block"], "left")
        rows = rows.withColumn("replicates", F.coalesce("replicates", F.array().cast("array<int>")))
        extra = ("replicates",)
    return materialize(models.sparse_rows(rows, ["entity", "t"], dense, long, names, "future", "weight", extra), "structured"), names


#: Ridge on all coefficients but the bias, upper bound of a neighbour's effect, ridge of an entity's own term (on the summed loss).
RIDGE, EDGE_LIMIT, ENTITY_PENALTY = 1e-3, 5.0, 10.0
#: L1 penalty of the neighbour terms: the one of a single fit, and the path to choose from.
EDGE_L1 = 1e-3
L1_PATH = (1e-4, 3e-4, 1e-3, 3e-3, 1e-2)


def graph_problem(name: str, names: list[str], l1: float | None = EDGE_L1, replicate: int | None = None, entity_penalty: float | None = ENTITY_PENALTY,
                  start=None) -> structured.Problem:
    """Local terms, a term per entity, and non-negative neighbour terms; without ``l1`` the neighbour terms are held at zero."""
    graph = np.fromiter((n.startswith("graph::") for n in names), bool, len(names))
    ridge = np.where(np.fromiter((n == "local::bias" for n in names), bool, len(names)), 0.0, RIDGE)
    upper = np.where(graph, 0.0 if l1 is None else EDGE_LIMIT, np.inf)
    return structured.Problem(name, ridge, np.where(graph, l1 or 0.0, 0.0), np.where(graph, 0.0, -np.inf), upper, replicate, entity_penalty, start)


def fit_graph(rows, names, l1=EDGE_L1):
    """(packed rows, solution) of one penalty."""
    packed = structured.pack(rows)
    return packed, structured.solve(packed, [graph_problem("graph", names, l1)])[0]


def fit_path(rows, names, path=L1_PATH):
    """(packed rows, barrier, solutions): the model without neighbours, and from there every penalty of the path in the same passes."""
    packed = structured.pack(rows)
    (barrier,) = structured.solve(packed, [graph_problem("barrier", names, None)])
    return packed, barrier, structured.solve(packed, [graph_problem(f"l1={x:g}", names, x, start=barrier.values) for x in path])


def coefficient_frame(spark, names, solution):
    return spark.createDataFrame(pa.table({"feature": pa.array(names, pa.string()), "coefficient": pa.array(solution.values, pa.float64())}))


@query("ml3_sparse_graph_hazard", "feature:s coefficient:f converged:i")
def ml3(spark, root):
    """Coefficients, and every entity's own term."""
    rows, names = structured_rows(spark, root)
    packed, fit = fit_graph(rows, names)
    own = structured.entity_terms(packed, fit).select(F.format_string("entity::%s", F.col("entity").cast("string")).alias("feature"), F.col("effect").alias("coefficient"))
    return coefficient_frame(spark, names, fit).unionByName(own).withColumn("converged", F.lit(int(fit.converged)))


def optimality(rows, names, fits, packed, l1s, tolerance=1e-5):
    """(fit, stationary) by sums over the rows themselves: at an optimum no coefficient within its bounds has a slope, and no entity's term has one.

    An aggregate of its own, from scores and effects.  The fits lie side by side, a column each, so that a row's terms are spread once.
    """
    spark = rows.sparkSession
    count = range(len(fits))
    effects = materialize(structured.entity_terms_of(packed, {f"u{k}": s for k, (_, _, s) in enumerate(fits)}), "effects")
    small = effects.count() * len(fits) <= hazards.BROADCAST_EFFECTS
    lines = structured.linear_score(rows, ["entity", "y", "w", "x"], {f"s{k}": values for k, (_, values, _) in enumerate(fits)})
    both = lines.join(F.broadcast(effects) if small else effects, "entity")
    rate = [F.exp(F.col(f"s{k}") + F.col(f"u{k}")) for k in count]
    slope = [F.col("w") * F.when(F.col("y") == 1, -r * F.exp(-r) / -F.expm1(-r)).otherwise(r) for r in rate]
    sloped = both.select("entity", "w", "x", *[f"u{k}" for k in count], *[c.alias(f"g{k}") for k, c in enumerate(slope)])
    sloped = materialize(sloped, "slopes")
    of_entities = sloped.groupBy("entity").agg(*[(F.sum(f"g{k}") + ENTITY_PENALTY * F.first(f"u{k}")).alias(f"g{k}") for k in count])
    worst_entity = of_entities.agg(*[F.max(F.abs(f"g{k}")) for k in count]).first()
    mass = sloped.agg(F.sum("w")).first()[0]
    long = sloped.select(F.explode("x").alias("z"), *[f"g{k}" for k in count])
    sums = long.groupBy(F.col("z.i").alias("i")).agg(*[F.sum(F.col("z.v") * F.col(f"g{k}")).alias(f"g{k}") for k in count])
    table = spark.createDataFrame(pa.table({"i": pa.array(range(len(names)), pa.int32()), "bias": pa.array([n == "local::bias" for n in names]), "graph": pa.array([n.startswith("graph::") for n in names])}
                                           | {f"b{k}": pa.array(values, pa.float64()) for k, (_, values, _) in enumerate(fits)}))
    # At a bound the slope may push against it.
    judged = []
    for k, (name, _, _) in enumerate(fits):
        b = F.col(f"b{k}")
        g = F.coalesce(F.col(f"g{k}"), F.lit(0.0)) / mass + F.when(F.col("bias"), 0.0).otherwise(RIDGE) * b + F.when(F.col("graph"), l1s[name]).otherwise(0.0)
        moved = F.when(F.col("graph"), F.least(F.greatest(b - g, F.lit(0.0)), F.lit(EDGE_LIMIT))).otherwise(b - g) - b
        judged.append(F.max(F.abs(moved)))
    worst = table.join(sums, "i", "left").agg(*judged).first()
    return spark.createDataFrame([(name, int(worst[k] < tolerance and worst_entity[k] < 1e-4)) for k, (name, _, _) in enumerate(fits)], "fit string, stationary int")


@query("ml3_penalty_path", "l1:f active:i objective:f passes_within_40:i converged:i")
def ml3_path(spark, root):
    rows, names = structured_rows(spark, root)
    _, barrier, path = fit_path(rows, names)
    graph = [k for k, n in enumerate(names) if n.startswith("graph::")]
    return spark.createDataFrame([(x, int((s.values[graph] > 1e-8).sum()), s.objective, int(s.passes + barrier.passes <= 40), int(s.converged)) for x, s in zip(L1_PATH, path, strict=True)],
                                 "l1 double, active bigint, objective double, passes_within_40 bigint, converged bigint")


@query("ml3_path_optimality", "fit:s planted:i stationary:i", f"SELECT unnest({[f'l1={x:g}' for x in L1_PATH]}) AS fit, 0 AS planted, 1 AS stationary UNION ALL SELECT unnest({[f'l1={x:g}, moved' for x in L1_PATH]}), 1, 0")
def ml3_optimality(spark, root):
    """Every fit of the path at its optimum, and beside it with one local coefficient moved by 0.01, which the same sums have to notice."""
    rows, names = structured_rows(spark, root)
    packed, _, path = fit_path(rows, names)
    fits, l1s = [], {}
    for x, s in zip(L1_PATH, path, strict=True):
        moved = s.values.copy()
        moved[names.index("local::past24")] += 0.01
        for name, values in ((s.name, s.values), (f"{s.name}, moved", moved)):
            fits.append((name, values, dataclasses.replace(s, values=values)))
            l1s[name] = x
    judged = optimality(rows, names, fits, packed, l1s)
    return judged.withColumn("planted", F.col("fit").like("%moved").cast("int"))


@query("ml4_stability_selection", "feature:s frequency:f q25:f median:f q75:f stable:i")
def ml4(spark, root):
    rows, names = structured_rows(spark, root, replicates=STABILITY_REPLICATES)
    return models.selection_frequency(stability_fits(spark, rows, names))


def stability_fits(spark, rows, names):
    """(feature, replicate, coefficient): all replicates fitted in the same passes, or in groups, whose coefficients are written as they come."""
    packed = structured.pack(rows, replicates=True)
    one = graph_problem("replicate", names, entity_penalty=None)
    parts = []
    for group in structured.grouped([dataclasses.replace(one, name=f"replicate {k}", replicate=k) for k in range(STABILITY_REPLICATES)]):
        found = [pa.table({"i": pa.array(range(len(names)), pa.int32()), "replicate": pa.array(np.full(len(names), p.replicate), pa.int32()), "coefficient": pa.array(fit.values, pa.float64())})
                 for p, fit in zip(group, structured.solve(packed, group), strict=True)]
        parts.append(materialize(spark.createDataFrame(pa.concat_tables(found)), "replicates"))
    return reduce(lambda a, b: a.unionByName(b), parts).join(models.places(spark, names), "i").select("feature", "replicate", "coefficient")


FRAILTY = "station_frailty"
GAP_TIME = ("lg", "order_2", "order_3plus", "log_gap", "hinge_1", "hinge_2", "load_7d", "severity")
#: The three recurrence models: a base score alone, event order with the gap since the last event, and the same with station effects.
RECURRENCE_MODELS = {"base": ("lg",), "gap_time": GAP_TIME, FRAILTY: GAP_TIME}
OOF_FOLDS, OOF_RIDGE, STATION_PENALTY = 3, 1.0, 10.0


def oof_splits(spark, root):
    """Rows with the design, once per held fold, with their role there."""
    f = recurrence_design(materialize(feature_frame(spark, root), "features")).withColumn("lg", F.expr("ln(base / (1 - base + 1e-6D) + 1e-6D)"))
    rows = f.select("entity", "t", "label", "lg", *[F.col(c).cast("double").alias(c) for c in RECURRENCE_TERMS])
    blocks = _day_blocks(spark, root).select("entity", "t", "block")
    split = sampling.purged_splits(sampling.map_folds(rows.join(blocks, ["entity", "t"]), _folds(spark, root, OOF_FOLDS)), OOF_FOLDS, 172800, 30 * HOUR)
    # An entity's rows lie together, so that each pass adds them up before anything is moved; a partition too large for that is cut.
    return materialize(split.filter("role <> 'purged'").hint("rebalance", "entity"), "splits")


def recurrence_fits(split):
    """Every model of every fold, fitted in the same passes; fits are named ``model/fold``."""
    models_of = F.explode(F.array(*[F.lit(m) for m in RECURRENCE_MODELS]))
    named = split.withColumn("model", models_of).withColumn("fit", F.concat_ws("/", "model", F.col("held").cast("string")))
    designs = [hazards.Design(f"{m}/{k}", features, m == FRAILTY, OOF_RIDGE, STATION_PENALTY) for m, features in RECURRENCE_MODELS.items() for k in range(OOF_FOLDS)]
    fits = hazards.fit_hazards(named.filter("role = 'train'"), designs, "label")
    return fits, materialize(fits.eta(named.filter("role = 'validation'")).select("entity", "t", "held", "model", "label", "eta"), "oof")


def _hazard_sql(rows: str, size: int, ridge: float, penalty: float, rounds: int) -> str:
    """Newton steps on cloglog fits with profiled station effects, as a recursion over (fit, entity) rows.

    ``rows`` has fit, entity, grouped, y and z1..; every round sums scores and curvatures by station, takes the stations off the
    system of the coefficients, solves that by elimination written out column by column, and moves both.
    """
    n = size + 1
    z = ["1.0::DOUBLE", *[f"z{k}" for k in range(1, n)]]
    eta = "u + " + " + ".join(f"b{k}*{z[k]}" for k in range(n))
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    per = ", ".join([f"sum(g*{z[k]}) AS g{k}" for k in range(n)] + [f"sum(h*{z[i]}*{z[j]}) AS h{i}_{j}" for i, j in pairs] + [f"any_value(b{k}) AS b{k}" for k in range(n)])
    over = "OVER (PARTITION BY fit)"
    ridged = [f"{ridge}*b{k}" if k else "0" for k in range(n)]
    total = ", ".join([f"sum(g{k} - h0_{k}*ug*inv) {over} + {ridged[k]} AS a0_{k}_{n}" for k in range(n)]
                      + [f"sum(h{i}_{j} - h0_{i}*h0_{j}*inv) {over} + {ridge if i == j and i else 0} AS a0_{i}_{j}" for i, j in pairs])
    # Elimination: a<step>_<row>_<column>; the matrix is symmetric, so the upper triangle is kept.  Column n is the right side.
    at = lambda s, i, j: f"a{s}_{min(i, j)}_{max(i, j)}" if j < n else f"a{s}_{i}_{n}"
    source = f"(SELECT *, {total} FROM stations)"
    for s in range(n):
        rest = [f"{at(s, i, j)} - {at(s, s, i)}*{at(s, s, j)}/{at(s, s, s)} AS a{s + 1}_{i}_{j}" for i in range(s + 1, n) for j in range(i, n + 1)]
        source = f"(SELECT *, {', '.join(rest)} FROM {source})" if rest else source
    for s in reversed(range(n)):
        known = "".join(f" - {at(s, s, j)}*d{j}" for j in range(s + 1, n))
        source = f"(SELECT *, ({at(s, s, n)}{known})/{at(s, s, s)} AS d{s} FROM {source})"
    shift = " + ".join(f"h0_{k}*-d{k}" for k in range(n))
    betas = ", ".join(f"b{k} - d{k} AS b{k}" for k in range(n))
    start = ", ".join(["ln(-ln(1 - avg(y) OVER (PARTITION BY fit))) AS b0", *[f"0.0::DOUBLE AS b{k}" for k in range(1, n)]])
    return f"""/*RECURSIVE*/ SELECT DISTINCT 0 AS round, fit, entity, 0.0::DOUBLE AS u, {start} FROM {rows} UNION ALL (WITH
 lines AS (SELECT w.round, r.*, w.u, {', '.join(f'w.b{k}' for k in range(n))}, exp(greatest(least({eta}, 15), -30)) AS rate FROM HAZARD w JOIN {rows} r USING (fit, entity) WHERE w.round < {rounds}),
 states AS (SELECT *, CASE WHEN y = 1 THEN -q ELSE rate END AS g, CASE WHEN y = 1 THEN q*(rate/p - 1) ELSE rate END AS h FROM (SELECT *, rate*exp(-rate)/p AS q FROM (SELECT *, CASE WHEN rate < 1e-5 THEN rate - rate*rate/2 + rate*rate*rate/6 ELSE 1 - exp(-rate) END AS p FROM lines))),
 stations AS (SELECT *, CASE WHEN grouped THEN g0 + {penalty}*u ELSE 0 END AS ug, CASE WHEN grouped THEN 1/(h0_0 + {penalty}) ELSE 0 END AS inv FROM (SELECT round, fit, entity, any_value(grouped) AS grouped, any_value(u) AS u, {per} FROM states GROUP BY round, fit, entity))
 SELECT round + 1 AS round, fit, entity, u - (ug + {shift})*inv AS u, {betas} FROM {source})"""


_UNITS = [f"z{k}" for k in range(1, len(GAP_TIME) + 1)]
_FOLD3 = f"""/*RECURSIVE*/ SELECT 0::BIGINT AS n, 0::BIGINT AS block, {[0] * OOF_FOLDS}::BIGINT[] AS ev, {[0] * OOF_FOLDS}::BIGINT[] AS ro, {[0] * OOF_FOLDS}::BIGINT[] AS bl, 0::BIGINT AS fold UNION ALL
 SELECT n, block, list_transform(ev, lambda x, i: CASE WHEN i=f+1 THEN x+events ELSE x END), list_transform(ro, lambda x, i: CASE WHEN i=f+1 THEN x+rows_n ELSE x END), list_transform(bl, lambda x, i: CASE WHEN i=f+1 THEN x+1 ELSE x END), f FROM (
 SELECT b.n, b.block, b.events, b.rows_n, f.ev, f.ro, f.bl, list_sort(list_transform(range({OOF_FOLDS}), lambda i: CASE WHEN b.events>0 THEN [f.ev[i+1], f.ro[i+1], f.bl[i+1], i] ELSE [f.ro[i+1], f.bl[i+1], f.ev[i+1], i] END))[1][4] AS f FROM fold3 f JOIN blkord b ON b.n=f.n+1)"""
cte("fold3", _FOLD3, "blkord")
cte("oofrows", f"""SELECT d.entity, d.t, d.label AS y, ln(base/(1-base+1e-6)+1e-6) AS lg, {', '.join(f'd.{c}::DOUBLE AS {c}' for c in GAP_TIME[1:])}, h.held, b.fold = h.held AS validation,
 b.fold <> h.held AND NOT EXISTS (SELECT 1 FROM fold3 x WHERE x.n>0 AND x.fold=h.held AND d.t>=x.block-108000 AND d.t<x.block+172800+108000) AS train
 FROM design d, (SELECT unnest(range({OOF_FOLDS})) AS held) h, (SELECT lo//86400*86400 AS d0 FROM bounds), fold3 b WHERE b.n>0 AND b.block = d0 + (d.t-d0)//172800*172800""", "design fold3 bounds")
cte("oofscaled", f"""SELECT r.entity, r.t, r.y, r.held, r.validation, r.train, {', '.join(f'(coalesce({c}, m_{c}) - m_{c})/s_{c} AS z{k}' for k, c in enumerate(GAP_TIME, 1))} FROM oofrows r
 JOIN (SELECT held, {', '.join(f'avg({c}) AS m_{c}, CASE WHEN stddev_pop({c})>0 THEN stddev_pop({c}) ELSE 1 END AS s_{c}' for c in GAP_TIME)} FROM oofrows WHERE train GROUP BY 1) USING (held)""", "oofrows")
cte("oofmodels", f"""SELECT s.* EXCLUDE ({', '.join(_UNITS[1:])}), m.model, m.model || '/' || held AS fit, m.model = '{FRAILTY}' AS grouped, {', '.join(f"CASE WHEN m.model = 'base' THEN 0.0 ELSE {z} END AS {z}" for z in _UNITS[1:])}
 FROM oofscaled s, (SELECT unnest({list(RECURRENCE_MODELS)}) AS model) m""", "oofscaled")
cte("ooftrain", "SELECT * FROM oofmodels WHERE train", "oofmodels")
cte("hazard", _hazard_sql("ooftrain", len(GAP_TIME), OOF_RIDGE, STATION_PENALTY, 12).replace("HAZARD", "hazard"), "ooftrain")
cte("fitted", "SELECT * FROM hazard WHERE round = 12", "hazard")
cte("oof", f"""SELECT v.entity, v.t, v.held, v.model, v.y AS label, CASE WHEN grouped THEN coalesce(f.u, 0) ELSE 0 END + {' + '.join(f'c.b{k}*{z}' for k, z in enumerate(['1', *_UNITS]))} AS eta FROM oofmodels v
 JOIN (SELECT DISTINCT ON (fit) * FROM fitted) c USING (fit) LEFT JOIN fitted f ON f.fit = v.fit AND f.entity = v.entity WHERE v.validation""", "oofmodels fitted")


@query("ml5_recurrence_effects", "fit:s rows_n:i events:i groups:i objective:f effect_mean:f effect_spread:f converged:i",
       f"""SELECT t.fit, rows_n, events, groups, loss + {OOF_RIDGE}/2*({' + '.join(f'b{k}*b{k}' for k in range(1, len(GAP_TIME) + 1))}) + {STATION_PENALTY}/2*CASE WHEN grouped THEN uu ELSE 0 END AS objective, CASE WHEN grouped THEN um END AS effect_mean, CASE WHEN grouped THEN us END AS effect_spread, 1 AS converged FROM (
       SELECT r.fit, count(*) AS rows_n, sum(y) AS events, sum(CASE WHEN y = 1 THEN -ln(1-exp(-rate)) ELSE rate END) AS loss FROM (SELECT fit, y, exp(CASE WHEN grouped THEN u ELSE 0 END + {' + '.join(f'b{k}*{z}' for k, z in enumerate(['1', *_UNITS]))}) AS rate FROM ooftrain JOIN fitted USING (fit, entity)) r GROUP BY 1) t
       JOIN (SELECT fit, count(*) AS groups, any_value(fit LIKE '{FRAILTY}%') AS grouped, sum(u*u) AS uu, avg(u) AS um, stddev_pop(u) AS us, {', '.join(f'any_value(b{k}) AS b{k}' for k in range(1, len(GAP_TIME) + 1))} FROM fitted GROUP BY 1) USING (fit)""", "ooftrain fitted")
def ml5_effects(spark, root):
    """Objective and station effects of every fit at its optimum."""
    fits, _ = recurrence_fits(oof_splits(spark, root))
    effects = fits.effects.groupBy("fit").agg(F.avg("effect").alias("effect_mean"), F.stddev_pop("effect").alias("effect_spread"))
    return fits.report.join(effects, "fit", "left")


@query("ml5_recurrence_models_oof", "model:s calibrated:i rows_n:i brier:f log_loss:f average_precision:f")
def ml5(spark, root):
    """Out-of-fold cloglog models (base, gap time, station frailty) before and after one calibrator per model on the pooled folds."""
    fits, pooled = recurrence_fits(oof_splits(spark, root))
    raw = pooled.select("model", "label", "eta", F.lit(0).alias("calibrated"))
    # A calibrator is a fit of one feature; the three share their passes.
    own = pooled.withColumn("fit", F.col("model"))
    calibrators = hazards.fit_hazards(own, [hazards.Design(m, ("eta",)) for m in RECURRENCE_MODELS], "label")
    fixed = calibrators.eta(own, "calibrated_eta").select("model", "label", F.col("calibrated_eta").alias("eta"), F.lit(1).alias("calibrated"))
    both = materialize(raw.unionByName(fixed).withColumn("p", hazards.risk()), "calibrated")
    return metrics.probability_metrics(both, "p", "label", None, ("model", "calibrated"))


@query("ml6_nested_designs_wald", "term:s coefficient:f standard_error:f statistic:f df:i")
def ml6(spark, root):
    cols = ["extra", "state", "state_by_exposure_e1", "state_by_events_past_7d"]
    rows = materialize(seasonal_design(feature_frame(spark, root)).select("entity", "label", *[F.col(c).cast("double").alias(c) for c in cols], F.lit(1.0).alias("w")), "seasonal")
    fit = models.fit_glm(rows, cols, "label", "w", "logit", 1e-6)
    cov = models.cluster_sandwich(rows, fit, "label", "w", "entity")
    stat, df, _ = models.wald_test(fit, cov, cols[2:])
    return spark.createDataFrame([(n, float(b), float(max(cov[i + 1, i + 1], 0.0) ** 0.5), stat, df) for i, (n, b) in enumerate(zip(fit.features, fit.values))],
                                 "term string, coefficient double, standard_error double, statistic double, df int")


BOOST = ["event_count_past_24", "event_count_past_168", "view_count_past_24", "cart_count_past_24", "since_event_bins", "prior_event_rate", "hour_sin", "hour_cos"]


#: How many trees, and their depth.
BOOST_ROUNDS, BOOST_DEPTH = 10, 3


def boosted_scores(spark, root):
    """Trees grown from all rows of the training span, scores for the later spans; rows of the same bins are one with their count."""
    lo = grid_bounds(readings(spark, root))["lo"]
    p = chronological_folds(causal_recurrence_features(panel(spark, root), HORIZON), lo + 10 * DAY, lo + 20 * DAY, lo + 30 * DAY, HORIZON * HOUR)
    p = materialize(p.select("entity", "t", "fold", "future", "observed", "event_count", *[F.col(c).cast("double").alias(c) for c in BOOST]), "boost")
    train = p.filter("fold = 'train' AND observed = 1")
    edges = models.feature_edges(train, BOOST)
    alike = materialize(models.rows_of_bins(train, edges, ["future"]), "boost-bins")
    trees = models.fit_boosted_binned(alike, edges, "future", "n", 20.0, BOOST_ROUNDS, BOOST_DEPTH, every_bin=True)
    return models.score_boosted_binned(trees, models.binned(p.filter("fold <> 'train'"), edges)).drop(*BOOST)


@query("ml7_boosted_trees", "fold:s rows_n:i brier:f average_precision:f roc_auc:f")
def ml7(spark, root):
    s = materialize(boosted_scores(spark, root).filter("observed = 1").select("fold", "future", "risk"), "boosted")
    return metrics.probability_metrics(s, "risk", "future", None, ("fold",))


@query("ml8_effect_tables", "feature:s coefficient:f barrier:f hazard_ratio:f selected:i")
def ml8(spark, root):
    rows, names = structured_rows(spark, root)
    return effect_table(coefficient_frame(spark, names, fit_graph(rows, names)[1]))


def effect_table(coefficients):
    """Barrier value (minus effect), hazard ratio, and whether the term is active."""
    return coefficients.selectExpr("feature", "coefficient", "-coefficient AS barrier", "exp(coefficient) AS hazard_ratio", "CAST(abs(coefficient) > 1e-6 AS INT) AS selected")


@query("ml8b_score_decomposition", "entity:i t:i eta:f ablated_eta:f contribution:f")
def ml8b(spark, root):
    rows, names = structured_rows(spark, root)
    packed, fit = fit_graph(rows, names)
    return decompose(rows, names, packed, fit)


def decompose(rows, names, packed, fit):
    """Score, score without the neighbour terms, and their difference, entity terms included."""
    local = np.where([n.startswith("graph::") for n in names], 0.0, fit.values)
    lines = structured.linear_score(rows, ["entity", "t"], {"full": fit.values, "local": local})
    own = structured.entity_terms(packed, fit)
    # One number per packed row; the join is then no reason to move the rows.
    own = F.broadcast(own) if packed.count() <= hazards.BROADCAST_EFFECTS else own
    whole = lines.join(own, "entity", "left").withColumn("effect", F.coalesce("effect", F.lit(0.0)))
    return whole.select("entity", "t", (F.col("full") + F.col("effect")).alias("eta"), (F.col("local") + F.col("effect")).alias("ablated_eta"), (F.col("full") - F.col("local")).alias("contribution"))


@query("ml9_prediction_table", "entity:i t:i step_risk:f risk_1h:f risk_3h:f risk_6h:f calibrated_6h:f active_rule:i")
def ml9(spark, root):
    rows = training_rows(spark, root)
    alike = materialize(models.rows_alike(rows, LOCAL, "future", "weight"), "scaled")
    fit = models.fit_glm(alike, LOCAL, "future", "weight", "cloglog")
    cal = models.calibrate(alike.withColumn("eta", fit.eta()), "eta", "future", "weight", "cloglog")
    scaled = rows.withColumn("eta", fit.eta() - F.log(F.lit(6.0)))
    return scaled.select("entity", "t", scalar.cloglog_risk("eta").alias("step_risk"), scalar.cloglog_risk("eta", 1).alias("risk_1h"), scalar.cloglog_risk("eta", 3).alias("risk_3h"),
                         scalar.cloglog_risk("eta", 6).alias("risk_6h"), scalar.calibrated_cloglog_risk(F.col("eta") + F.log(F.lit(6.0)), cal.intercept, cal.values[0], 1).alias("calibrated_6h"),
                         scalar.flag(F.col("past24") > 0).alias("active_rule"))
