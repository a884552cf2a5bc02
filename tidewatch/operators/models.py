"""Hazard models fitted as Spark jobs.

Coefficients live on the driver (one number per feature); rows never do.  Each
fit is a handful of passes that return sums of the size of the coefficient
vector, through MLlib where it has the model; :mod:`hazards` and :mod:`structured` fit
random effects, box bounds and L1 penalties.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import scalar
from tidewatch.session import materialize


#: Steps and mean-gradient tolerance of the shift when a calibration slope is held at its bound.
SHIFT_STEPS, SHIFT_TOLERANCE = 100, 1e-8


@dataclass(frozen=True)
class Coefficients:
    """A fitted linear score."""

    features: tuple[str, ...]
    values: tuple[float, ...]
    intercept: float
    link: str = "cloglog"
    converged: bool = True
    passes: int = 0

    def eta(self) -> Column:
        return scalar.linear_score(list(self.features), list(self.values), self.intercept)

    def risk(self, steps: int = 1) -> Column:
        return scalar.cloglog_risk(self.eta(), steps) if self.link == "cloglog" else scalar.logit_risk(self.eta())

    def frame(self, spark) -> DataFrame:
        rows = [("(intercept)", float(self.intercept)), *[(f, float(v)) for f, v in zip(self.features, self.values)]]
        return spark.createDataFrame(rows, "feature string, coefficient double")


def _assembled(df: DataFrame, features: list[str], penalties: dict[str, float] | None) -> DataFrame:
    # A ridge penalty p_j on column j equals a unit penalty on the column divided by sqrt(p_j).
    scales = penalties or {}
    cols = df.withColumns({f"_x_{f}": F.col(f).cast("double") / math.sqrt(scales.get(f, 1.0)) for f in features})
    return VectorAssembler(inputCols=[f"_x_{f}" for f in features], outputCol="_features").transform(cols)


def rows_alike(df: DataFrame, features: list[str], label: str, weight: str) -> DataFrame:
    """Rows with equal features and label as one: a fit without penalty has the same optimum, and for counts far fewer rows per pass.

    Their weights are summed, and scaled to one at most: the fit's first step is taken from the size of the weights.
    """
    alike = materialize(df.groupBy(*features, label).agg(F.sum(weight).alias(weight)), "alike")
    return alike.withColumn(weight, F.col(weight) / alike.agg(F.max(weight)).scalar())


def fit_glm(df: DataFrame, features: list[str], label: str, weight: str | None = None, link: str = "cloglog", ridge: float = 0.0,
            penalties: dict[str, float] | None = None, iterations: int = 30) -> Coefficients:
    """Weighted binary GLM with cloglog or logit link and optional per-feature ridge penalties."""
    data = _assembled(df, features, penalties).withColumn("_label", F.col(label).cast("double"))
    data = data.withColumn("_weight", F.col(weight).cast("double") if weight else F.lit(1.0)).select("_features", "_label", "_weight")
    if link == "logit":
        est = LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", regParam=ridge, standardization=False, maxIter=iterations)
    else:
        est = GeneralizedLinearRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", family="binomial", link=link, regParam=ridge, maxIter=iterations)
    model = est.fit(data)
    back = [1.0 / math.sqrt((penalties or {}).get(f, 1.0)) for f in features]
    return Coefficients(tuple(features), tuple(float(v) * s for v, s in zip(model.coefficients, back)), float(model.intercept), link)


def calibrate(df: DataFrame, eta: str, label: str, weight: str | None = None, link: str = "cloglog", bounds: tuple[float, float] = (0.0, 10.0)) -> Coefficients:
    """Shift and slope on a linear score; a slope outside its bounds is fixed there and the shift refitted."""
    fit = fit_glm(df, [eta], label, weight, link)
    slope = min(max(fit.values[0], bounds[0]), bounds[1])
    if slope == fit.values[0]:
        return fit
    # The slope is fixed: Newton steps on the shift alone, from the link of the prevalence, halved while they overshoot.
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(label).cast("double")
    mean_y, mean_eta = df.agg(F.sum(w * y) / F.sum(w), F.sum(w * F.col(eta)) / F.sum(w)).first()
    if not 0 < mean_y < 1:
        raise ValueError("calibration needs rows of both labels")
    shift = (math.log(-math.log1p(-mean_y)) if link == "cloglog" else math.log(mean_y / (1 - mean_y))) - slope * mean_eta

    def at(value: float) -> tuple[float, float, float]:
        line = F.lit(value) + F.lit(slope) * F.col(eta)
        if link == "cloglog":
            rate = F.exp(F.least(F.greatest(line, F.lit(-30.0)), F.lit(15.0)))
            p = F.least(F.greatest(-F.expm1(-rate), F.lit(1e-12)), F.lit(1 - 1e-12))
            loss, slope_, bend = -(y * F.log(p) - (1 - y) * rate), rate * (1 - y / p), rate * ((1 - y / p) + y * rate * (1 - p) / (p * p))
        else:
            p = F.least(F.greatest(scalar.logit_risk(line), F.lit(1e-12)), F.lit(1 - 1e-12))
            loss, slope_, bend = -(y * F.log(p) + (1 - y) * F.log(1 - p)), p - y, p * (1 - p)
        return df.agg(F.sum(w * loss) / F.sum(w), F.sum(w * slope_) / F.sum(w), F.sum(w * bend) / F.sum(w)).first()

    value, gradient, bend = at(shift)
    for _ in range(SHIFT_STEPS):
        if abs(gradient) < SHIFT_TOLERANCE:
            return Coefficients((eta,), (slope,), shift, link)
        step = -gradient / bend if bend > 1e-9 else -math.copysign(1.0, gradient)
        step = max(min(step, 4.0), -4.0)
        for _ in range(30):
            next_value, next_gradient, next_bend = at(shift + step)
            if next_value <= value + 1e-12:
                break
            step /= 2
        shift, value, gradient, bend = shift + step, next_value, next_gradient, next_bend
    if abs(gradient) < SHIFT_TOLERANCE:
        return Coefficients((eta,), (slope,), shift, link)
    raise ValueError(f"the calibration shift has not converged: gradient {gradient:.3g} at {shift:.6g}")


def calibrate_trajectory(df: DataFrame, etas: str, y: str, mask: str, weight: str) -> Coefficients:
    """Cloglog shift and slope over all uncensored steps of the score arrays."""
    steps = df.select(F.col(weight).alias("w"), F.explode(F.arrays_zip(F.col(etas).alias("e"), F.col(y).alias("l"), F.col(mask).alias("m"))).alias("z"))
    return calibrate(steps.filter("z.m = 1").selectExpr("z.e AS eta", "z.l AS hit", "w"), "eta", "hit", "w")


# --- sparse structured hazard ---------------------------------------------------

def places(spark, names: list[str]) -> DataFrame:
    """(feature, i): each name and its place, as columns and not row by row."""
    return spark.createDataFrame(pa.table({"feature": pa.array(names, pa.string()), "i": pa.array(range(len(names)), pa.int32())}))


def sparse_rows(base: DataFrame, keys: list[str], dense: dict[str, Column], long: DataFrame, names: list[str], label: str, weight: str,
                extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per key with index/value arrays over ``names``; ``long`` adds sparse (feature, value) terms.

    Terms get their place by a join with the list of names, so there may be one per edge and lag; ``long`` may also name them by that place already (i, value).
    """
    position = {n: i for i, n in enumerate(names)}
    placed = long if "i" in long.columns else long.join(places(base.sparkSession, names), "feature")
    grouped = placed.groupBy(*keys).agg(
        F.collect_list(F.struct(F.col("i").alias("i"), F.col("value").cast("double").alias("v"))).alias("_sparse"))
    fixed = F.array(*[F.struct(F.lit(position[n]).alias("i"), c.cast("double").alias("v")) for n, c in dense.items()])
    joined = base.join(grouped, keys, "left")
    return joined.select(*keys, F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"),
                         F.concat(fixed, F.coalesce("_sparse", F.array().cast("array<struct<i:int,v:double>>"))).alias("x"), *extra)


def selection_frequency(fits: DataFrame, threshold: float = 1e-6, stable: float = 0.7) -> DataFrame:
    """Share of replicates that keep a term, coefficient quartiles, and the stable mask."""
    return fits.groupBy("feature").agg(
        F.avg((F.abs("coefficient") > threshold).cast("int")).alias("frequency"),
        F.percentile("coefficient", F.lit(0.25)).alias("q25"), F.percentile("coefficient", F.lit(0.5)).alias("median"),
        F.percentile("coefficient", F.lit(0.75)).alias("q75")).withColumn("stable", (F.col("frequency") >= stable).cast("int"))


# --- sandwich covariance and Wald test -------------------------------------------

def _outer_sums(df: DataFrame, columns: list[str], weight: str) -> np.ndarray:
    """Sum of w x x' over all rows; tasks return p*p partial sums."""
    p = len(columns)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, p))
        for pdf in frames:
            x = pdf[columns].to_numpy(dtype="float64")
            total += (x * pdf[weight].to_numpy(dtype="float64")[:, None]).T @ x
        yield pd.DataFrame({"k": np.arange(p * p), "v": total.ravel()})

    sums = df.select(*columns, weight).mapInPandas(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(p * p)
    for r in sums:
        out[r["k"]] = r["v"]
    return out.reshape(p, p)


def cluster_sandwich(df: DataFrame, fit: Coefficients, label: str, weight: str, cluster: str) -> np.ndarray:
    """Cluster-robust covariance of (intercept, features) for a logit or cloglog fit."""
    names = ["_one", *fit.features]
    rate = F.exp(F.greatest(F.least(fit.eta(), F.lit(15.0)), F.lit(-30.0)))
    p = fit.risk()
    if fit.link == "cloglog":
        residual = F.col(weight) * rate * (F.col(label) / F.greatest(p, F.lit(1e-12)) - 1)
        curvature = F.col(weight) * rate * rate * (1 - p) / F.greatest(p, F.lit(1e-12))
    else:
        residual, curvature = F.col(weight) * (F.col(label) - p), F.col(weight) * p * (1 - p)
    data = df.withColumns({"_one": F.lit(1.0), "_res": residual, "_cur": curvature})
    bread = np.linalg.pinv(_outer_sums(data, names, "_cur"))
    scores = data.groupBy(cluster).agg(*[F.sum(F.col(c) * F.col("_res")).alias(c) for c in names]).withColumn("_w", F.lit(1.0))
    return bread @ _outer_sums(scores, names, "_w") @ bread


def _chi2_tail(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution (regularized incomplete gamma, by series or continued fraction)."""
    a, z = df / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= z / n
            total += term
        return 1.0 - front * total
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def wald_test(fit: Coefficients, covariance: np.ndarray, terms: list[str]) -> tuple[float, int, float]:
    """Joint test that the listed coefficients are zero: (statistic, degrees of freedom, p)."""
    at = [1 + fit.features.index(t) for t in terms]
    b = np.array([fit.values[i - 1] for i in at])
    v = covariance[np.ix_(at, at)]
    statistic = float(b @ np.linalg.pinv(v) @ b)
    rank = int(np.linalg.matrix_rank(v))
    return statistic, rank, _chi2_tail(statistic, rank)


# --- boosted trees ----------------------------------------------------------------

def fit_boosted(train: DataFrame, features: list[str], label: str, cap: float = 50.0, rounds: int = 10, depth: int = 4):
    """Gradient-boosted trees with a capped positive class weight."""
    positives, rows = train.agg(F.sum(label), F.count(F.lit(1))).first()
    weight = min((rows - positives) / max(positives, 1), cap)
    data = VectorAssembler(inputCols=features, outputCol="_features").transform(train.fillna(0, features)).select(
        "_features", F.col(label).cast("double").alias("_label"), F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(1.0).alias("_weight"))
    return GBTClassifier(featuresCol="_features", labelCol="_label", weightCol="_weight", maxIter=rounds, maxDepth=depth, seed=7).fit(data)


def score_boosted(model, rows: DataFrame, features: list[str], out: str = "risk") -> DataFrame:
    data = VectorAssembler(inputCols=features, outputCol="_features").transform(rows.fillna(0, features))
    return model.transform(data).withColumn(out, vector_to_array("probability")[1]).select(*rows.columns, out)


#: Values that a feature keeps in the trees at most, as MLlib's trees do; a feature with more is cut at this many quantiles.
TREE_BINS = 32


@dataclass(frozen=True)
class BinnedTrees:
    """Boosted trees over bin numbers, and the inner edges of the bins of each feature."""

    edges: dict[str, list[float]]
    model: object


def feature_edges(train: DataFrame, features: list[str], bins: int = TREE_BINS) -> dict[str, list[float]]:
    """Inner edges of each feature's bins, from all rows: between all values where there are few, else at quantiles."""
    shares = [k / bins for k in range(1, bins)]
    train = train.fillna(0, features)
    known = train.agg(*[F.percentile_approx(f, shares, 10_000).alias(f"q_{i}") for i, f in enumerate(features)],
                      *[F.approx_count_distinct(f).alias(f"n_{i}") for i, f in enumerate(features)]).first()
    # The count is off by a few per cent; whether there are few is settled by the values themselves.
    few = [i for i in range(len(features)) if known[f"n_{i}"] <= 2 * bins]
    sets = train.agg(*[F.sort_array(F.collect_set(features[i])).alias(f"s_{i}") for i in few]).first() if few else {}
    edges = {}
    for i, f in enumerate(features):
        values = sets[f"s_{i}"] if i in few else None
        if values is not None and len(values) <= bins:
            edges[f] = [(a + b) / 2 for a, b in zip(values, values[1:])]
        else:
            edges[f] = sorted(set(known[f"q_{i}"] or ()))
    return edges


def binned(rows: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Rows with bin numbers in place of the features; a missing value is zero."""
    names = list(edges)
    cut = Bucketizer(splitsArray=[[-math.inf, *edges[f], math.inf] for f in names], inputCols=names, outputCols=[f"_bin_{f}" for f in names])
    rest = [c for c in rows.columns if c not in edges]
    # The bucketizer marks its numbers as categories, which a tree would split without regard to their order; a cast drops the mark.
    return cut.transform(rows.fillna(0, names)).select(*rest, *[F.col(f"_bin_{f}").cast("int").alias(f) for f in names])


def rows_of_bins(rows: DataFrame, edges: dict[str, list[float]], by: list[str], out: str = "n") -> DataFrame:
    """(by, bin numbers, n): rows that no tree over these bins can tell apart, as one with their count."""
    return binned(rows, edges).groupBy(*by, *edges).agg(F.count(F.lit(1)).alias(out))


def fit_boosted_binned(train: DataFrame, edges: dict[str, list[float]], label: str, count: str, cap: float = 50.0, rounds: int = 10, depth: int = 4, every_bin: bool = False) -> BinnedTrees:
    """As :func:`fit_boosted`, over :func:`rows_of_bins`: the sums that the trees are grown from are those of the rows themselves.

    MLlib looks for split candidates in a sample of as many rows as the square of its limit of bins, or of ten thousand.  With ``every_bin`` that
    limit is set so high that it looks at all rows; there are never more candidates than bins of ``edges``.
    """
    features = list(edges)
    limit = max(TREE_BINS, math.isqrt(train.count()) + 1) if every_bin else TREE_BINS
    positives, rows = train.agg(F.sum(F.col(label) * F.col(count)), F.sum(count)).first()
    weight = min((rows - positives) / max(positives, 1), cap)
    data = VectorAssembler(inputCols=features, outputCol="_features").transform(train).select(
        "_features", F.col(label).cast("double").alias("_label"), (F.col(count) * F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(1.0)).alias("_weight"))
    model = GBTClassifier(featuresCol="_features", labelCol="_label", weightCol="_weight", maxIter=rounds, maxDepth=depth, maxBins=limit, seed=7).fit(data)
    return BinnedTrees(edges, model)


def score_boosted_binned(trees: BinnedTrees, rows: DataFrame, out: str = "risk") -> DataFrame:
    """Risk of :func:`rows_of_bins`."""
    data = VectorAssembler(inputCols=list(trees.edges), outputCol="_features").transform(rows)
    return trees.model.transform(data).withColumn(out, vector_to_array("probability")[1]).select(*rows.columns, out)
