"""Fits that read all of their rows."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import models
from tidewatch.plans import model_queries


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A log of 230 users over 25 days, three events in ten a purchase."""
    root = str(tmp_path_factory.mktemp("tables"))
    spark.range(230 * 40).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + (id DIV 230) * 54000 + (id * 7919) % 50000) AS ts", "id % 230 AS user_id",
                                     "CASE WHEN id * 31 % 10 < 3 THEN 'purchase' WHEN id % 3 = 0 THEN 'click' ELSE 'view' END AS event_type", "1.0D * (id % 100) AS value",
                                     "'{\"k\": 1}' AS props").write.parquet(f"{root}/events.parquet")
    return root


def test_boosted_trees_are_grown_from_all_training_rows(spark, events, monkeypatch):
    seen = []
    fit = models.GBTClassifier.fit

    def spied(self, data, *more):
        held = data.groupBy("_label").agg(F.sum("_weight").alias("w"), F.count("*").alias("n")).collect()
        seen.append(({r["_label"]: r["w"] for r in held}, sum(r["n"] for r in held), self.getMaxBins()))
        return fit(self, data, *more)

    monkeypatch.setattr(models.GBTClassifier, "fit", spied)
    scores = model_queries.boosted_scores(spark, events)
    weights, rows, bins = seen[0]
    p = model_queries.causal_recurrence_features(model_queries.panel(spark, events), model_queries.HORIZON)
    lo = p.agg(F.min("t")).first()[0]
    train = p.filter((F.col("t") + model_queries.HORIZON * model_queries.HOUR <= lo + 10 * model_queries.DAY) & (F.col("observed") == 1))
    n = {r["future"]: r["n"] for r in train.groupBy("future").agg(F.count("*").alias("n")).collect()}
    assert sum(n.values()) > 50_000 and weights[0.0] == n[0]
    assert weights[1.0] == pytest.approx(n[1] * min(n[0] / n[1], 20.0))
    # So many bins are allowed that MLlib takes no sample to find split candidates.
    assert bins**2 >= rows
    assert scores.count() == p.filter(F.col("t") + model_queries.HORIZON * model_queries.HOUR > lo + 10 * model_queries.DAY).count()
