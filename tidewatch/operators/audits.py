"""Table contracts and audits; every check is a row or a count, never a crash."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timeline_contract(rows: DataFrame, step: int, expected: Column, year: Column | None = None) -> DataFrame:
    """Per entity: row count against the calendar, duplicates, gaps, misaligned rows, and rows of bins that start in another year than ``year``."""
    w = "PARTITION BY entity ORDER BY t"
    strange = F.lit(False) if year is None else F.year(F.timestamp_seconds(F.col("t") - step)) != year
    stepped = rows.withColumn("other_year", strange).selectExpr("entity", "t", "other_year", f"t - lag(t) OVER ({w}) AS d")
    out = stepped.groupBy("entity").agg(*[F.expr(e) for e in (
        "count(1) AS rows_n", "count_if(d = 0) AS duplicates", f"count_if(d <> 0 AND d <> {step}) AS gaps", f"count_if(t % {step} <> 0) AS misaligned",
        "count_if(other_year) AS other_years")])
    return out.withColumn("expected_rows", expected).withColumn(
        "passed", F.expr("CAST(rows_n = expected_rows AND duplicates = 0 AND gaps = 0 AND misaligned = 0 AND other_years = 0 AS INT)"))


def violations(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, violations) for SQL predicates that must never hold; one pass."""
    one = rows.selectExpr(*[f"count_if({p}) AS {n}" for n, p in rules.items()])
    return one.selectExpr(f"stack({len(rules)}, " + ", ".join(f"'{n}', {n}" for n in rules) + ") AS (rule, violations)")


# Invariants of the risk table: each predicate marks a broken row.
RISK_INVARIANTS = {
    "label_outside_risk_set": "hazard_label = 1 AND risk_set <> 1",
    "risk_without_physical": "risk_set = 1 AND physical_at_risk <> 1",
    "risk_without_history": "risk_set = 1 AND history_valid <> 1",
    "risk_without_label": "risk_set = 1 AND step_label_valid <> 1",
    "risk_with_positive": "risk_set = 1 AND positive_minutes > 0",
    "hard_negative_with_event": "hard_negative_21600 = 1 AND onset_within_21600 = 1",
    "hard_negative_unexposed": "hard_negative_21600 = 1 AND exposure_recent <> 1",
}


def reconcile(checks: dict[str, tuple[Column, Column]], spark) -> DataFrame:
    """(check, observed, expected, status) from pairs of scalar subqueries."""
    row = spark.range(1).select(*[F.struct(a.cast("bigint").alias("observed"), b.cast("bigint").alias("expected")).alias(n) for n, (a, b) in checks.items()])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("v")) for n in checks])).alias("x")).select("x.check", "x.v.*")
    return long.withColumn("status", F.when(F.col("observed") == F.col("expected"), "PASS").otherwise("FAIL"))


def key_audit(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Rows, duplicate keys and keys shared with any other part, per part.

    One aggregate by key over the tagged union replaces pairwise intersections.
    """
    tagged = reduce(DataFrame.unionByName, [d.select(*keys, F.lit(n).alias("part")) for n, d in parts.items()])
    per = tagged.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))
    shared = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("parts"), F.collect_list(F.struct("part", "n")).alias("p"))
    return shared.select("parts", F.explode("p").alias("p")).groupBy(F.col("p.part").alias("part")).agg(
        F.sum("p.n").alias("rows_n"), F.sum(F.col("p.n") - 1).alias("duplicates"), F.sum((F.col("parts") > 1).cast("int")).alias("shared_keys"))


def uncovered_keys(universe: DataFrame, parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Keys of the universe and how many of them no part holds."""
    held = reduce(DataFrame.unionByName, [d.select(*keys) for d in parts.values()]).distinct().withColumn("_held", F.lit(1))
    joined = universe.select(*keys).distinct().join(held, keys, "left")
    return joined.agg(F.count(F.lit(1)).alias("keys_n"), F.count_if(F.col("_held").isNull()).alias("uncovered"))


def prefix_invariance(rows: DataFrame, cut: Column, score: str, operator: Callable[[DataFrame], DataFrame], outputs: list[str]) -> DataFrame:
    """Run an operator on everything, on the prefix alone, and with the future changed; count prefix rows that differ."""
    marked = rows.withColumn("_cut", cut)
    past = F.col("t") < F.col("_cut")
    whole = operator(marked)
    prefix = operator(marked.filter(past))
    shaken = operator(marked.withColumn(score, F.when(past, F.col(score)).otherwise(F.lit(100.0) + F.coalesce(F.col(score), F.lit(0.0)))))
    keep = ["entity", "t", *outputs]

    def differing(other: DataFrame) -> Column:
        a, b = whole.filter(past).select(*keep), other.filter(past).select(*keep)
        return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count(F.lit(1))).scalar()

    return rows.sparkSession.range(1).select(differing(prefix).alias("prefix_differences"), differing(shaken).alias("future_differences"),
                                             whole.filter(past).agg(F.count(F.lit(1))).scalar().alias("rows_checked"))


def queue_contract(records: DataFrame, expected: DataFrame) -> DataFrame:
    """Queue sizes per period against the agreed counts."""
    seen = records.groupBy("period").agg(F.sum("evaluable").alias("complete"), F.sum("operational").alias("operational"), F.count(F.lit(1)).alias("events"))
    return expected.join(seen, "period", "left").withColumn("status", F.when(
        F.col("complete").eqNullSafe(F.col("want_complete")) & F.col("operational").eqNullSafe(F.col("want_operational")), "PASS").otherwise("FAIL"))
