"""Grouped summaries and data audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import binning, episodes, scan
from tidewatch.plans.registry import cte, query
from tidewatch.plans.standins import (HOUR, PANEL_TYPES, catalog_view, episode_events, readings, risk_rows, scored,
                                      sensor_rows, sensor_timeline)
from tidewatch.session import table


@query("ag1_sensor_bins", "entity:i bin_start:i raw_rows:i observed_minutes:i positive_minutes:i temp_count:i temp_sum:f temp_min:f rh_max:f vis_sum:f vis_min:f fog_minutes:i",
       "SELECT *, temp_ds/10.0 AS temp_sum FROM bins", "bins")
def ag1(spark, root):
    return binning.bin_sensors(sensor_rows(spark, root), HOUR, ["temp", "rh", "vis"], ["temp", "vis"], ["rh"], ["fog"], F.col("thickness") > 0)


@query("ag2_dense_bin_features", "entity:i t:i observed_minutes:i raw_rows:i coverage:f label_coverage:f temp_mean:f rh_mean:f vis_mean:f fog_fraction:f", "SELECT * FROM tl", "tl")
def ag2(spark, root):
    return sensor_timeline(spark, root)


@query("ag3_counts_by_type", "entity:i t:i event_count:i view_count:i cart_count:i remove_count:i", "SELECT * FROM counts", "counts")
def ag3(spark, root):
    return binning.count_by_type(readings(spark, root), HOUR, PANEL_TYPES)


cte("cells", """SELECT city || '|' || printf('%.4f', floor(lat/0.5)*0.5) || '|' || printf('%.4f', floor(lon/0.5)*0.5) AS cell, epoch_us(o_orderdate)//1000000//86400*86400 AS t,
 CAST(round(o_totalprice*100) AS BIGINT) AS cents FROM orders JOIN stations ON o_custkey=station""", "stations")


def _cells(spark, root):
    o = table(spark, root, "orders").selectExpr("o_custkey AS station", "unix_micros(CAST(o_orderdate AS TIMESTAMP)) DIV 86400000000 * 86400 AS t",
                                                "CAST(round(o_totalprice * 100) AS BIGINT) AS cents")
    return o.join(catalog_view(spark, root), "station").withColumn("entity", binning.grid_cell(F.col("city"), F.col("lat"), F.col("lon"), 0.5))


@query("ag4_grid_cell_days", "cell:s t:i event_count:i severity_mean:f",
       "SELECT cell, t, count(*) AS event_count, sum(cents)/100.0/count(*) AS severity_mean FROM cells GROUP BY 1,2", "cells")
def ag4(spark, root):
    return _cells(spark, root).groupBy(F.col("entity").alias("cell"), "t").agg(
        F.count(F.lit(1)).alias("event_count"), (F.sum("cents") / 100.0 / F.count(F.lit(1))).alias("severity_mean"))


@query("ag5_frequent_entities", "entity:i n:i", "SELECT user_id AS entity, count(*) AS n FROM events WHERE event_type='purchase' GROUP BY 1 HAVING count(*)>=2 ORDER BY n DESC, 1 LIMIT 50")
def ag5(spark, root):
    return binning.frequent_entities(readings(spark, root).filter("event_type = 'purchase'"), 2, 50)


@query("ag6_masked_moments", "split:s feature:s n:i mean:f std:f low:f high:f",
       """SELECT split, feature, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS low, max(v) AS high FROM (
       SELECT CASE WHEN t < lo+15*86400 THEN 'train' ELSE 'test' END AS split, f.feature, CASE f.feature WHEN 'temp_mean' THEN temp_mean WHEN 'rh_mean' THEN rh_mean ELSE vis_mean END AS v
       FROM tl, bounds, (VALUES ('temp_mean'),('rh_mean'),('vis_mean')) f(feature) WHERE observed_minutes>0) GROUP BY 1,2""", "tl bounds")
def ag6(spark, root):
    from tidewatch.plans.standins import grid_bounds

    tl = sensor_timeline(spark, root).filter("observed_minutes > 0")
    lo = grid_bounds(readings(spark, root))["lo"]
    return binning.unpivot_stats(tl.withColumn("split", F.when(F.col("t") < lo + 15 * 86400, "train").otherwise("test")),
                                 ["temp_mean", "rh_mean", "vis_mean"], ["split"])


@query("ag7_nested_rollups", "level:s entity:i year:i orders:i cents:i",
       """SELECT CASE WHEN GROUPING(yr)=0 THEN 'station_year' ELSE 'station' END AS level, o_custkey AS entity, coalesce(yr,0) AS year, count(*) AS orders, sum(CAST(round(o_totalprice*100) AS BIGINT)) AS cents
       FROM (SELECT *, year(o_orderdate) AS yr FROM orders) GROUP BY GROUPING SETS ((o_custkey),(o_custkey,yr))""")
def ag7(spark, root):
    o = table(spark, root, "orders").selectExpr("o_custkey AS entity", "year(o_orderdate) AS yr", "CAST(round(o_totalprice * 100) AS BIGINT) AS c")
    sets = o.groupingSets([[F.col("entity")], [F.col("entity"), F.col("yr")]], F.col("entity"), F.col("yr"))
    return sets.agg(F.expr("CASE WHEN grouping(yr) = 0 THEN 'station_year' ELSE 'station' END").alias("level"),
                    F.count(F.lit(1)).alias("orders"), F.sum("c").alias("cents")).withColumn("year", F.coalesce("yr", F.lit(0)))


@query("ag8_anomaly_counters", "anomaly:s n:i",
       """SELECT 'temp_low' AS anomaly, count(*) FILTER (temp_d < -100) AS n FROM rd UNION ALL SELECT 'rh_high', count(*) FILTER (rh_d > 980) FROM rd
       UNION ALL SELECT 'vis_missing', count(*) FILTER (vis IS NULL) FROM rd UNION ALL SELECT 'value_high', count(*) FILTER (cents > 20000) FROM rd""", "rd")
def ag8(spark, root):
    return anomaly_counts(readings(spark, root), {"temp_low": "temp_d < -100", "rh_high": "rh_d > 980",
                                                  "vis_missing": "vis IS NULL", "value_high": "cents > 20000"})


def anomaly_counts(df, rules: dict[str, str]):
    """All counters in one pass, in long form."""
    one = df.selectExpr(*[f"count_if({rule}) AS {name}" for name, rule in rules.items()])
    return one.selectExpr(f"stack({len(rules)}, " + ", ".join(f"'{n}', {n}" for n in rules) + ") AS (anomaly, n)")


_AUDIT_SQL = """count(*) AS rows_n, count(DISTINCT day) AS days, min(cents) AS low, max(cents) AS high, avg(cents) AS mean, stddev_pop(cents) AS sd,
 count(*) FILTER (cents>20000) AS large, 100.0*count(*) FILTER (cents>20000)/count(*) AS large_pct, count(*) FILTER (o_orderstatus='F') AS closed"""


@query("ag9_station_month_audit", "scope:s entity:i period:s rows_n:i days:i low:i high:i mean:f sd:f large:i large_pct:f closed:i",
       f"""SELECT CASE WHEN GROUPING(entity)=1 THEN 'month' WHEN GROUPING(month)=1 THEN 'station_year' ELSE 'station_month' END AS scope,
       coalesce(entity,-1) AS entity, coalesce(month, CAST(yr AS VARCHAR)) AS period, {_AUDIT_SQL}
       FROM (SELECT o_custkey AS entity, strftime(o_orderdate,'%Y-%m') AS month, year(o_orderdate) AS yr, CAST(o_orderdate AS DATE) AS day, o_orderstatus, CAST(round(o_totalprice*100) AS BIGINT)%50000 AS cents FROM orders)
       GROUP BY GROUPING SETS ((entity,yr),(month),(entity,month))""")
def ag9(spark, root):
    o = table(spark, root, "orders").selectExpr(
        "o_custkey AS entity", "date_format(o_orderdate, 'yyyy-MM') AS month", "year(o_orderdate) AS yr", "CAST(o_orderdate AS DATE) AS day",
        "o_orderstatus", "CAST(round(o_totalprice * 100) AS BIGINT) % 50000 AS cents")
    e, m, y = F.col("entity"), F.col("month"), F.col("yr")
    aggs = ["count(1) AS rows_n", "count(DISTINCT day) AS days", "min(cents) AS low", "max(cents) AS high", "avg(cents) AS mean", "stddev_pop(cents) AS sd",
            "count_if(cents > 20000) AS large", "100.0D * count_if(cents > 20000) / count(1) AS large_pct", "count_if(o_orderstatus = 'F') AS closed",
            "CASE WHEN grouping(entity) = 1 THEN 'month' WHEN grouping(month) = 1 THEN 'station_year' ELSE 'station_month' END AS scope"]
    sets = o.groupingSets([[e, y], [m], [e, m]], e, m, y).agg(*[F.expr(a) for a in aggs])
    return sets.selectExpr("scope", "coalesce(entity, -1) AS entity", "coalesce(month, CAST(yr AS STRING)) AS period",
                           "rows_n", "days", "low", "high", "mean", "sd", "large", "large_pct", "closed")


@query("ag10_category_share", "category:s records:i percentage:f",
       "SELECT lang || '/' || source AS category, count(*) AS records, 100.0*count(*)/(SELECT count(*) FROM documents) AS percentage FROM documents GROUP BY 1 ORDER BY records DESC, category LIMIT 15")
def ag10(spark, root):
    return category_share(table(spark, root, "documents").selectExpr("lang || '/' || source AS category"), "category", 15)


def category_share(df, column: str, n: int):
    """Most common categories with their share of all rows (a top-n report)."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("records"))
    total = counted.agg(F.sum("records")).scalar()
    return (counted.withColumn("percentage", 100.0 * F.col("records") / total)
            .orderBy(F.desc("records"), column).limit(n))


@query("ag11_missingness", "field:s missing:i share:f",
       """SELECT 'temp' AS field, count(*) FILTER (temp_d IS NULL) AS missing, count(*) FILTER (temp_d IS NULL)*1.0/count(*) AS share FROM rd
       UNION ALL SELECT 'vis', count(*) FILTER (vis IS NULL), count(*) FILTER (vis IS NULL)*1.0/count(*) FROM rd UNION ALL SELECT 'rh', count(*) FILTER (rh_d IS NULL), count(*) FILTER (rh_d IS NULL)*1.0/count(*) FROM rd""", "rd")
def ag11(spark, root):
    counts = anomaly_counts(readings(spark, root), {"temp": "temp_d IS NULL", "vis": "vis IS NULL", "rh": "rh_d IS NULL"})
    total = readings(spark, root).agg(F.count(F.lit(1))).scalar()
    return counts.select(F.col("anomaly").alias("field"), F.col("n").alias("missing"), (F.col("n") / total).alias("share"))


@query("ag12_distribution_summary", "event_type:s n:i mean:f std:f minimum:f p25:f median:f p75:f p90:f maximum:f",
       """SELECT event_type, count(*) AS n, sum(cents)/100.0/count(*) AS mean, stddev_samp(value) AS std, min(value) AS minimum, quantile_cont(value,0.25) AS p25, quantile_cont(value,0.5) AS median,
       quantile_cont(value,0.75) AS p75, quantile_cont(value,0.9) AS p90, max(value) AS maximum FROM (SELECT event_type, cents, cents/100.0::DOUBLE AS value FROM rd) GROUP BY 1""", "rd")
def ag12(spark, root):
    r = readings(spark, root).selectExpr("event_type", "cents / 100.0D AS value")
    return scan.distribution_summary(r, "value", ("event_type",))


@query("ag13_deterministic_mode", "entity:i favourite:s", """SELECT entity, event_type AS favourite FROM (SELECT entity, event_type, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, event_type) AS rn FROM rd GROUP BY 1,2) WHERE rn=1""", "rd")
def ag13(spark, root):
    return readings(spark, root).groupBy("entity").agg(F.mode("event_type", deterministic=True).alias("favourite"))


@query("ag14_observed_years", "entity:i observed_years:s",
       "SELECT o_custkey AS entity, string_agg(y, ',' ORDER BY y) AS observed_years FROM (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders) GROUP BY 1")
def ag14(spark, root):
    return table(spark, root, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(
        F.array_join(F.array_sort(F.collect_set(F.year("o_orderdate").cast("string"))), ",").alias("observed_years"))


def concentration(months, entity: str = "entity"):
    """Peak month, its share, HHI, normalized entropy and winter share per entity from month counts."""
    total = months.groupBy(entity).agg(F.sum("n").alias("total"))
    s = months.join(total, entity).withColumn("share", F.col("n") / F.col("total"))
    return s.groupBy(entity).agg(
        F.max("total").alias("event_count"),
        (-F.max(F.struct("n", (-F.col("month")).alias("m")))["m"]).alias("peak_month"),
        F.max("share").alias("peak_share"), F.sum(F.col("share") * F.col("share")).alias("hhi"),
        (-F.sum(F.col("share") * F.log("share")) / F.log(F.lit(12.0))).alias("entropy"),
        F.sum(F.when(F.col("month").isin(12, 1, 2), F.col("share")).otherwise(0.0)).alias("winter_share"))


@query("ag15_concentration", "entity:i event_count:i peak_month:i peak_share:f hhi:f entropy:f winter_share:f",
       """SELECT entity, max(tot) AS event_count, arg_max(month, n*100-month) AS peak_month, max(n*1.0/tot) AS peak_share, sum((n*1.0/tot)*(n*1.0/tot)) AS hhi,
       -sum((n*1.0/tot)*ln(n*1.0/tot))/ln(12) AS entropy, coalesce(sum(n*1.0/tot) FILTER (month IN (12,1,2)),0) AS winter_share
       FROM (SELECT *, sum(n) OVER (PARTITION BY entity) AS tot FROM (SELECT o_custkey AS entity, month(o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1,2)) GROUP BY 1""")
def ag15(spark, root):
    months = table(spark, root, "orders").groupBy(F.col("o_custkey").alias("entity"), F.month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return concentration(months)


@query("ag16_month_by_recurrence", "onset_year:i onset_month:i season:s recurrence:s n:i",
       "SELECT onset_year, onset_month, season, recurrence, count(*) AS n FROM epv GROUP BY 1,2,3,4", "epv")
def ag16(spark, root):
    return episodes.order_valid_events(episode_events(spark, root)).groupBy("onset_year", "onset_month", "season", "recurrence").agg(F.count(F.lit(1)).alias("n"))


def _two_scores(spark, root):
    return scored(spark, root).filter("score IS NOT NULL").selectExpr(
        "entity", "t", "future AS label", "noise / 997.0D AS base", "score AS extra", "1.0D + pmod(t DIV 3600, 3) AS weight")


cte("two", "SELECT entity, t, future AS label, noise/997.0 AS base, score AS extra, 1.0 + (t//3600)%3 AS weight FROM scored WHERE score IS NOT NULL", "scored")


def entity_heterogeneity(df):
    """How evenly a score change helps: effective positive entities, share improved, median deltas."""
    per = df.selectExpr("entity", "label", "weight", "greatest(least(base, 1 - 1e-12D), 1e-12D) AS b", "greatest(least(extra, 1 - 1e-12D), 1e-12D) AS x").selectExpr(
        "entity", "label", "weight",
        "weight * (-(label * ln(x) + (1 - label) * ln(1 - x)) + (label * ln(b) + (1 - label) * ln(1 - b))) AS dl",
        "weight * ((x - label) * (x - label) - (b - label) * (b - label)) AS db").groupBy("entity").agg(
        (F.sum("dl") / F.sum("weight")).alias("dl"), (F.sum("db") / F.sum("weight")).alias("db"), F.sum("label").alias("pos"))
    whole = per.agg(F.count(F.lit(1)).alias("entities"), F.sum((F.col("pos") > 0).cast("int")).alias("positive_entities"),
                    (F.pow(F.sum("pos"), F.lit(2)) / F.sum(F.col("pos") * F.col("pos"))).alias("effective_entities"),
                    F.avg((F.col("dl") < 0).cast("int")).alias("improved_loss"), F.avg((F.col("db") < 0).cast("int")).alias("improved_brier"),
                    F.lit(1).alias("one"))
    q = scan.exact_quantiles(per, "dl", {"q25_dl": .25, "median_dl": .5, "q75_dl": .75}).withColumn("one", F.lit(1))
    b = scan.exact_quantiles(per, "db", {"median_db": .5}).withColumn("one", F.lit(1))
    return whole.join(q, "one").join(b, "one")


@query("ag17_entity_heterogeneity", "entities:i positive_entities:i effective_entities:f improved_loss:f improved_brier:f q25_dl:f median_dl:f q75_dl:f median_db:f",
       """SELECT count(*) AS entities, count(*) FILTER (pos>0) AS positive_entities, pow(sum(pos),2)/sum(pos*pos) AS effective_entities, avg(CASE WHEN dl<0 THEN 1 ELSE 0 END) AS improved_loss,
       avg(CASE WHEN db<0 THEN 1 ELSE 0 END) AS improved_brier, quantile_cont(dl,0.25) AS q25_dl, quantile_cont(dl,0.5) AS median_dl, quantile_cont(dl,0.75) AS q75_dl, quantile_cont(db,0.5) AS median_db FROM (
       SELECT entity, sum(label) AS pos, sum(weight*(-(label*ln(x)+(1-label)*ln(1-x))+(label*ln(b)+(1-label)*ln(1-b))))/sum(weight) AS dl, sum(weight*((x-label)*(x-label)-(b-label)*(b-label)))/sum(weight) AS db
       FROM (SELECT *, greatest(least(base,1-1e-12),1e-12) AS b, greatest(least(extra,1-1e-12),1e-12) AS x FROM two) GROUP BY 1)""", "two")
def ag17(spark, root):
    return entity_heterogeneity(_two_scores(spark, root))


def weighted_correlation(df, x: str, y: str, w: str, by: list[str]):
    """Weighted Pearson correlation and means from sums in one aggregate."""
    s = df.groupBy(*by).agg(*[F.expr(e) for e in (
        f"sum({w}) AS sw", f"sum({w}*{x}) AS sx", f"sum({w}*{y}) AS sy", f"sum({w}*{x}*{x}) AS sxx", f"sum({w}*{y}*{y}) AS syy", f"sum({w}*{x}*{y}) AS sxy")])
    return s.selectExpr(*by, "sx / sw AS mean_x", "sy / sw AS mean_y",
                        "try_divide(sxy / sw - sx / sw * sy / sw, sqrt((sxx / sw - sx / sw * sx / sw) * (syy / sw - sy / sw * sy / sw))) AS correlation")


@query("ag18_weighted_correlation", "label:i mean_x:f mean_y:f correlation:f",
       """SELECT label, sum(weight*base)/sum(weight) AS mean_x, sum(weight*extra)/sum(weight) AS mean_y,
       (sum(weight*base*extra)/sum(weight)-sum(weight*base)/sum(weight)*sum(weight*extra)/sum(weight))/sqrt((sum(weight*base*base)/sum(weight)-pow(sum(weight*base)/sum(weight),2))*(sum(weight*extra*extra)/sum(weight)-pow(sum(weight*extra)/sum(weight),2))) AS correlation
       FROM two GROUP BY 1""", "two")
def ag18(spark, root):
    return weighted_correlation(_two_scores(spark, root), "base", "extra", "weight", ["label"])


def score_agreement(df, x: str, y: str):
    """Pearson, Spearman (average ranks), RMSE and maximum absolute difference of two scores."""
    ranked = df.join(scan.average_ranks(df, x), x).join(scan.average_ranks(df, y), y)
    return ranked.agg(F.corr(x, y).alias("pearson"), F.corr(f"{x}_rank", f"{y}_rank").alias("spearman"),
                      F.sqrt(F.avg((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)))).alias("rmse"),
                      F.max(F.abs(F.col(x) - F.col(y))).alias("max_abs"), F.count(F.lit(1)).alias("rows_n"))


@query("ag19_score_agreement", "pearson:f spearman:f rmse:f max_abs:f rows_n:i",
       """SELECT corr(base,extra) AS pearson, corr(rb,rx) AS spearman, sqrt(avg((base-extra)*(base-extra))) AS rmse, max(abs(base-extra)) AS max_abs, count(*) AS rows_n FROM (
       SELECT *, rank() OVER (ORDER BY base) + (count(*) OVER (PARTITION BY base)-1)/2.0 AS rb, rank() OVER (ORDER BY extra) + (count(*) OVER (PARTITION BY extra)-1)/2.0 AS rx FROM two)""", "two")
def ag19(spark, root):
    return score_agreement(_two_scores(spark, root), "base", "extra")


@query("ag20_distinct_pairs", "returnflag:s pairs:i rows_n:i", "SELECT l_returnflag AS returnflag, count(DISTINCT (l_partkey, l_suppkey)) AS pairs, count(*) AS rows_n FROM lineitem GROUP BY 1")
def ag20(spark, root):
    return table(spark, root, "lineitem").groupBy(F.col("l_returnflag").alias("returnflag")).agg(
        F.count_distinct(F.struct("l_partkey", "l_suppkey")).alias("pairs"), F.count(F.lit(1)).alias("rows_n"))


@query("ag21_mean_std_over_seeds", "model:s evaluation:s seeds:i brier_mean:f brier_std:f rate_mean:f rate_std:f",
       """SELECT model, evaluation, count(*) AS seeds, avg(brier) AS brier_mean, stddev_samp(brier) AS brier_std, avg(rate) AS rate_mean, stddev_samp(rate) AS rate_std FROM (
       SELECT m.model, CASE WHEN label=1 THEN 'positive' ELSE 'negative' END AS evaluation, entity%5 AS seed, avg(pow(CASE m.model WHEN 'base' THEN base ELSE extra END - label,2)) AS brier, avg(CASE m.model WHEN 'base' THEN base ELSE extra END) AS rate
       FROM two, (VALUES ('base'),('extra')) m(model) GROUP BY 1,2,3) GROUP BY 1,2""", "two")
def ag21(spark, root):
    long = _two_scores(spark, root).selectExpr("label", "entity % 5 AS seed", "stack(2, 'base', base, 'extra', extra) AS (model, p)")
    per = long.groupBy("model", F.expr("CASE WHEN label = 1 THEN 'positive' ELSE 'negative' END").alias("evaluation"), "seed").agg(
        F.avg(F.pow(F.col("p") - F.col("label"), F.lit(2))).alias("brier"), F.avg("p").alias("rate"))
    return per.groupBy("model", "evaluation").agg(
        F.count(F.lit(1)).alias("seeds"), F.avg("brier").alias("brier_mean"), F.stddev_samp("brier").alias("brier_std"),
        F.avg("rate").alias("rate_mean"), F.stddev_samp("rate").alias("rate_std"))


_FUNNEL = {"timeline": "1 = 1", "observed": "observed_minutes > 0", "history": "history_valid = 1", "physical": "physical_at_risk = 1",
           "risk_set": "risk_set = 1", "labelled_6h": "risk_set = 1 AND label_valid_21600 = 1", "positive": "hazard_label = 1"}


@query("ag22_sample_flow", "stage:s n:i entities:i",
       """SELECT s.stage, count(*) AS n, count(DISTINCT entity) AS entities FROM risk, (VALUES ('timeline'),('observed'),('history'),('physical'),('risk_set'),('labelled_6h'),('positive')) s(stage)
       WHERE CASE s.stage WHEN 'timeline' THEN true WHEN 'observed' THEN observed_minutes>0 WHEN 'history' THEN history_valid=1 WHEN 'physical' THEN physical_at_risk=1 WHEN 'risk_set' THEN risk_set=1
       WHEN 'labelled_6h' THEN risk_set=1 AND lv6=1 ELSE hazard_label=1 END GROUP BY 1""", "risk")
def ag22(spark, root):
    # Per-entity counts first: the stage copies then multiply entities, not rows.
    per = risk_rows(spark, root).groupBy("entity").agg(*[F.expr(f"count_if({p})").alias(s) for s, p in _FUNNEL.items()])
    long = per.selectExpr("entity", f"stack({len(_FUNNEL)}, " + ", ".join(f"'{s}', {s}" for s in _FUNNEL) + ") AS (stage, k)")
    return long.filter("k > 0").groupBy("stage").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("entities"))
