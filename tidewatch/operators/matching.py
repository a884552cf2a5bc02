"""Alarm segments, pre-event grids, one-to-one matching and budget audits.

Only the greedy step sees an entity as a whole, and it sees segments and events,
not rows: both are bounded by the calendar.  Row-level work (windows, labels,
true/false classification) stays relational.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import clock
from tidewatch.operators import scan
from tidewatch.operators.temporal import EventClock, event_clocks


def alarm_rows(rows: DataFrame, alarm: str, step: int, resets: DataFrame | None = None) -> DataFrame:
    """Alarm rows with their segment number (0-based per entity).

    A segment ends at a gap longer than ``step`` and, when ``resets`` is given,
    at an onset between two alarms (the later alarm included).
    """
    alarms = rows.filter(F.coalesce(F.col(alarm), F.lit(0)) >= 0.5)
    if resets is None:
        seen = alarms.withColumn("_seen", F.lit(0))
    else:
        seen = event_clocks(alarms, resets, [EventClock("_seen", F.col("onset"), True)], slice_seconds=None).withColumnRenamed("_seen_n", "_seen")
    w = "PARTITION BY entity ORDER BY t"
    marked = seen.selectExpr("*", f"CASE WHEN t - lag(t) OVER ({w}) <= {step} AND _seen = lag(_seen) OVER ({w}) THEN 0 ELSE 1 END AS _new")
    return marked.selectExpr(*alarms.columns, f"CAST(sum(_new) OVER ({w}) - 1 AS BIGINT) AS segment")


def segments_of(marked: DataFrame) -> DataFrame:
    return marked.groupBy("entity", "segment").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.count(F.lit(1)).alias("bins"))


def pre_event_windows(events: DataFrame, step: int, horizon: int) -> DataFrame:
    """Last grid point strictly before the onset and the full horizon of points up to it."""
    last = clock.floor_to(F.col("onset") - 1, step)
    return events.withColumns({"window_end": last, "window_start": last - (horizon - step), "expected_bins": F.lit(horizon // step)})


def window_availability(events: DataFrame, rows: DataFrame, step: int, horizon: int, observed: str = "observed") -> DataFrame:
    """Rows present, observed and on the grid in each event's pre-event window, with queue flags.

    The window becomes step-wide cells, so rows and events meet on (entity, cell).
    """
    windowed = pre_event_windows(events, step, horizon)
    cells = windowed.select("event_id", "entity", "window_start", "window_end", F.explode(
        F.sequence(F.floor(F.col("window_start") / step), F.floor(F.col("window_end") / step))).alias("_cell"))
    slim = rows.select("entity", "t", F.floor(F.col("t") / step).alias("_cell"), F.coalesce(F.col(observed), F.lit(0)).alias("_obs"))
    counted = cells.join(slim, ["entity", "_cell"]).filter("t BETWEEN window_start AND window_end").groupBy("event_id", "entity").agg(
        F.count(F.lit(1)).alias("available_bins"), F.sum("_obs").alias("observed_bins"), F.min("t").alias("first_available"),
        F.count_distinct(F.when(F.col("t") % step == 0, F.col("t"))).alias("_on_grid"))
    known = rows.select("entity").distinct().withColumn("_known", F.lit(1))
    joined = windowed.join(counted, ["event_id", "entity"], "left").join(known, "entity", "left").fillna(0, ["available_bins", "observed_bins", "_on_grid"])
    full = joined.withColumns({
        "evaluable": ((F.col("available_bins") == F.col("expected_bins")) & (F.col("_on_grid") == F.col("expected_bins"))).cast("int"),
        "operational": (F.col("available_bins") > 0).cast("int"),
        "available_hours": F.coalesce((F.col("onset") - F.col("first_available")) / 3600.0, F.lit(0.0)),
        "censored_bins": F.col("available_bins") - F.col("observed_bins"),
    })
    return full.withColumn("exclusion_reason", F.when(F.col("_known").isNull(), "station_id_not_matched")
                           .when(F.col("operational") == 0, "no_legal_risk_prediction_in_window")
                           .when(F.col("evaluable") == 0, "incomplete_legal_prediction_window").otherwise("")).drop("_known", "_on_grid")


def greedy_pairs(segments: DataFrame, events: DataFrame, horizon: int) -> DataFrame:
    """One segment to one event, segments in time order, earliest event first.

    A segment may take an event with ``start < onset <= stop + horizon``.  As both
    lists move forward in time the greedy choice is a merge of two sorted lists,
    one row with both per entity: a task merges those of thousands of entities.
    """
    kind, ekind = segments.schema["entity"].dataType.simpleString(), events.schema["event_id"].dataType.simpleString()
    mine = segments.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "segment"))).alias("_segments"))
    known = F.struct("onset", F.col("event_id").isNull().alias("unnamed"), "event_id")
    todo = events.filter("onset IS NOT NULL").groupBy(F.col("entity").alias("_who")).agg(F.sort_array(F.collect_list(known)).alias("_events"))
    both = mine.join(todo, F.col("entity").eqNullSafe(F.col("_who"))).drop("_who")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in ("_segments", "_events")]
            (first, last), (segs, evs) = ([np.append(0, np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))).tolist() for x in lists], [x.flatten() for x in lists])
            starts, stops, onsets = segs.field("start").to_pylist(), segs.field("stop").to_pylist(), evs.field("onset").to_pylist()
            owners, taking, taken = [], [], []
            for i in range(batch.num_rows):
                at, end = last[i], last[i + 1]
                for s in range(first[i], first[i + 1]):
                    while at < end and onsets[at] <= starts[s]:
                        at += 1
                    if at < end and onsets[at] <= stops[s] + horizon:
                        owners.append(i)
                        taking.append(s)
                        taken.append(at)
                        at += 1
            owners, taking, taken = (pa.array(x, pa.int64()) for x in (owners, taking, taken))
            yield pa.RecordBatch.from_arrays([batch.column("entity").take(owners), segs.field("segment").take(taking), segs.field("start").take(taking), evs.field("event_id").take(taken)],
                                             names=["entity", "segment", "start", "event_id"])

    return both.mapInArrow(run, f"entity {kind}, segment bigint, start bigint, event_id {ekind}")


def strict_match(rows: DataFrame, events: DataFrame, alarm: str, step: int, horizon: int, observed: str = "observed",
                 queue: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Strict event contract: (event records, classified alarm rows).

    ``queue`` is the events' :func:`window_availability`, where it is known; then ``rows`` need hold no more than the alarms.
    """
    marked = alarm_rows(rows, alarm, step, events)
    queue = window_availability(events, rows, step, horizon, observed) if queue is None else queue
    pairs = greedy_pairs(segments_of(marked), queue.filter("operational = 1"), horizon)
    records = queue.join(pairs.withColumnRenamed("start", "segment_start"), ["entity", "event_id"], "left").withColumns({
        "hit": F.col("segment").isNotNull().cast("int"),
        "lead_hours": F.when(F.col("segment").isNotNull(), (F.col("onset") - F.greatest("segment_start", F.col("onset") - horizon)) / 3600.0),
        "carry_in": F.coalesce((F.col("segment_start") < F.col("onset") - horizon).cast("int"), F.lit(0)),
    })
    won = records.filter("hit = 1").select("entity", "segment", F.col("onset").alias("_onset"))
    labelled = marked.join(won, ["entity", "segment"], "left")
    true = F.coalesce((F.col("t") >= F.col("_onset") - horizon) & (F.col("t") < F.col("_onset")), F.lit(False))
    seen = F.coalesce(F.col(observed), F.lit(0)) >= 0.5
    classified = labelled.withColumns({
        "true_alarm": true.cast("int"), "false_alarm": (~true & seen).cast("int"), "unsettled_alarm": (~true & ~seen).cast("int")})
    return records, classified.withColumn("reserved_alarm", F.col("false_alarm") + F.col("unsettled_alarm")).drop("_onset")


def queue_metrics(records: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Hit rate, lead and utility of the standardized and the operational queue."""
    def stats(flag: str, prefix: str) -> list[Column]:
        on, hit = f"{flag} = 1", f"{flag} = 1 AND hit = 1"
        return [F.expr(x) for x in (
            f"count_if({on}) AS {prefix}events", f"count_if({hit}) AS {prefix}hits",
            f"try_divide(count_if({hit}), count_if({on})) AS {prefix}hit_rate",
            f"avg(CASE WHEN {hit} THEN lead_hours END) AS {prefix}mean_lead",
            f"coalesce(try_divide(sum(CASE WHEN {hit} THEN lead_hours END), count_if({on})), 0) AS {prefix}utility")]

    base = records.groupBy(*by).agg(F.count(F.lit(1)).alias("target_events"), *stats("evaluable", ""), *stats("operational", "op_"),
                                    F.expr("count_if(evaluable = 1 AND carry_in = 1) AS carry_in_hits"))
    med = scan.exact_quantiles(records.filter("evaluable = 1 AND hit = 1"), "lead_hours", {"median_lead": 0.5}, by)
    opm = scan.exact_quantiles(records.filter("operational = 1 AND hit = 1"), "lead_hours", {"op_median_lead": 0.5}, by)
    if by:
        return base.join(med, list(by), "left").join(opm, list(by), "left")
    one = F.lit(1).alias("_one")
    return (base.select("*", one).join(med.select("*", one), "_one", "left").join(opm.select("*", one), "_one", "left").drop("_one"))


def simple_match(rows: DataFrame, events: DataFrame, alarm: str, step: int, horizon: int, observed: str = "observed") -> DataFrame:
    """Earlier contract: observed rows only, an event counts once any row precedes it within the horizon."""
    seen = rows.filter(F.coalesce(F.col(observed), F.lit(0)) == 1)
    spread = events.select("event_id", "entity", "onset", F.explode(F.sequence(
        F.floor((F.col("onset") - horizon) / step), F.floor((F.col("onset") - 1) / step))).alias("_cell"))
    present = (spread.join(seen.select("entity", "t", F.floor(F.col("t") / step).alias("_cell")), ["entity", "_cell"])
               .filter((F.col("t") >= F.col("onset") - horizon) & (F.col("t") < F.col("onset"))).select("event_id", "entity").distinct())
    queue = events.join(present.withColumn("_p", F.lit(1)), ["event_id", "entity"], "left").withColumn("evaluable", F.coalesce("_p", F.lit(0))).drop("_p")
    pairs = greedy_pairs(segments_of(alarm_rows(seen, alarm, step)), queue.filter("evaluable = 1"), horizon)
    return queue.join(pairs.withColumnRenamed("start", "segment_start"), ["entity", "event_id"], "left").withColumns({
        "hit": F.col("segment").isNotNull().cast("int"),
        "lead_hours": F.when(F.col("segment").isNotNull(), (F.col("onset") - F.greatest("segment_start", F.col("onset") - horizon)) / 3600.0)})


def _window_cells(events: DataFrame, step: int, horizon: int) -> DataFrame:
    """Events spread over the time cells of their windows."""
    return events.select("event_id", "entity", "onset", F.explode(F.sequence(
        F.floor((F.col("onset") - horizon) / step), F.floor((F.col("onset") - 1) / step))).alias("_cell"))


def window_rows(rows: DataFrame, events: DataFrame, step: int, horizon: int) -> DataFrame:
    """The rows that lie in the cells of some event's window, which are all that :func:`final_episode_match` looks at."""
    cells = _window_cells(events, step, horizon).select("entity", "_cell").distinct()
    return rows.withColumn("_cell", F.floor(F.col("t") / step)).join(cells, ["entity", "_cell"], "left_semi").select(*rows.columns)


def final_episode_match(rows: DataFrame, events: DataFrame, alarm: Column, step: int, horizon: int,
                        minimum_bins: int, merge_gap: int, max_silence: int) -> DataFrame:
    """Last alarm episode before each event: hit when long enough and not silent too long."""
    spread = _window_cells(events, step, horizon)
    slim = rows.select("entity", "t", F.floor(F.col("t") / step).alias("_cell"), alarm.cast("int").alias("_a"))
    inside = spread.join(slim, ["entity", "_cell"]).filter((F.col("t") >= F.col("onset") - horizon) & (F.col("t") < F.col("onset")))
    w = Window.partitionBy("entity", "event_id").orderBy("t")
    alarmed = inside.filter("_a = 1").withColumn("_new", F.coalesce((F.col("t") - F.lag("t").over(w) > merge_gap), F.lit(False)).cast("int"))
    numbered = alarmed.withColumn("_episode", F.sum("_new").over(w))
    episodes = numbered.groupBy("entity", "event_id", "_episode").agg(F.min("t").alias("first_alarm"), F.max("t").alias("last_alarm"), F.count(F.lit(1)).alias("episode_bins"))
    final = episodes.groupBy("entity", "event_id").agg(F.max(F.struct("_episode", "first_alarm", "last_alarm", "episode_bins")).alias("e"))
    seen = inside.groupBy("entity", "event_id").agg(F.lit(1).alias("evaluable"))
    out = events.join(seen, ["entity", "event_id"], "left").join(final, ["entity", "event_id"], "left")
    ok = (F.col("onset") - F.col("e.last_alarm") <= max_silence) & (F.col("e.episode_bins") >= minimum_bins)
    hit = F.coalesce(ok, F.lit(False))
    return out.select(*events.columns, F.coalesce("evaluable", F.lit(0)).alias("evaluable"), hit.cast("int").alias("hit"),
                      F.when(hit, (F.col("onset") - F.col("e.first_alarm")) / 3600.0).alias("lead_hours"),
                      F.when(hit, (F.col("onset") - F.col("e.last_alarm")) / 3600.0).alias("last_lead_hours"))


def month_rows(rows: DataFrame) -> DataFrame:
    """Rows of each entity-month."""
    return rows.groupBy("entity", clock.month_key("t").alias("month")).agg(F.count(F.lit(1)).alias("observed_rows"))


def month_budget(rows: DataFrame, classified: DataFrame, budget_hours: float, step: int, present: DataFrame | None = None) -> DataFrame:
    """Alarm, false, unsettled and reserved hours per entity-month against a budget; ``present`` is :func:`month_rows`, where it is known."""
    month = clock.month_key("t").alias("month")
    present = month_rows(rows) if present is None else present
    used = classified.groupBy("entity", month).agg(
        F.count(F.lit(1)).alias("alarm_bins"), F.sum("false_alarm").alias("false_bins"),
        F.sum("unsettled_alarm").alias("unsettled_bins"), F.sum("reserved_alarm").alias("reserved_bins"))
    m = present.join(used, ["entity", "month"], "left").fillna(0)
    hours = step / 3600.0
    out = m.withColumns({f"{k}_hours": F.col(f"{k}_bins") * hours for k in ("alarm", "false", "unsettled", "reserved")})
    return out.withColumns({
        "utilization": F.col("alarm_hours") / budget_hours, "false_utilization": F.col("false_hours") / budget_hours,
        "reserved_utilization": F.col("reserved_hours") / budget_hours,
        "exceeded": (F.col("false_hours") > budget_hours + 1e-9).cast("int"),
        "reserved_exceeded": (F.col("reserved_hours") > budget_hours + 1e-9).cast("int")})


def budget_summary(monthly: DataFrame) -> DataFrame:
    """Mean, 95 % quantile and maximum over entity-months, with exceedance rates."""
    cols = ("false_hours", "unsettled_hours", "reserved_hours", "utilization", "reserved_utilization")
    base = monthly.agg(F.count(F.lit(1)).alias("station_months"), F.avg("exceeded").alias("exceedance_rate"),
                       F.avg("reserved_exceeded").alias("reserved_exceedance_rate"),
                       *[F.avg(c).alias(f"mean_{c}") for c in cols], *[F.max(c).alias(f"max_{c}") for c in cols]).withColumn("_one", F.lit(1))
    for c in cols:
        base = base.join(scan.exact_quantiles(monthly, c, {f"p95_{c}": 0.95}).withColumn("_one", F.lit(1)), "_one")
    return base.drop("_one")


def window_reasons(events: DataFrame, timeline: DataFrame, step: int, horizon: int) -> DataFrame:
    """Why an event's window is incomplete: counts of missing or excluded bins and the ordered reasons."""
    windowed = pre_event_windows(events, step, horizon)
    points = windowed.select("event_id", "entity", F.explode(F.sequence("window_start", "window_end", F.lit(step).cast("bigint"))).alias("t"))
    joined = points.join(timeline.select("entity", "t", "risk_set", "physical_at_risk", "history_valid", "step_label_valid"), ["entity", "t"], "left")
    counts = joined.groupBy("entity", "event_id").agg(*[F.expr(x) for x in (
        "count_if(risk_set IS NULL) AS missing_bins", "count_if(physical_at_risk = 0) AS physical_excluded",
        "count_if(history_valid = 0) AS history_excluded", "count_if(step_label_valid = 0) AS label_excluded", "count_if(risk_set = 1) AS valid_bins")])
    reasons = """array_compact(array(CASE WHEN missing_bins > 0 THEN 'prediction_grid_missing' END,
        CASE WHEN history_excluded > 0 THEN 'incomplete_24h_history' END, CASE WHEN label_excluded > 0 THEN 'incomplete_next_step_label' END,
        CASE WHEN physical_excluded > 0 THEN 'outside_physical_risk_or_cooldown' END))"""
    return events.join(counts, ["entity", "event_id"]).withColumn("_r", F.expr(reasons)).withColumns({
        "primary_reason": F.coalesce(F.try_element_at("_r", F.lit(1)), F.lit("")), "all_reasons": F.array_join("_r", ";")}).drop("_r")
