"""Window, as-of, range-count and island operators on (entity, t).

Panels are dense: one row per entity and bin, so a window over one entity is
bounded by the calendar, never by raw volume.  Operators that must accept raw
rows (`event_clocks`) are cut into (entity, time slice) tasks and
receive what happened before their slice as a carried value, so one hot entity
is spread over as many tasks as there are slices.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.clock import DAY

UNB = Window.unboundedPreceding


def by_clock(entity: str | list[str] = "entity", t: str = "t"):
    keys = [entity] if isinstance(entity, str) else entity
    return Window.partitionBy(*keys).orderBy(t)


def past_rows(k: int, **kw):
    """The k rows strictly before the current one."""
    return by_clock(**kw).rowsBetween(-k, -1)


def trailing(k: int, **kw):
    """The current row and the k-1 before it."""
    return by_clock(**kw).rowsBetween(-(k - 1), 0)


def ahead(k: int, **kw):
    """The k rows strictly after the current one."""
    return by_clock(**kw).rowsBetween(1, k)


def lag_diff(col: str, k: int, **kw) -> Column:
    return F.col(col) - F.lag(col, k).over(by_clock(**kw))


def full_window_mean(col: str, k: int, **kw) -> Column:
    """Trailing mean that exists only when all k rows are present and non-null."""
    w = trailing(k, **kw)
    return F.when(F.count(F.col(col)).over(w) == k, F.avg(col).over(w))


def forward_sum(col: str, k: int, **kw) -> tuple[Column, Column]:
    """Sum over the next k rows and whether all k exist; incomplete sums are NULL."""
    w = ahead(k, **kw)
    complete = F.count(F.lit(1)).over(w) == k
    return F.when(complete, F.sum(col).over(w)), complete.cast("int")


def with_horizon_label(df: DataFrame, count_col: str, horizon: int) -> DataFrame:
    """``future``: event in bins t+1..t+H; ``observed``: all H bins exist."""
    frame = f"OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {horizon} FOLLOWING)"
    return df.selectExpr(
        "*", f"CASE WHEN sum({count_col}) {frame} > 0 THEN 1 ELSE 0 END AS future",
        f"CASE WHEN count(1) {frame} = {horizon} THEN 1 ELSE 0 END AS observed")


def islands(df: DataFrame, start: Column, name: str = "island", keys=("entity",), t: str = "t") -> DataFrame:
    """Number islands by a running count of start flags."""
    w = Window.partitionBy(*keys).orderBy(t)
    return df.withColumn(name, F.sum(F.coalesce(start, F.lit(False)).cast("int")).over(w.rowsBetween(UNB, 0)))


def contiguous_run(df: DataFrame, step: int, k: int, name: str = "history_ok") -> DataFrame:
    """1 where the last k rows are spaced by exactly ``step``."""
    w = by_clock()
    broken = F.coalesce(F.col("t") - F.lag("t").over(w) != step, F.lit(True))
    run = Window.partitionBy("entity", "_run").orderBy("t")
    return (islands(df.withColumn("_brk", broken), F.col("_brk"), "_run")
            .withColumn(name, (F.row_number().over(run) >= k).cast("int")).drop("_brk", "_run"))


@dataclass(frozen=True)
class EventClock:
    """A moment derived from each event, compared with the row clock.

    ``at`` is the moment; a row sees the event once ``at <= t`` (inclusive) or
    ``at < t``.  Shifting ``at`` turns range counts into differences of two
    clocks: onsets in ``[t, t+H)`` are ``onset-H < t`` minus ``onset < t``.
    """

    name: str
    at: Column
    inclusive: bool = False
    payload: tuple[str, ...] = ()
    where: Column | None = None


def event_clocks(rows: DataFrame, events: DataFrame, clocks: list[EventClock], t: str = "t",
                 keys: tuple[str, ...] = ("entity",), slice_seconds: int | None = 30 * DAY) -> DataFrame:
    """Attach ``<name>_n`` (events seen) and ``<name>_last`` (last payload) for every clock.

    The events, not the rows, are multiplied: every clock is a marker in one
    union that is ordered once.  With ``slice_seconds`` each (keys, time slice)
    is its own task and earlier slices arrive as a carried summary, so a hot key
    is spread over its slices.  Dense panels, already bounded by the calendar,
    may pass ``None`` and skip the carry.
    """
    row_cols = [c for c in rows.columns if c not in keys]
    sliced = slice_seconds is not None
    slice_of = (lambda c: F.floor(c / F.lit(slice_seconds))) if sliced else (lambda c: F.lit(0))
    payload = sorted({c for k in clocks for c in k.payload})
    made = F.array_compact(F.array(*[
        F.when(F.lit(True) if k.where is None else k.where,
               F.struct(F.lit(k.name).alias("name"), k.at.cast("bigint").alias("at"),
                        F.lit(0 if k.inclusive else 2).alias("kind"))) for k in clocks]))
    markers = events.select(*keys, F.struct(F.lit(0).alias("_"), *payload).alias("_event"), F.explode(made).alias("_m")).select(
        *keys, slice_of(F.col("_m.at")).alias("_slice"), F.col("_m.at").alias("_at"),
        F.col("_m.kind").alias("_kind"), F.col("_m.name").alias("_name"), "_event")
    tagged = rows.select(*keys, slice_of(F.col(t)).alias("_slice"), F.col(t).cast("bigint").alias("_at"),
                         F.lit(1).alias("_kind"), F.struct(*row_cols).alias("_row"))
    group = [*keys, "_slice"] if sliced else list(keys)
    inside = Window.partitionBy(*group).orderBy("_at", "_kind", "_event").rowsBetween(UNB, 0)

    def mine(k):
        return F.col("_name") == k.name

    seen = {}
    for k in clocks:
        seen[f"_n_{k.name}"] = F.count(F.when(mine(k), 1)).over(inside)
        if k.payload:
            seen[f"_l_{k.name}"] = F.last(F.when(mine(k), F.col("_event")), ignorenulls=True).over(inside)
    ordered = tagged.unionByName(markers, allowMissingColumns=True).withColumns(seen).filter("_kind = 1")
    if not sliced:
        return ordered.select(*keys, "_row.*", *[F.col(f"_n_{k.name}").alias(f"{k.name}_n") for k in clocks],
                              *[F.col(f"_l_{k.name}").alias(f"{k.name}_last") for k in clocks if k.payload])
    summary = markers.groupBy(*group).agg(
        *[F.count(F.when(mine(k), 1)).alias(f"s_{k.name}") for k in clocks],
        *[F.max(F.when(mine(k), F.struct("_at", "_event"))).alias(f"e_{k.name}") for k in clocks if k.payload])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(UNB, -1)
    carry = (tagged.select(*group).distinct().join(summary, group, "full_outer").select(
        *group, *[F.coalesce(F.sum(f"s_{k.name}").over(before), F.lit(0)).alias(f"c_{k.name}") for k in clocks],
        *[F.last(f"e_{k.name}", ignorenulls=True).over(before)["_event"].alias(f"f_{k.name}") for k in clocks if k.payload]))
    joined = ordered.join(carry, group, "left")
    return joined.select(
        *keys, "_row.*",
        *[(F.col(f"_n_{k.name}") + F.coalesce(f"c_{k.name}", F.lit(0))).alias(f"{k.name}_n") for k in clocks],
        *[F.coalesce(f"_l_{k.name}", f"f_{k.name}").alias(f"{k.name}_last") for k in clocks if k.payload])


def events_in_frame(rows: DataFrame, count_col: str, back: int, ahead_s: int, t: str = "t") -> Column:
    """Range-frame count on a dense panel: bins with start in ``[t-back, t+ahead_s]``."""
    return F.coalesce(F.sum(count_col).over(by_clock(t=t).rangeBetween(-back, ahead_s)), F.lit(0))


def multistep_targets(rows: DataFrame, risk: str, hazard: str, horizon: int, step: int) -> DataFrame:
    """Labels and censor mask over the next ``horizon`` rows starting at the row itself.

    The walk stops at a gap in time, at the first row not at risk, or (inclusive)
    at the first event.  Adds ``labels``, ``mask`` (arrays) and ``event_step`` (-1).
    """
    over = "OVER (PARTITION BY entity ORDER BY t{})"
    ahead = over.format(f" ROWS BETWEEN CURRENT ROW AND {horizon - 1} FOLLOWING")
    after = over.format(f" ROWS BETWEEN 1 FOLLOWING AND {horizon - 1} FOLLOWING")
    placed = rows.selectExpr("*", f"row_number() {over.format('')} AS _at", f"t - lag(t) {over.format('')} <> {step} AS _gap")
    # Places of the next row that stops the walk, of the next event, and of the end of the rows that can be seen.
    looked = placed.selectExpr(
        "*", f"least(min(CASE WHEN {risk} IS DISTINCT FROM 1 THEN _at END) {ahead}, min(CASE WHEN _gap THEN _at END) {after}, _at + count(1) {ahead}) - _at AS _open",
        f"min(CASE WHEN {hazard} = 1 THEN _at END) {ahead} - _at AS _event")
    known = looked.selectExpr("*", "CASE WHEN _event < _open THEN _event + 1 ELSE _open END AS _n", "CAST(CASE WHEN _event < _open THEN _event ELSE -1 END AS INT) AS event_step")
    return known.selectExpr(
        *rows.columns, f"transform(sequence(0, {horizon - 1}), i -> CASE WHEN i = event_step THEN 1 ELSE 0 END) AS labels",
        f"transform(sequence(0, {horizon - 1}), i -> CASE WHEN i < _n THEN 1 ELSE 0 END) AS mask", "event_step")


def history_summary(rows: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Last, mean, minimum and maximum of each column over the trailing k rows."""
    frame = f"OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return rows.selectExpr("*", *[x for c in columns for x in (
        f"{c} AS {c}_last", f"avg({c}) {frame} AS {c}_mean", f"min({c}) {frame} AS {c}_min", f"max({c}) {frame} AS {c}_max")])


def circular_shift(rows: DataFrame, value: str, shift: int, keys: tuple[str, ...], out: str) -> DataFrame:
    """Value of the row ``shift`` positions earlier within the key, wrapping around."""
    w = Window.partitionBy(*keys).orderBy("t")
    numbered = rows.withColumns({"_rn": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    source = numbered.select(*keys, F.pmod(F.col("_rn") + shift, F.col("_n")).alias("_rn"), F.col(value).alias(out))
    return numbered.join(source, [*keys, "_rn"]).drop("_rn", "_n")


def block_start(t: str, origin: Column, days: int = 7) -> Column:
    """Start of the calendar block of ``days`` days counted from ``origin`` (a clock)."""
    day = F.floor((F.col(t) - origin) / DAY)
    return origin + F.floor(day / days) * days * DAY


def time_quality(rows: DataFrame, arrival: str, part: str) -> DataFrame:
    """Adjacent duplicates, out-of-order rows and missing minutes in arrival order per entity.

    ``part`` is any non-decreasing label of the arrival order (a file, a range of
    offsets).  Steps inside a part are taken part by part; the steps between
    parts come from each part's first and last row, so a busy entity is spread
    over its parts.
    """
    base = rows.selectExpr("entity", "t DIV 60 * 60 AS m", f"{arrival} AS a", f"{part} AS part")
    inner = base.selectExpr("entity", "m", "lag(m) OVER (PARTITION BY entity, part ORDER BY a) AS p")
    edges = base.groupBy("entity", "part").agg(F.min_by("m", "a").alias("m"), F.max_by("m", "a").alias("last"))
    between = edges.selectExpr("entity", "m", "lag(last) OVER (PARTITION BY entity ORDER BY part) AS p")
    steps = inner.unionByName(between.filter("p IS NOT NULL"))
    return steps.groupBy("entity").agg(
        F.expr("count_if(m = p)").alias("duplicate_adjacent"), F.expr("count_if(m < p)").alias("out_of_order"),
        F.expr("coalesce(sum(CASE WHEN m - p > 60 THEN (m - p) DIV 60 - 1 END), 0)").alias("missing_minutes"),
        F.min("m").alias("first_minute"), F.max("m").alias("last_minute"))


def source_signal(rows: DataFrame, eta: str, fit: Column, active: Column, low: float, high: float, clip: float) -> DataFrame:
    """Entity-normalized signal: clip((eta - q_low) / max(q_high - q_low, 0.1), 0, clip); 0 off the active set."""
    norms = rows.filter(fit).groupBy("entity").agg(F.percentile(eta, F.array(F.lit(low), F.lit(high))).alias("_q"))
    joined = rows.join(norms, "entity", "left")
    raw = (F.col(eta) - F.col("_q")[0]) / F.greatest(F.col("_q")[1] - F.col("_q")[0], F.lit(0.1))
    return joined.withColumn("signal", F.when(active & F.col("_q").isNotNull(), F.greatest(F.lit(0.0), F.least(raw, F.lit(clip))))
                             .otherwise(0.0)).drop("_q")
