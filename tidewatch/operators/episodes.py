"""Gap sessionization and event tables.

Positive readings are first collapsed to (entity, bucket) partial aggregates
with a bucket no wider than the merge gap.  Rows inside one bucket can never be
separated by more than the gap, so islands over buckets equal islands over
rows, while an entity contributes at most calendar/bucket rows to the ordered
step however many raw rows it has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import clock
from tidewatch.functions.scalar import flag
from tidewatch.operators.temporal import UNB, islands
from tidewatch.session import materialize


@dataclass(frozen=True)
class EpisodeRules:
    merge_gap_seconds: int = 600
    cooldown_seconds: int = 3600
    cold_limit: float = 2.0
    minimum_rows: int = 1
    only_cold: bool = True
    step: int = 600
    bucket: int = 60

    @property
    def separation(self) -> int:
        """A break is a gap strictly longer than the merge gap plus one minute."""
        return self.merge_gap_seconds + 60


def dedupe_positives(readings: DataFrame, value: str, threshold: float, order: list[str], payload: list[str]) -> DataFrame:
    """Positive rows, one per (entity, t): the last in ``order`` wins."""
    kept = F.max(F.struct(*order, value, *payload)).alias("x")
    return (readings.filter(F.col(value) > threshold).groupBy("entity", "t").agg(kept)
            .select("entity", "t", f"x.{value}", *[f"x.{c}" for c in payload]))


def collapse(positives: DataFrame, value: str, bucket: int, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Partial event measures per (entity, bucket)."""
    return positives.groupBy(*keys, F.floor(F.col("t") / bucket).alias("bucket")).agg(
        F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n"),
        F.max(F.struct(F.col(value).alias("v"), (-F.col("t")).alias("at"))).alias("peak"),
        F.min("temp").alias("min_temp"), F.max("temp").alias("max_temp"), F.max("rh").alias("max_rh"),
        F.min("vis").alias("min_vis"), F.max("fog").alias("fog"), F.sum("exposed").alias("exposed"))


def episode_ids(buckets: DataFrame, separation: Column | int, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Number the islands of buckets separated by more than ``separation`` seconds."""
    sep = F.lit(separation) if isinstance(separation, int) else separation
    previous = F.lag("hi").over(Window.partitionBy(*keys).orderBy("lo"))
    return islands(buckets.withColumn("_brk", F.coalesce(F.col("lo") - previous > sep, F.lit(True))),
                   F.col("_brk"), "episode", keys, "lo").drop("_brk")


def measure(numbered: DataFrame, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Event measures from the numbered buckets."""
    return numbered.groupBy(*keys, "episode").agg(
        F.min("lo").alias("onset"), F.max("hi").alias("ending"), F.sum("n").alias("positive_rows"),
        F.max("peak").alias("peak"), F.min("min_temp").alias("min_temp"), F.max("max_temp").alias("max_temp"),
        F.max("max_rh").alias("max_rh"), F.min("min_vis").alias("min_vis"), F.max("fog").alias("fog_supported"),
        F.sum("exposed").alias("exposed_rows"),
    ).withColumns({
        "elapsed_minutes": F.floor((F.col("ending") - F.col("onset")) / 60) + 1,
        "max_value": F.col("peak.v"), "peak_at": -F.col("peak.at"),
    }).drop("peak")


def judge(events: DataFrame, cold_limit: Column, cooldown: Column, minimum_rows: int, step: int,
          only_cold: bool = True, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Validity flags, exclusion reason and the running index of valid events."""
    w = Window.partitionBy(*keys).orderBy("onset")
    cold = flag(F.col("min_temp") <= cold_limit)
    long_enough = flag(F.col("positive_rows") >= minimum_rows)
    candidate = cold * long_enough if only_cold else long_enough
    out = events.withColumns({
        "event_sequence": F.row_number().over(w),
        "reference_issue": clock.floor_to("onset", step),
        "previous_end": F.lag("ending").over(w),
        "cold_plausible": cold, "duration_pass": long_enough, "candidate_event": candidate,
    })
    rested = flag(F.col("previous_end").isNull() | (F.col("reference_issue") >= F.col("previous_end") + cooldown))
    out = out.withColumn("cooldown_pass", rested).withColumn("valid", F.col("candidate_event") * F.col("cooldown_pass"))
    reason = (F.when(F.col("valid") == 1, "").when(F.col("cold_plausible") == 0, "warm_or_missing_temperature")
              .when(F.col("duration_pass") == 0, "too_few_positive_minutes")
              .otherwise("prediction_time_within_cooldown"))
    running = F.sum("valid").over(w.rowsBetween(UNB, 0))
    return out.withColumns({
        "recurrent_index": F.when(F.col("valid") == 1, running).otherwise(0), "exclusion_reason": reason,
        "event_id": F.concat(F.col(keys[-1]).cast("string"), F.format_string("-E%04d", F.col("event_sequence"))),
    })


def extract_events(readings: DataFrame, value: str, threshold: float, rules: EpisodeRules, order: list[str]) -> DataFrame:
    """Readings to judged events.  Needs columns temp, rh, vis, fog, exposed."""
    if rules.bucket > rules.separation:
        raise ValueError("bucket must not exceed the merge separation")
    rows = dedupe_positives(readings, value, threshold, order, ["temp", "rh", "vis", "fog", "exposed"])
    numbered = episode_ids(collapse(rows, value, rules.bucket), rules.separation)
    return judge(measure(numbered), F.lit(rules.cold_limit), F.lit(rules.cooldown_seconds),
                 rules.minimum_rows, rules.step, rules.only_cold)


def order_valid_events(events: DataFrame, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Order, order group, gaps and season of the valid events only."""
    w = Window.partitionBy(*keys).orderBy("onset", "ending", "event_id")
    month = F.month(clock.from_clock("onset"))
    return events.filter("valid = 1").withColumns({
        "event_order": F.row_number().over(w),
        "gap_hours": (F.col("onset") - F.lag("ending").over(w)) / 3600.0,
        "onset_gap_hours": (F.col("onset") - F.lag("onset").over(w)) / 3600.0,
        "onset_year": F.year(clock.from_clock("onset")), "onset_month": month,
        "season": F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring")
                   .when(month.isin(6, 7, 8), "summer").otherwise("autumn"),
    }).withColumns({
        "order_group": F.when(F.col("event_order") == 1, "first").when(F.col("event_order") == 2, "second").otherwise("third_plus"),
        "recurrence": F.when(F.col("event_order") == 1, "first").otherwise("recurrent"),
    })


def season_year(t: str, outside: bool = False) -> Column:
    """November-April season labelled by its start year.

    May-October belongs to the season before it, or is -1 with ``outside``.
    """
    ts = clock.from_clock(t)
    year = F.when(F.month(ts) >= 11, F.year(ts)).otherwise(F.year(ts) - 1)
    return F.when(F.month(ts).between(5, 10), F.lit(-1)).otherwise(year) if outside else year


def seasonal_orders(valid: DataFrame, data_start: Column, data_end: Column) -> DataFrame:
    """Global and within-season order with the season's censoring flags."""
    v = valid.withColumn("season_start_year", season_year("onset"))
    start = F.unix_timestamp(F.make_timestamp(F.col("season_start_year"), F.lit(11), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    end = F.unix_timestamp(F.make_timestamp(F.col("season_start_year") + 1, F.lit(4), F.lit(30), F.lit(23), F.lit(59), F.lit(59)))
    out = v.withColumns({
        "global_order": F.row_number().over(Window.partitionBy("entity").orderBy("season_start_year", "onset")),
        "season_order": F.row_number().over(Window.partitionBy("entity", "season_start_year").orderBy("onset")),
        "left_censored": (start < data_start).cast("int"), "right_censored": (end > data_end).cast("int"),
    })
    return out.withColumn("complete_season", (1 - F.col("left_censored")) * (1 - F.col("right_censored")))


def instrument_resolution(positives: DataFrame, value: str) -> DataFrame:
    """Smallest repeated increment between distinct levels per entity.

    Levels are whole ten-thousandths.  An increment counts when it repeats at
    least ``max(3, 1 % of the levels)`` times; else the 10 % quantile of the
    increments is used; a single level stands for itself.
    """
    levels = (positives.filter(F.col(value) > 0).groupBy("entity", F.round(F.col(value) * 10000).cast("bigint").alias("level"))
              .agg(F.count(F.lit(1)).alias("rows")))
    w = Window.partitionBy("entity").orderBy("level")
    steps = levels.withColumn("inc", F.col("level") - F.lag("level").over(w))
    per = steps.groupBy("entity").agg(F.count(F.lit(1)).alias("levels"), F.min("level").alias("lowest"), F.sum("rows").alias("rows"))
    counted = steps.filter("inc is not null").groupBy("entity", "inc").agg(F.count(F.lit(1)).alias("times"))
    need = F.greatest(F.lit(3), F.ceil(F.col("levels") * 0.01))
    chosen = counted.join(per, "entity").groupBy("entity").agg(
        F.min(F.when(F.col("times") >= need, F.col("inc"))).alias("repeated"),
        F.percentile("inc", F.lit(0.1), F.col("times")).alias("fallback"))
    return per.join(chosen, "entity", "left").select(
        "entity", "rows", (F.coalesce("repeated", "fallback", F.when(F.col("levels") == 1, F.col("lowest")), F.lit(100)) / 10000.0).alias("resolution"))


def persistent_buckets(buckets: DataFrame, k: int, max_gap: int, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Keep buckets in runs of at least ``k`` rows with gaps of at most ``max_gap`` seconds."""
    runs = episode_ids(buckets, max_gap, keys)
    size = F.sum("n").over(Window.partitionBy(*keys, "episode"))
    return runs.withColumn("_size", size).filter(F.col("_size") >= k).drop("_size", "episode")


# The definition grid of the sensitivity study.
GRID_MERGE_MINUTES = (10, 30, 60)
GRID_COOLDOWN_HOURS = (1, 3, 6)
GRID_COLD_LIMITS = (2, 0)
GRID_RULES = ("positive", "resolution_persistent")


def definition_grid(spark, persistence: int = 3) -> DataFrame:
    """The 36 event definitions, one of them the reference."""
    def axis(values):
        return F.explode(F.array(*[F.lit(v) for v in values]))

    grid = spark.range(1).select(axis(GRID_MERGE_MINUTES).alias("merge_minutes"))
    for name, values in (("cooldown_hours", GRID_COOLDOWN_HOURS), ("cold_limit", GRID_COLD_LIMITS), ("rule", GRID_RULES)):
        grid = grid.withColumn(name, axis(values))
    return grid.select(
        F.format_string("merge%d_cool%dh_temp%d_%s", "merge_minutes", "cooldown_hours", "cold_limit",
                        F.when(F.col("rule") == "positive", "positive").otherwise(f"resolution_persistent_{persistence}")).alias("definition_id"),
        "*", ((F.col("merge_minutes") == 10) & (F.col("cooldown_hours") == 1) & (F.col("cold_limit") == 2)
              & (F.col("rule") == "positive")).cast("int").alias("is_reference"))


def evaluate_definitions(positives: DataFrame, value: str, bucket: int = 60, persistence: int = 3,
                         persistence_gap: int = 120, scale: int = 60, step: int = 600) -> DataFrame:
    """Judged events of every definition.

    Rows are bucketed once per thickness rule and merged once per merge gap;
    cooldown and temperature limits only touch the small event table.  ``scale``
    stretches minutes for logs sparser than one row a minute.
    """
    resolution = instrument_resolution(positives, value).select("entity", "resolution")
    plain = collapse(positives, value, bucket).withColumn("rule", F.lit("positive"))
    above = positives.join(resolution, "entity").filter(F.col(value) > F.col("resolution") + 1e-12).drop("resolution")
    lasting = persistent_buckets(collapse(above, value, bucket), persistence, persistence_gap).withColumn("rule", F.lit("resolution_persistent"))
    merges = F.explode(F.array(*[F.lit(m) for m in GRID_MERGE_MINUTES])).alias("merge_minutes")
    keyed = plain.unionByName(lasting).select("*", merges)
    keys = ("rule", "merge_minutes", "entity")
    numbered = episode_ids(keyed, (F.col("merge_minutes") + 1) * scale, keys)
    measured = measure(numbered, keys)
    limits = F.explode(F.array(*[F.struct(F.lit(c).alias("cooldown_hours"), F.lit(x).alias("cold_limit"))
                                 for c in GRID_COOLDOWN_HOURS for x in GRID_COLD_LIMITS])).alias("lim")
    full = measured.select("*", limits).select("*", "lim.*").drop("lim")
    keys = ("rule", "merge_minutes", "cooldown_hours", "cold_limit", "entity")
    return judge(full, F.col("cold_limit"), F.col("cooldown_hours") * 60 * scale, 1, step, True, keys)


def greedy_match(reference: DataFrame, candidate: DataFrame, tolerance: int, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """One-to-one onset matches within ``tolerance`` seconds, closest pairs first (then the earlier reference, then the earlier candidate).

    Pairs come from an equi-join on tolerance-wide time cells, so only neighbouring events meet.  A pair that comes before all others
    of its reference and of its candidate is one that the pass in order would take, whatever happens elsewhere; so all such
    pairs are taken at once, what they use up is dropped, and rounds go on until no pair is left.  A round is two grouped minima.
    """
    ref = reference.select(*keys, F.col("onset").alias("ref"), F.floor(F.col("onset") / tolerance).alias("cell"))
    cand = candidate.select(*keys, F.col("onset").alias("cand"), F.explode(
        F.array(*[F.floor(F.col("onset") / tolerance) + d for d in (-1, 0, 1)])).alias("cell"))
    pairs = ref.join(cand, [*keys, "cell"]).withColumn("shift", F.abs(F.col("cand") - F.col("ref"))).filter(F.col("shift") <= tolerance)
    left = materialize(pairs.select(*keys, "ref", "cand", "shift").distinct(), "onset-pairs")
    place = F.struct("shift", "ref", "cand")
    rounds = []
    while not left.isEmpty():
        of_ref, of_cand = (F.min(place).over(Window.partitionBy(*keys, side)) for side in ("ref", "cand"))
        taken = materialize(left.withColumns({"_r": of_ref, "_c": of_cand}).filter((F.col("_r") == place) & (F.col("_c") == place)).drop("_r", "_c"), "onset-matches")
        rounds.append(taken)
        rest = left.join(taken.select(*keys, "ref"), [*keys, "ref"], "left_anti").join(taken.select(*keys, "cand"), [*keys, "cand"], "left_anti")
        left = materialize(rest.select(*keys, "ref", "cand", "shift"), "onset-pairs")
    out = left
    for taken in rounds:
        out = out.unionByName(taken)
    return out
