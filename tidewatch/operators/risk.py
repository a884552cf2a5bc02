"""Risk timeline: history, exposure, recurrence covariates, labels and spells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.clock import DAY
from tidewatch.functions.scalar import exposure_flags, flag
from tidewatch.operators import temporal
from tidewatch.operators.temporal import EventClock, by_clock, event_clocks, islands


@dataclass(frozen=True)
class RiskRules:
    step: int = 600
    history_bins: int = 36
    lookback_bins: int = 6
    horizons: tuple[int, ...] = (3600, 10800, 21600)
    minimum_observed_minutes: int = 1
    minimum_history_bins: float = 0.9
    minimum_history_coverage: float = 0.8
    minimum_label_coverage: float = 1.0
    cooldown: int = 3600
    temperature_c: float = 2.0
    humidity_pct: float = 95.0
    visibility_m: float = 1000.0


def recurrence_clocks() -> list[EventClock]:
    """Valid events seen at a row: by completed end, by onset, and by onset 7/30 days ago."""
    valid = F.col("valid") == 1
    return [
        EventClock("ended", F.col("ending"), True, ("ending", "elapsed_minutes", "max_value"), valid),
        EventClock("begun", F.col("onset"), False, (), valid),
        EventClock("begun7", F.col("onset") + 7 * DAY, False, (), valid),
        EventClock("begun30", F.col("onset") + 30 * DAY, False, (), valid),
    ]


def recurrence_covariates() -> dict[str, Column]:
    last = F.col("ended_last")
    duration = last["elapsed_minutes"] / 60.0
    return {
        "current_event_order": F.col("ended_n") + 1,
        "previous_missing": last.isNull().cast("int"),
        "gap_hours": (F.col("t") - last["ending"]) / 3600.0,
        "previous_duration_hours": duration,
        "previous_max": last["max_value"],
        "previous_severity": F.log1p(duration) * F.log1p(last["max_value"]),
        "events_past_7d": F.col("begun_n") - F.col("begun7_n"),
        "events_past_30d": F.col("begun_n") - F.col("begun30_n"),
        "next_event_index": F.col("begun_n") + 1,
    }


def physical_clocks() -> list[EventClock]:
    return [
        EventClock("any_begun", F.col("onset"), False, ("onset", "ending")),
        EventClock("any_ended", F.col("ending"), True, ("ending",)),
    ]


def label_clocks(horizons: tuple[int, ...]) -> list[EventClock]:
    valid = F.col("valid") == 1
    return [EventClock(f"within_{h}", F.col("onset") - h, False, (), valid) for h in horizons]


def with_event_state(timeline: DataFrame, events: DataFrame, rules: RiskRules) -> DataFrame:
    """Everything the events say about a row, in one ordered pass."""
    horizons = tuple(sorted({rules.step, *rules.horizons}))
    rows = event_clocks(timeline, events, recurrence_clocks() + physical_clocks() + label_clocks(horizons), slice_seconds=None)
    previous = F.col("any_begun_last")
    blocked = (F.col("t") <= previous["ending"]) | (F.col("t") < previous["ending"] + rules.cooldown)
    return rows.withColumns({
        **recurrence_covariates(),
        "time_since_last_hours": (F.col("t") - F.col("any_ended_last")["ending"]) / 3600.0,
        "physical_at_risk": (1 - flag(blocked)) * flag(F.col("positive_minutes") == 0),
        **{f"onset_within_{h}": flag(F.col(f"within_{h}_n") - F.col("begun_n") > 0) for h in horizons},
    }).drop(*[f"{k.name}_n" for k in recurrence_clocks() + physical_clocks() + label_clocks(horizons)],
            "ended_last", "any_begun_last", "any_ended_last")


def with_history(timeline: DataFrame, rules: RiskRules) -> DataFrame:
    """Exposure history and the completeness of the trailing history window."""
    exposed = timeline.withColumns(exposure_flags("temp_min", "rh_max", "vis_min", "fog_fraction",
                                                  rules.temperature_c, rules.humidity_pct, rules.visibility_m))
    recent = temporal.trailing(rules.lookback_bins)
    out = exposed.withColumns({
        "exposure_recent": F.max("exposure_e3").over(recent),
        "exposure_fraction": F.avg("exposure_e3").over(recent),
        "bin_observed": flag(F.col("observed_minutes") >= rules.minimum_observed_minutes),
    }).withColumns({
        "history_bins": temporal.full_window_mean("bin_observed", rules.history_bins),
        "history_coverage": temporal.full_window_mean("coverage", rules.history_bins),
        "next_label": F.lead("label_coverage").over(by_clock()),
    })
    return out.withColumns({
        "history_valid": flag((F.col("history_bins") >= rules.minimum_history_bins)
                              & (F.col("history_coverage") >= rules.minimum_history_coverage)),
        "step_label_valid": flag(F.col("next_label") >= rules.minimum_label_coverage),
    })


def risk_timeline(timeline: DataFrame, events: DataFrame, rules: RiskRules) -> DataFrame:
    """Full risk table: one row per (entity, bin) with flags, labels and spells."""
    rows = with_history(with_event_state(timeline, events, rules), rules)
    at_risk = F.col("physical_at_risk") * F.col("history_valid") * F.col("step_label_valid")
    rows = rows.withColumn("risk_set", at_risk).withColumn("hazard_label", F.col(f"onset_within_{rules.step}") * F.col("risk_set"))
    cols = {}
    for h in rules.horizons:
        total, complete = temporal.forward_sum("label_coverage", h // rules.step)
        cols[f"label_fraction_{h}"] = total / (h // rules.step)
        cols[f"label_complete_{h}"] = complete
    rows = rows.withColumns(cols).withColumns({
        f"label_valid_{h}": flag((F.col(f"label_complete_{h}") == 1)
                                 & (F.col(f"label_fraction_{h}") >= rules.minimum_label_coverage)) for h in rules.horizons})
    rows = rows.withColumns({
        f"hard_negative_{h}": F.col("risk_set") * F.col("exposure_recent") * F.col(f"label_valid_{h}")
        * (1 - F.col(f"onset_within_{h}")) for h in rules.horizons})
    return with_spells(rows, rules.step)


def with_spells(rows: DataFrame, step: int) -> DataFrame:
    """Runs of at-risk rows: spell number, step in the spell, hours since entry; 0 outside."""
    w = by_clock()
    inside = F.col("risk_set") == 1
    entered = inside & (F.coalesce(F.lag("risk_set").over(w), F.lit(0)) == 0)
    numbered = islands(rows.withColumn("_in", entered), F.col("_in"), "_spell")
    position = F.sum("risk_set").over(Window.partitionBy("entity", "_spell").orderBy("t").rowsBetween(temporal.UNB, 0))
    return numbered.withColumns({
        "spell_index": F.when(inside, F.col("_spell")).otherwise(0),
        "spell_step": F.when(inside, position).otherwise(0),
    }).withColumn("hours_since_entry", F.col("spell_step") * step / 3600.0).drop("_in", "_spell")


def event_eligibility(events: DataFrame, risk: DataFrame) -> DataFrame:
    """Join each valid event to its reference row and list why it cannot be a label."""
    ref = risk.select("entity", F.col("t").alias("reference_issue"), "physical_at_risk", "history_valid",
                      "step_label_valid", "risk_set", "hazard_label", F.lit(1).alias("_found"))
    joined = events.join(ref, ["entity", "reference_issue"], "left")
    reasons = F.array_join(F.array_compact(F.array(
        F.when(F.col("physical_at_risk") != 1, "not_physically_at_risk"),
        F.when(F.col("history_valid") != 1, "insufficient_history_coverage"),
        F.when(F.col("step_label_valid") != 1, "incomplete_next_step_label"))), ";")
    eligible = flag((F.col("valid") == 1) & (F.col("risk_set") == 1) & (F.col("hazard_label") == 1))
    return joined.withColumn("eligible", eligible).withColumn(
        "eligibility_reason",
        F.when(F.col("valid") != 1, "not_a_target_event")
        .when(F.col("_found").isNull(), "reference_time_outside_timeline")
        .when(F.col("eligible") == 1, "")
        .when(reasons == "", "risk_set_exclusion").otherwise(reasons))
