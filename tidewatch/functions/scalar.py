"""Column expressions for cleaning, calendar terms, exposure rules and risks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import clock

# Text that stands for "no value" in the raw logs.
MISSING_MARKERS = ("", "--", "nan", "NaN", "NAN", "null", "NULL", "None", "none")

# Plausible sensor ranges (low, high); None leaves a side open.
VALID_RANGES = {
    "device_voltage": (0.0, 30.0),
    "ice_thickness": (0.0, None),
    "ice_sensor_frequency": (0.0, None),
    "air_temperature": (-50.0, 60.0),
    "relative_humidity": (0.0, 100.0),
    "station_pressure": (300.0, 1100.0),
    "rain": (0.0, 500.0),
    "hourly_rain": (0.0, 500.0),
    "wind_direction": (0.0, 360.0),
    "wind_speed": (0.0, 75.0),
    "visibility": (0.0, 50000.0),
}

EARTH_RADIUS_KM = 6371.0088


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def flag(cond: Column) -> Column:
    """0/1 flag; a NULL comparison counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clean_text(col: Column | str) -> Column:
    return F.trim(F.coalesce(_c(col).cast("string"), F.lit("")))


def is_marker(col: Column | str) -> Column:
    return clean_text(col).isin(*MISSING_MARKERS)


def nullify_markers(col: Column | str) -> Column:
    return F.when(~is_marker(col), clean_text(col))


def numeric(col: Column | str) -> Column:
    """Text to DOUBLE; markers, bad text and NaN become NULL."""
    value = nullify_markers(col).try_cast("double")
    return F.when(~F.isnan(value), value)


def alias_coalesce(*cols: Column | str) -> Column:
    return F.coalesce(*[nullify_markers(c) for c in cols])


def parse_clock(col: Column | str, formats: tuple[str, ...]) -> Column:
    """First matching format wins; unparseable text becomes NULL."""
    text = clean_text(col)
    return clock.to_clock(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]))


def in_range(col: Column | str, low: float | None, high: float | None) -> Column:
    """Value kept inside ``[low, high]``; outside becomes NULL."""
    value = _c(col)
    return F.when(~out_of_range(col, low, high), value)


def out_of_range(col: Column | str, low: float | None, high: float | None) -> Column:
    value = _c(col)
    bad = F.lit(False)
    if low is not None:
        bad = bad | (value < F.lit(low))
    if high is not None:
        bad = bad | (value > F.lit(high))
    return F.coalesce(bad, F.lit(False))


def token_flag(col: Column | str, token: str) -> Column:
    return flag(clean_text(col).contains(token))


def has_text(col: Column | str) -> Column:
    return flag(~is_marker(col))


def direction_parts(degrees: Column | str) -> tuple[Column, Column]:
    radians = F.radians(_c(degrees))
    return F.sin(radians), F.cos(radians)


def prefix_lookup(col: Column | str, prefixes: dict[str, str], default: str = "Unknown") -> Column:
    text = clean_text(col)
    return F.coalesce(*[F.when(text.startswith(p), F.lit(v)) for p, v in prefixes.items()], F.lit(default))


def calendar_terms(t: Column | str) -> dict[str, Column]:
    """Hour and day-of-year on the circle, with the real year length."""
    ts = clock.from_clock(t)
    hours = F.hour(ts) + F.minute(ts) / F.lit(60.0)
    year = F.year(ts)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    days = F.when(leap, 366.0).otherwise(365.0)
    hour_angle = hours * F.lit(2.0) * F.pi() / F.lit(24.0)
    day_angle = (F.dayofyear(ts) - 1) * F.lit(2.0) * F.pi() / days
    return {
        "hour_sin": F.sin(hour_angle), "hour_cos": F.cos(hour_angle),
        "day_of_year_sin": F.sin(day_angle), "day_of_year_cos": F.cos(day_angle),
    }


def calendar_terms_simple(t: Column | str) -> dict[str, Column]:
    """Variant for event panels: whole hour, 365.25-day year."""
    ts = clock.from_clock(t)
    hour_angle = F.hour(ts) * F.lit(2.0) * F.pi() / F.lit(24.0)
    day_angle = F.dayofyear(ts) * F.lit(2.0) * F.pi() / F.lit(365.25)
    return {
        "hour_sin": F.sin(hour_angle), "hour_cos": F.cos(hour_angle),
        "day_of_year_sin": F.sin(day_angle), "day_of_year_cos": F.cos(day_angle),
    }


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    den = _c(denominator)
    return F.when(den > 0, _c(numerator) / den)


def exposure_flags(temperature: str, humidity: str, visibility: str, fog: str,
                   temperature_c: float = 2.0, humidity_pct: float = 95.0,
                   visibility_m: float = 1000.0) -> dict[str, Column]:
    cold_humid = (F.col(temperature) <= temperature_c) & (F.col(humidity) >= humidity_pct)
    foggy = F.coalesce(F.col(visibility) < visibility_m, F.lit(False)) | F.coalesce(F.col(fog) > 0, F.lit(False))
    e1, e2 = flag(cold_humid), flag(foggy)
    return {"exposure_e1": e1, "exposure_e2": e2, "exposure_e3": F.greatest(e1, e2)}


def split_label(year: Column | str, split: dict[str, tuple[int, ...]]) -> Column:
    """Year to split name; later entries win, unknown years are ``excluded``."""
    labels = [F.when(_c(year).isin(*years), F.lit(name)) for name, years in reversed(split.items()) if years]
    return F.coalesce(*labels, F.lit("excluded"))


def zscore(col: Column | str, mean: Column, scale: Column, clip: float) -> Column:
    """Mean-imputed, standardized and clipped value."""
    z = (F.coalesce(_c(col), mean) - mean) / F.greatest(scale, F.lit(1e-8))
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), z))


def cloglog_risk(eta: Column | str, steps: int = 1) -> Column:
    bounded = F.greatest(F.least(_c(eta), F.lit(15.0)), F.lit(-30.0))
    return -F.expm1(-F.lit(float(steps)) * F.exp(bounded))


def logit_risk(eta: Column | str) -> Column:
    bounded = F.greatest(F.least(_c(eta), F.lit(35.0)), F.lit(-35.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-bounded))


def calibrated_cloglog_risk(eta: Column | str, intercept: float, slope: float, steps: int) -> Column:
    return cloglog_risk(F.lit(intercept) + F.lit(slope) * _c(eta), steps)


def linear_score(features: list[str], coefficients: list[float], intercept: float) -> Column:
    terms = [F.col(f) * F.lit(float(b)) for f, b in zip(features, coefficients, strict=True)]
    return reduce(lambda a, b: a + b, terms, F.lit(float(intercept)))


def constant_hazard(risk: Column | str, horizon: int) -> Column:
    """Per-step hazard that compounds to ``risk`` over ``horizon`` steps."""
    bounded = F.greatest(F.least(_c(risk), F.lit(1.0 - 1e-7)), F.lit(0.0))
    return F.array_repeat(F.lit(1.0) - F.pow(F.lit(1.0) - bounded, F.lit(1.0 / horizon)), horizon)


def blend(base: Column | str, extra: Column | str, alpha: float, where: Column | None = None) -> Column:
    mixed = F.lit(1.0 - alpha) * _c(base) + F.lit(alpha) * _c(extra)
    return mixed if where is None else F.when(F.coalesce(where, F.lit(False)), mixed).otherwise(_c(base))


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    a1, a2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat, dlon = a2 - a1, F.radians(_c(lon2)) - F.radians(_c(lon1))
    half = F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(dlon / 2), F.lit(2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(half))
