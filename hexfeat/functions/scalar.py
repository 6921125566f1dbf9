"""Scalar formulas as Column expressions: they stay in whole-stage codegen and never need a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# Fixed values of the data model: text confidences, compass points, fuel codes by tier, months of the fire season.
# Fixed values of the data model: confidence words, compass points, fuel tiers, the box of the national forecasts.
CONFIDENCES = {"l": 30.0, "low": 30.0, "n": 60.0, "nominal": 60.0, "h": 90.0, "high": 90.0}
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
FUEL_TIERS = {"non_burnable": (91, 92, 93, 98, 99), "grass": range(101, 110), "grass_shrub": range(121, 125), "shrub": range(141, 150), "timber_understory": range(161, 166), "timber_litter": range(181, 190), "slash_blowdown": range(201, 205)}
FORECAST_BOX = ((24.5, 49.5), (-125.0, -66.5))
FIRE_MONTHS = (6, 7, 8, 9, 10, 11)


def number(text: str | Column) -> Column:
    """A double, or null if the text is none. NaN counts as null, as everywhere in the data model."""
    value = _col(text).try_cast("double")
    return F.when(F.isnan(value), None).otherwise(value)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mapped(value: Column, pairs: dict) -> Column:
    """pairs[value], or null."""
    out = F.lit(None)
    for key, to in reversed(list(pairs.items())):
        out = F.when(value == F.lit(key), F.lit(to)).otherwise(out)
    return out


def confidence(text: str | Column) -> Column:
    """Words and letters for low, nominal and high as 30, 60 and 90; numbers as they are; else null."""
    t = F.lower(F.trim(_col(text)))
    return F.coalesce(mapped(t, CONFIDENCES), t.try_cast("double"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def wind_speed_kmh(u: Column, v: Column) -> Column:
    """From components in m/s; a missing component counts as 0."""
    u, v = F.coalesce(u, F.lit(0.0)), F.coalesce(v, F.lit(0.0))
    return F.bround(F.sqrt(u * u + v * v) * 3.6, 2)


def wind_direction(u: Column, v: Column) -> Column:
    """Degrees from which the wind blows, clockwise from north."""
    return F.bround(F.pmod(F.lit(270.0) - F.degrees(F.atan2(v, u)), F.lit(360.0)), 1)


def vapour_pressure_deficit(celsius: Column, humidity: Column) -> Column:
    """kPa. Missing temperature counts as 20 degrees, missing humidity as 50 %."""
    t = F.coalesce(celsius, F.lit(20.0))
    rh = F.least(F.greatest(F.coalesce(humidity, F.lit(50.0)), F.lit(0.0)), F.lit(100.0))
    return F.bround(F.greatest(F.lit(0.0), 0.6108 * F.exp(17.27 * t / (t + 237.3)) * (1 - rh / 100)), 4)


def celsius(fahrenheit: Column) -> Column:
    return F.bround((fahrenheit - 32) * 5.0 / 9.0, 1)


def mph_to_kmh(text: Column) -> Column:
    """'10 to 15 mph' or '10 mph': the mean in km/h; null if there is no number."""
    low = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    high = F.regexp_extract(text, r"to\s+(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.bround((low + F.coalesce(high, low)) / 2 * 1.60934, 1)


def compass_degrees(point: Column) -> Column:
    return mapped(F.upper(F.trim(point)), {p: 22.5 * i for i, p in enumerate(COMPASS)})


def acquisition_time(date: Column, hhmm: Column) -> Column:
    """YYYY-MM-DD and HHMM without leading zeros; null if they don't parse."""
    return F.try_to_timestamp(F.concat_ws(" ", date.cast("string"), F.lpad(hhmm.cast("string"), 4, "0")), F.lit("yyyy-MM-dd HHmm"))


def scan_time(file_name: Column) -> Column:
    """The start time _sYYYYDDDHHMM in a file name."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(file_name, r"_s(\d{11})", 1), F.lit("")), F.lit("yyyyDDDHHmm"))


def forecast_key(cycle: Column) -> Column:
    """Path of the surface file of an hourly forecast cycle."""
    return F.concat(F.lit("hrrr."), F.date_format(cycle, "yyyyMMdd"), F.lit("/conus/hrrr.t"), F.date_format(cycle, "HH"), F.lit("z.wrfsfcf00.grib2"))


def fuel_tier(code: Column) -> Column:
    """Tier of a fuel code; null, text and unknown codes are `unknown`."""
    code = code.try_cast("int")
    out = F.lit("unknown")
    for tier, codes in FUEL_TIERS.items():
        out = F.when(code.isin(*codes), tier).otherwise(out)
    return out


def season(time: Column) -> Column:
    return F.when(F.month(time).isin(*FIRE_MONTHS), "fire_season").when(time.isNotNull(), "off_season")


def quality_tier(flag: Column) -> Column:
    return F.when(flag <= 2, "tier_a").when(flag.isNotNull(), "tier_b")


def circular_mean(degrees: str | Column) -> Column:
    """Aggregate: mean direction in [0, 360); null without values."""
    r = F.radians(_col(degrees))
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))), F.lit(360.0))


def path_name(feature: Column) -> Column:
    return F.translate(F.translate(feature, "/", "_"), " ", "_")


def window_start(time: Column, hours: int = 6) -> Column:
    """Start of the window of so many hours (a divisor of 24) that holds a timestamp without time zone."""
    return F.to_date(time).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.floor(F.hour(time) / hours) * hours).cast("int"))


def has_forecast(lat: Column, lon: Column) -> Column:
    """Whether the national forecasts cover a point; a missing coordinate is not covered."""
    (south, north), (west, east) = FORECAST_BOX
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))
