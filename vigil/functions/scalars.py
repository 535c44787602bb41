"""Column functions of the sensor engine. All are built-in expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean alarm and no alarm, and the form of a decimal number.
ALARM_TRUE, ALARM_FALSE = ("true", "t"), ("false", "f")
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def empty_to_null(c: Column) -> Column:
    """Trimmed text; null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def parse_alarm(c: Column) -> Column:
    """Three-valued alarm from t/f/true/false in any case; null for anything else."""
    text = F.lower(F.trim(c))
    return F.when(text.isin(*ALARM_TRUE), True).when(text.isin(*ALARM_FALSE), False)


def panel_alarm(c: Column) -> Column:
    """Alarm as panels read it: anything but a true text is false."""
    return F.coalesce(F.lower(F.trim(c)).isin(*ALARM_TRUE), F.lit(False))


def parse_number(c: Column) -> Column:
    """A finite number with point or comma; null otherwise."""
    text = F.replace(F.trim(c), F.lit(","), F.lit("."))
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def parse_state(c: Column) -> Column:
    """The raw text where it is no number; null where it is empty."""
    return F.when(parse_number(c).isNull(), empty_to_null(c))


def first_part(c: Column, separator: str = "-") -> Column:
    return empty_to_null(F.split_part(c, F.lit(separator), F.lit(1)))


def picket(c: Column) -> Column:
    """The number after the picket mark, in either case."""
    return F.nullif(F.regexp_extract(c, r"(?iu)ПК\s*(\d+)", 1), F.lit("")).try_cast("int")


def row_hash(*cols: Column) -> Column:
    """SHA-256 of the compact JSON array of the given texts, nulls kept."""
    return F.sha2(F.to_json(F.array(*cols), {"ignoreNullFields": "false"}), 256)


def pseudonym(c: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), c.cast("string")), 256), 1, 16)


def in_sample(c: Column, parts: int, part: int) -> Column:
    """Membership of a deterministic hash sample, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long") % parts == part


def synthetic_coordinate(c: Column) -> Column:
    """A value in [0, 1] from the first 16 hexadecimal digits of SHA-256."""
    return F.round(F.conv(F.substring(F.sha2(c.cast("string"), 256), 1, 16), 16, 10).cast("double") / F.lit(float(2**64 - 1)), 6)


def neutral_cell(c: Column) -> Column:
    """Text that a spreadsheet won't run as a formula."""
    return F.regexp_replace(c, r"^(\s*[=+\-@])", "'$1")


def wkt_point(c: Column) -> Column:
    """struct(lon, lat) of a WKT point inside the valid ranges; null otherwise."""
    pattern = r"(?i)^\s*POINT\s*\(\s*([-+.\deE]+)\s+([-+.\deE]+)\s*\)\s*$"
    lon, lat = (F.regexp_extract(c, pattern, i).try_cast("double") for i in (1, 2))
    return F.when(lon.between(-180, 180) & lat.between(-90, 90), F.struct(lon.alias("lon"), lat.alias("lat")))


def geojson_point(c: Column) -> Column:
    """struct(lon, lat) of a GeoJSON point inside the valid ranges; null otherwise."""
    lon, lat = (F.get_json_object(c, f"$.coordinates[{i}]").try_cast("double") for i in (0, 1))
    return F.when((F.get_json_object(c, "$.type") == "Point") & lon.between(-180, 180) & lat.between(-90, 90), F.struct(lon.alias("lon"), lat.alias("lat")))


def to_feature(lon: Column, lat: Column, **properties: Column) -> Column:
    """A GeoJSON feature as text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*(c.alias(k) for k, c in properties.items())).alias("properties")))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def recurrence_score(days: Column) -> Column:
    """1 / (1 + days since the last event), 0 without one."""
    return F.coalesce(1 / (1 + days.cast("double")), F.lit(0.0))


def rule_score(alarm_share: Column, previous: Column, failure: Column) -> Column:
    """The largest of the alarm share, half the previous score and three quarters of the failure flag."""
    return F.greatest(F.coalesce(alarm_share, F.lit(0.0)), 0.5 * F.coalesce(previous, F.lit(0.0)), 0.75 * F.coalesce(failure, F.lit(0.0)))


def weighted_recent(first: Column, second: Column) -> Column:
    """A signal's recent count and half of another's, nulls as 0."""
    return F.coalesce(first.cast("double"), F.lit(0.0)) + 0.5 * F.coalesce(second.cast("double"), F.lit(0.0))


def dropout_rule(gap: Column, current: Column, previous: Column) -> Column:
    """Chance of silence from the days since the previous observation and the fall of activity (fixed weights)."""
    zero = lambda c: F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    fall = F.greatest(zero(previous) - F.coalesce(current.cast("double"), F.lit(0.0)), F.lit(0.0)) / (1 + zero(previous))
    return logistic(clip(0.9 * F.log1p(zero(gap)) + 1.4 * fall - 1.8, -20.0, 20.0))


def flood_rule(flood_alarm: Column, pump_alarm: Column, power_alarm: Column, flood_value: Column, pump_value: Column, gap: Column) -> Column:
    """The strongest of three signs of flooding on a logistic scale (fixed weights)."""
    up = lambda c: F.greatest(c, F.lit(0.0))
    fv, pv = F.abs(flood_value), F.abs(pump_value)
    # The pump's alarm count isn't negative, so it adds nothing to the second sign.
    signs = (up(flood_alarm) + 0.5 * F.greatest(up(pump_alarm), pv), fv, 0.7 * F.abs(fv - pv) + 0.3 * (up(power_alarm) + up(gap)))
    return logistic(clip(F.greatest(*signs), -20.0, 20.0))


def scenario_rule(*signals: Column) -> Column:
    """1 - exp(-(the two largest signals) / 5), signals below 0 as 0."""
    top = F.sort_array(F.array(*(F.greatest(F.coalesce(s.cast("double"), F.lit(0.0)), F.lit(0.0)) for s in signals)), asc=False)
    return 1 - F.exp(-(top[0] + top[1]) / 5)


def scenario_anomaly(*features: Column) -> Column:
    """1 - exp(-length of the vector, each part clipped at 10, by its number of parts)."""
    squares = sum((F.pow(clip(F.coalesce(x.cast("double"), F.lit(0.0)), -10.0, 10.0), F.lit(2.0)) for x in features), F.lit(0.0))
    return 1 - F.exp(-F.sqrt(squares) / max(1, len(features)))


def multi_signal(types: Column, any_alarm: Column, recurrence: Column) -> Column:
    """The largest of half the alarming types (1 at most), a quarter for any alarm and half the recurrence score."""
    return F.greatest(F.least(types / 2, F.lit(1.0)), 0.25 * any_alarm.cast("double"), 0.5 * recurrence)


def period_name(day: Column) -> Column:
    """Half-year name such as 2024H1."""
    return F.concat(F.year(day).cast("string"), F.when(F.month(day) <= 6, "H1").otherwise("H2"))
