"""Column functions: parsing, encodings, flags, fuel and text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock import fixed
from paddock.schemas import CAR_ENTRY

_FLOAT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INT = r"^\s*[+-]?\d+\s*$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: str | Column, values: Mapping, default: Column | None = None) -> Column:
    """CASE expression over a fixed mapping, NULL (or ``default``) for other values."""
    pairs = iter(values.items())
    k, v = next(pairs)
    out = F.when(col(c) == k, v)
    for k, v in pairs:
        out = out.when(col(c) == k, v)
    return out if default is None else out.otherwise(default)


def _number(c: Column) -> Column:
    return F.when(c.rlike(_FLOAT), F.trim(c).try_cast("double"))


def parse_lap_time(c: str | Column) -> Column:
    """``m:ss.fff`` or plain seconds to seconds; anything else NULL.

    Three or more parts give the first part, as the feed's consumer always did.
    """
    c = col(c)
    parts = F.split(c, ":")
    minutes = F.when(parts[0].rlike(_INT), F.trim(parts[0]).try_cast("int"))
    return F.when(F.size(parts) == 2, minutes * 60 + _number(F.try_element_at(parts, F.lit(2)))).otherwise(
        _number(parts[0])
    )


def parse_temp(c: str | Column) -> Column:
    """Number from text, NULL when malformed."""
    return _number(col(c).cast("string"))


def drs_status(c: str | Column) -> Column:
    code = col(c).try_cast("int")
    return F.when(col(c).isNotNull(), lookup(code, fixed.DRS_CODES, F.lit("unknown")))


def channel_fields(channels: Column) -> Column:
    """Named channel values from a channel map; absent channels stay NULL."""

    def at(number: str) -> Column:
        return F.try_element_at(channels, F.lit(number))

    return F.struct(
        at("2").alias("speed_kmh"),
        at("4").alias("throttle_pct"),
        (at("5") != 0).alias("brake"),
        at("3").try_cast("int").alias("gear"),
        drs_status(at("45")).alias("drs"),
    )


def decode_channels(c: str | Column) -> Column:
    """Struct of named channel values from one car's JSON entry."""
    return channel_fields(F.from_json(col(c), CAR_ENTRY)["Channels"])


def interval_seconds(c: str | Column) -> Column:
    """Day-time interval to seconds."""
    c = col(c)
    whole = (
        F.extract(F.lit("DAY"), c) * 86400
        + F.extract(F.lit("HOUR"), c) * 3600
        + F.extract(F.lit("MINUTE"), c) * 60
    )
    return (whole + F.extract(F.lit("SECOND"), c)).cast("double")


def _iso(c: Column, zone: str) -> Column:
    pattern = "yyyy-MM-dd'T'HH:mm:ss"
    micros = F.date_format(c, "SSSSSS")
    return F.concat(
        F.date_format(c, pattern),
        F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)),
        F.lit(zone),
    )


def json_value(c: Column, dtype: T.DataType) -> Column:
    """NaN to NULL, intervals to seconds, timestamps to ISO text, through nested types."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    if isinstance(dtype, T.DayTimeIntervalType):
        return interval_seconds(c)
    if isinstance(dtype, T.TimestampNTZType):
        return _iso(c, "")
    if isinstance(dtype, T.TimestampType):
        return _iso(c, "+00:00")
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: json_value(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, x: json_value(x, dtype.valueType))
    if isinstance(dtype, T.StructType):
        inner = [json_value(c[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*inner))
    return c


def normalize_json(df: DataFrame) -> DataFrame:
    """Every column as JSON-friendly primitives."""
    return df.select(*[json_value(df[f.name], f.dataType).alias(f.name) for f in df.schema.fields])


def compound_code(c: str | Column) -> Column:
    default = F.lit(fixed.COMPOUND_CODES[fixed.DEFAULT_COMPOUND])
    return lookup(c, fixed.COMPOUND_CODES, default)


def compound_model(c: str | Column) -> Column:
    default = F.lit(fixed.COMPOUND_MODELS[fixed.DEFAULT_COMPOUND])
    return lookup(c, fixed.COMPOUND_MODELS, default)


def stable_code(c: str | Column, modulus: int = 1000) -> Column:
    return (F.crc32(col(c).cast("string").cast("binary")) % modulus).cast("int")


def fuel_at_lap(lap: str | Column, race_laps: str | Column) -> Column:
    return F.lit(fixed.START_FUEL_KG) * (1 - col(lap) / col(race_laps))


def fuel_features(
    df: DataFrame, lap="lap_number", race_laps="laps_in_session", time="lap_time_seconds"
) -> DataFrame:
    """Training features: fuel at the lap, fuel-adjusted lap time, estimated load."""
    fuel = fuel_at_lap(lap, race_laps)
    burnt = F.lit(fixed.START_FUEL_KG) - fuel
    return df.select(
        "*",
        fuel.alias("fuel_at_lap"),
        (col(time) - fixed.FUEL_SECONDS_PER_KG * burnt).alias("fuel_adjusted_time"),
        F.greatest(fuel, F.lit(0.0)).alias("fuel_load_est"),
    )


def forward_fuel(lap: str | Column, race_laps: str | Column) -> Column:
    """Inference form of the fuel feature, which has no lap-time term."""
    fuel = fuel_at_lap(lap, F.greatest(col(race_laps), F.lit(1)))
    return -fixed.FUEL_SECONDS_PER_KG * (F.lit(fixed.START_FUEL_KG) - fuel)


def forward_fuel_load(lap: str | Column, race_laps: str | Column) -> Column:
    return F.greatest(fuel_at_lap(lap, F.greatest(col(race_laps), F.lit(1))), F.lit(0.0))


def fuel_features_forward(df: DataFrame, lap="lap_number", race_laps="total_laps") -> DataFrame:
    return df.withColumn("fuel_adjusted_time", forward_fuel(lap, race_laps))


def is_sc(c: str | Column) -> Column:
    """Safety car or virtual safety car in the concatenated status codes."""
    return F.coalesce(col(c).rlike("[467]"), F.lit(False))


def is_wet(c: str | Column) -> Column:
    return F.coalesce(col(c).isin(*fixed.WET_COMPOUNDS), F.lit(False))


def validate_plans(df: DataFrame, laps="pit_laps", compounds="compounds") -> DataFrame:
    """Add length_ok, unknown_compounds (sorted) and ok to pit-plan rows."""
    known = F.array(*[F.lit(c) for c in sorted(fixed.COMPOUND_CODES)])
    length_ok = (F.size(laps) == 0) | (F.size(laps) == F.size(compounds))
    unknown = F.array_sort(F.array_except(compounds, known))
    return df.select(
        "*",
        length_ok.alias("length_ok"),
        unknown.alias("unknown_compounds"),
        (length_ok & (F.size(unknown) == 0)).alias("ok"),
    )


def key_pattern(c: str | Column) -> Column:
    """Collapse id segments of a colon-separated key to ``*``."""
    part = "^[0-9a-fA-F-]{8,}$|^[0-9]+$"
    return F.array_join(
        F.transform(F.split(col(c), ":"), lambda s: F.when(s.rlike(part), "*").otherwise(s)), ":"
    )


def percent(c: str | Column) -> Column:
    """Whole percent, halves to even."""
    return F.format_string("%.0f%%", F.rint(col(c).cast("double") * 100))


def alert_message(driver: str | Column, ahead: str | Column, score: str | Column) -> Column:
    return F.format_string(
        "Undercut threat: driver %s on driver %s (%s)",
        col(driver).cast("string"), col(ahead).cast("string"), percent(score),
    )


def format_contribution(name: str | Column, value: str | Column, unit: str = "probability") -> Column:
    label = lookup(name, fixed.FEATURE_LABELS, col(name))
    value = F.rint(col(value).cast("double") * 100) / 100
    sign = F.when(col(value) >= 0, "+").otherwise("")
    return F.format_string("%s %s%.2f %s", label, sign, value, F.lit(unit))


def season_split(df: DataFrame, season: str = "season", time: str = "lap_time_seconds",
                 train_end: int = fixed.TRAIN_LAST_SEASON, holdout: int = fixed.HOLDOUT_SEASON):
    """(train, holdout) over timed laps of the supported seasons."""
    held = df.filter(
        col(time).isNotNull() & col(season).between(fixed.TRAIN_FIRST_SEASON, holdout)
    )
    return held.filter(col(season) <= train_end), held.filter(col(season) == holdout)


def optimal_pit_lap(lap: str | Column, ahead: str | Column) -> Column:
    return (col(lap) + F.greatest(col(ahead).cast("int"), F.lit(1))).cast("int")


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function (Abramowitz-Stegun 7.1.26, error < 1.5e-7)."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (
        0.254829592
        + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))
    )
    erf = 1 - poly * F.exp(-z * z)
    return 0.5 * (1 + F.signum(x) * erf)


def hash_uniform(*parts: Column) -> Column:
    """Uniform in (0, 1) from the md5 of the parts, equal under any partitioning."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def hash_gaussian(*parts: Column) -> Column:
    """Standard normal draw by Box-Muller from two hash uniforms."""
    u1, u2 = hash_uniform(*parts, F.lit("a")), hash_uniform(*parts, F.lit("b"))
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * F.pi() * u2)
