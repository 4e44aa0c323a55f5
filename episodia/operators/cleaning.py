"""Bounds, unit repairs and cross-imputation of wide state tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodia.functions import fixed_values as fixed
from episodia.functions.scalars import drop_sentinel, keep_within, step_value


def within_bounds(df: DataFrame, bounds: Mapping[str, tuple] = fixed.BOUNDS,
                  sentinel: float | None = fixed.SENTINEL_ABOVE) -> DataFrame:
    """Null outside the bounds, all columns in one projection."""
    out = {}
    for c, (low, high) in bounds.items():
        if c in df.columns:
            x = drop_sentinel(c, sentinel) if sentinel is not None else F.col(c)
            out[c] = keep_within(x, low, high)
    return df.withColumns(out)


def units_reassigned(df: DataFrame, celsius: str, fahrenheit: str, percent: str) -> DataFrame:
    """Celsius above 45 without a Fahrenheit value was Fahrenheit; fractions
    recorded as percentages are scaled."""
    wrong = (F.col(celsius) > 45) & F.col(fahrenheit).isNull()
    return df.withColumns({
        fahrenheit: F.when(wrong, F.col(celsius)).otherwise(F.col(fahrenheit)),
        celsius: F.when(~F.coalesce(wrong, F.lit(False)), F.col(celsius)),
        percent: F.when(F.col(percent) < 1, F.col(percent) * 100).otherwise(F.col(percent)),
    })


def reciprocal_fill(df: DataFrame, fraction: str, percent: str) -> DataFrame:
    return df.withColumns({
        fraction: F.coalesce(F.col(fraction), F.col(percent) / 100),
        percent: F.coalesce(F.col(percent), F.col(fraction) * 100),
    })


def component_total(df: DataFrame, parts: Sequence[str], name: str) -> DataFrame:
    """Sum of the parts where all of them are present; else an existing total stays."""
    total = F.col(parts[0])
    for p in parts[1:]:
        total = total + F.col(p)
    return df.withColumn(name, F.coalesce(total, F.col(name)) if name in df.columns else total)


def pressure_fill(df: DataFrame, systolic: str, mean: str, diastolic: str) -> DataFrame:
    """Any one of the three pressures from the other two."""
    s, m, d = F.col(systolic), F.col(mean), F.col(diastolic)
    return df.withColumns({
        diastolic: F.coalesce(d, (3 * m - s) / 2),
        mean: F.coalesce(m, (s + 2 * d) / 3),
        systolic: F.coalesce(s, 3 * m - 2 * d),
    })


def temperature_fill(df: DataFrame, celsius: str, fahrenheit: str) -> DataFrame:
    """Swap values recorded under the other unit, then convert both ways."""
    c, f = F.col(celsius), F.col(fahrenheit)
    as_c = (f > 25) & (f < 45)
    c1, f1 = F.when(as_c, f).otherwise(c), F.when(~F.coalesce(as_c, F.lit(False)), f)
    as_f = c1 > 70
    c2, f2 = F.when(~F.coalesce(as_f, F.lit(False)), c1), F.when(as_f, c1).otherwise(f1)
    return df.withColumns({
        fahrenheit: F.coalesce(f2, c2 * 1.8 + 32),
        celsius: F.coalesce(c2, (f2 - 32) / 1.8),
    })


def linear_pair_fill(df: DataFrame, x: str, y: str, slope: float, offset: float, y_floor: float | None = None) -> DataFrame:
    """``y = slope * x + offset`` both ways; ``y`` is not allowed below the floor."""
    new_y = F.coalesce(F.col(y), F.col(x) * slope + offset)
    if y_floor is not None:
        new_y = F.when(new_y < y_floor, F.lit(y_floor)).otherwise(new_y)
    return df.withColumns({x: F.coalesce(F.col(x), (F.col(y) - offset) / slope), y: new_y})


def blood_fill(df: DataFrame, hb="hb", ht="ht", total="total_bili", direct="direct_bili") -> DataFrame:
    """Haemoglobin/haematocrit and total/direct bilirubin from each other."""
    out = linear_pair_fill(df, hb, ht, 2.862, 1.216)
    return linear_pair_fill(out, total, direct, 0.6934, -0.1752, 0.0)


def oxygen_estimate(df: DataFrame, percent: str, device_held: str, flow_held: str, percent_held: str) -> DataFrame:
    """Inspired oxygen from flow and device where no value is held.

    Five rules by device; the conditions read the held values.
    """
    unknown = F.col(percent_held).isNull()
    has_flow = F.col(flow_held).isNotNull()
    device = F.col(device_held)
    cannula = F.coalesce(device.isin(fixed.CANNULA_DEVICES), F.lit(False))
    mask = device.isNull() | device.isin(fixed.MASK_DEVICES)
    non_rebreather = F.coalesce(device == fixed.NON_REBREATHER_DEVICE, F.lit(False))
    value = (
        F.when(unknown & has_flow & cannula, step_value(flow_held, fixed.FLOW_CANNULA))
        .when(unknown & ~has_flow & cannula, F.lit(float(fixed.ROOM_AIR_PERCENT)))
        .when(unknown & has_flow & mask, step_value(flow_held, fixed.FLOW_MASK))
        .when(unknown & has_flow & non_rebreather,
              step_value(flow_held, fixed.FLOW_NON_REBREATHER, fixed.FLOW_NON_REBREATHER_HIGH))
        .when(unknown & ~has_flow & (mask | non_rebreather), F.lit(None).cast("double"))
        .otherwise(F.col(percent))
    )
    return df.withColumn(percent, value)


def outlier_keys(df: DataFrame, keys: list[str], limits: Mapping[str, float]) -> DataFrame:
    """Keys with any value above its limit."""
    tests = [F.col(c) > v for c, v in limits.items() if c in df.columns]
    bad = tests[0]
    for t in tests[1:]:
        bad = F.coalesce(bad, F.lit(False)) | F.coalesce(t, F.lit(False))
    return df.filter(bad).select(*keys).distinct()


def defaults_filled(df: DataFrame, constants: Mapping[str, object], capped: Mapping[str, tuple] = {},
                    medians: Mapping[str, str] = {}) -> DataFrame:
    """Constants for nulls, then replacement of extremes, then medians.

    A column may be in several of them; the rules apply one after the other.

    ``capped`` maps a column to (above, replacement); ``medians`` maps a column
    to the name of a one-row median column already attached.
    """
    out = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in constants.items()}
    for c, (limit, new) in capped.items():
        value = out.get(c, F.col(c))
        out[c] = F.when(value > limit, F.lit(new)).otherwise(value)
    for c, m in medians.items():
        out[c] = F.coalesce(out.get(c, F.col(c)), F.col(m))
    return df.withColumns(out)
