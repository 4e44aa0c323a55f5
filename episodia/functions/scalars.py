"""Column expressions: every function takes and returns ``Column``.

All of them stay inside whole-stage code generation except the regular
expressions, which Spark evaluates in the JVM row by row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from episodia.functions import fixed_values as fixed

C = Column


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- time -------------------------------------------------------------------

def epoch_seconds(ts) -> C:
    """Whole seconds since 1970 (UTC session)."""
    return F.unix_timestamp(col(ts))


def day_of(ts) -> C:
    return F.to_date(col(ts))


def age_at(anchor_age, anchor_year, ts) -> C:
    """Age in the year of ``ts`` for someone aged ``anchor_age`` in ``anchor_year``."""
    return col(anchor_age) + F.year(col(ts)) - col(anchor_year)


def seconds_between(start, end) -> C:
    return epoch_seconds(end) - epoch_seconds(start)


def within_days(start, end, days: int) -> C:
    """``end`` is strictly after ``start`` and at most ``days`` later."""
    gap = seconds_between(start, end)
    return (gap > 0) & (gap <= days * 86400)


def months_before(ts, months: int) -> C:
    """The same clock time ``months`` calendar months earlier."""
    whole = col(ts).cast("timestamp")
    rest = F.unix_micros(whole) - F.unix_micros(F.to_date(whole).cast("timestamp"))
    start = F.unix_micros(F.add_months(F.to_date(whole), -months).cast("timestamp"))
    return F.timestamp_micros(start + rest)


def day_count(start, day) -> C:
    """Days from ``start`` to ``day``, 0 on the same date."""
    return F.datediff(col(day), col(start))


# --- deterministic randomness ------------------------------------------------

def uniform(*parts) -> C:
    """Number in [0, 1) from the first eight bytes of SHA-256 of ``a:b:c``."""
    key = F.concat_ws(":", *[col(p).cast("string") for p in parts])
    head = F.substring(F.sha2(key, 256), 1, 16)
    whole = F.conv(head, 16, 10).cast("decimal(20,0)").cast("double")
    return whole / F.lit(18446744073709551616.0)


def split_name(u, train: float, valid: float, names=("train", "valid", "test")) -> C:
    return F.when(u < train, names[0]).when(u < train + valid, names[1]).otherwise(names[2])


# --- nulls, text and codes ---------------------------------------------------

def blank_to_null(c) -> C:
    return F.nullif(F.trim(col(c)), F.lit(""))


def number_or_null(c) -> C:
    """Text to double; anything that does not parse, and NaN, becomes null."""
    value = col(c).cast("string").try_cast("double")
    return F.when(~F.isnan(value), value)


def is_finite(c) -> C:
    x = col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def finite_or_null(c) -> C:
    return F.when(is_finite(c), col(c))


def starts_with_any(code, prefixes: Sequence[str]) -> C:
    """``code`` begins with one of ``prefixes``; one IN list per prefix length."""
    by_length: dict[int, list[str]] = {}
    for p in prefixes:
        by_length.setdefault(len(p), []).append(p)
    tests = [F.substring(col(code), 1, n).isin(ps) for n, ps in sorted(by_length.items())]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def first_matching_group(c, rules, default="other", exact: Mapping[str, str] | None = None) -> C:
    """Ordered substring rules ``(group, [needles])``; the first match wins."""
    out = None
    for value, group in (exact or {}).items():
        test = col(c) == value
        out = F.when(test, group) if out is None else out.when(test, group)
    for group, needles in rules:
        test = reduce(lambda a, b: a | b, [col(c).contains(n) for n in needles])
        out = F.when(test, group) if out is None else out.when(test, group)
    return out.otherwise(default)


def care_unit_group(unit) -> C:
    return first_matching_group(
        unit, fixed.UNIT_RULES, exact={u: "icu" for u in fixed.ICU_UNIT_NAMES}
    )


def code_group(c, groups: Mapping[str, Sequence[str]], default="other") -> C:
    """Code to group by a literal map."""
    pairs = [F.lit(x) for g, codes in groups.items() for code in codes for x in (code, g)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(c)), F.lit(default))


def pattern_flag(text, patterns: Sequence[str]) -> C:
    """1 if any pattern occurs in ``text``, whatever the case.

    One regular expression per class.  Where texts repeat, as names do,
    classify the distinct ones and join the result.
    """
    return F.coalesce(col(text).rlike("(?i)" + "|".join(patterns)), F.lit(False)).cast("int")


def matching_classes(text, classes: Mapping[str, Sequence[str]]) -> C:
    """Array of the classes whose patterns occur in ``text``."""
    found = [F.when(pattern_flag(text, p) == 1, F.lit(name)) for name, p in classes.items()]
    return F.array_compact(F.array(*found))


def text_code(text, table=fixed.DEVICE_CODES, default=None) -> C:
    """Text to code by ordered lists of lower-case words."""
    low = F.lower(col(text))
    out = None
    for code, words in table:
        test = low.isin(words)
        out = F.when(test, F.lit(code)) if out is None else out.when(test, F.lit(code))
    return out.otherwise(F.lit(None) if default is None else col(default))


def composite_key(*parts, sep="_") -> C:
    return F.concat_ws(sep, *[col(p).cast("string") for p in parts])


def pretty_name(c, prefix="s_") -> C:
    """Column name to a readable label."""
    return F.initcap(F.regexp_replace(F.regexp_replace(col(c), f"^{prefix}", ""), "_", " "))


# --- units and rates ---------------------------------------------------------

def to_millilitres(amount, unit) -> C:
    return F.when(col(unit) == "L", col(amount) * 1000).otherwise(col(amount))


def weight_rate(rate, weight, item, factors: Mapping[int, float] = fixed.VASO_FACTORS) -> C:
    """Rate per kilogram with the item's factor; other items keep their rate."""
    out = None
    for key, factor in factors.items():
        value = col(rate) / F.nullif(col(weight), F.lit(0.0)) * factor
        out = F.when(col(item) == key, value) if out is None else out.when(col(item) == key, value)
    return out.otherwise(col(rate))


def fahrenheit(c) -> C:
    return col(c) * 1.8 + 32


def celsius(c) -> C:
    return (col(c) - 32) / 1.8


def infusion_rate(volume, rate, amount) -> C:
    """Volume-equivalent rate; null where the amount is 0 or missing."""
    return col(volume) * col(rate) / F.nullif(col(amount), F.lit(0.0))


# --- bounds and scaling ------------------------------------------------------

def keep_within(c, low, high) -> C:
    """Null outside ``[low, high]``."""
    return F.when(col(c).between(low, high), col(c))


def drop_sentinel(c, above=fixed.SENTINEL_ABOVE) -> C:
    return F.when(col(c) <= above, col(c))


def clip(c, low, high) -> C:
    """``greatest``/``least`` skip nulls, so nulls are guarded here."""
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(low)), F.lit(high)))


def zscore(c, mean, std, limit=fixed.Z_LIMIT) -> C:
    """Standardise and clip; a missing or tiny spread counts as 1."""
    spread = F.when(col(std) >= 1e-8, col(std)).otherwise(F.lit(1.0))
    return clip((col(c) - col(mean)) / spread, -limit, limit)


def capped_ratio(top, bottom, cap=fixed.RATIO_CAP) -> C:
    ratio = col(top) / F.nullif(col(bottom), F.lit(0.0))
    return F.when(ratio.isNotNull(), F.least(ratio, F.lit(float(cap))))


def above(c, threshold) -> C:
    """1 above the threshold, 0 otherwise and for null."""
    return F.coalesce((col(c) > threshold).cast("int"), F.lit(0))


def quartile_level(c, q1, q2, q3) -> C:
    """0 for none, 1-4 by the quartiles of the non-zero values."""
    x = col(c)
    return (
        F.when(x >= col(q3), 4).when(x >= col(q2), 3).when(x >= col(q1), 2)
        .when(x > 0, 1).otherwise(0)
    )


def step_value(c, at_most=(), at_least=()) -> C:
    """Stepwise lookup.

    The smallest limit at or above ``c`` in ``at_most`` decides; a limit of
    ``at_least`` at or below ``c`` overrides it, the largest one first.
    """
    out = None
    for limit, value in sorted(at_least, reverse=True):
        test = col(c) >= limit
        out = F.when(test, F.lit(float(value))) if out is None else out.when(test, F.lit(float(value)))
    for limit, value in sorted(at_most):
        test = col(c) <= limit
        out = F.when(test, F.lit(float(value))) if out is None else out.when(test, F.lit(float(value)))
    return out


# --- flags and actions -------------------------------------------------------

def dose_flag(c) -> C:
    return (F.coalesce(col(c), F.lit(0)) > 0).cast("int")


def any_flag(*cs) -> C:
    return F.greatest(*[dose_flag(c) for c in cs])


def two_way(c, one, zero=None) -> C:
    """1 for ``one``; 0 for ``zero`` (or for everything else if omitted)."""
    if zero is None:
        return F.coalesce((col(c) == one).cast("int"), F.lit(0))
    return F.when(col(c) == one, 1).when(col(c) == zero, 0)


def encode_bits(flags: Sequence) -> C:
    """Flags to one integer, the first flag in the lowest bit."""
    return reduce(lambda a, b: a + b, [F.shiftleft(col(f).cast("int"), i) for i, f in enumerate(flags)])


def decode_bit(action, i: int) -> C:
    return F.shiftright(col(action), i).bitwiseAND(F.lit(1))


def active_count(flags: Sequence) -> C:
    return reduce(lambda a, b: a + b, [F.coalesce(col(f), F.lit(0)) for f in flags])


def label_of_flags(flags: Sequence, labels: Mapping[tuple, str]) -> C:
    """Tuple of flags to its label; an unmapped tuple is an error."""
    key = F.concat_ws(",", *[col(f).cast("int").cast("string") for f in flags])
    pairs = [F.lit(x) for k, name in labels.items() for x in (",".join(str(v) for v in k), name)]
    found = F.try_element_at(F.create_map(*pairs), key)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no label for flags "), key)))


# --- scores and rewards ------------------------------------------------------

def hinge_severity(
    positive=fixed.SEVERITY_POSITIVE, negative=fixed.SEVERITY_NEGATIVE,
    absolute=fixed.SEVERITY_ABSOLUTE, prefix="",
) -> C:
    """Weighted sum of one-sided terms and absolute values of z-scores."""
    zero = F.lit(0.0)
    terms = [F.greatest(-col(prefix + n), zero) * w for n, w in negative.items()]
    terms += [F.greatest(col(prefix + n), zero) * w for n, w in positive.items()]
    terms += [F.abs(col(prefix + n)) * w for n, w in absolute.items()]
    return reduce(lambda a, b: a + b, terms)


def linear_severity(coefficients: Mapping[str, float], intercept: float, low=None, high=None,
                    transforms: Mapping | None = None) -> C:
    """Intercept plus weighted features, optionally transformed, then clamped."""
    change = transforms or {}
    total = F.lit(float(intercept))
    for name, w in coefficients.items():
        total = total + change.get(name, lambda x: x)(col(name)) * float(w)
    return total if low is None else clip(total, low, high)


def terminal_reward(p, scale=fixed.TERMINAL_REWARD) -> C:
    return F.lit(float(scale)) - col(p) * (2.0 * scale)


def step_reward(done, now, following, bad_end, scale=fixed.TERMINAL_REWARD) -> C:
    """Improvement on ordinary rows; plus or minus ``scale`` on the last row."""
    end = F.when(col(bad_end) == 0, F.lit(float(scale))).otherwise(F.lit(-float(scale)))
    return F.when(col(done) == 0, col(now) - col(following)).otherwise(end)


def verdict(effect, expected) -> C:
    """Does the direction of the effect (up if positive) agree with expectation?"""
    direction = F.when(col(effect) > 0, "up").otherwise("down")
    return (
        F.when(col(effect).isNull(), "error")
        .when(col(expected).isNull() | (col(expected) == "unknown"), "unknown")
        .when(direction == col(expected), "correct")
        .otherwise("wrong")
    )


def add_effects(base, flags_and_effects: Sequence[tuple]) -> C:
    """Predicted value plus the effect of every active flag."""
    return reduce(
        lambda a, fe: a + col(fe[0]) * F.coalesce(col(fe[1]), F.lit(0.0)),
        flags_and_effects, col(base),
    )


# --- clinical ratios and scores (published definitions) ----------------------

def oxygen_ratio(pao2, fraction) -> C:
    return col(pao2) / F.nullif(col(fraction), F.lit(0.0))


def shock_index(hr, systolic) -> C:
    return col(hr) / F.nullif(col(systolic), F.lit(0.0))


def _points(c, cuts) -> C:
    """Points by ordered conditions; missing values score 0."""
    out = None
    for test, points in cuts:
        cond = test(col(c))
        out = F.when(cond, points) if out is None else out.when(cond, points)
    return out.otherwise(0)


def organ_failure_score(ratio, ventilated, platelets, bilirubin, pressure, vaso, gcs,
                        creatinine, urine_24h) -> C:
    """Six-organ failure score with the cut-offs published in 1996.

    Own definition: missing inputs score 0 points for their organ.
    """
    vent = F.coalesce(col(ventilated), F.lit(0)) > 0
    breathing = (
        F.when((col(ratio) < 100) & vent, 4).when((col(ratio) < 200) & vent, 3)
        .when(col(ratio) < 300, 2).when(col(ratio) < 400, 1).otherwise(0)
    )
    clotting = _points(platelets, [(lambda x: x < 20, 4), (lambda x: x < 50, 3),
                                   (lambda x: x < 100, 2), (lambda x: x < 150, 1)])
    liver = _points(bilirubin, [(lambda x: x >= 12, 4), (lambda x: x >= 6, 3),
                                (lambda x: x >= 2, 2), (lambda x: x >= 1.2, 1)])
    flow = (
        F.when(col(vaso) > 0.1, 4).when(col(vaso) > 0, 3)
        .when(col(pressure) < 70, 1).otherwise(0)
    )
    nerves = _points(gcs, [(lambda x: x < 6, 4), (lambda x: x < 10, 3),
                           (lambda x: x < 13, 2), (lambda x: x < 15, 1)])
    kidney = (
        F.when((col(creatinine) >= 5) | (col(urine_24h) < 200), 4)
        .when((col(creatinine) >= 3.5) | (col(urine_24h) < 500), 3)
        .when(col(creatinine) >= 2, 2).when(col(creatinine) >= 1.2, 1).otherwise(0)
    )
    return breathing + clotting + liver + flow + nerves + kidney


def inflammation_score(temp_c, hr, rr, paco2, wbc) -> C:
    """Four inflammatory-response criteria published in 1992; missing scores 0."""
    return (
        F.coalesce(((col(temp_c) > 38) | (col(temp_c) < 36)).cast("int"), F.lit(0))
        + above(hr, 90)
        + F.greatest(above(rr, 20), F.coalesce((col(paco2) < 32).cast("int"), F.lit(0)))
        + F.coalesce(((col(wbc) > 12) | (col(wbc) < 4)).cast("int"), F.lit(0))
    )
