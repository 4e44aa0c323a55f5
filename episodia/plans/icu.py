"""Four-hour episode panel: long events to wide states, bins and doses.

Inputs are DataFrames with times in epoch seconds:

* events: stay, at, item, value, priority (lower wins between sources), seq
* items: item, field (the item dimension)
* stays: stay, intime, outtime and any attributes to carry
* fluids: stay, starttime, endtime, amount, rate, tev (rate null for a bolus)
* vaso: stay, starttime, endtime, ratestd
* drugs: stay, starttime, endtime, drug_class
* outputs: stay, at, value
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodia.functions import fixed_values as fixed
from episodia.functions import scalars as S
from episodia.operators import aggregates as A
from episodia.operators import cleaning as C
from episodia.operators import intervals as I
from episodia.operators import joins as J
from episodia.operators import sequences as W
from episodia.session import durable

KEY = ["stay"]
BIN = ["stay", "bin"]


def wide_states(events: DataFrame, items: DataFrame, stays: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per stay and time with the first value of every field.

    Items map to fields through the dimension; events outside the stay drop out.
    """
    named = events.join(items.select("item", "field"), "item").filter(F.col("value").isNotNull())
    inside = named.join(stays.select("stay", "intime", "outtime"), "stay").filter(F.col("at").between(F.col("intime"), F.col("outtime")))
    return A.first_value_wide(inside, ["stay", "at"], "field", "value", fields, ["priority", "seq"])


def clean_states(wide: DataFrame, hold_hours: Mapping[str, float] = fixed.HOLD_HOURS,
                 bounds: Mapping[str, tuple] = fixed.BOUNDS, rows_per_task: int | None = None) -> DataFrame:
    """Bounds, unit repairs, totals, cross fills, then time-limited holds.

    Steps whose columns are absent are skipped.
    """
    has = lambda *cs: all(c in wide.columns for c in cs)
    out = wide
    if has("temp_c", "temp_f", "fio2_100"):
        out = C.units_reassigned(out, "temp_c", "temp_f", "fio2_100")
    out = C.within_bounds(out, bounds)
    if has("gcs_eye", "gcs_verbal", "gcs_motor"):
        out = C.component_total(out, ["gcs_eye", "gcs_verbal", "gcs_motor"], "gcs")
    if has("fio2_100", "o2flow", "interface"):
        if "fio2_1" not in out.columns:
            out = out.withColumn("fio2_1", F.lit(None).cast("double"))
        out = C.reciprocal_fill(out, "fio2_1", "fio2_100")
        held = {c: fixed.HOLD_HOURS[c] for c in ("interface", "fio2_100", "o2flow")}
        out = W.held_values(out, KEY, "at", [], held, "_held", rows_per_task)
        out = C.oxygen_estimate(out, "fio2_100", "interface_held", "o2flow_held", "fio2_100_held")
        out = C.reciprocal_fill(out.drop(*[f"{c}_held" for c in held]), "fio2_1", "fio2_100")
    if has("sysbp", "meanbp", "diabp"):
        out = C.pressure_fill(out, "sysbp", "meanbp", "diabp")
    if has("temp_c", "temp_f"):
        out = C.temperature_fill(out, "temp_c", "temp_f")
    if has("hb", "ht", "total_bili", "direct_bili"):
        out = C.blood_fill(out)
    fields = [c for c in out.columns if c not in ("stay", "at")]
    hours = {c: hold_hours.get(c, fixed.LAB_HOLD_HOURS) for c in fields}
    return W.held_values(out, KEY, "at", [], hours, rows_per_task=rows_per_task)


def interventions(stays: DataFrame, fluids: DataFrame, vaso: DataFrame, drugs: DataFrame, outputs: DataFrame,
                  classes: Sequence[str], width: int) -> list[DataFrame]:
    """Volume, dose, drug-flag and output tables, each unique per stay and bin."""
    frame = (stays, KEY)
    edges = ("intime", "outtime", width)
    rated = fluids.withColumn("norm_rate", S.infusion_rate("tev", "rate", "amount"))
    infused = I.volume_per_bin(rated.filter("norm_rate is not null"), *frame, "starttime", "endtime", "norm_rate", *edges, "infused")
    bolus = I.points_to_bins(rated.filter("norm_rate is null"), *frame, "starttime", *edges).groupBy(*BIN).agg(F.sum("tev").alias("bolus"))
    urine = I.points_to_bins(outputs, *frame, "at", *edges).groupBy(*BIN).agg(F.sum("value").alias("output_step"))
    rates = I.active_rates_per_bin(vaso, *frame, "starttime", "endtime", "ratestd", *edges)
    dose = A.exact_quantiles(rates, BIN, "ratestd", {"median_dose_vaso": 0.5, "max_dose_vaso": 1.0})
    flags = I.active_flags_per_bin(drugs, *frame, "starttime", "endtime", "drug_class", {c: f"{c}_active" for c in classes}, *edges)
    return [infused, bolus, urine, dose, flags]


def openings(stays: DataFrame, fluids: DataFrame, outputs: DataFrame) -> DataFrame:
    """Fluid and output totals before the stay."""
    rated = fluids.withColumn("norm_rate", S.infusion_rate("tev", "rate", "amount"))
    base = stays.select("stay", "intime")
    a = I.volume_before(rated.filter("norm_rate is not null"), base, KEY, "starttime", "endtime", "norm_rate", "intime", "_infused")
    b = I.totals_before(rated.filter("norm_rate is null"), base, KEY, "starttime", "tev", "intime", "_bolus")
    c = I.totals_before(outputs, base, KEY, "at", "value", "intime", "opening_output")
    out = a.join(b.select("stay", "_bolus"), "stay").join(c.select("stay", "opening_output"), "stay")
    return out.select("stay", (F.col("_infused") + F.col("_bolus")).alias("opening_input"), "opening_output")


def binned_panel(states: DataFrame, stays: DataFrame, fluids: DataFrame, vaso: DataFrame, drugs: DataFrame,
                 outputs: DataFrame, classes: Sequence[str], width: int = 4 * 3600) -> DataFrame:
    """Occupied bins with mean states, interventions, running balance and attributes.

    Every table is unique per (stay, bin) and laid out that way by its own
    aggregation, so the joins below add no shuffle of their own.
    """
    fields = [c for c in states.columns if c not in ("stay", "at")]
    bins = A.means(I.points_to_bins(states, stays, KEY, "at", "intime", "outtime", width), BIN, fields)
    zero = {"infused": 0.0, "bolus": 0.0, "output_step": 0.0, **{f"{c}_active": 0 for c in classes}}
    tables = interventions(stays, fluids, vaso, drugs, outputs, classes, width)
    out = J.enrich(bins, [(x, BIN, {c: zero[c] for c in x.columns if c in zero}) for x in tables])
    out = J.enrich(out, [(openings(stays, fluids, outputs), KEY, {"opening_input": 0.0, "opening_output": 0.0})])
    out = out.withColumn("input_step", F.col("infused") + F.col("bolus"))
    out = I.running_balance(out, KEY, "bin", "input_step", "output_step", "opening_input", "opening_output")
    out = out.withColumnsRenamed({"gain_total": "input_total", "loss_total": "output_total", "balance": "cumulated_balance"})
    return out.join(stays, "stay").drop("infused", "bolus", "opening_input", "opening_output")


def dataset(panel: DataFrame) -> DataFrame:
    """Dose defaults, outlier stays removed, doses in quartile levels.

    The panel is written once: outliers, both quartile passes and the result
    read it.
    """
    panel = durable(panel)
    out = C.defaults_filled(panel, {"median_dose_vaso": 0.0, "max_dose_vaso": 0.0})
    limits = {"output_step": fixed.OUTPUT_STEP_MAX, "total_bili": fixed.BILIRUBIN_MAX, "input_step": fixed.INPUT_STEP_MAX}
    out = J.without_keys(out, C.outlier_keys(out, KEY, limits), KEY)
    for source, name in (("max_dose_vaso", "vasopressor_dose"), ("input_step", "ivfluid_dose")):
        cuts = A.exact_quantiles(out.filter(F.col(source) > 0), [], source, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
        out = A.with_single_row(out, cuts).withColumn(name, S.quartile_level(source, "q1", "q2", "q3")).drop("q1", "q2", "q3")
    return out


def final_features(panel: DataFrame, fields: Sequence[str], groups: int | None = None, hours: int = 4, nearest: int = 5) -> DataFrame:
    """Gap interpolation for columns with few gaps, fill from the nearest rows, ratios and scores.

    With ``groups``, means of so many clusters take the place of the nearest rows.
    """
    from episodia.operators.models import imputed_from_similar
    from episodia.operators.neighbours import filled_from_nearest

    rows = panel.count()
    nulls = {r["column_name"]: r["n_null"] for r in A.null_counts(panel, fields).collect()}
    few = [c for c in fields if 0 < nulls[c] < 0.05 * rows]
    out = W.interpolated(panel, KEY, "bin", few) if few else panel
    out = imputed_from_similar(out, fields, groups) if groups else filled_from_nearest(out, fields, nearest)
    w = W.panel_window(KEY, ["bin"]).rowsBetween(-(24 // hours - 1), 0)
    out = out.withColumn("_urine_day", F.sum("output_step").over(w))
    out = out.withColumns({"pao2_fio2": S.oxygen_ratio("pao2", "fio2_1"), "shock_index": S.shock_index("hr", "sysbp")})
    return out.withColumns({
        "sofa": S.organ_failure_score("pao2_fio2", "mechvent", "platelets", "total_bili", "meanbp", "max_dose_vaso", "gcs", "creatinine", "_urine_day"),
        "sirs": S.inflammation_score("temp_c", "hr", "rr", "paco2", "wbc"),
    }).drop("_urine_day")
