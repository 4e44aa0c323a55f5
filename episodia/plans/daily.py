"""Daily hospital panel: one row per admission and calendar day.

Inputs are DataFrames.  The plan has three parts, so that wide rows are shuffled
only once:

1. admission-level columns join before an admission is spread over its days;
2. every source is reduced to one row per (admission, day);
3. the days and the rows of all sources are stacked and read in order of date, so
   one layout by admission serves what a day has, forward fills, latches and the
   last unit and service.

A very busy admission costs no more than its days.

Expected columns

* admissions: hadm_id, subject_id, admittime, dischtime, hospital_expire_flag,
  admission_type, admission_location
* patients: subject_id, gender, anchor_age, anchor_year
* severity: hadm_id, drg_type, drg_severity, drg_mortality
* comorbidity: hadm_id, charlson_score
* transfers: hadm_id, transfer_id, careunit, eventtype, intime, outtime
* services: hadm_id, service_id, curr_service, transfertime
* labs: hadm_id, itemid, charttime, valuenum
* cultures: hadm_id, charttime, chartdate, org_name, spec_type_desc
* prescriptions: hadm_id, drug, drug_type, starttime, stoptime
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodia.functions import fixed_values as fixed
from episodia.functions import scalars as S
from episodia.operators import aggregates as A
from episodia.operators import intervals as I
from episodia.operators import joins as J
from episodia.operators import sequences as W
from episodia.operators.quality import coverage_report, with_provenance
from episodia.operators.sampling import early_sample, hash_split
from episodia.operators.scan import panel_window

DAY = ["hadm_id", "calendar_date"]
SCHEMA_VERSION = "daily_v1"
CLASSES = list(fixed.DRUG_PATTERNS)
# day columns that are numbers, not flags
COUNTS = ["n_labs_today"]
# Output order (fixed values).
COLUMNS = [
    "hadm_id", "subject_id", "day_of_stay", "calendar_date", "is_last_day",
    "admittime", "dischtime", "hospital_expire_flag", "age_at_admit", "gender",
    "admission_type", "admission_location", "drg_severity", "drg_mortality", "charlson_score",
    "careunit_group", "is_icu", "days_in_current_unit", "curr_service_group",
    "creatinine", "bun", "sodium", "potassium", "bicarbonate", "anion_gap", "glucose", "hemoglobin",
    "wbc", "platelets", "magnesium", "calcium", "phosphate", "inr", "bilirubin", "nlr",
    "albumin", "lactate_elevated", "n_labs_today",
    "culture_ordered_today", "positive_culture_cumulative", "blood_culture_positive_cumulative",
    "antibiotic_active", "anticoagulant_active", "diuretic_active", "steroid_active", "insulin_active", "opioid_active",
    "antibiotic_started", "antibiotic_stopped", "icu_escalation", "icu_stepdown", "discharged", "n_active_drug_classes",
    "readmit_30d", "split", "schema_version", "build_timestamp_utc",
]


def cohort(admissions: DataFrame, patients: DataFrame, min_age: int = 18) -> DataFrame:
    """Adult admissions with a known discharge on a later day."""
    people = patients.select("subject_id", "gender", "anchor_age", "anchor_year")
    joined = J.episode_frame(admissions, (people, ["subject_id"]))
    joined = joined.withColumn("age_at_admit", S.age_at("anchor_age", "anchor_year", "admittime"))
    kept = joined.filter((F.col("age_at_admit") >= min_age) & (F.to_date("dischtime") > F.to_date("admittime")))
    return kept.drop("anchor_age", "anchor_year")


# --- one row per admission and day -------------------------------------------------

def frames(kept: DataFrame) -> DataFrame:
    """First and last day of each admission."""
    return kept.select("hadm_id", F.to_date("admittime").alias("_first"), F.to_date("dischtime").alias("_last"))


def daily_locations(transfers: DataFrame, frame: DataFrame) -> DataFrame:
    """Per day: the unit that contains it, and the last unit that began on it.

    Stretches are cut to the admission first; what began earlier counts as
    begun on the first day.  The latest start wins, then the id.
    """
    rows = transfers.filter("hadm_id is not null and eventtype != 'discharge'").select(
        "hadm_id", "careunit", F.struct("intime", "transfer_id").alias("_rank"), F.to_date("intime").alias("_in"),
        F.to_date(F.coalesce("outtime", F.col("intime") + F.expr("interval 1 day"))).alias("_out"),
    ).join(frame, "hadm_id").filter("_in <= _last")
    begun = F.greatest("_in", "_first")
    stop = F.least("_out", F.date_add("_last", 1))
    unit = F.struct("_in", S.care_unit_group("careunit").alias("careunit_group"))
    spread = rows.select("hadm_id", "_rank", unit.alias("_unit"), F.inline(F.concat(
        F.array(F.struct(begun.alias("calendar_date"), F.lit(False).alias("_in_it"))),
        F.transform(F.when(stop > begun, F.sequence(begun, F.date_sub(stop, 1))).otherwise(F.array().cast("array<date>")),
                    lambda d: F.struct(d.alias("calendar_date"), F.lit(True).alias("_in_it"))),
    )))
    return spread.groupBy(*DAY).agg(
        F.max_by("_unit", F.when(F.col("_in_it"), F.col("_rank"))).alias("_inside"),
        F.max_by("_unit", F.when(~F.col("_in_it"), F.col("_rank"))).alias("_began"),
    )


def daily_services(services: DataFrame) -> DataFrame:
    """Last service that began on the day."""
    rows = services.withColumn("calendar_date", F.to_date("transfertime"))
    return rows.groupBy(*DAY).agg(F.max_by(F.struct(S.code_group("curr_service", fixed.SERVICE_GROUPS).alias("curr_service_group")), F.struct("transfertime", "service_id")).alias("_service"))


def daily_labs(labs: DataFrame, items: Mapping[int, str] = fixed.DAILY_LAB_ITEMS) -> DataFrame:
    """Daily means per item, ratio, lactate flag and the number of items."""
    known = labs.filter(F.col("hadm_id").isNotNull() & F.col("valuenum").isNotNull())
    wide = A.mean_wide(known.withColumn("calendar_date", F.to_date("charttime")), DAY, "itemid", "valuenum", items)
    names = list(items.values())
    # an item was drawn exactly where its mean is known
    return wide.withColumns({
        "n_labs_today": S.active_count([F.col(c).isNotNull().cast("int") for c in names]),
        "nlr": S.capped_ratio("neutrophils", "lymphocytes"), "lactate_elevated": S.above("lactate_raw", fixed.LACTATE_THRESHOLD),
    }).drop("neutrophils", "lymphocytes", "lactate_raw")


def daily_cultures(cultures: DataFrame) -> DataFrame:
    rows = cultures.filter("hadm_id is not null").withColumn("calendar_date", F.to_date(F.coalesce("charttime", "chartdate")))
    grown = F.col("org_name").isNotNull()
    flags = A.flags_by_group(rows, DAY, {"_pos": grown, "_blood": grown & (F.col("spec_type_desc") == "BLOOD CULTURE")})
    return flags.withColumn("culture_ordered_today", F.lit(1))


def daily_prescriptions(prescriptions: DataFrame) -> DataFrame:
    """Active classes per day (end excluded) and antibiotic start and stop days.

    Names repeat far more often than they differ, so each distinct name is
    classified once.
    """
    rx = prescriptions.filter("hadm_id is not null and drug_type = 'MAIN' and starttime is not null and drug is not null")
    named = rx.select("drug").distinct().select("drug", *[S.pattern_flag("drug", p).alias(c) for c, p in fixed.DRUG_PATTERNS.items()])
    rx = rx.select("hadm_id", "drug", F.to_date("starttime").alias("_from"), F.to_date("stoptime").alias("_to")).join(named, "drug").filter(S.active_count(CLASSES) > 0)
    rx = rx.withColumn("_to", F.coalesce("_to", F.date_add("_from", 1)))

    def mark(day, active, started, stopped):
        return F.struct(day.alias("calendar_date"), F.lit(active).alias("_on"), F.lit(started).alias("_a"), F.lit(stopped).alias("_z"))

    days = F.when(F.col("_to") > F.col("_from"), F.sequence("_from", F.date_sub("_to", 1))).otherwise(F.array().cast("array<date>"))
    edges = F.when(F.col("antibiotic") == 1, F.array(mark(F.col("_from"), 0, 1, 0), mark(F.col("_to"), 0, 0, 1))).otherwise(F.array())
    spread = rx.select("hadm_id", *CLASSES, F.inline(F.concat(F.transform(days, lambda d: mark(d, 1, 0, 0)), edges)))
    return spread.groupBy(*DAY).agg(
        *[F.max(F.col(c) * F.col("_on")).alias(f"{c}_active") for c in CLASSES],
        F.max("_a").alias("antibiotic_started"), F.max("_z").alias("antibiotic_stopped"))


def daily_care_changes(transfers: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Escalation to and step-down from intensive care, and discharge, per day."""
    rows = transfers.filter("hadm_id is not null").select(
        "hadm_id", F.to_date("intime").alias("calendar_date"), "intime", "transfer_id", "eventtype",
        F.coalesce((S.care_unit_group("careunit") == "icu").cast("int"), F.lit(0)).alias("_icu"))
    moves = W.entries_and_exits(rows.filter("eventtype != 'discharge'"), ["hadm_id"], ["intime", "transfer_id"], "_icu",
                                "icu_escalation", "icu_stepdown", rows_per_task)
    ends = rows.filter("eventtype = 'discharge'").select(*DAY, F.lit(0).alias("icu_escalation"), F.lit(0).alias("icu_stepdown"), F.lit(1).alias("discharged"))
    both = moves.select(*DAY, "icu_escalation", "icu_stepdown", F.lit(0).alias("discharged")).unionByName(ends)
    names = ["icu_escalation", "icu_stepdown", "discharged"]
    return both.groupBy(*DAY).agg(*[F.max(c).alias(c) for c in names])


# --- windows -------------------------------------------------------------------------

def with_windows(days: DataFrame, facts: Mapping[str, tuple[DataFrame, Mapping[str, object]]],
                 limits: Mapping[str, int] = fixed.FILL_LIMITS) -> DataFrame:
    """All columns that depend on the day, over one layout by admission.

    ``facts`` holds for each source its rows per (admission, day) and the defaults
    of days without.  They are not joined: a day's row comes after the facts up to
    its date, and a running frame remembers the last fact of each kind with its date.
    """
    w = panel_window(["hadm_id"], ["calendar_date", "_asked"])
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = J.stacked(days, {name: table for name, (table, _) in facts.items()}, DAY, "_stay", "_asked").withColumn("day_of_stay", F.col("_stay.day_of_stay"))
    fills = {c: limits[tier] for tier, cols in fixed.DAILY_TIERS.items() for c in cols if c in facts["_labs"][0].columns}
    day = F.col("calendar_date")
    last = lambda value: F.last(value, ignorenulls=True).over(so_far)
    # rows are in order of date, so the last date is the largest
    last_day = lambda test: F.max(F.when(test, day)).over(so_far)
    # few single values, since a frame writes all it remembers with every row: the 0/1 columns of a source are bits of one
    flags = {name: [c for c in defaults if c not in COUNTS] for name, (_, defaults) in facts.items()}
    bits = lambda name: reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.coalesce(f"{name}.{c}", F.lit(0)), i) for i, c in enumerate(flags[name])])
    rows = rows.withColumns({
        **{f"_at{name}": last_day(F.col(name).isNotNull()) for name in facts},
        **{f"_bits{name}": last(F.when(F.col(name).isNotNull(), bits(name))) for name in facts if flags[name]},
        **{c: last(F.col(f"{name}.{c}")) for name, (_, defaults) in facts.items() for c in defaults if c in COUNTS},
        **{c: last(F.col(f"_labs.{c}")) for c in fills}, **{f"_at_{c}": last_day(F.col(f"_labs.{c}").isNotNull()) for c in fills},
        **{f"_at{c}": last_day(F.col(f"_cultures.{c}") == 1) for c in ("_pos", "_blood")},
        "_inside": last(F.col("_locations._inside")), "_at_inside": last_day(F.col("_locations._inside").isNotNull()),
        "_began": last(F.col("_locations._began")), "_service": last(F.col("_services._service")),
    }).filter("_asked")
    # days are dense, so dates count rows; values from before the first day are not the stay's
    since = lambda at: F.datediff(day, at)
    group = lambda c: F.coalesce(c, F.lit("other"))
    out = rows.withColumn("_unit", F.when(F.col("_at_inside") == day, F.col("_inside")).otherwise(F.col("_began")))
    return out.select(
        *DAY, "_stay.*",
        *[F.when(F.col(f"_at{name}") == day, F.col(c) if c in COUNTS else F.getbit(f"_bits{name}", F.lit(flags[name].index(c))).cast("int")).otherwise(v).alias(c)
          for name, (_, defaults) in facts.items() for c, v in defaults.items()],
        *[F.when(since(f"_at_{c}") <= F.least(F.lit(n), "day_of_stay"), F.col(c)).alias(c) for c, n in fills.items()],
        *[F.coalesce((since(f"_at{c}") <= F.col("day_of_stay")).cast("int"), F.lit(0)).alias(name)
          for c, name in (("_pos", "positive_culture_cumulative"), ("_blood", "blood_culture_positive_cumulative"))],
        group("_unit.careunit_group").alias("careunit_group"), (group("_unit.careunit_group") == "icu").cast("int").alias("is_icu"),
        F.coalesce(S.day_count("_unit._in", "calendar_date"), F.lit(0)).alias("days_in_current_unit"),
        # a service that began before the stay still holds
        group("_service.curr_service_group").alias("curr_service_group"))


# --- admissions ------------------------------------------------------------------------

def with_admission_columns(stays: DataFrame, severity: DataFrame, comorbidity: DataFrame, admissions: DataFrame, drg_type: str = "APR") -> DataFrame:
    """Severity, comorbidity and the 30-day return of the subject."""
    top = severity.filter(F.col("drg_type") == drg_type).groupBy("hadm_id").agg(
        F.max("drg_severity").alias("drg_severity"), F.max("drg_mortality").alias("drg_mortality"))
    known = admissions.select("hadm_id", "subject_id", "admittime", "dischtime").filter("dischtime is not null")
    label = J.returned_within(known, "subject_id", "hadm_id", "admittime", "dischtime", 30).select("hadm_id", "readmit_30d")
    return J.enrich(stays, [
        (top, ["hadm_id"], {}), (comorbidity.select("hadm_id", "charlson_score"), ["hadm_id"], {}), (label, ["hadm_id"], {"readmit_30d": 0}),
    ])


def build_daily_panel(t: Mapping[str, DataFrame], built_at: str, min_age: int = 18, seed: int = 42,
                      sample: tuple[int, int] | None = None) -> DataFrame:
    """The whole panel.  ``sample`` = (episodes, seed) keeps a subject sample early."""
    kept = cohort(t["admissions"], t["patients"], min_age)
    if sample:
        kept = early_sample(kept, "subject_id", "hadm_id", *sample)
    stays = with_admission_columns(kept, t["severity"], t["comorbidity"], t["admissions"])
    stays = hash_split(stays, "subject_id", seed=seed)
    days = I.day_spine(stays, "admittime", "dischtime")
    active = [f"{c}_active" for c in CLASSES]
    zero = lambda *names: dict.fromkeys(names, 0)
    days = with_windows(days, {
        "_labs": (daily_labs(t["labs"]), zero("lactate_elevated", "n_labs_today")),
        "_cultures": (daily_cultures(t["cultures"]), zero("culture_ordered_today")),
        "_prescriptions": (daily_prescriptions(t["prescriptions"]), zero(*active, "antibiotic_started", "antibiotic_stopped")),
        "_changes": (daily_care_changes(t["transfers"]), zero("icu_escalation", "icu_stepdown", "discharged")),
        "_locations": (daily_locations(t["transfers"], frames(kept)), {}), "_services": (daily_services(t["services"]), {}),
    })
    days = days.withColumn("n_active_drug_classes", S.active_count(active))
    days = with_provenance(days, {"schema_version": SCHEMA_VERSION, "build_timestamp_utc": built_at})
    absent = coverage_report(days, COLUMNS)["absent"]
    if absent:
        raise ValueError(f"the panel lacks {absent}")
    return days.select(*COLUMNS)
