"""Fixed values.

Everything here is a constant that results depend on: word lists, bounds,
weights and thresholds.  There is no logic in this module.  Source item ids are
not listed; item dimensions are passed in as DataFrames.
"""

# Drug-name patterns per class, matched case-insensitively anywhere in the name.
DRUG_PATTERNS = {
    "antibiotic": [
        "vancomycin", "piperacillin", "ceftriaxone", "cefazolin", "cefepime",
        "meropenem", "imipenem", "azithromycin", "levofloxacin", "ciprofloxacin",
        "metronidazole", "ampicillin", "clindamycin", "doxycycline",
        "trimethoprim", "sulfamethoxazole", "linezolid", "daptomycin",
        "nitrofurantoin", "gentamicin", "tobramycin", "amikacin", "rifampin",
        "fluconazole", "micafungin", "caspofungin", "anidulafungin",
        "cephalexin", "cefdinir", "cefpodoxime", "cefuroxime",
    ],
    "anticoagulant": [
        "heparin", "enoxaparin", "warfarin", "apixaban", "rivaroxaban",
        "fondaparinux", "dabigatran", "argatroban",
    ],
    "diuretic": [
        "furosemide", "torsemide", "bumetanide", "metolazone",
        "hydrochlorothiazide", "spironolactone", "chlorothiazide", "acetazolamide",
    ],
    "steroid": [
        "methylprednisolone", "prednisone", "dexamethasone",
        "hydrocortisone", "prednisolone", "fludrocortisone",
    ],
    "insulin": ["insulin"],
    "opioid": [
        "morphine", "hydromorphone", "oxycodone", "fentanyl",
        "tramadol", "codeine", "methadone", "buprenorphine",
        "oxymorphone", "hydrocodone", "meperidine",
    ],
}

# Care-unit groups: the first rule with a matching substring wins.
UNIT_RULES = [
    ("icu", ["Intensive Care"]),
    ("ed", ["Emergency Department"]),
    ("medicine", ["Med/Surg", "Medicine"]),
    ("obstetrics", ["Labor", "Obstetric"]),
    ("oncology", ["Hematology", "Oncology"]),
    ("neurology", ["Neurology"]),
    ("psychiatry", ["Psychiatry"]),
    ("surgery", ["Surgery", "Vascular", "Transplant"]),
]
# Units that are intensive care although their name lacks the phrase above.
ICU_UNIT_NAMES = ["Coronary Care Unit (CCU)"]

# Service codes per service group.
SERVICE_GROUPS = {
    "medicine": ["MED", "CMED", "NMED", "OMED", "GU"],
    "surgery": ["SURG", "NSURG", "CSURG", "VSURG", "TSURG", "PSURG", "ORTHO", "ENT", "EYE"],
    "icu_svc": ["MICU", "SICU", "TSICU", "CSRU", "CCU"],
    "psychiatry": ["PSYCH"],
    "obstetrics": ["OBS", "GYN"],
    "trauma": ["TRAUM"],
}

# Diagnosis-code prefixes: category, weight, prefixes.  Dots are removed, since
# codes come without them.  A code is tried down to SHORTEST_PREFIX characters,
# so with the value here the two-character entries never match; set it to 2 to
# let them.
SHORTEST_PREFIX = 3
COMORBIDITY_PREFIXES = [
    ("mi", 1, ["I21", "I22", "I252"]),
    ("chf", 1, ["I50", "I110", "I130", "I132", "I42"]),
    ("pvd", 1, ["I70", "I71", "I731", "I738", "I739", "I771"]),
    ("cvd", 1, ["I60", "I61", "I62", "I63", "I64", "I65", "I66", "G45", "G46"]),
    ("dementia", 1, ["F00", "F01", "F02", "F03", "F051", "G30", "G311"]),
    ("copd", 1, ["J40", "J41", "J42", "J43", "J44", "J45", "J46", "J47", "J60",
                 "J61", "J62", "J63", "J64", "J65", "J66", "J67"]),
    ("rheumatic", 1, ["M05", "M06", "M32", "M33", "M34", "M353"]),
    ("pud", 1, ["K25", "K26", "K27", "K28"]),
    ("mild_liver", 1, ["K700", "K701", "K702", "K703", "K73", "K74"]),
    ("dm_uncomplicated", 1, ["E100", "E101", "E109", "E110", "E111", "E119",
                             "E130", "E131", "E139"]),
    ("dm_complicated", 2, ["E102", "E103", "E104", "E105", "E112", "E113",
                           "E114", "E115", "E132", "E133", "E134", "E135"]),
    ("hemiplegia", 2, ["G81", "G82", "G041"]),
    ("renal", 2, ["N03", "N05", "N18", "N19", "N250"]),
    ("cancer", 2, ["C0", "C1", "C2", "C3", "C4", "C5", "C6", "C70", "C71", "C72", "C73", "C74", "C75", "C76", "C81", "C82",
                   "C83", "C84", "C85", "C88", "C90", "C91", "C92", "C93", "C94",
                   "C95", "C96"]),
    ("severe_liver", 3, ["K72", "K766", "K767"]),
    ("metastatic", 6, ["C77", "C78", "C79", "C80"]),
    ("aids", 6, ["B20", "B21", "B22", "B24"]),
]

# Weights of the flag-based comorbidity score.
COMORBIDITY_WEIGHTS = {
    "mi": 1, "chf": 1, "pvd": 1, "cvd": 1, "dementia": 1, "copd": 1, "rheum": 1,
    "pud": 1, "mild_liver": 1, "dm_no_cc": 1, "dm_cc": 2, "hemiplegia": 2,
    "renal": 2, "malign": 2, "sev_liver": 3, "metastatic": 6, "hiv": 6,
}

# Oxygen-device text to code.
DEVICE_CODES = [
    (0, ["none"]),
    (1, ["ventilator"]),
    (2, ["cannula", "nasal cannula", "high flow nasal cannula"]),
    (3, ["face tent"]),
    (4, ["aerosol-cool"]),
    (5, ["trach mask"]),
    (6, ["hi flow neb"]),
    (7, ["non-rebreather"]),
    (8, [""]),
    (9, ["venti mask"]),
    (10, ["medium conc mask"]),
]

# Oxygen flow (l/min, at most) to inspired oxygen percentage, by device.
FLOW_CANNULA = [(1, 24), (2, 28), (3, 32), (4, 36), (5, 40), (6, 44), (8, 50),
                (10, 55), (12, 62), (15, 70)]
FLOW_MASK = [(4, 36), (6, 40), (8, 58), (10, 66), (12, 69), (15, 75)]
FLOW_NON_REBREATHER = [(6, 60), (8, 70), (9.99, 80)]
# Oxygen flow (l/min, at least).
FLOW_NON_REBREATHER_HIGH = [(10, 90), (15, 100)]
ROOM_AIR_PERCENT = 21
CANNULA_DEVICES = [0, 2]
MASK_DEVICES = [1, 3, 4, 5, 6, 9, 10]
NON_REBREATHER_DEVICE = 7

# Physiological bounds; values outside become null.
BOUNDS = {
    "height": (50, 250), "weight": (0.5, 300),
    "gcs_eye": (1, 4), "gcs_verbal": (1, 5), "gcs_motor": (1, 6), "gcs": (3, 15),
    "rass": (-5, 4), "hr": (0, 250), "sysbp": (0, 300), "meanbp": (0, 200),
    "diabp": (0, 200), "nibp_dia": (0, 200), "art_sys": (0, 300), "art_dia": (0, 200),
    "rr": (0, 80), "rr_spont": (0, 80), "rr_total": (0, 80), "spo2": (0, 100),
    "temp_c": (25, 45), "temp_f": (77, 113), "pain_level": (0, 10),
    "cvp": (-20, 40), "papsys": (5, 120), "papmean": (5, 80), "papdia": (0, 60),
    "ci": (0.5, 10), "svr": (100, 4000),
    "fio2_100": (20, 100), "fio2_1": (0.2, 1.0), "o2flow": (0, 70), "peep": (0, 40),
    "tidalvolume": (0, 1800), "tidal_observed": (0, 1800), "minuteventil": (0, 50),
    "pawmean": (0, 50), "pawpeak": (0, 80), "pawplateau": (0, 60),
    "potassium": (1, 12), "sodium": (95, 178), "chloride": (70, 150),
    "glucose": (1, 1000), "bun": (1, 300), "creatinine": (0.1, 50),
    "magnesium": (0.5, 10), "calcium": (4, 20), "ionised_ca": (0.2, 5),
    "co2": (5, 60), "phosphate": (0.5, 15), "anion_gap": (0, 40),
    "sgot": (0, 10000), "sgpt": (0, 10000), "total_bili": (0, 100),
    "direct_bili": (0, 70), "total_protein": (1, 15), "albumin": (0.5, 7),
    "troponin": (0, 100), "crp": (0, 500), "alk_phos": (0, 5000), "ldh": (0, 10000),
    "fibrinogen": (50, 1000),
    "hb": (1, 25), "ht": (5, 70), "rbc": (0.5, 10), "wbc": (0, 500),
    "platelets": (1, 2000), "neuts_pct": (0, 100), "lymphs_pct": (0, 100),
    "monos_pct": (0, 100), "eos_pct": (0, 100), "basos_pct": (0, 100),
    "ptt": (10, 200), "pt": (7, 200), "act": (50, 600), "inr": (0.5, 25),
    "arterial_ph": (6.7, 7.8), "pao2": (10, 700), "paco2": (5, 200),
    "arterial_be": (-50, 40), "lactate": (0.1, 30), "hco3": (2, 55),
    "etco2": (0, 100), "svo2": (0, 100),
}
SENTINEL_ABOVE = 10_000

# Hours a charted value may be held; laboratory values 28 h, blood gas 8 h.
HOLD_HOURS = {
    "height": 168, "weight": 72, "gcs_eye": 6, "gcs_verbal": 6, "gcs_motor": 6,
    "rass": 6, "hr": 2, "sysbp": 2, "meanbp": 2, "diabp": 2, "nibp_dia": 2,
    "art_sys": 2, "art_dia": 2, "rr": 2, "rr_spont": 2, "rr_total": 2, "spo2": 2,
    "temp_c": 6, "temp_f": 6, "cvp": 2, "papsys": 2, "papmean": 2, "papdia": 2,
    "ci": 2, "svr": 2, "interface": 24, "fio2_100": 12, "fio2_1": 12, "o2flow": 12,
    "peep": 6, "tidalvolume": 6, "tidal_observed": 6, "minuteventil": 6,
    "pawmean": 6, "pawpeak": 6, "pawplateau": 6, "pain_level": 8, "cam_icu": 4,
    "gcs": 6, "mechvent": 6, "extubated": 6,
    "arterial_ph": 8, "pao2": 8, "paco2": 8, "arterial_be": 8, "lactate": 8,
    "hco3": 8, "etco2": 8,
}
LAB_HOLD_HOURS = 28

# Weight-normalised vasopressor rate: multiplier per rate/weight, by item.
VASO_FACTORS = {
    221906: 0.0833333, 221289: 0.0833333, 221749: 0.0833333,
    222315: 5 * 0.0833333, 221662: 0.0166667,
}

# Row limits of the daily forward fill, by tier.
FILL_LIMITS = {"tier1": 2, "tier2": 3, "albumin": 5}
DAILY_TIERS = {
    "tier1": ["creatinine", "bun", "sodium", "potassium", "bicarbonate", "anion_gap",
              "glucose", "hemoglobin", "wbc", "platelets", "magnesium", "calcium",
              "phosphate"],
    "tier2": ["inr", "bilirubin", "nlr"],
    "albumin": ["albumin"],
}
DAILY_LAB_ITEMS = {
    50912: "creatinine", 51006: "bun", 50983: "sodium", 50971: "potassium",
    50882: "bicarbonate", 50868: "anion_gap", 50931: "glucose", 51222: "hemoglobin",
    51301: "wbc", 51265: "platelets", 50960: "magnesium", 50893: "calcium",
    50970: "phosphate", 51237: "inr", 50885: "bilirubin", 51244: "lymphocytes",
    51256: "neutrophils", 50862: "albumin", 50813: "lactate_raw",
}
RATIO_CAP = 50
LACTATE_THRESHOLD = 2.0

# Treatment, outcome and expected direction of the effect.
EXPECTED_DIRECTIONS = [
    ("insulin_active", "glucose", "down"),
    ("antibiotic_active", "wbc", "down"),
    ("antibiotic_active", "positive_culture_cumulative", "down"),
    ("diuretic_active", "bun", "up"),
    ("diuretic_active", "potassium", "down"),
    ("diuretic_active", "sodium", "up"),
    ("steroid_active", "glucose", "up"),
    ("steroid_active", "wbc", "up"),
    ("anticoagulant_active", "inr", "up"),
]

# Severity index on z-scores: hinge weights and the absolute term.
SEVERITY_POSITIVE = {"bun": 0.24, "creatinine": 0.24, "phosphate": 0.10, "hr": 0.09}
SEVERITY_NEGATIVE = {"hb": 0.28}
SEVERITY_ABSOLUTE = {"chloride": 0.05}

# Replay table: action flags in bit order, their source columns, clip bounds.
REPLAY_ACTIONS = ["vasopressor_b", "ivfluid_b", "antibiotic_b", "diuretic_b", "mechvent_b"]
REPLAY_SOURCES = {
    "vasopressor_b": "vasopressor_dose", "ivfluid_b": "ivfluid_dose",
    "antibiotic_b": "antibiotic_active", "diuretic_b": "diuretic_active",
    "mechvent_b": "mechvent",
}
REPLAY_DYNAMIC = {
    "hb": (1, 25), "bun": (1, 200), "creatinine": (0.1, 25), "phosphate": (0.1, 20),
    "hr": (15, 300), "chloride": (70, 150),
}
REPLAY_STATIC = {"age": (18, 100), "charlson_score": (0, 37), "prior_ed_visits_6m": (0, 20)}
REPLAY_LOG = ["bun", "creatinine"]
TERMINAL_REWARD = 15.0
Z_LIMIT = 5.0
SPLIT_SHARES = (0.70, 0.15, 0.15)

# Whole-stay outliers.
OUTPUT_STEP_MAX = 12_000
INPUT_STEP_MAX = 10_000
BILIRUBIN_MAX = 10_000

# Estimation.
PROPENSITY_CLIP = (0.01, 0.99)
OVERLAP_RANGE = (0.1, 0.9)
POOR_OVERLAP_SHARE = 0.20
DISCOUNT = 0.99
VALUE_CLIP = 40.0
MIN_PROBABILITY = 1e-6
