"""Hourly rows to one-step transitions with labels and actions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodia.functions.scalars import composite_key, label_of_flags, number_or_null
from episodia.operators.quality import require_columns, with_provenance
from episodia.operators.scan import Following, RowIndex, Total, ordered
from episodia.operators.sequences import jump_label

FLAGS = ["a_t_vaso", "a_t_vent", "a_t_crrt"]
STATES = ["sofa", "mbp", "heart_rate", "resp_rate", "spo2", "gcs", "urine_output_rate", "oxygen_delivery",
          "creatinine", "bun", "age", "charlson"]


def hourly_transitions(
    hourly: DataFrame, labels: Mapping[tuple, str], states: Sequence[str] = STATES, threshold: float = 2,
    jump: str = "sofa", provenance: Mapping[str, str] | None = None, rows_per_task: int | None = None,
) -> DataFrame:
    """One row per hour with next states, jump label, end flag and action label.

    Rows without ids, hour or end time are dropped; text numbers are coerced.
    All window columns come from one ordered pass per stay.
    """
    ids = ["subject_id", "hadm_id", "stay_id", "hr"]
    now = [f"s_t_{s}" for s in states]
    require_columns(hourly, [*ids, "starttime", "endtime", *now, *FLAGS])
    rows = hourly.withColumns({c: number_or_null(c).cast("long") for c in ids})
    rows = rows.dropna(subset=[*ids, "endtime"]).withColumns({
        **{c: number_or_null(c) for c in now},
        **{c: F.least(F.greatest(F.coalesce(number_or_null(c), F.lit(0.0)).cast("int"), F.lit(0)), F.lit(1)) for c in FLAGS},
    })
    following = F.struct(F.lit(1).alias("there"), *[F.col(c) for c in now])
    out = ordered(rows, ["stay_id"], ["hr", "starttime"], {
        "_next": Following(following), "episode_step": RowIndex(),
        "index_admittime": Total("starttime", "min"), "index_dischtime": Total("endtime", "max"),
    }, rows_per_task=rows_per_task)
    out = out.withColumns({f"s_t1_{s}": F.col(f"_next.s_t_{s}") for s in states})
    out = out.withColumns({
        "y_t1": jump_label(f"s_t_{jump}", f"s_t1_{jump}", threshold), "done": F.col("_next").isNull().cast("int"),
        "a_t": label_of_flags(FLAGS, labels), "transition_id": composite_key("stay_id", "hr"),
        "episode_id": F.col("stay_id").cast("string"), "patient_id": F.col("subject_id"), "index_hadm_id": F.col("hadm_id"),
        "split": F.col("split") if "split" in hourly.columns else F.lit("train"),
    }).withColumnRenamed("hr", "t")
    named = {"a_t_source": "treatments", "a_t_raw_discharge_location": "N/A", "sample_tag": "full", **(provenance or {})}
    order = [
        "episode_id", "episode_step", "transition_id", "patient_id", "index_hadm_id", "t", "index_admittime", "index_dischtime",
        "y_t1", "done", "a_t", *FLAGS, "a_t_source", "a_t_raw_discharge_location", *now, *[f"s_t1_{s}" for s in states], "split",
        *[n for n in named if n not in ("a_t_source", "a_t_raw_discharge_location")],
    ]
    return with_provenance(out, named).select(*order)
