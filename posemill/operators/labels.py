"""Training labels: one rater's rows with confidence weights, overridden by expert rows for the participants they rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posemill.functions.geometry import window_center
from posemill.functions.scalars import confidence_weight, floating_outcome
from posemill.operators.joins import inside_or_all

EXPERT_WEIGHT = 5.0


def usable(labels: DataFrame, flag: str = "exclude") -> DataFrame:
    """Rows that are not excluded; a NULL flag doesn't exclude."""
    return labels.filter(F.coalesce(F.col(flag).try_cast("int"), F.lit(0)) == 0)


def rater_labels(labels: DataFrame) -> DataFrame:
    """source, participant, seg_id, start_s, end_s, floating_outcome, label_source, sample_weight, exclude."""
    rows = usable(labels)
    return rows.select("source", "participant", "seg_id", "start_s", "end_s", floating_outcome(F.col("float_label"), F.col("passive_active")).alias("floating_outcome"),
                       F.lit("mine").alias("label_source"), confidence_weight(F.col("label_confidence")).alias("sample_weight"), F.lit(0).alias("exclude"))


def expert_labels(expert: DataFrame, windows: DataFrame, first: float = 30.0, last: float = 60.0) -> DataFrame:
    """A label for every window of an expert's participant whose centre lies in the rated stretch, or for all its
    windows if none does. expert: participant, floating_outcome, window_start, window_end (NULL: the usual stretch)."""
    rated = expert.filter(F.col("floating_outcome").isNotNull()).select("participant", "floating_outcome", F.coalesce("window_start", F.lit(first)).alias("_a"), F.coalesce("window_end", F.lit(last)).alias("_b"))
    joined = windows.join(rated, "participant")
    centre = window_center(F.col("start_s"), F.col("end_s"))
    chosen = inside_or_all(joined, ["participant"], (centre >= F.col("_a")) & (centre < F.col("_b")))
    return chosen.select("source", "participant", F.col("start_s").cast("int").alias("seg_id"), "start_s", "end_s", "floating_outcome",
                         F.lit("expert").alias("label_source"), F.lit(EXPERT_WEIGHT).alias("sample_weight"), F.lit(0).alias("exclude"))


def fused_labels(mine: DataFrame, expert: DataFrame) -> DataFrame:
    """Expert rows, and the rater's rows of all other participants."""
    return mine.join(expert.select("participant").distinct(), "participant", "left_anti").unionByName(expert, allowMissingColumns=True)
