"""Reports: one row a video with its assessment or abstention, one row a file with the assessment by criterion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posemill.functions import scalars as X
from posemill.functions.geometry import symmetry_index
from posemill.functions.nulls import ensure_columns, holds, mean_present
from posemill.operators.learn import Fitted, mean_shares

#: Names of the classes in reports, and of the criteria's classes.
NAMES = ("NOT FLOATING", "ALMOST FLOATING", "FLOATING")
TRUNK = ("vertical", "diagonal", "horizontal")
ACTIVITY = ("tense", "neutral", "relaxed")
OUTCOME = ("cannot float", "floats with lots of effort", "floats with effort", "floats with no effort")
CRITERIA = {"floating_outcome": OUTCOME, "trunk": TRUNK, "activity": ACTIVITY}
UNABLE = "UNABLE TO ASSESS"
_MEASURES = ("trunk_angle_med", "trunk_angle_std", "hip_y_slope", "arm_speed_l", "arm_speed_r", "leg_speed_l", "leg_speed_r")


def video_reports(windows: DataFrame, video: str = "source", mode: str = "rule-based", min_valid: float = 60.0) -> DataFrame:
    """One row a video: classification, reason (of an abstention), mode, confidence_pct, fractions, pose quality, what the
    medians of its reliable windows say, and text, the report as lines.

    windows: valid_pct, start_s, float_pred, confidence (NULL: unknown) and the measures of the table of windows; measures
    that are no columns count as missing. Windows below min_valid don't count. Fewer than 40 % reliable ones: no
    assessment. The class is the most frequent one (ties: the smallest) of the middle 80 % of the reliable windows, or of
    all below ten; a mean confidence below 0.55 marks it as uncertain. One exchange by video.
    """
    rows = ensure_columns(windows, {**dict.fromkeys(_MEASURES, "double"), "confidence": "double"})
    rows = rows.withColumn("_ok", holds(F.col("valid_pct") >= min_valid))
    own = W.partitionBy(video, "_ok")
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(own), "_i": F.row_number().over(own.orderBy("start_s")) - 1})
    inside = (F.col("_n") < 10) | ((F.col("_i") >= F.floor(F.col("_n") * 0.1)) & (F.col("_i") < F.floor(F.col("_n") * 0.9)))
    of = lambda c, when: F.when(when, F.col(c))
    ok, mid = F.col("_ok"), F.col("_ok") & inside
    found = rows.groupBy(video).agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(ok, 1)).alias("n"), F.bround(F.avg(of("valid_pct", ok)), 1).alias("pose"), F.mode(of("float_pred", mid), True).alias("verdict"),
        F.avg(of("confidence", mid)).alias("conf"), *[F.avg(F.when(mid, (F.col("float_pred") == k).cast("double"))).alias(f"f{k}") for k in range(3)], *[F.median(of(c, ok)).alias(c) for c in _MEASURES])
    reliable = F.col("n") / F.col("total")
    poor = X.abstention(F.col("n"), F.col("total"), F.lit(1.0)) == "UNABLE"
    name = F.get(F.array(*map(F.lit, NAMES)), F.col("verdict").cast("int"))
    arm, leg = mean_present(F.col("arm_speed_l"), F.col("arm_speed_r")), mean_present(F.col("leg_speed_l"), F.col("leg_speed_r"))
    told = lambda c: F.when(~poor, c)
    out = found.select(
        F.col(video).alias("video"), told(F.lit(mode)).alias("mode"),
        F.when(poor, UNABLE).when(F.col("conf") < 0.55, F.concat(F.lit("UNCERTAIN ("), F.initcap(F.lower(name)), F.lit(")"))).otherwise(name).alias("classification"),
        F.when(poor, F.concat(F.lit("pose visibility too low ("), _percent(reliable), F.lit(" of windows reliable)"))).alias("reason"),
        told(F.bround(100 * F.col("conf"), 0)).alias("confidence_pct"), *[told(F.bround(F.coalesce(f"f{k}", F.lit(0.0)), 3)).alias(f"fraction_{n}") for k, n in ((2, "floating"), (1, "almost"), (0, "not"))],
        F.col("pose").alias("pose_quality_pct"), told(X.posture_band(F.col("trunk_angle_med"))).alias("posture"), told(F.bround("trunk_angle_med", 1)).alias("trunk_angle_deg"),
        told(X.stability_band(F.col("trunk_angle_std"))).alias("stability"), told(F.bround("trunk_angle_std", 1)).alias("trunk_variation_deg"), told(X.drift_sign(F.col("hip_y_slope"))).alias("vertical_movement"),
        told(F.bround("hip_y_slope", 3)).alias("body_drift"), told(X.activity_band(arm)).alias("arm_activity"), told(X.activity_band(leg)).alias("leg_activity"),
        told(X.symmetry_label(symmetry_index(F.col("leg_speed_l"), F.col("leg_speed_r")))).alias("symmetry"), F.col("total").alias("windows_total"), F.col("n").alias("windows_reliable"))
    return out.withColumn("text", _text())


def _percent(share: Column) -> Column:
    return F.concat(F.bround(100 * share, 0).cast("int"), F.lit("%"))


def _text() -> Column:
    line = lambda label, *parts: F.concat(F.lit(f"{label}: "), *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    share = lambda c: _percent(F.col(f"fraction_{c}"))
    lines = [
        F.concat(F.lit("Video: "), "video", F.lit(" ["), "mode", F.lit("]")), line("Classification", F.col("classification")),
        F.when(F.col("confidence_pct").isNotNull(), line("Confidence", F.col("confidence_pct").cast("int"), "%")),
        line("Mix", "floating ", share("floating"), " / almost ", share("almost"), " / not ", share("not")), line("Posture", F.col("posture"), " (trunk ", shown("trunk_angle_deg"), "°)"),
        line("Stability", F.col("stability"), " (variation ±", shown("trunk_variation_deg"), "°)"), line("Vertical move", F.col("vertical_movement"), " (drift ", shown("body_drift"), " /s)"),
        line("Arm activity", F.col("arm_activity")), line("Leg activity", F.col("leg_activity")), line("Symmetry", F.col("symmetry")), line("Pose quality", shown("pose_quality_pct"), "% valid")]
    whole = F.concat_ws("\n", *lines)
    return F.when(F.col("reason").isNotNull(), F.concat("video", F.lit(": "), "classification", F.lit(" - "), "reason")).otherwise(whole)


def assessments(windows: DataFrame, models: dict[str, Fitted], key: str = "source", min_valid: float = 60.0) -> DataFrame:
    """One row for each key with reliable windows: n_windows, and for each criterion (a name of CRITERIA, or any) its class
    by mean share, <criterion>_label and <criterion>_conf."""
    rows = windows.filter(F.col("valid_pct") >= min_valid) if "valid_pct" in windows.columns else windows
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_windows"))
    for criterion, model in models.items():
        said = mean_shares(model.predict(rows), [key], "proba", model.model.classes)
        label = X.class_name(F.col(criterion), CRITERIA[criterion]) if criterion in CRITERIA else F.col(criterion).cast("string")
        said = said.withColumnRenamed("pred", criterion).withColumns({f"{criterion}_label": label, f"{criterion}_conf": F.bround("confidence", 3)}).drop("confidence")
        out = out.join(said, key)
    return out
