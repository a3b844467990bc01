"""From landmark frames to the table of 3-second windows: geometry, visibility, robust motion statistics and cadence.

Frames are dealt by video once; frame measures, windows and aggregates share that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posemill.functions import geometry as G
from posemill.functions.nulls import holds, mean_present, nan_to_null
from posemill.operators.signal import cadence
from posemill.operators.stats import median_slope, points
from posemill.operators.windows import centred_windows, hop_windows

#: The windows of the current feature set, and the landmarks that it reads.
WINDOW, STEP, CADENCE_WINDOW = 3.0, 1.5, 8.0
CORE = ("left_shoulder", "right_shoulder", "left_hip", "right_hip")
ARM = ("left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist")
LEG = ("left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle")
LANDMARKS = tuple(dict.fromkeys((*CORE, *ARM, *LEG, "nose")))
LIMBS = {"arm_l": ("left_wrist", "left_shoulder"), "arm_r": ("right_wrist", "right_shoulder"), "leg_l": ("left_ankle", "left_hip"), "leg_r": ("right_ankle", "right_hip")}


def frame_measures(frames: DataFrame, aspect: float = G.ASPECT) -> DataFrame:
    """One row a frame: t, validity, trunk_angle, hip_y, ankle_y, knee_angle, torso, limb vectors and confidences."""
    frames = nan_to_null(frames)
    x = lambda p: G.corrected_x(F.col(f"{p}_x"), aspect)
    y = lambda p: F.col(f"{p}_y")
    v = lambda p: F.col(f"{p}_visibility")
    mid = lambda part, c: G.midpoint(c(f"left_{part}"), c(f"right_{part}"))
    seen = lambda *ps: G.all_visible(*map(v, ps))
    core, sx, sy, hx, hy = seen(*CORE), mid("shoulder", x), mid("shoulder", y), mid("hip", x), mid("hip", y)
    knees = [G.joint_angle(x(f"{s}_hip"), y(f"{s}_hip"), x(f"{s}_knee"), y(f"{s}_knee"), x(f"{s}_ankle"), y(f"{s}_ankle")) for s in ("left", "right")]
    limbs: dict[str, Column] = {}
    for name, (far, near) in LIMBS.items():
        limbs |= {f"{name}_seen": seen(far, near), f"{name}_x": F.when(seen(far, near), x(far) - x(near)), f"{name}_y": F.when(seen(far, near), y(far) - y(near))}
    confidence = lambda ps: mean_present(*map(v, ps))
    return frames.select(
        "video_id", "participant_id", F.col("camera_view").alias("view"), F.col("time_sec").alias("t"), core.alias("core"),
        F.when(core, G.torso_length(sx, sy, hx, hy)).alias("torso"), F.when(core, G.trunk_angle(sx, sy, hx, hy)).alias("trunk_angle"), F.when(core, hy).alias("hip_y"),
        F.when(seen("left_ankle", "right_ankle"), mid("ankle", y)).alias("ankle_y"), F.when(seen(*LEG), (knees[0] + knees[1]) / 2).alias("knee_angle"),
        *[c.alias(n) for n, c in limbs.items()], confidence(CORE).alias("torso_conf"), confidence(ARM).alias("arm_conf"), confidence(LEG).alias("leg_conf"),
        holds(v("nose") < G.MIN_VISIBILITY).cast("double").alias("nose_low"))


def limb_steps(keys: list[str], limb: str, fps: Column) -> Column:
    """Speed of a limb since the frame that showed it last, if that is less than 2 / fps ago; NULL otherwise."""
    before = W.partitionBy(*keys).orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    seen = F.col(f"{limb}_seen")
    last = lambda c: F.last(F.when(seen, F.col(c)), True).over(before)
    dt = F.col("t") - last("t")
    return F.when(seen & (dt > 0) & (dt < 2 / fps), F.hypot(F.col(f"{limb}_x") - last(f"{limb}_x"), F.col(f"{limb}_y") - last(f"{limb}_y")) / dt)


def frame_rate(video: list[str], time: str, default: float = 25.0) -> tuple[Column, Column]:
    """Two steps: a frame's distance from the one before, to be added as _dt, and of these the video's frames a second."""
    dt = F.col(time) - F.lag(time).over(W.partitionBy(*video).orderBy(time))
    return dt, F.coalesce(F.try_divide(F.lit(1.0), F.median("_dt").over(W.partitionBy(*video))), F.lit(default))


#: The window's columns, in the order of the table.
_MEASURES = ("trunk_angle_med", "trunk_angle_std", "trunk_angle_slope", "hip_y_med", "hip_y_std", "hip_y_slope", "ankle_y_med")
COLUMNS = ("video_id", "participant_id", "pid", "view", "start_s", "end_s", *_MEASURES, "knee_angle_med_deg", *[f"{n[:3]}_freq{n[3:]}" for n in LIMBS], *[f"{n[:3]}_speed{n[3:]}" for n in LIMBS],
           "arm_speed", "leg_speed", "arm_asym", "leg_asym", "torso_valid_pct", "valid_pct", "left_arm_valid_pct", "right_arm_valid_pct", "left_leg_valid_pct", "right_leg_valid_pct",
           "mean_torso_conf", "mean_arm_conf", "mean_leg_conf", "nose_low_vis_frac")


def window_features(frames: DataFrame, with_cadence: bool = True) -> DataFrame:
    """One row for each admitted 3-second window of each video, in the columns of the table of windows: medians,
    deviations, slopes, speeds, cadences, validity. Frames a second are the video's own (25 where it has one frame).

    A window is admitted with at least int(1.5 * fps) frames with the core visible, and more than 40 % of its frames.
    Without cadences their columns are NULL.
    """
    measured = frame_measures(frames)
    per_video = W.partitionBy("video_id")
    dt, rate = frame_rate(["video_id"], "t")
    rows = measured.withColumn("_dt", dt).withColumns({"torso_med": F.median(F.when(F.col("core"), F.col("torso"))).over(per_video), "fps": rate}).drop("_dt")
    keys = ["video_id", "start_s"]
    hopped = hop_windows(rows, ["video_id"], "t", WINDOW, STEP).withColumns({f"{n}_step": limb_steps(keys, n, F.col("fps")) for n in LIMBS})
    share = lambda c: F.bround(100 * F.avg(F.col(c).cast("double")), 1)
    side = {"l": "left", "r": "right"}
    # The windows of the limbs, the medians and the slopes' points share one exchange by video and window.
    base = hopped.groupBy(*keys).agg(
        F.first("participant_id").alias("participant_id"), F.first("view").alias("view"), F.first("fps").alias("_fps"),
        F.sum(F.col("core").cast("int")).alias("_valid"), F.avg(F.col("core").cast("double")).alias("_share"),
        *[F.median(c).alias(f"{c}_med") for c in ("trunk_angle", "hip_y", "ankle_y")], F.median("knee_angle").alias("knee_angle_med_deg"),
        *[F.stddev_pop(c).alias(f"{c}_std") for c in ("trunk_angle", "hip_y")], *[points("t", c).alias(f"{c}_slope") for c in ("trunk_angle", "hip_y")],
        *[F.when(F.first("torso_med") > 0, F.avg(f"{n}_step") / F.first("torso_med")).alias(f"{n[:3]}_speed{n[3:]}") for n in LIMBS],
        share("core").alias("torso_valid_pct"), *[share(f"{n}_seen").alias(f"{side[n[-1]]}_{n[:3]}_valid_pct") for n in LIMBS],
        *[F.bround(F.avg(f"{c}_conf"), 3).alias(f"mean_{c}_conf") for c in ("torso", "arm", "leg")], F.bround(F.avg("nose_low"), 3).alias("nose_low_vis_frac"))
    half = F.floor(0.5 * WINDOW * F.col("_fps"))
    base = base.filter((F.col("_valid") >= half) & (F.col("_share") > 0.4))
    out = base.withColumns({f"{c}_slope": median_slope(F.col(f"{c}_slope"), F.greatest(F.lit(4), half)) for c in ("trunk_angle", "hip_y")})
    for part in ("arm", "leg"):
        left, right = F.col(f"{part}_speed_l"), F.col(f"{part}_speed_r")
        out = out.withColumns({f"{part}_speed": mean_present(left, right), f"{part}_asym": G.symmetry_index(left, right)})
    beats = {n: f"{n[:3]}_freq{n[3:]}" for n in LIMBS}
    if with_cadence:
        wide = centred_windows(rows, base.select("video_id", "start_s"), ["video_id"], "t", "start_s", WINDOW, CADENCE_WINDOW)
        told = cadence(wide, keys, "t", [f"{n}_y" for n in LIMBS], "fps", CADENCE_WINDOW)
        out = out.join(told.withColumnsRenamed({f"{n}_y_freq": name for n, name in beats.items()}), keys, "left")
    else:
        out = out.withColumns({name: F.lit(None).cast("double") for name in beats.values()})
    return out.withColumns({"start_s": F.bround("start_s", 1), "end_s": F.bround(F.col("start_s") + WINDOW, 1), "pid": F.col("participant_id"), "valid_pct": F.col("torso_valid_pct")}).select(*COLUMNS)


#: The points of the body whose movement counts.
BODY = tuple(dict.fromkeys((*ARM, *LEG)))


def body_movement(frames: DataFrame, keys: list[str], time: str, fps: float | None = None, aspect: float = G.ASPECT, bin_seconds: float = 1.0) -> DataFrame:
    """keys, bin, at, movement, average: the speed of the whole body in torso lengths a second.

    Of each two consecutive frames (0 < dt <= 2 / fps) the mean over the points visible in both of the distance moved,
    by the series' median torso length and dt. movement is the mean over the pairs of a bin (seconds since the first
    pair), at their mean time, average the mean over all pairs. Series without a torso length or a pair give no rows.
    fps: frames a second; None: each series' own.
    """
    x = lambda p: G.corrected_x(F.col(f"{p}_x"), aspect)
    y = lambda p: F.col(f"{p}_y")
    mid = lambda part, c: G.midpoint(c(f"left_{part}"), c(f"right_{part}"))
    order, whole = W.partitionBy(*keys).orderBy(time), W.partitionBy(*keys)
    torso = G.torso_length(mid("shoulder", x), mid("shoulder", y), mid("hip", x), mid("hip", y))
    dt, rate = frame_rate(keys, time)
    moved = []
    for p in BODY:
        ok = G.visible(F.col(f"{p}_visibility")) & G.visible(F.lag(f"{p}_visibility").over(order))
        moved.append(F.when(ok, F.hypot(x(p) - F.lag(x(p)).over(order), y(p) - F.lag(y(p)).over(order))))
    rows = nan_to_null(frames).select(*keys, F.col(time).alias("_t"), F.when(torso > 0, torso).alias("_torso"), dt.alias("_dt"), mean_present(*moved).alias("_moved"))
    rows = rows.withColumns({"_torso": F.median("_torso").over(whole), "_fps": F.lit(float(fps)) if fps else rate})
    pairs = rows.filter((F.col("_torso") > 0) & (F.col("_dt") > 0) & (F.col("_dt") <= 2 / F.col("_fps")) & F.col("_moved").isNotNull())
    pairs = pairs.withColumn("_m", F.col("_moved") / F.col("_torso") / F.col("_dt"))
    binned = pairs.withColumn("bin", F.floor((F.col("_t") - F.min("_t").over(whole)) / bin_seconds))
    bins = binned.groupBy(*keys, "bin").agg(F.avg("_t").alias("at"), F.avg("_m").alias("movement"), F.sum("_m").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return bins.withColumn("average", F.sum("_s").over(whole) / F.sum("_n").over(whole)).drop("_s", "_n")
