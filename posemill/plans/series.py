"""Queries on time series: windows, robust statistics, rules and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posemill.functions import geometry as G
from posemill.functions import scalars as X
from posemill.operators import features as feature_ops
from posemill.operators import cluster, feedback, joins, report, signal, stats, windows
from posemill.plans.base import FEATURES, FRAMES, HOPPED, features, frames, hopped, mean_of, query, r, read
from posemill.sources.writers import written_once


@query(f"""WITH {HOPPED}
SELECT user_id, start_s, count(*) AS n, round_even(median(sig), 6) AS med, round_even(stddev_pop(sig), 6) AS sd,
       round_even(avg(CASE WHEN sig IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS valid
FROM hopped GROUP BY user_id, start_s
HAVING count(sig) >= 3 AND avg(CASE WHEN sig IS NOT NULL THEN 1.0 ELSE 0.0 END) > 0.4""")
def hop_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.avg(F.col("sig").isNotNull().cast("double"))
    rows = hopped(spark, sf_dir).groupBy("user_id", "start_s").agg(
        F.count(F.lit(1)).alias("n"), r(F.median("sig")).alias("med"), r(F.stddev_pop("sig")).alias("sd"), share.alias("_share"), F.count("sig").alias("_valid"))
    return rows.filter((F.col("_valid") >= 3) & (F.col("_share") > 0.4)).select("user_id", "start_s", "n", "med", "sd", r("_share").alias("valid"))


@query(f"""WITH {HOPPED}, p AS (
  SELECT a.user_id, a.start_s, (b.sig - a.sig) / (b.t - a.t) AS s FROM hopped a JOIN hopped b
  ON a.user_id = b.user_id AND a.start_s = b.start_s AND b.t > a.t AND a.sig IS NOT NULL AND b.sig IS NOT NULL
), n AS (SELECT user_id, start_s, count(sig) AS n FROM hopped GROUP BY ALL)
SELECT n.user_id, n.start_s, round_even(CASE WHEN any_value(n.n) >= 4 THEN median(s) END, 6) AS slope
FROM n LEFT JOIN p ON n.user_id = p.user_id AND n.start_s = p.start_s GROUP BY n.user_id, n.start_s""")
def theil_sen_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.theil_sen(hopped(spark, sf_dir), ["user_id", "start_s"], "t", "sig").withColumn("slope", r("slope"))


@query(f"""WITH {FRAMES}, d AS (SELECT user_id, t - lag(t) OVER w AS dt, abs(value - lag(value) OVER w) AS dv, value FROM frames WINDOW w AS (PARTITION BY user_id ORDER BY t)
), g AS (SELECT user_id, coalesce(1 / median(dt), 25) AS fps, median(value) AS torso FROM d GROUP BY user_id)
SELECT g.user_id, round_even(any_value(fps), 6) AS fps, round_even(any_value(torso), 6) AS torso,
       round_even(CASE WHEN any_value(torso) > 0 THEN avg(dv / dt) / any_value(torso) END, 6) AS speed
FROM g LEFT JOIN d ON d.user_id = g.user_id AND d.dt > 0 AND d.dt < 2 / fps GROUP BY g.user_id""")
def global_norm_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("user_id").orderBy("t")
    d = frames(spark, sf_dir).select("user_id", "value", (F.col("t") - F.lag("t").over(order)).alias("dt"), F.abs(windows.difference("value", ["user_id"], "t")).alias("dv"))
    whole = W.partitionBy("user_id")
    d = d.withColumns({"fps": F.coalesce(1 / F.median("dt").over(whole), F.lit(25.0)), "torso": F.median("value").over(whole)})
    good = (F.col("dt") > 0) & (F.col("dt") < 2 / F.col("fps"))
    return d.groupBy("user_id").agg(r(F.first("fps")).alias("fps"), r(F.first("torso")).alias("torso"),
                                    r(F.when(F.first("torso") > 0, F.avg(F.when(good, F.col("dv") / F.col("dt"))) / F.first("torso"))).alias("speed"))


@query(f"""WITH {FRAMES}, o AS (SELECT user_id, t, sig, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n FROM frames
), g AS (
  SELECT user_id, t, sig, n, last_value(sig IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN sig IS NOT NULL THEN n END IGNORE NULLS) OVER b AS n0,
         first_value(sig IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN sig IS NOT NULL THEN n END IGNORE NULLS) OVER a AS n1
  FROM o WINDOW b AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
)
SELECT user_id, round_even(t, 6) AS t, round_even(coalesce(sig, CASE WHEN n - n0 <= 2 THEN v0 + (coalesce(v1, v0) - v0) * (n - n0) / coalesce(n1 - n0, 1) END), 6) AS filled FROM g""")
def gap_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.interpolate_gaps(frames(spark, sf_dir), ["user_id"], "t", "sig", 2).select("user_id", r("t").alias("t"), r("filled").alias("filled"))


@query(f"""WITH {FRAMES}, o AS (SELECT user_id, coalesce(sig, 0) AS v, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS p FROM frames),
b AS (SELECT unnest(range(1, 6))::INT AS bin)
SELECT user_id, bin, round_even(sum(v * cos(2 * pi() / 64 * p * bin)) ** 2 + sum(v * sin(2 * pi() / 64 * p * bin)) ** 2, 3) AS power FROM o, b GROUP BY user_id, bin""")
def dft_dominant_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).select("user_id", F.coalesce("sig", F.lit(0.0)).alias("v"), (F.row_number().over(W.partitionBy("user_id").orderBy("t")) - 1).alias("p"))
    return signal.dft_power(rows, ["user_id"], "p", "v", 64, 5).withColumn("power", r("power", 3))


@query()
def cadence_fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of one a second: the gated FFT cadence of each user's values."""
    rows = frames(spark, sf_dir).select("user_id", "t", "sig", F.sin(F.row_number().over(W.partitionBy("user_id").orderBy("t")) * 1.8).alias("wave"))
    return signal.cadence(rows, ["user_id"], "t", ["sig", "wave"], fps=4.0, seconds=8.0)


#: Where the synthetic body's points are, and how far they move.
PLACES = {"left_shoulder": (0.40, 0.50), "right_shoulder": (0.41, 0.52), "left_hip": (0.55, 0.53), "right_hip": (0.56, 0.55), "left_elbow": (0.35, 0.52), "right_elbow": (0.36, 0.54),
          "left_wrist": (0.30, 0.55), "right_wrist": (0.31, 0.57), "left_knee": (0.65, 0.56), "right_knee": (0.66, 0.58), "left_ankle": (0.75, 0.58), "right_ankle": (0.76, 0.60), "nose": (0.35, 0.48)}
MOVES = {p: 0.03 if p.endswith(("wrist", "ankle")) else 0.002 for p in PLACES}
#: user_id, t (25 frames a second), seen, and the y of each point.
LANDMARKS = FRAMES + f""", landmarks AS (
  SELECT user_id, i / 25 AS t, seen, {', '.join(f"{y} + {MOVES[p]} * sin(i / 25 * 9 + {j}) + value / 1e5 AS {p}" for j, (p, (_, y)) in enumerate(PLACES.items()))}
  FROM (SELECT user_id, value, event_type <> 'error' AS seen, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i FROM frames))"""


def synthetic_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as frames at 25 a second of a floating body whose limbs move with the values."""
    rows = frames(spark, sf_dir).withColumn("i", F.row_number().over(W.partitionBy("user_id").orderBy("t")) - 1)
    phase, seen = F.col("i") / 25 * 9, F.when(F.col("event_type") == "error", 0.2).otherwise(0.9)
    columns = []
    for j, (name, (x, y)) in enumerate(PLACES.items()):
        columns += [F.lit(x).alias(f"{name}_x"), (F.lit(y) + MOVES[name] * F.sin(phase + j) + F.col("value") / 1e5).alias(f"{name}_y"), seen.alias(f"{name}_visibility")]
    return rows.select("user_id", F.format_string("u%05d", "user_id").alias("video_id"), F.format_string("P%02d", "user_id").alias("participant_id"), F.lit("side_front").alias("camera_view"), (F.col("i") / 25).alias("time_sec"), *columns)


_MID = {c: [f"({PLACES[f'left_{p}'][0]} + {PLACES[f'right_{p}'][0]}) / 2 * 16 / 9" if c == "x" else f"(left_{p} + right_{p}) / 2" for p in ("shoulder", "hip")] for c in "xy"}
_POINTS = [p for p in PLACES if p != "nose"]


@query(f"""WITH {LANDMARKS}, l AS (
  SELECT user_id, t, t - lag(t) OVER w AS dt, seen AND lag(seen) OVER w AS seen_twice, ({' + '.join(f'abs({p} - lag({p}) OVER w)' for p in _POINTS)}) / {len(_POINTS)} AS moved,
         sqrt(({_MID['x'][0]} - {_MID['x'][1]}) ** 2 + ({_MID['y'][0]} - {_MID['y'][1]}) ** 2) AS torso FROM landmarks WINDOW w AS (PARTITION BY user_id ORDER BY t)
), m AS (SELECT *, median(torso) FILTER (WHERE torso > 0) OVER (PARTITION BY user_id) AS size FROM l
), p AS (SELECT user_id, t, moved / size / dt AS m, floor(t - min(t) OVER (PARTITION BY user_id)) AS bin FROM m WHERE seen_twice AND dt > 0 AND dt <= 2.0 / 25)
SELECT user_id, bin::BIGINT AS bin, round_even(avg(t), 6) AS at, round_even(avg(m), 6) AS movement, round_even(any_value(average), 6) AS average
FROM p JOIN (SELECT user_id, avg(m) AS average FROM p GROUP BY user_id) USING (user_id) GROUP BY user_id, bin""")
def movement_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feature_ops.body_movement(synthetic_landmarks(spark, sf_dir), ["user_id"], "time_sec", fps=25.0)
    return out.select("user_id", "bin", *[r(c).alias(c) for c in ("at", "movement", "average")])


@query()
def landmark_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of windows; the tests hold it against a plain loop over frames."""
    return feature_ops.window_features(synthetic_landmarks(spark, sf_dir))


@query(f"""WITH {HOPPED}, w AS (SELECT DISTINCT user_id, start_s FROM hopped)
SELECT w.user_id, w.start_s, count(*) AS n, round_even(avg(f.value) + 1e-9, 6) AS mean
FROM w JOIN frames f ON f.user_id = w.user_id AND f.t >= w.start_s + 36 - 96 AND f.t < w.start_s + 36 + 96 GROUP BY w.user_id, w.start_s""")
def centred_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = hopped(spark, sf_dir).select("user_id", "start_s").distinct()
    near = windows.centred_windows(frames(spark, sf_dir), starts, ["user_id"], "t", "start_s", 72.0, 192.0)
    return near.groupBy("user_id", "start_s").agg(F.count(F.lit(1)).alias("n"), mean_of(F.avg("value")).alias("mean"))


#: The rules in SQL; the effort threshold is the median over users outside the sealed ones.
RULES = FEATURES + f""", e AS (
  SELECT *, CASE WHEN arm IS NULL THEN leg WHEN leg IS NULL THEN arm ELSE (arm + leg) / 2 END AS effort FROM features
), thr AS (SELECT coalesce(median(effort), 4.0) AS thr FROM e WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
), f AS (
  SELECT e.*, thr, coalesce(slope > 0.05, false) AS sinks, coalesce(angle_std > 12, false) AS unstable, coalesce(effort > thr, false) AS works FROM e, thr
), ruled AS (
  SELECT *, CASE WHEN sinks OR (unstable AND works) THEN 0 WHEN NOT sinks AND NOT unstable AND NOT works THEN 2 ELSE 1 END AS float_pred,
         CASE WHEN sinks THEN '{X.SINKING}' WHEN unstable AND works THEN '{X.STRUGGLING}'
              WHEN NOT sinks AND NOT unstable AND NOT works THEN '{X.STABLE}' ELSE '{X.MAINTAINING}' END AS reason,
         CASE WHEN angle < 20 THEN 'horizontal' WHEN angle < 45 THEN 'angled' ELSE 'vertical' END AS alignment,
         CASE WHEN effort < 0.6 * thr THEN 'low' WHEN effort < thr THEN 'moderate' ELSE 'high' END AS effort_level
  FROM f)"""


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read twice: for the threshold, and for the rows.
    rows = written_once(features(spark, sf_dir), "features").withColumn("effort", X.effort(F.col("arm"), F.col("leg")))
    sealed = read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    pooled = stats.exact_percentiles(joins.non_members(rows, sealed, "user_id"), {"effort": F.col("effort")}, [0.5])["effort"][0]
    rows = rows.withColumn("thr", F.lit(4.0 if pooled is None else pooled))
    found = X.rule_class(F.col("angle_std"), F.col("slope"), F.col("effort"), F.col("thr"))
    return rows.withColumns({**found, "alignment": X.alignment(F.col("angle")), "effort_level": X.effort_level(F.col("effort"), F.col("thr"))})


@query(f"WITH {RULES} SELECT user_id, start_s, float_pred, reason, alignment, effort_level FROM ruled")
def rule_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruled(spark, sf_dir).select("user_id", "start_s", "float_pred", "reason", "alignment", "effort_level")


@query(f"""WITH {RULES}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_s) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c FROM ruled WHERE valid_pct >= 60),
s AS (SELECT * FROM o WHERE c < 10 OR (i >= floor(c * 0.1) AND i < floor(c * (1 - 0.1)))),
k AS (SELECT user_id, float_pred, count(*) AS n FROM s GROUP BY ALL),
m AS (SELECT user_id, float_pred AS verdict FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, float_pred) = 1)
SELECT s.user_id, any_value(m.verdict) AS verdict, count(*) AS windows, round_even(avg(CASE WHEN float_pred = 0 THEN 1.0 ELSE 0 END), 6) AS share_0,
       round_even(avg(CASE WHEN float_pred = 1 THEN 1.0 ELSE 0 END), 6) AS share_1, round_even(avg(CASE WHEN float_pred = 2 THEN 1.0 ELSE 0 END), 6) AS share_2
FROM s JOIN m ON s.user_id = m.user_id GROUP BY s.user_id""")
def verdict_mid80(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.middle_slice(ruled(spark, sf_dir).filter("valid_pct >= 60"), ["user_id"], ["start_s"])
    out = rows.groupBy("user_id").agg(stats.smallest_mode("float_pred").alias("verdict"), F.count(F.lit(1)).alias("windows"), *stats.class_mix("float_pred"))
    return out.withColumns({f"share_{k}": r(f"share_{k}") for k in range(3)})


@query(f"""WITH {FEATURES}, m AS (
  SELECT user_id, median(angle) FILTER (WHERE valid_pct >= 75) AS angle, median(angle_std) FILTER (WHERE valid_pct >= 75) AS sd, median(slope) FILTER (WHERE valid_pct >= 75) AS slope,
         median(arm) FILTER (WHERE valid_pct >= 75) AS arm, median(leg) FILTER (WHERE valid_pct >= 75) AS leg, count(*) AS total, count(*) FILTER (WHERE valid_pct >= 75) AS reliable,
         max(valid_pct) / 100 AS conf FROM features GROUP BY user_id)
SELECT user_id, CASE WHEN angle IS NULL THEN 'unknown' WHEN angle < 20 THEN 'horizontal' WHEN angle < 45 THEN 'inclined' ELSE 'near-vertical' END AS posture,
       CASE WHEN sd IS NULL THEN 'unknown' WHEN sd < 8 THEN 'high' WHEN sd < 14 THEN 'moderate' ELSE 'low' END AS stability,
       CASE WHEN slope < -0.05 THEN 'rising' WHEN slope > 0.05 THEN 'sinking' ELSE 'stable' END AS drift,
       CASE WHEN arm IS NULL THEN 'unknown' WHEN arm < 2.5 THEN 'low' WHEN arm < 5 THEN 'moderate' ELSE 'high' END AS arm_activity,
       CASE WHEN leg IS NULL THEN 'unknown' WHEN leg < 2.5 THEN 'low' WHEN leg < 5 THEN 'moderate' ELSE 'high' END AS leg_activity,
       CASE WHEN arm + leg > 0 THEN CASE WHEN abs(arm - leg) / (arm + leg) < 0.3 THEN 'balanced' ELSE 'asymmetric' END ELSE 'unknown' END AS symmetry,
       CASE WHEN reliable = 0 OR reliable / total < 0.4 THEN 'UNABLE' WHEN conf < 0.55 THEN 'UNCERTAIN' ELSE 'OK' END AS status,
       CASE WHEN angle < 20 THEN 'FLAT' WHEN angle < 45 THEN 'PARTIAL' WHEN angle IS NOT NULL THEN 'UPRIGHT' END AS tag
FROM m""")
def report_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = lambda c: F.median(F.when(F.col("valid_pct") >= 75, F.col(c)))
    m = features(spark, sf_dir).groupBy("user_id").agg(good("angle").alias("angle"), good("angle_std").alias("sd"), good("slope").alias("slope"), good("arm").alias("arm"), good("leg").alias("leg"),
                                                      F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("valid_pct") >= 75, 1)).alias("reliable"), (F.max("valid_pct") / 100).alias("conf"))
    arm, leg = F.col("arm"), F.col("leg")
    return m.select("user_id", X.posture_band(F.col("angle")).alias("posture"), X.stability_band(F.col("sd")).alias("stability"), X.drift_sign(F.col("slope")).alias("drift"),
                    X.activity_band(arm).alias("arm_activity"), X.activity_band(leg).alias("leg_activity"), X.symmetry_label(G.symmetry_index(arm, leg)).alias("symmetry"),
                    X.abstention(F.col("reliable"), F.col("total"), F.col("conf")).alias("status"), X.overlay_tag(F.col("angle")).alias("tag"))


@query(f"""WITH {FEATURES}
SELECT user_id, start_s, round_even(f, 6) AS flotation_index, CASE WHEN f >= 0.72 THEN 'Well' WHEN f >= 0.45 THEN 'Marginal' WHEN f IS NOT NULL THEN 'NotFloating' END AS label
FROM (SELECT *, CASE WHEN angle IS NOT NULL THEN greatest(least(0.45 * cos(radians(angle)) + 0.35 * (1 - least(greatest(hip, 0), 1.5) / 1.5) + 0.2 * (1 - least(greatest(head, 0), 1)), 1), 0) END AS f FROM features)""")
def flotation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).withColumn("f", G.flotation_index(F.col("angle"), F.col("hip"), F.col("head")))
    return rows.select("user_id", "start_s", r("f").alias("flotation_index"), G.flotation_label(F.col("f")).alias("label"))


@query(f"""WITH {FEATURES}
SELECT user_id, start_s, round_even(CASE WHEN angle IS NOT NULL THEN 100 * (1 - least(abs(angle), 90) / 90) END, 6) AS flatness,
       round_even(CASE WHEN angle_std IS NOT NULL THEN 100 * (1 - least(angle_std, 15) / 15) END, 6) AS steadiness,
       round_even(CASE WHEN slope IS NOT NULL THEN 100 * (1 - least(abs(slope), 0.1) / 0.1) END, 6) AS level,
       round_even(CASE WHEN arm IS NOT NULL THEN greatest(100 * (1 - least(greatest(arm, coalesce(leg, arm)), 6) / 6), 0) END, 6) AS stillness,
       round_even(CASE WHEN arm IS NOT NULL AND leg IS NOT NULL AND greatest(arm, leg) > 0 THEN 100 * least(arm, leg) / greatest(arm, leg) END, 6) AS balance,
       round_even(arm * 72 / 60, 6) AS cycles
FROM features""")
def coaching_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    factors = G.coaching_factors(c("angle"), c("angle_std"), c("slope"), c("arm"), c("leg"))
    return features(spark, sf_dir).select("user_id", "start_s", *[r(v).alias(k) for k, v in factors.items()], r(G.balance_percent(c("arm"), c("leg"))).alias("balance"), r(G.cycle_count(c("arm"), F.lit(72))).alias("cycles"))


_Z = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END END AS {c}_z" for c in ("angle", "angle_std", "slope", "arm", "leg"))
FEEDBACK = {"angle": ("trunk too steep", "trunk very flat"), "angle_std": ("trunk unsteady", "trunk very steady"), "slope": ("sinking", "rising"), "arm": ("arms busy", "arms still"), "leg": ("legs busy", "legs still")}


@query(f"""WITH {FEATURES}, z AS (SELECT user_id, start_s, {_Z} FROM features), l AS (
  SELECT user_id, start_s, unnest(['angle', 'angle_std', 'slope', 'arm', 'leg']) AS feature, unnest([angle_z, angle_std_z, slope_z, arm_z, leg_z]) AS z FROM z
), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, start_s ORDER BY abs(z) DESC, feature DESC)::INT AS rank FROM l WHERE abs(z) >= 1.5)
SELECT user_id, start_s, rank, feature, round_even(z, 5) AS z, CASE feature {' '.join(f"WHEN '{k}' THEN CASE WHEN z > 0 THEN '{a}' ELSE '{b}' END" for k, (a, b) in FEEDBACK.items())} END AS message
FROM k WHERE rank <= 3""")
def zscore_topk_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.standardized(features(spark, sf_dir), list(FEEDBACK))
    top = windows.top_deviations(rows, ["user_id", "start_s"], {c: F.col(f"{c}_z") for c in FEEDBACK})
    return top.select("user_id", "start_s", "rank", "feature", r("z", 5).alias("z"), X.feature_message(F.col("feature"), F.col("z"), FEEDBACK).alias("message"))


_NAMED = {"trunk_angle_med": "angle", "trunk_angle_std": "angle_std", "hip_depth_med": "hip", "head_sub_frac": "head", "arm_speed": "arm", "leg_speed": "leg"}
#: Takes values off the ties of two decimals, where formatters differ.
_OFF = 0.00012345
_SAID = " ".join(f"WHEN '{f}' THEN '" + X.MESSAGES[f].replace("%v", f"' || printf('{d.replace('%%', '%%')}', {'100 * ' if f == 'head_sub_frac' else ''}v) || '").replace("%r", f"' || printf('{d}', ideal) || '") + "'"
                 for f in _NAMED for d in [{"trunk_angle_med": "%.0f", "trunk_angle_std": "%.0f", "head_sub_frac": "%.0f%%"}.get(f, "%.2f")])


@query(f"""WITH {FEATURES}, n0 AS (SELECT user_id, start_s, user_id % 8 AS cluster, {', '.join(f'{c} + {_OFF} AS {f}' for f, c in _NAMED.items())} FROM features
), n AS (SELECT *, CASE WHEN trunk_angle_med IS NOT NULL THEN greatest(least(0.45 * cos(radians(trunk_angle_med)) + 0.35 * (1 - least(greatest(hip_depth_med, 0), 1.5) / 1.5) + 0.2 * (1 - least(greatest(head_sub_frac, 0), 1)), 1), 0) END AS index FROM n0
), best AS (SELECT {', '.join(f'round_even(median({f}), 2) AS {f}' for f in _NAMED)} FROM n GROUP BY cluster HAVING median(index) IS NOT NULL ORDER BY round_even(median(index), 2) DESC, cluster LIMIT 1
), l AS (SELECT user_id, start_s, unnest([{', '.join(f"'{f}'" for f in _NAMED)}]) AS feature, unnest([{', '.join(f'n.{f}' for f in _NAMED)}]) AS v, unnest([{', '.join(f'best.{f}' for f in _NAMED)}]) AS ideal,
  unnest([{', '.join(f's.{f}' for f in _NAMED)}]) AS sd FROM n, best, (SELECT {', '.join(f'stddev_samp({f}) AS {f}' for f in _NAMED)} FROM n) s
), k AS (SELECT *, abs((v - ideal) / sd) AS away FROM l WHERE sd > 1e-6 AND abs((v - ideal) / sd) >= 1.5)
SELECT user_id, start_s, row_number() OVER (PARTITION BY user_id, start_s ORDER BY away DESC, feature DESC)::INT AS rank, feature, round_even(away, 1) AS z, CASE feature {_SAID} END AS message
FROM k QUALIFY row_number() OVER (PARTITION BY user_id, start_s ORDER BY away DESC, feature DESC) <= 3""")
def profile_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows against the medians of the cluster that floats best."""
    rows = features(spark, sf_dir).select("user_id", "start_s", (F.col("user_id") % 8).alias("cluster"), *[(F.col(c) + F.lit(_OFF)).alias(f) for f, c in _NAMED.items()])
    profile = cluster.well_profile(rows, "cluster", list(_NAMED), "trunk_angle_med", "hip_depth_med", "head_sub_frac")
    return feedback.profile_feedback(rows, profile, ["user_id", "start_s"])


@query(f"""WITH {FEATURES}, z AS (SELECT user_id, start_s, {_Z} FROM features)
SELECT user_id, start_s, round_even(1.0 * angle_z + 0.7 * angle_std_z + 1.0 * slope_z + 0.5 * arm_z + 0.5 * leg_z, 5) AS score FROM z""")
def minority_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from posemill.operators.sampling import weighted_score

    rows = stats.standardized(features(spark, sf_dir), list(FEEDBACK))
    score = weighted_score({"angle_z": 1.0, "angle_std_z": 0.7, "slope_z": 1.0, "arm_z": 0.5, "leg_z": 0.5})
    return rows.select("user_id", "start_s", r(score, 5).alias("score"))


@query(f"""WITH {FRAMES}, o AS (SELECT user_id, t, value, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM frames),
p AS (SELECT *, list_transform(range(least(5, n)), lambda j: CASE WHEN least(5, n) > 1 THEN round_even(j * (n - 1)::DOUBLE / (least(5, n) - 1), 0)::BIGINT ELSE 0 END) AS places FROM o)
SELECT user_id, round_even(t, 6) AS t, value FROM p WHERE list_contains(places, i)""")
def even_spread_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.even_spread(frames(spark, sf_dir), ["user_id"], ["t"], 5).select("user_id", r("t").alias("t"), "value")


@query(f"""WITH {RULES}, w AS (
  SELECT user_id, start_s, valid_pct, float_pred, CASE WHEN n > 3 THEN least(angle / 60, 1) END AS conf, angle, angle_std AS sd, slope, arm AS al, arm * 2 AS ar, leg AS ll, leg / 3 AS lr, valid_pct >= 75 AS ok FROM ruled
), i AS (SELECT *, row_number() OVER (PARTITION BY user_id, ok ORDER BY start_s) - 1 AS i, count(*) OVER (PARTITION BY user_id, ok) AS c FROM w
), m AS (SELECT *, ok AND (c < 10 OR (i >= floor(c * 0.1) AND i < floor(c * 0.9))) AS mid FROM i
), v AS (SELECT user_id, float_pred AS verdict FROM m WHERE mid GROUP BY user_id, float_pred QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, float_pred) = 1
), a AS (
  SELECT user_id, count(*) AS total, count(*) FILTER (WHERE ok) AS n, round_even(avg(valid_pct) FILTER (WHERE ok), 1) AS pose, avg(conf) FILTER (WHERE mid) AS conf,
         avg(CASE WHEN float_pred = 2 THEN 1.0 ELSE 0 END) FILTER (WHERE mid) AS f2, avg(CASE WHEN float_pred = 1 THEN 1.0 ELSE 0 END) FILTER (WHERE mid) AS f1, avg(CASE WHEN float_pred = 0 THEN 1.0 ELSE 0 END) FILTER (WHERE mid) AS f0,
         {', '.join(f'median({c}) FILTER (WHERE ok) AS {c}' for c in ('angle', 'sd', 'slope', 'al', 'ar', 'll', 'lr'))} FROM m GROUP BY user_id
), b AS (SELECT *, n = 0 OR n / total < 0.4 AS poor, list_avg(list_filter([al, ar], lambda x: x IS NOT NULL)) AS arm, list_avg(list_filter([ll, lr], lambda x: x IS NOT NULL)) AS leg,
         CASE verdict WHEN 0 THEN 'NOT FLOATING' WHEN 1 THEN 'ALMOST FLOATING' ELSE 'FLOATING' END AS name, CASE verdict WHEN 0 THEN 'Not Floating' WHEN 1 THEN 'Almost Floating' ELSE 'Floating' END AS title FROM a LEFT JOIN v USING (user_id))
SELECT user_id::VARCHAR AS video, CASE WHEN poor THEN 'UNABLE TO ASSESS' WHEN conf < 0.55 THEN 'UNCERTAIN (' || title || ')' ELSE name END AS classification,
  CASE WHEN poor THEN 'pose visibility too low (' || round_even(100 * n / total, 0)::INT || '% of windows reliable)' END AS reason, CASE WHEN NOT poor THEN round_even(100 * conf, 0) END AS confidence_pct,
  CASE WHEN NOT poor THEN round_even(f2, 3) END AS fraction_floating, CASE WHEN NOT poor THEN round_even(f1, 3) END AS fraction_almost, CASE WHEN NOT poor THEN round_even(f0, 3) END AS fraction_not, pose AS pose_quality_pct,
  CASE WHEN NOT poor THEN CASE WHEN angle IS NULL THEN 'unknown' WHEN angle < 20 THEN 'horizontal' WHEN angle < 45 THEN 'inclined' ELSE 'near-vertical' END END AS posture,
  CASE WHEN NOT poor THEN CASE WHEN sd IS NULL THEN 'unknown' WHEN sd < 8 THEN 'high' WHEN sd < 14 THEN 'moderate' ELSE 'low' END END AS stability,
  CASE WHEN NOT poor THEN CASE WHEN slope < -0.05 THEN 'rising' WHEN slope > 0.05 THEN 'sinking' ELSE 'stable' END END AS vertical_movement,
  CASE WHEN NOT poor THEN CASE WHEN arm IS NULL THEN 'unknown' WHEN arm < 2.5 THEN 'low' WHEN arm < 5 THEN 'moderate' ELSE 'high' END END AS arm_activity,
  CASE WHEN NOT poor THEN CASE WHEN leg IS NULL THEN 'unknown' WHEN leg < 2.5 THEN 'low' WHEN leg < 5 THEN 'moderate' ELSE 'high' END END AS leg_activity,
  CASE WHEN NOT poor THEN CASE WHEN ll + lr > 0 THEN CASE WHEN abs(ll - lr) / (ll + lr) < 0.3 THEN 'balanced' ELSE 'asymmetric' END ELSE 'unknown' END END AS symmetry, total AS windows_total, n AS windows_reliable FROM b""")
def video_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule-based report of each user's windows."""
    c = F.col
    rows = ruled(spark, sf_dir).select(
        c("user_id").cast("string").alias("source"), "start_s", "valid_pct", "float_pred", F.when(c("n") > 3, F.least(c("angle") / 60, F.lit(1.0))).alias("confidence"), c("angle").alias("trunk_angle_med"),
        c("angle_std").alias("trunk_angle_std"), c("slope").alias("hip_y_slope"), c("arm").alias("arm_speed_l"), (c("arm") * 2).alias("arm_speed_r"), c("leg").alias("leg_speed_l"), (c("leg") / 3).alias("leg_speed_r"))
    return report.video_reports(rows, min_valid=75.0).drop("mode", "text", "trunk_angle_deg", "trunk_variation_deg", "body_drift")
