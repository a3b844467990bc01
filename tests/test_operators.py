"""Operators on small frames with answers worked out by hand or by plain Python."""

from __future__ import annotations

import json
import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from posemill.functions import geometry as G
from posemill.functions import scalars as X
from posemill.functions.nulls import ensure_columns, mean_present, nan_to_null
from posemill.operators import agreement as A
from posemill.operators import cluster, features, feedback, joins, labels, learn, report, sampling, signal, stats, windows
from posemill.operators.boost import Trees, boost, grow
from posemill.plans.series import synthetic_landmarks
from posemill.sources import readers, schemas, writers


def one(spark, *columns, **values):
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], kinds).select(*columns).first()


def test_nan_is_null_and_missing_columns(spark):
    df = spark.createDataFrame([(1.0, float("nan"))], "a double, b double")
    assert nan_to_null(df).first() == (1.0, None)
    out = ensure_columns(df, {"c": "int", "pid": "double"}, {"pid": "a"}).first()
    assert out["c"] is None and out["pid"] == 1.0


def test_geometry(spark):
    row = one(
        spark, G.trunk_angle(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(0.0)), G.joint_angle(*map(F.lit, (0.0, 1.0, 0.0, 0.0, 1.0, 0.0))),
        G.symmetry_index(F.lit(1.0), F.lit(3.0)), G.symmetry_index(F.lit(0.0), F.lit(0.0)), G.balance_percent(F.lit(1.0), F.lit(4.0)),
        mean_present(F.lit(None).cast("double"), F.lit(2.0)), G.visible(F.lit(0.5)), G.all_visible(F.lit(0.6), F.lit(None).cast("double")),
        G.depth_below(F.lit(3.0), F.lit(1.0), F.lit(1.0)), G.flotation_index(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    assert row[0] == pytest.approx(45) and row[1] == pytest.approx(90)
    assert row[2:] == (0.5, None, 25.0, 2.0, False, False, None, pytest.approx(1.0))


@pytest.mark.parametrize("name, standard, keep, short, view, trial", [
    ("a/P7_x.csv", "P07", "P07", "P7", "unknown", "T01"), ("p007.csv", "P07", "P07", "P7", "unknown", "T01"), ("12 Side front.mp4", "V12", "P04", "12 Side front.mp4", "side_front", "T01"),
    ("top1.csv", "P01", "P01", "top1.csv", "top", "T01"), ("rear.csv", "rear", "rear.csv", "rear.csv", "side_rear", "T01"), ("P038_T02_side_front.mp4", "P38", "P38", "P38", "side_front", "T02"),
    ("a.b_features.csv", "a.b_feat", "a.b_features.csv", "a.b_features.csv", "unknown", "T01"),
    ("P20240131123456_x.csv", "P20240131123456", "P20240131123456", "P20240131123456", "unknown", "T01"), ("P000.csv", "P00", "P00", "P0", "unknown", "T01")])
def test_ids(spark, name, standard, keep, short, view, trial):
    c = F.col("n")
    assert one(spark, X.participant_id(c), X.participant_id(c, "keep"), X.participant_id(c, "short"), X.manifest_view(c), X.manifest_trial(c), n=name) == (standard, keep, short, view, trial)


def test_names(spark):
    c = F.col("n")
    assert one(spark, X.sanitized(c), X.natural_key(c), X.csv_quoted(c), X.manifest_participant(c), n='Side Anna 12".mp4') == ("Side_Anna_12_.mp4", 12, '"Side Anna 12"".mp4"', "P??")
    assert [one(spark, X.manifest_participant(c), n=n)[0] for n in ("7 Side front.mp4", "x.mov", "P3_rear.mp4")] == ["V07", "P??", "P03"]
    names = {"P12_Anna_side_raw_features.csv": "anna", "P1_side_P2_Top_P3_Bo_P4_Eve": "eve", "Anna_P7_raw": None, "P1_raw": None, "P01_Lea_raw.csv": "lea"}
    assert {n: one(spark, X.name_token(c), n=n)[0] for n in names} == names
    assert one(spark, X.class_name(F.lit(1), ("not", "almost")), X.class_name(F.lit(7), ("not", "almost"))) == ("almost", "7")


def test_clip_places(spark):
    start = X.clip_window(F.lit(36.0))["clip_start"]
    assert one(spark, start, X.clip_file(F.lit("P07"), start), X.clip_window(F.lit(0.0))["clip_start"]) == (33.5, "P07__0033.mp4", 0.0)


def test_head(spark):
    nose = lambda seen, left, right: G.head_y(F.lit(1.0), F.lit(seen), F.lit(2.0), F.lit(left), F.lit(4.0), F.lit(right))
    assert one(spark, nose(True, True, True), nose(False, True, True), nose(False, False, True), nose(False, False, False)) == (1.0, 3.0, 4.0, None)
    assert one(spark, G.submerged(F.lit(2.0), F.lit(1.0)), G.submerged(F.lit(1.0), F.lit(1.0)), G.submerged(F.lit(None).cast("double"), F.lit(1.0))) == (1.0, 0.0, None)


def test_frame_validity(spark):
    given = G.frame_validity(*[F.lit(c).cast("double") for c in (0.36, 0.35, None, 1.0, 0.0, 0.5, 0.5, 0.09)])
    assert len(G.BODY_JOINTS) == 8 and one(spark, given["valid"], given["pose_conf"]) == (0.5, pytest.approx(0.35))


def test_stillness_without_legs(spark):
    none = F.lit(None).cast("double")
    still = lambda arm, leg: G.coaching_factors(none, none, none, arm, leg)["stillness"]
    assert one(spark, still(F.lit(3.0), none), still(F.lit(3.0), F.lit(6.0)), still(none, F.lit(3.0))) == (50.0, 0.0, None)


def test_rules_treat_missing_as_passing(spark):
    def rule(std, slope, effort, strict=False):
        c = X.rule_class(F.lit(std).cast("double"), F.lit(slope).cast("double"), F.lit(effort).cast("double"), F.lit(4.0), strict=strict)
        return one(spark, c["float_pred"])[0]
    assert [rule(None, None, None), rule(13, 0, 5), rule(13, 0, 3), rule(0, 0.06, 0), rule(12, 0.05, 4)] == [2, 0, 1, 0, 2]
    assert rule(None, 0, 0, strict=True) is None
    assert one(spark, X.alignment(F.lit(50.0), 60.0), X.alignment(F.lit(50.0))) == ("angled", "vertical")


def test_bands_and_abstention(spark):
    null = F.lit(None).cast("double")
    assert one(spark, X.posture_band(F.lit(20)), X.posture_band(null), X.drift_sign(null), X.drift_sign(F.lit(-0.06)), X.alignment(null), X.symmetry_label(F.lit(0.3))) == (
        "inclined", "unknown", "stable", "rising", "vertical", "asymmetric")
    assert one(spark, X.abstention(F.lit(4), F.lit(10), F.lit(0.55)), X.abstention(F.lit(0), F.lit(1), F.lit(1.0)), X.abstention(F.lit(9), F.lit(10), F.lit(0.5))) == ("OK", "UNABLE", "UNCERTAIN")


@pytest.mark.parametrize("last", [0.0, 2.9, 3.0, 4.4, 4.5, 7.6])
def test_hop_windows_equal_the_loop(spark, last):
    t = [round(i * 0.1, 1) for i in range(int(round(last * 10)) + 1)]
    rows = windows.hop_windows(spark.createDataFrame([("v", x) for x in t], "v string, t double"), ["v"], "t", 3.0, 1.5)
    got = {r["start_s"]: r["n"] for r in rows.groupBy("start_s").agg(F.count("*").alias("n")).collect()}
    want, start = {}, 0.0
    while start < max(last - 3, 0) + 1e-6:
        want[start] = sum(start <= x < start + 3 for x in t)
        start += 1.5
    assert got == want


def test_interpolation_equals_pandas(spark):
    rng = random.Random(5)
    for _ in range(6):
        values = [None if rng.random() < 0.5 else rng.uniform(0, 9) for _ in range(25)]
        df = spark.createDataFrame([("v", float(i), x) for i, x in enumerate(values)], "v string, t double, x double")
        got = [r["filled"] for r in windows.interpolate_gaps(df, ["v"], "t", "x", 3).orderBy("t").collect()]
        want = pd.Series(values, dtype=float).interpolate(limit=3)
        assert np.allclose([np.nan if g is None else g for g in got], want, equal_nan=True)
        assert np.allclose(signal.filled_forward(np.array([np.nan if v is None else v for v in values]), 3), want, equal_nan=True)


@pytest.mark.parametrize("n, rows", [(9, 9), (10, 8), (21, 16)])
def test_middle_slice(spark, n, rows):
    assert windows.middle_slice(spark.range(n).withColumn("g", F.lit(0)), ["g"], ["id"]).count() == rows


def test_even_spread_and_first(spark):
    rows = spark.range(10).withColumn("g", F.lit(0))
    assert sorted(r[0] for r in windows.even_spread(rows, ["g"], ["id"], 4).select("id").collect()) == [0, 3, 6, 9]
    assert [r[0] for r in windows.even_spread(rows, ["g"], ["id"], 1).select("id").collect()] == [0]
    assert windows.keep_first(rows, ["g"], ["id"]).first()["id"] == 0


def test_theil_sen(spark):
    rng = random.Random(2)
    points = [(0, rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(12)] + [(1, float(i), 2.0 * i + 1) for i in range(5)] + [(2, 0.0, 1.0), (2, 1.0, None), (3, 1.0, 1.0), (3, 1.0, 2.0), (3, 1.0, 5.0), (3, 2.0, 1.0)]
    got = {r["g"]: r["slope"] for r in stats.theil_sen(spark.createDataFrame(points, "g int, t double, v double"), ["g"], "t", "v").collect()}
    own = sorted((t, v) for g, t, v in points if g == 0)
    assert got[0] == pytest.approx(statistics.median((b[1] - a[1]) / (b[0] - a[0]) for i, a in enumerate(own) for b in own[i + 1:]))
    assert got[1] == 2.0 and got[2] is None and got[3] == -1.0


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, None), (9.0, 5.0)], "a double, b double")
    scaled = stats.robust_scaled(stats.imputed(df, ["a", "b"]), ["a", "b"]).collect()
    q1, q2, q3 = np.percentile([1, 2, 4, 9], [25, 50, 75])
    assert sorted(r["a"] for r in scaled) == pytest.approx(sorted((x - q2) / (q3 - q1) for x in (1, 2, 4, 9)))
    assert {r["b"] for r in scaled} == {0.0}
    z = stats.standardized(df, ["a", "b"]).collect()
    assert sorted(r["a_z"] for r in z) == pytest.approx(sorted((np.array([1, 2, 4, 9]) - 4) / np.std([1, 2, 4, 9])))
    assert {r["b_z"] for r in z} == {0.0, None}
    assert stats.winsorized(df, ["a"], 0.25, 0.75).agg(F.min("a"), F.max("a")).first() == (q1, q3)


@pytest.mark.parametrize("held", [10, 10_000])
def test_exact_percentiles_at_any_size(spark, held):
    rng = random.Random(7)
    rows = [(rng.gauss(0, 1), float(rng.randint(0, 3)), None if i % 3 else rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double").withColumn("d", F.lit(None).cast("double"))
    shares = [0.0, 0.02, 0.5, 0.731, 1.0]
    got = stats.exact_percentiles(df, {c: F.col(c) for c in "abcd"}, shares, held)
    for i, c in enumerate("abc"):
        assert got[c] == pytest.approx(list(np.percentile([r[i] for r in rows if r[i] is not None], [100 * p for p in shares])))
    assert got["d"] == [None] * 5


def test_label_attach(spark):
    points = spark.createDataFrame([("s", 1.0), ("s", 4.0), ("s", 5.0), ("s", 20.0), ("z", 1.0)], "source string, at double")
    given = spark.createDataFrame([("s", 0.0, 5.0, 1, 0, 0.6), ("s", 4.0, 12.0, 2, 2, None), ("q", 0.0, 99.0, 3, 1, 1.0)], "source string, a double, b double, ord int, label int, w double")
    got = {(r["source"], r["at"]): (r["label"], r["weight"]) for r in joins.attach_labels(points, given, "source", "at", "a", "b", "ord", "label", "w", ["source", "at"]).collect()}
    assert got == {("s", 1.0): (0, 0.6), ("s", 4.0): (2, 0.6), ("s", 5.0): (2, 1.0)}
    twice = points.filter("at = 4").unionByName(points.filter("at = 4"))
    assert joins.attach_labels(twice, given, "source", "at", "a", "b", "ord", "label", "w", ["source", "at"]).count() == 2


def test_fallback_default_and_priority(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, x int")
    assert sorted(r["x"] for r in joins.inside_or_all(df, ["k"], F.col("x") == 2).collect()) == [2, 3]
    dim = spark.createDataFrame([("a", "val")], "k string, split string")
    assert [r["split"] for r in joins.with_default(df, dim, "k", "split", "train").orderBy("x").collect()] == ["val", "val", "train"]
    assert joins.non_members(df.unionByName(spark.createDataFrame([(None, 9)], "k string, x int")), dim, "k").count() == 2
    assert {tuple(r) for r in joins.first_given([spark.createDataFrame([("a", 9)], "k string, x int"), df], "k").collect()} == {("a", 9), ("b", 3)}


def test_labels_fuse(spark):
    kinds = "source string, participant string, seg_id int, start_s double, end_s double, float_label int, passive_active int, label_confidence int, exclude string"
    mine = labels.rater_labels(spark.createDataFrame([("f", "P01", 1, 0.0, 8.0, 2, 0, 2, None), ("f", "P01", 2, 0.0, 8.0, 1, 0, 0, "1"), ("g", "P02", 1, 0.0, 8.0, 2, 1, 5, "0")], kinds))
    assert sorted((r["participant"], r["floating_outcome"], r["sample_weight"]) for r in mine.collect()) == [("P01", 3, 1.0), ("P02", 2, 0.8)]
    wins = spark.createDataFrame([("g", "P02", 0.0, 3.0), ("g", "P02", 30.0, 33.0), ("h", "P03", 0.0, 3.0)], "source string, participant string, start_s double, end_s double")
    scores = spark.createDataFrame([("P02", 1, None, None), ("P03", 0, None, None)], "participant string, floating_outcome int, window_start double, window_end double")
    experts = labels.expert_labels(scores, wins).withColumn("participant", F.when(F.col("source") == "g", "P02").otherwise("P03"))
    fused = labels.fused_labels(mine, experts).collect()
    assert sorted((r["participant"], r["label_source"], r["start_s"]) for r in fused) == [("P01", "mine", 0.0), ("P02", "expert", 30.0), ("P03", "expert", 0.0)]


def test_agreement(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 3), rng.randint(0, 3)) for _ in range(60)]
    df = spark.createDataFrame(rows, "t int, p int")
    counts = A.pair_counts(df, "t", "p")
    n = len(rows)
    for power in (1, 2):
        o = sum(abs(a - b) ** power for a, b in rows)
        e = sum(abs(a - b) ** power for a, _ in rows for _, b in rows) / n
        assert A.weighted_kappa(counts, power).first()[0] == pytest.approx(1 - o / e)
    assert A.weighted_kappa(A.pair_counts(spark.createDataFrame([(1, 1)], "t int, p int"), "t", "p")).first()[0] is None
    assert A.weighted_kappa(A.pair_counts(df, "t", "t")).first()[0] == 1.0
    scores = {r["label"]: r for r in A.class_scores(counts).collect()}
    assert sum(r["support"] for r in scores.values()) == n
    for k, s in scores.items():
        hit, real, said = sum(a == b == k for a, b in rows), sum(a == k for a, _ in rows), sum(b == k for _, b in rows)
        assert (s["precision"], s["recall"], s["f1"]) == pytest.approx((hit / said, hit / real, 2 * hit / (said + real)))
    assert A.confusion_matrix(df, "t", "p", [0, 1, 2, 3]).count() == 4


def test_published_arithmetic():
    """Macro F1 is the mean of the class scores, and supports add up, in the published summaries."""
    assert round((0.473 + 0.543 + 0.802) / 3, 3) == 0.606
    assert 203 + 746 + 1159 == 2108 and 1071 + 834 + 201 == 2106 and 221 + 494 + 1255 + 133 == 2103


def test_split_is_a_partition(spark):
    units = spark.createDataFrame([(i, "a" if i < 11 else "b" if i < 14 else "c") for i in range(15)], "u int, s string")
    got = sampling.stratified_split(units, "u", "s", sampling.hash_order("u", 1)).toPandas()
    assert sorted(got["u"]) == list(range(15))
    counts = got.groupby(["s", "split"]).size().to_dict()
    assert counts[("a", "train")] == 7 and counts[("a", "val")] == 2 and counts[("a", "test")] == 2
    assert counts[("b", "train")] == 2 and counts[("b", "val")] == 1 and counts[("c", "train")] == 1  # another stratum has test units
    alone = sampling.stratified_split(spark.createDataFrame([(i, "b") for i in range(3)], "u int, s string"), "u", "s", F.col("u")).collect()
    assert {r["u"]: r["split"] for r in alone} == {0: "train", 1: "train", 2: "test"}
    two = sampling.stratified_split(spark.createDataFrame([(i, "ab"[i]) for i in range(2)], "u int, s string"), "u", "s", F.col("u")).collect()
    assert {r["split"] for r in two} == {"train"}


def test_spaced_picks_equal_the_greedy_loop(spark):
    rng = random.Random(3)
    rows = [(f"p{rng.randint(0, 5)}", round(rng.uniform(0, 60), 1), rng.random()) for _ in range(80)] + [("p0", 0.0, None), ("p6", 50.0, float("nan")), ("p6", 9.0, None)]
    for most in (12, 99):
        got = sampling.spaced_picks(spark.createDataFrame(rows, "g string, at double, score double"), "g", "at", "score", most, 3, 6.0).collect()
        chosen: list[tuple] = []
        for g, at, s in sorted(rows, key=lambda x: (x[2] is None or x[2] != x[2], -x[2] if x[2] is not None and x[2] == x[2] else 0, x[1])):
            own = [c for c in chosen if c[0] == g]
            if len(chosen) < most and len(own) < 3 and all(abs(at - c[1]) >= 6 for c in own):
                chosen.append((g, at, s))
        assert sorted(r[:2] for r in map(tuple, got)) == sorted(c[:2] for c in chosen)
        assert most == 12 or ("p6", 50.0) in [c[:2] for c in chosen]


def test_round_robin(spark):
    rows = [(c, f"p{i % 4}", float(i * 7), i) for c in range(3) for i in range(12)]
    got = sampling.round_robin_picks(spark.createDataFrame(rows, "c int, g string, at double, o int"), "c", "g", "at", "o", 10, 3, 6.0).toPandas()
    assert len(got) == 10 and got.groupby("g").size().max() <= 3
    for _, part in got.groupby("g"):
        places = sorted(part["at"])
        assert all(b - a >= 6 for a, b in zip(places, places[1:]))


def test_cadence():
    fps, t = 25.0, np.arange(200) / 25.0
    rng = np.random.default_rng(0)
    assert signal.cadence_per_minute(np.sin(2 * math.pi * 1.5 * t), fps) == pytest.approx(90, abs=2)
    assert signal.cadence_per_minute(np.ones(200), fps) == 0.0
    assert signal.cadence_per_minute(np.sin(2 * math.pi * 5 * t), fps) == 0.0
    assert sum(signal.cadence_per_minute(rng.normal(size=200), fps) == 0.0 for _ in range(20)) >= 15
    assert signal.cadence_per_minute(np.ones(50), fps) is None
    holes = np.sin(2 * math.pi * 1.5 * t)
    holes[50:130] = np.nan
    assert signal.cadence_per_minute(np.where(np.arange(200) < 150, np.nan, 1.0), fps) is None
    assert signal.cadence_per_minute(holes, fps) is not None


def plain_windows(frames: pd.DataFrame) -> dict[float, dict[str, float]]:
    """The windows of one video by a loop over starts, one measure after another."""
    f = frames.sort_values("time_sec").reset_index(drop=True)
    t = f.time_sec.to_numpy()
    fps = 1 / np.median(np.diff(t)) if len(t) > 1 else 25.0
    at = {p: (f[f"{p}_x"].to_numpy() * 16 / 9, f[f"{p}_y"].to_numpy(), f[f"{p}_visibility"].to_numpy()) for p in features.LANDMARKS}
    seen = lambda *ps: np.logical_and.reduce([at[p][2] > 0.5 for p in ps])
    middle = lambda part: [(at[f"left_{part}"][i] + at[f"right_{part}"][i]) / 2 for i in (0, 1)]
    core, (sx, sy), (hx, hy) = seen(*features.CORE), middle("shoulder"), middle("hip")
    torso = np.median(np.hypot(sx - hx, sy - hy)[core]) if core.any() else np.nan
    angle = np.degrees(np.arctan2(abs(sy - hy), abs(sx - hx)))

    def knee(side):
        a, b, c = (np.array(at[f"{side}_{p}"][:2]) for p in ("hip", "knee", "ankle"))
        cosine = ((a - b) * (c - b)).sum(0) / (np.linalg.norm(a - b, axis=0) * np.linalg.norm(c - b, axis=0) + 1e-9)
        return np.degrees(np.arccos(np.clip(cosine, -1, 1)))

    series = {"trunk_angle": (angle, core), "hip_y": (hy, core), "ankle_y": (middle("ankle")[1], seen("left_ankle", "right_ankle")), "knee_angle_deg": ((knee("left") + knee("right")) / 2, seen(*features.LEG))}
    out, start = {}, 0.0
    while start < max(t[-1] - 3, 0) + 1e-6:
        w = (t >= start) & (t < start + 3)
        row = {"torso_valid_pct": round(100 * core[w].mean(), 1), "nose_low_vis_frac": round((at["nose"][2][w] < 0.5).mean(), 3)}
        for name, (values, ok) in series.items():
            own = values[w & ok]
            row[name.replace("_deg", "") + "_med" + ("_deg" if "knee" in name else "")] = np.median(own) if len(own) else np.nan
            if name in ("trunk_angle", "hip_y"):
                row[f"{name}_std"] = np.std(own) if len(own) else np.nan
                ts = t[w & ok]
                slopes = [(own[j] - own[i]) / (ts[j] - ts[i]) for i in range(len(own)) for j in range(i + 1, len(own))]
                row[f"{name}_slope"] = np.median(slopes) if len(own) >= max(4, int(1.5 * fps)) else np.nan
        for part, (far, near) in {"arm": ("wrist", "shoulder"), "leg": ("ankle", "hip")}.items():
            for side in ("left", "right"):
                ok = seen(f"{side}_{far}", f"{side}_{near}")
                dx, dy = (at[f"{side}_{far}"][i] - at[f"{side}_{near}"][i] for i in (0, 1))
                places = np.flatnonzero(w & ok)
                speeds = [np.hypot(dx[b] - dx[a], dy[b] - dy[a]) / (t[b] - t[a]) for a, b in zip(places, places[1:]) if t[b] - t[a] < 2 / fps]
                row[f"{part}_speed_{side[0]}"] = np.mean(speeds) / torso if speeds and torso > 0 else np.nan
                row[f"{side}_{part}_valid_pct"] = round(100 * ok[w].mean(), 1)
                around = (t >= start + 1.5 - 4) & (t < start + 1.5 + 4)
                beat = signal.cadence_per_minute(np.where(ok, dy, np.nan)[around], fps)
                row[f"{part}_freq_{side[0]}"] = np.nan if beat is None else beat
            pair = [row[f"{part}_speed_{x}"] for x in "lr"]
            row[f"{part}_speed"] = np.nanmean(pair) if not np.isnan(pair).all() else np.nan
            row[f"{part}_asym"] = abs(pair[0] - pair[1]) / sum(pair) if sum(pair) > 0 else np.nan
        for part, points in {"torso": features.CORE, "arm": features.ARM, "leg": features.LEG}.items():
            row[f"mean_{part}_conf"] = round(np.mean([at[p][2][w].mean() for p in points]), 3)
        if (w & core).sum() >= int(1.5 * fps) and core[w].mean() > 0.4:
            out[start] = row
        start += 1.5
    return out


@pytest.mark.parametrize("rate", [25, 10])
def test_windows_equal_the_plain_loop(spark, tmp_path, rate):
    """All columns, at the video's own rate; then through files and readers to the rules."""
    frames = synthetic_landmarks(spark, "/root/testdata/sf0.001").withColumn("time_sec", F.round(F.col("time_sec") * 25 / rate, 6))
    more = frames.filter("user_id < 4").withColumns({"video_id": F.concat("video_id", F.lit("b")), "nose_visibility": F.when(F.col("time_sec") < 1, 0.5).otherwise(F.lit(None).cast("double"))})
    chosen = frames.filter("user_id < 12").unionByName(more)
    if rate == 10:  # longer windows of fewer frames
        chosen = chosen.withColumn("left_knee_visibility", F.lit(0.4))
    rows = features.window_features(chosen)
    assert rows.columns == [c.split(" ")[0] for c in schemas.WINDOWS.split(", ")]
    got = rows.toPandas().set_index(["video_id", "start_s"]).sort_index()
    want = {(v, s): row for v, part in chosen.toPandas().groupby("video_id") for s, row in plain_windows(part.fillna({"nose_visibility": np.nan})).items()}
    assert sorted(want) == list(got.index) and len(want) > 5
    for key, row in want.items():
        for name, value in row.items():
            assert got.loc[key, name] == pytest.approx(value, rel=1e-6, abs=1.1e-3 if "conf" in name or "frac" in name else 0.11 if "pct" in name else 1e-7, nan_ok=True), (key, name)
    writers.write_csv(rows, str(tmp_path / "P07_features.csv"))
    read = readers.read_features(spark, str(tmp_path / "P07_features.csv") + "/*.csv", None)
    ruled = X.rule_class(F.col("trunk_angle_std"), F.col("hip_y_slope"), X.effort(F.col("arm_speed"), F.col("leg_speed")), F.lit(4.0))
    assert read.withColumns(ruled).filter("reason IS NOT NULL AND float_pred IN (0, 1, 2)").count() == len(got)


def test_one_frame_and_low_nose(spark):
    one_frame = synthetic_landmarks(spark, "/root/testdata/sf0.001").filter("time_sec = 0").limit(1)
    assert features.window_features(one_frame).count() == 0
    low = features.frame_measures(one_frame.withColumn("nose_visibility", F.lit(0.5))).first()["nose_low"]
    none = features.frame_measures(one_frame.withColumn("nose_visibility", F.lit(None).cast("double"))).first()["nose_low"]
    assert (low, none, features.frame_measures(one_frame.withColumn("nose_visibility", F.lit(0.49))).first()["nose_low"]) == (0.0, 0.0, 1.0)


def test_body_movement_starts_at_the_first_pair(spark):
    frames = synthetic_landmarks(spark, "/root/testdata/sf0.001").filter("user_id = 1").withColumns({f"{p}_visibility": F.when(F.col("time_sec") < 0.5, 0.1).otherwise(0.9) for p in features.LANDMARKS})
    got = features.body_movement(frames, ["user_id"], "time_sec", 25.0, bin_seconds=0.25).toPandas().sort_values("bin")
    f = frames.toPandas().sort_values("time_sec")
    torso = np.median(np.hypot((f.left_shoulder_x + f.right_shoulder_x - f.left_hip_x - f.right_hip_x) / 2 * 16 / 9, (f.left_shoulder_y + f.right_shoulder_y - f.left_hip_y - f.right_hip_y) / 2))
    seen = f[f.time_sec >= 0.5]
    moved = np.mean([np.hypot(seen[f"{p}_x"].diff() * 16 / 9, seen[f"{p}_y"].diff()) for p in features.BODY], axis=0)[1:] / torso / np.diff(seen.time_sec)
    assert got["average"].iloc[0] == pytest.approx(moved.mean()) and got["bin"].iloc[0] == 0
    first = moved[np.floor((seen.time_sec.to_numpy()[1:] - seen.time_sec.to_numpy()[1]) / 0.25) == 0]
    assert got["movement"].iloc[0] == pytest.approx(first.mean())


def test_learning_round_trip(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, i % 3, f"p{i // 3 % 6}", i % 3 + rng.gauss(0, 0.3), None if i % 17 == 0 else rng.random()) for i in range(180)]
    df = spark.createDataFrame(rows, "i int, y int, g string, a double, b double")
    folds = learn.grouped_folds(df, "g", 3)
    assert folds.count() == 6 and folds.groupBy("g").count().filter("count > 1").count() == 0
    scores = {}
    for name in ("ordinal", "softmax", "tree", "boosted"):
        out = learn.out_of_fold(df, folds, "g", "y", ["a", "b"], learn.challengers()[name])
        assert out.count() == 180
        assert out.select(F.max(F.abs(F.aggregate("proba", F.lit(0.0), lambda s, x: s + x) - 1))).first()[0] < 1e-9
        scores[name] = learn.scored(out, "y")
    assert scores[learn.winner(scores)]["macro_f1"] > 0.8
    for name in ("ordinal", "softmax", "boosted", "forest"):
        make = learn.challengers()[name]
        frozen = learn.fitted(df, "y", ["a", "b"], make)
        learn.freeze(spark, str(tmp_path / name), frozen, "y", ["p9"])
        again, meta = learn.thaw(spark, str(tmp_path / name))
        both = [m.predict(df).orderBy("i").select("pred").collect() for m in (frozen, again)]
        assert both[0] == both[1] and meta["sealed"] == ["p9"] and set(meta["versions"]) == {"python", "spark", "numpy", "pandas"}
    assert again.predict(df.drop("b")).count() == 180
    with pytest.raises(FileNotFoundError, match="no frozen model"):
        learn.thaw(spark, str(tmp_path / "nowhere"))


def test_trees_split_where_the_gain_is_greatest():
    """Against every split tried one after another."""
    rng = np.random.default_rng(1)
    codes, slope, bend = rng.integers(0, 6, (90, 3)), rng.normal(size=90), rng.uniform(0.1, 1, 90)
    feature, cut, step, at = grow(codes, slope, bend, 6, 1, 1.0, 20)

    def worth(rows):
        return slope[rows].sum() ** 2 / (bend[rows].sum() + 1.0)

    tried = [(worth(codes[:, f] <= b) + worth(codes[:, f] > b), -f, -b) for f in range(3) for b in range(5) if 20 <= (codes[:, f] <= b).sum() <= 70]
    assert (feature[0], cut[0]) == (-max(tried)[1], -max(tried)[2]) and set(at) == {1, 2}
    left = codes[:, feature[0]] <= cut[0]
    assert step[1] == pytest.approx(-slope[left].sum() / (bend[left].sum() + 1.0)) and step[2] == pytest.approx(-slope[~left].sum() / (bend[~left].sum() + 1.0))


@pytest.mark.parametrize("n, classes", [(300, 2), (300, 3), (12_000, 3)])
def test_boosting_learns_and_keeps(n, classes):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 3, n), np.ones(n)])
    y = np.clip((x[:, 0] > 0).astype(int) + (x[:, 1] == 2), 0, classes - 1)
    flipped = np.where(rng.random(n) < 0.1, rng.integers(0, classes, n), y)
    trees = boost(x, flipped, np.ones(n), classes, 3, 120, 0.08, 1.0)
    again = Trees.from_bytes(trees.to_bytes())
    assert (again.shares(x).argmax(axis=1) == y).mean() > 0.9 and np.allclose(again.shares(x).sum(axis=1), 1) and np.array_equal(again.shares(x), trees.shares(x))
    assert len(trees.feature) == 120 if n <= 10_000 else len(trees.feature) < 120
    plain = boost(x, flipped, np.ones(n), classes, 3, 0, 0.08, 1.0)
    assert plain.shares(x[:1])[0] == pytest.approx(np.bincount(flipped, minlength=classes) / n) or n > 10_000


def test_each_ordinal_side_is_balanced(spark):
    """Nine rows of ten on one side: a balanced model's even share lies between the classes, not beyond them."""
    rng = random.Random(2)
    rows = [(0, rng.gauss(0, 1)) for _ in range(180)] + [(1, rng.gauss(2, 1)) for _ in range(10)] + [(2, rng.gauss(4, 1)) for _ in range(10)]
    df = spark.createDataFrame(rows, "y int, a double")
    model = learn.fitted(df, "y", ["a"], learn.OrdinalLogistic)
    at = spark.createDataFrame([(x / 10,) for x in range(-20, 60)], "a double")
    above = [(r["a"], 1 - r["proba"][0]) for r in model.predict(at).collect()]
    even = min(above, key=lambda p: abs(p[1] - 0.5))[0]
    assert 1.0 < even < 2.0
    scales = learn.fold_scales(df, ["a"], {"a": 0.0})["a"]
    assert scales == pytest.approx((np.median([r[1] for r in rows]), np.subtract(*np.percentile([r[1] for r in rows], [75, 25]))))


def test_folds_of_one_class_give_no_rows(spark):
    df = spark.createDataFrame([(0, f"p{i}", float(i)) for i in range(6)], "y int, g string, a double")
    out = learn.out_of_fold(df, learn.grouped_folds(df, "g", 2), "g", "y", ["a"], learn.challengers()["tree"])
    assert out.count() == 0 and learn.scored(out, "y")["weighted_kappa"] is None


def test_champion_and_sealed_report(spark):
    rng = random.Random(5)
    rows = [(i % 3, f"p{i // 3 % 6}", i % 3 + rng.gauss(0, 0.3), rng.random()) for i in range(150)]
    df = spark.createDataFrame(rows, "y int, g string, a double, b double")
    best, model, scores = learn.champion(df.filter("g <> 'p5'"), "g", "y", ["a", "b"], folds=2, names=["ordinal", "softmax"])
    assert set(scores) == {"ordinal", "softmax"} and scores[best]["macro_f1"] > 0.75
    report = learn.sealed_report(model, df.filter("g = 'p5'"), "g", "y")
    assert report["accuracy"] > 0.7 and report["video_accuracy"] in (0.0, 1.0)
    assert learn.importances(df, "y", ["a", "b"])[0][0] == "a"
    mean, deviation = learn.grouped_accuracy(df, "g", "y", ["a", "b"], make=learn.challengers()["tree"])
    assert mean > 0.7 and deviation >= 0 and learn.grouped_accuracy(df.limit(29), "g", "y", ["a", "b"]) is None


def test_expert_table(spark):
    said = [("p", 0.0, 3.0, "trunk", "m", 0), ("p", 29.0, 32.0, "trunk", "m", 2), ("p", 58.0, 61.0, "trunk", "m", 1), ("p", 60.0, 63.0, "trunk", "m", 0), ("q", 90.0, 93.0, "trunk", "m", 1), ("p", 40.0, 43.0, "head", "m", 1)]
    predictions = spark.createDataFrame(said, "participant string, start_s double, end_s double, criterion string, model string, pred int")
    expert = spark.createDataFrame([("p", "trunk", 2), ("q", "trunk", 1), ("p", "head", None)], "participant string, criterion string, rating int")
    table = learn.expert_table(expert, predictions)
    assert {(r["participant"], r["voted"], r["error"]) for r in table.collect()} == {("p", 1, 1), ("q", 1, 0)}
    assert tuple(learn.expert_summary(table).first()) == ("trunk", "m", 1, 2, 0.5)


def loop_second_round(rows, reviewed, n_minority, n_unlabelled, per_group, spacing):
    """The three streams one clip after another: (group, at, reason)."""
    picks, starts = [], {}
    for g, at, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if len(picks) < n_minority and len(starts.get(g, [])) < per_group and all(abs(at - p) >= spacing for p in starts.get(g, [])):
            picks.append((g, at, "minority"))
            starts.setdefault(g, []).append(at)
    n = 0
    for g in sorted({r[0] for r in rows} - {r[0] for r in reviewed}, key=lambda g: int(g[1:])):
        own = sorted(r[1] for r in rows if r[0] == g)
        for i in np.linspace(0, len(own) - 1, min(per_group, len(own))).round().astype(int):
            if n < n_unlabelled and all(abs(own[i] - p) >= spacing for p in starts.get(g, [])):
                picks.append((g, own[i], "unlabeled"))
                starts.setdefault(g, []).append(own[i])
                n += 1
    return sorted({(g, int(at), why): (g, at, why) for g, at, why in reversed(picks + [(g, at, "rereview") for g, at, _ in reviewed])}.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_second_round_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(f"P{g}", at, round(rng.random(), 9)) for g in range(1, 9) for at in sorted({1.5 * rng.randrange(20) for _ in range(9)})]
    reviewed = [r for r in rows if r[0] == "P2"]
    kinds = "g string, at double, score double"
    got = sampling.second_round(spark.createDataFrame(rows, kinds), spark.createDataFrame(reviewed, kinds), "g", "at", "score", 9, 7, 3, 6.0)
    assert sorted((r["g"], r["at"], r["reason"]) for r in got.collect()) == loop_second_round(rows, reviewed, 9, 7, 3, 6.0)


def test_second_round_keeps_reasons_apart(spark):
    rows = spark.createDataFrame([("P1", 0.0, 9.0), ("P2", 3.0, 1.0), ("P2", 4.5, 2.0)], "g string, at double, score double")
    got = sampling.second_round(rows, rows.filter("g = 'P1'"), "g", "at", "score", 1, 5, 3, 6.0).collect()
    assert sorted((r["g"], r["at"], r["reason"], r["seg_id"]) for r in got) == [("P1", 0.0, "minority", 0), ("P1", 0.0, "rereview", 0), ("P2", 3.0, "unlabeled", 3)]
    numbered = sampling.second_round(rows, rows.filter("g = 'P1'").withColumn("seg_id", F.lit(42)), "g", "at", "score", 1, 5, 3, 6.0)
    assert [r["seg_id"] for r in numbered.filter("reason = 'rereview'").collect()] == [42]


@pytest.mark.parametrize("key_length", [1, 4, 9])
def test_prefix_match_equals_the_loop(spark, key_length):
    rng = random.Random(3)
    paths = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    stems = ["", "a", "b", "ab", "zz", "abab", "abababababab"] + [p[:rng.randint(1, 9)] for p in paths[:20]]
    got = joins.prefix_match(spark.createDataFrame([(s,) for s in set(stems)], "s string"), spark.createDataFrame([(p,) for p in paths], "p string"), "s", "p", key_length)
    assert {r["s"]: r["p"] for r in got.collect()} == {s: min(p for p in paths if p.startswith(s)) for s in stems if any(p.startswith(s) for p in paths)}


def test_match_videos(spark):
    videos = ["/v/gareth tread side front.mp4", "/v/P07 side.mp4", "/v/a_p007_side front.mp4", "/v/p7x side.mp4", "/v/7 Side front.mp4", "/v/7 side rear.mp4", "/v/P9 top side.mp4", "/v/0012 side.mp4", "/v/12a side.mp4", "/v/00 side.mp4"]
    rows = [("P07", "P7_Gareth_raw"), ("P07", "P07_side_raw"), ("P07", "P7_top"), ("P09", "P9_x"), ("P12", None), ("P99", "P12_Zed"), ("P3", "P3_side"), ("P00", "P0")]
    manual = spark.createDataFrame([("P3", "/m/3.mp4")], "participant string, video_path string")
    got = joins.match_videos(spark.createDataFrame(rows, "participant string, raw_stem string"), spark.createDataFrame([(v,) for v in videos], "path string"), manual)
    assert {(r["participant"], r["raw_stem"]): (r["video"], r["tier"]) for r in got.collect()} == {
        ("P07", "P7_Gareth_raw"): ("/v/gareth tread side front.mp4", 1), ("P07", "P07_side_raw"): ("/v/P07 side.mp4", 2), ("P07", "P7_top"): ("/v/P07 side.mp4", 2), ("P09", "P9_x"): (None, None),
        ("P12", None): ("/v/0012 side.mp4", 3), ("P99", "P12_Zed"): ("/v/0012 side.mp4", 3), ("P3", "P3_side"): ("/m/3.mp4", 0), ("P00", "P0"): ("/v/00 side.mp4", 3)}


def test_priority_and_last_file(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "i int, k string"), spark.createDataFrame([("a", "u", 2), ("a", "z", 1), ("a", "y", 1), ("b", "x", None)], "k2 string, u string, t int")
    assert [tuple(r) for r in joins.priority_match(left, right, F.col("k") == F.col("k2"), F.col("t"), ["i"], ["u"]).collect()] == [(1, 1, "y")]
    assert joins.last_file(right, "k2", "u").orderBy("k2").first()["u"] == "z"


def test_two_raters(spark):
    kinds = "source string, seg_id int, y int, exclude string"
    a = spark.createDataFrame([("f", 1, 2, None), ("f", 1, 0, "0"), ("f", 2, 1, "1"), ("g", 1, None, None)], kinds)
    b = spark.createDataFrame([("f", 1, 2), ("f", 2, 2), ("g", 1, 1)], "source string, seg_id int, y int")
    assert sorted(map(tuple, A.double_rated(a, b, "y").collect())) == [("f__1", 0, 2), ("f__1", 2, 2)]


def test_medians_of_few_and_many_groups(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.choice((1, 2, None)), rng.randrange(3), rng.gauss(0, 1), None if rng.random() < 0.5 else rng.random()) for _ in range(60)] + [(7, 7, None, 1.0)]
    df = spark.createDataFrame(rows, "g int, h int, a double, b double")
    want = {}
    for g, h in {r[:2] for r in rows}:
        own = [[r[i] for r in rows if r[:2] == (g, h) and r[i] is not None] for i in (2, 3)]
        want[g, h] = tuple(statistics.median(x) if x else None for x in own)
    for few in (200, 2):
        monkeypatch.setattr(stats, "FEW_GROUPS", few)
        got = {(r["g"], r["h"]): (r["a"], r["b"]) for r in stats.exact_medians(df, ["g", "h"], ["a", "b"]).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("n, missing", [(1, 0), (1, 3), (2, 1), (57, 0), (60, 13), (4, 40), (0, 3)])
def test_prepared_equals_step_by_step(spark, n, missing):
    rng = random.Random(n)
    rows = [(rng.gauss(5, 3), 1.0) for _ in range(n)] + [(None, 1.0)] * missing
    df = spark.createDataFrame(rows, "a double, b double")
    want = stats.robust_scaled(stats.imputed(stats.winsorized(df, ["a", "b"]), ["a", "b"]), ["a", "b"]).toPandas()
    got = stats.prepared(df, ["a", "b"]).toPandas()
    assert np.allclose(sorted(got.a), sorted(want.a)) and np.allclose(got.b, want.b)


def test_missing_share_and_shuffle(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1.0, None), (3, 1.0, 2.0)], "i int, a double, b double")
    assert [r["i"] for r in stats.present_enough(df, ["a", "b"]).collect()] == [3]
    order = df.select("i", sampling.hash_order("i", 5).alias("o")).orderBy("o").collect()
    assert sorted(r["i"] for r in order) == [1, 2, 3] and order == df.select("i", sampling.hash_order("i", 5).alias("o")).orderBy("o").collect()


def test_feedback_against_a_read_profile(spark, tmp_path):
    rows = spark.createDataFrame([("a", 10.0, 1.0, 0.0, 0.1), ("a", 14.0, 3.0, 0.2, 0.1), ("b", 80.0, 2.0, 1.4, 0.9)], "c string, trunk_angle_med double, arm_speed double, hip_depth_med double, head_sub_frac double")
    names = ["trunk_angle_med", "arm_speed", "hip_depth_med", "head_sub_frac"]
    profile = cluster.well_profile(rows, "c", names, "trunk_angle_med", "hip_depth_med", "head_sub_frac")
    assert profile["well_cluster"] == "a" and profile["well_profile"]["trunk_angle_med"] == 12.0 and profile["std"]["arm_speed"] == pytest.approx(1.0)
    (tmp_path / "p.json").write_text(json.dumps({"well_cluster": 1, "well_profile": profile["well_profile"], "std": profile["std"]}))
    read = readers.read_profile(spark, str(tmp_path / "p.json")).first().asDict()
    got = feedback.profile_feedback(rows, read, ["c"], least=1.0).orderBy("c", "rank").collect()
    assert [(r["c"], r["rank"], r["z"]) for r in got] == [("a", 1, 1.0), ("a", 1, 1.0), ("b", 1, 1.7), ("b", 2, 1.7), ("b", 3, 1.7)]
    said = {r["feature"]: r["message"] for r in got}
    assert set(said) == {"arm_speed", "trunk_angle_med", "hip_depth_med", "head_sub_frac"}
    assert said["trunk_angle_med"] == "Body angle 80 deg from flat (ideal ~12). Press chest down to raise hips." and said["head_sub_frac"].startswith("Head below the surface 90% of")
    assert feedback.issue_counts(spark.createDataFrame([("x",), ("y",), ("x",)], "feature string"), 1).first()["n"] == 2


def test_video_reports(spark):
    kinds = "source string, start_s double, valid_pct double, float_pred int, confidence double, trunk_angle_med double, hip_y_slope double"
    rows = [("good", 1.5 * i, 90.0, 2 if i not in (0, 9) else 0, 0.9, 10.0, 0.06) for i in range(10)] + [("poor", 1.5 * i, 90.0 if i < 3 else 10.0, 2, 0.9, 10.0, 0.0) for i in range(8)]
    rows += [("even", 1.5 * i, 60.0, i, 0.5, None, None) for i in range(2)] + [("none", 0.0, None, 1, None, None, None)]
    got = {r["video"]: r for r in report.video_reports(spark.createDataFrame(rows, kinds)).collect()}
    assert {v: r["classification"] for v, r in got.items()} == {"good": "FLOATING", "poor": "UNABLE TO ASSESS", "even": "UNCERTAIN (Not Floating)", "none": "UNABLE TO ASSESS"}
    assert got["poor"]["reason"] == "pose visibility too low (38% of windows reliable)" and got["none"]["windows_reliable"] == 0 and got["poor"]["fraction_not"] is None
    assert (got["good"]["fraction_floating"], got["good"]["confidence_pct"], got["good"]["posture"], got["good"]["vertical_movement"], got["good"]["arm_activity"]) == (1.0, 90.0, "horizontal", "sinking", "unknown")
    assert got["good"]["text"].split("\n")[:5] == ["Video: good [rule-based]", "Classification: FLOATING", "Confidence: 90%", "Mix: floating 100% / almost 0% / not 0%", "Posture: horizontal (trunk 10.0°)"]
    assert got["even"]["posture"] == "unknown" and "trunk unknown" in got["even"]["text"]


def test_assessments(spark):
    rng = random.Random(1)
    rows = [(f"P{i % 4}_f.csv", 100.0 if i % 7 else 10.0, i % 4 % 3, (i % 4) + rng.gauss(0, 0.1)) for i in range(160)]
    df = spark.createDataFrame(rows, "source string, valid_pct double, y int, a double")
    models = {"trunk": learn.fitted(df, "y", ["a"], learn.challengers()["tree"]), "other": learn.fitted(df, "y", ["a"], learn.challengers()["softmax"])}
    got = {r["source"]: r for r in report.assessments(df, models).collect()}
    assert {s: (r["trunk"], r["trunk_label"]) for s, r in got.items()} == {"P0_f.csv": (0, "vertical"), "P1_f.csv": (1, "diagonal"), "P2_f.csv": (2, "horizontal"), "P3_f.csv": (0, "vertical")}
    assert sum(r["n_windows"] for r in got.values()) == sum(x[1] > 60 for x in rows) and all(0 < r["trunk_conf"] <= 1 and r["other_label"] == str(r["other"]) for r in got.values())


def test_files_of_two_generations(spark, tmp_path):
    (tmp_path / "P01_features.csv").write_text("video_id,start_s,end_s,torso_valid_pct,hip_y_med\nv,0.0,3.0,80,0.5\n")
    (tmp_path / "P02_features.csv").write_text("end_s,start_s,valid_pct,hip_depth_med,video_id\n3.0,0.0,90,1.5,w\n")
    rows = {r["participant"]: r for r in readers.read_features(spark, str(tmp_path / "*.csv")).collect()}
    assert rows["P01"]["hip_y_med"] == 0.5 and rows["P01"]["hip_depth_med"] is None and rows["P02"]["hip_depth_med"] == 1.5 and rows["P02"]["hip_y_med"] is None
    assert rows["P02"]["win_center"] == 1.5 and rows["P01"]["valid_pct"] == 80.0
    with pytest.raises(FileNotFoundError, match="no feature files"):
        readers.read_features(spark, str(tmp_path / "none*.csv"))


def test_landmark_files_and_sealed_participants(spark, tmp_path):
    frames = synthetic_landmarks(spark, "/root/testdata/sf0.001").filter("user_id IN (1, 2)").withColumnRenamed("user_id", "frame")
    full = frames.select(*[c if c in frames.columns else F.lit(float("nan")).alias(c) for c in (x.split(" ")[0] for x in schemas.FRAMES.split(", "))])
    writers.write_csv(full, str(tmp_path / "P01_raw.csv"))
    read = readers.read_landmarks(spark, str(tmp_path / "P01_raw.csv"))
    assert read.count() == full.count() and read.filter("left_ear_x IS NOT NULL").count() == 0
    assert features.window_features(read, False).count() == features.window_features(full, False).count()
    rows = spark.createDataFrame([("P07", "P7_Top_features.csv"), ("P08", "P8_side.csv")], "participant string, source string")
    sealed = spark.createDataFrame([("p7",)], "participant string")
    assert [r[0] for r in readers.without_participants(rows, sealed).collect()] == ["P08"] and [r[0] for r in readers.only_participants(rows, sealed).collect()] == ["P07"]
    assert [r[0] for r in rows.filter(readers.name_excludes(F.col("source"), "top", "rear")).collect()] == ["P08"]


def test_manifest_of_unreadable_files(spark):
    files = spark.createDataFrame([("/v/7 Side front.mp4",), ("/v/P3_T02_rear.mp4",)], "path string")
    probes = spark.createDataFrame([("/v/7 Side front.mp4", 29.97, 640, 360, 300)], "path string, fps double, width int, height int, frames int")
    got = {r["video_id"]: (r["fps"], r["duration_s"], r["frames"], r["readable"], r["exercise"]) for r in readers.manifest(files, probes=probes).collect()}
    assert got == {"V07_T01_side_front": (29.97, 10.0, 300, True, "back_float"), "P03_T02_side_rear": (0.0, 0.0, 0, False, "back_float")}
    assert readers.manifest(files).columns == [c.split(" ")[0] for c in schemas.MANIFEST.split(", ")]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "P07_features.csv").write_text("video_id,start_s,end_s,torso_valid_pct,trunk_angle_med\nv,0.0,3.0,80,nan\nv,1.5,4.5,20,12.5\n")
    rows = readers.read_features(spark, str(tmp_path / "*.csv")).collect()
    assert len(rows) == 1 and rows[0]["participant"] == "P07" and rows[0]["trunk_angle_med"] is None and rows[0]["win_center"] == 1.5
    df = spark.createDataFrame([("top", 1), ("side", 2)], "view string, x int")
    writers.write_by_view(df, str(tmp_path / "views"))
    assert spark.read.parquet(str(tmp_path / "views")).filter("view = 'top'").first()["x"] == 1
    writers.write_json(df, str(tmp_path / "json"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "json")).collect()) == ['{"view":"side","x":2}', '{"view":"top","x":1}']
    assert writers.clip_manifest_json(df, ["x"]).first()[0] == '[{"view":"top","x":1},{"view":"side","x":2}]'
    (tmp_path / "videos" / "a").mkdir(parents=True)
    (tmp_path / "videos" / "a" / "P1_top.MP4").write_bytes(b"x")
    (tmp_path / "videos" / "n.txt").write_bytes(b"x")
    assert readers.video_index(spark, str(tmp_path / "videos")).count() == 1


def test_stream_windows(spark, tmp_path):
    from posemill.streaming.live import live_windows

    spark.sql("SELECT 'a' AS k, timestamp_seconds(id) AS ts, cast(id AS double) AS x FROM range(0, 60)").write.parquet(str(tmp_path / "in"))
    frames = spark.readStream.schema("k string, ts timestamp, x double").parquet(str(tmp_path / "in"))
    run = live_windows(frames, "k", "ts", "x").writeStream.outputMode("complete").format("memory").queryName("live").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("live").filter("n = 3").count() > 10
