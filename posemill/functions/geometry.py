"""Geometry of body landmarks in one frame; y grows downward, lengths are in units of the coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from posemill.functions.nulls import holds, mean_present

#: Fixed values of the current feature set.
MIN_VISIBILITY = 0.5
ASPECT = 16.0 / 9.0
EPSILON = 1e-9


def visible(confidence: Column, least: float = MIN_VISIBILITY) -> Column:
    return holds(confidence > F.lit(least))


def all_visible(*confidences: Column, least: float = MIN_VISIBILITY) -> Column:
    out = F.lit(True)
    for c in confidences:
        out = out & visible(c, least)
    return out


#: Fixed values of the earlier feature set: the joints whose visibility makes a frame valid, and their least confidence.
BODY_JOINTS = ("left_shoulder", "right_shoulder", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle")
LEGACY_VISIBILITY = 0.35


def frame_validity(*confidences: Column, least: float = LEGACY_VISIBILITY) -> dict[str, Column]:
    """valid: the share of joints that are visible; pose_conf: their mean confidence. Without a detection both are 0."""
    seen, sure = F.lit(0.0), F.lit(0.0)
    for c in confidences:
        seen, sure = seen + visible(c, least).cast("double"), sure + F.coalesce(c, F.lit(0.0))
    return {"valid": seen / len(confidences), "pose_conf": sure / len(confidences)}


def corrected_x(x: Column, aspect: float = ASPECT) -> Column:
    """x in the units of y."""
    return x * F.lit(aspect)


def midpoint(left: Column, right: Column) -> Column:
    return (left + right) / 2


def torso_length(shoulder_x: Column, shoulder_y: Column, hip_x: Column, hip_y: Column) -> Column:
    return F.hypot(shoulder_x - hip_x, shoulder_y - hip_y)


def trunk_angle(shoulder_x: Column, shoulder_y: Column, hip_x: Column, hip_y: Column) -> Column:
    """Degrees between the trunk and the horizontal: 0 to 90."""
    return F.degrees(F.atan2(F.abs(shoulder_y - hip_y), F.abs(shoulder_x - hip_x)))


def joint_angle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Degrees at b between the directions to a and c."""
    ux, uy, vx, vy = ax - bx, ay - by, cx - bx, cy - by
    cosine = (ux * vx + uy * vy) / (F.hypot(ux, uy) * F.hypot(vx, vy) + EPSILON)
    return F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))))


def depth_below(y: Column, water_line: Column, torso: Column) -> Column:
    """Torso lengths below the water line; NULL for a torso of at most one unit."""
    return F.when(torso > 1, (y - water_line) / torso)


def head_y(nose: Column, nose_seen: Column, left_ear: Column, left_seen: Column, right_ear: Column, right_seen: Column) -> Column:
    """The nose if visible, else the mean of the visible ears."""
    return F.coalesce(F.when(nose_seen, nose), mean_present(F.when(left_seen, left_ear), F.when(right_seen, right_ear)))


def submerged(head: Column, water_line: Column) -> Column:
    """1.0 if the head is below the water line, 0.0 if not, NULL if unknown."""
    return (head > water_line).cast("double")


def symmetry_index(left: Column, right: Column) -> Column:
    """0 (equal) to 1 (one side only); NULL if a side is missing or both are 0."""
    return F.when(left + right > 0, F.abs(left - right) / (left + right))


def balance_percent(left: Column, right: Column) -> Column:
    both = left.isNotNull() & right.isNotNull() & (F.greatest(left, right) > 0)
    return F.when(both, 100 * F.least(left, right) / F.greatest(left, right))


def window_center(start: Column, end: Column) -> Column:
    return (start + end) / 2


def clamp(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def flotation_index(angle: Column, hip_depth: Column, head_share: Column) -> Column:
    """0 to 1: flat trunk 45 %, shallow hips 35 %, head above water 20 %."""
    raw = 0.45 * F.cos(F.radians(angle)) + 0.35 * (1 - clamp(hip_depth, 0.0, 1.5) / 1.5) + 0.20 * (1 - clamp(head_share, 0.0, 1.0))
    return clamp(raw, 0.0, 1.0)


def flotation_label(index: Column) -> Column:
    return F.when(index >= 0.72, "Well").when(index >= 0.45, "Marginal").when(index.isNotNull(), "NotFloating")


def coaching_factors(angle: Column, angle_std: Column, drift: Column, arm: Column, leg: Column) -> dict[str, Column]:
    """Flatness, steadiness, level and stillness, 0 to 100; NULL where an input is missing. Stillness goes by the busier
    of arms and legs, or by the arms alone where legs are missing."""
    def score(value: Column, most: float) -> Column:
        return F.when(value.isNotNull(), clamp(100 * (1 - F.least(value, F.lit(most)) / most), 0.0, 100.0))
    effort = F.when(arm.isNotNull(), F.greatest(arm, leg))
    return {"flatness": score(F.abs(angle), 90.0), "steadiness": score(angle_std, 15.0), "level": score(F.abs(drift), 0.1), "stillness": score(effort, 6.0)}


def cycle_count(per_minute: Column, seconds: Column) -> Column:
    return per_minute * seconds / 60
