"""Ids from file names, bands, recodes and the rule classifier: plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from posemill.functions.nulls import holds, mean_present


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or NULL."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def base_name(path: Column) -> Column:
    """Without folders and without the last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(.)\.[^.]*$", "$1")


def _number(digits: Column) -> Column:
    """Digits of any length without leading zeros."""
    return F.regexp_replace(digits, r"^0+(?=\d)", "")


def _two_digits(digits: Column) -> Column:
    bare = _number(digits)
    return F.when(F.length(bare) < 2, F.concat(F.lit("0"), bare)).otherwise(bare)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def participant_id(path: Column, mode: str = "standard") -> Column:
    """A participant's id from a file name or label.

    standard: P and a number anywhere is P07; else a leading number is V07; else the first 8 characters. person: without
    the V form. keep: text without P and a number stays as it is. short: only at the start, and not padded (P7); else
    the whole file name. Numbers may be of any length.
    """
    stem = base_name(path)
    if mode == "keep":
        return F.coalesce(F.concat(F.lit("P"), _two_digits(_group(path, r"[Pp](\d+)"))), path)
    if mode == "short":
        return F.coalesce(F.concat(F.lit("P"), _number(_group(file_name(path), r"^[Pp](\d+)"))), file_name(path))
    forms = [F.concat(F.lit("P"), _two_digits(_group(stem, r"[Pp](\d+)")))]
    if mode == "standard":
        forms.append(F.concat(F.lit("V"), _two_digits(_group(stem, r"^\s*(\d+)"))))
    return F.coalesce(*forms, F.substring(stem, 1, 8))


def manifest_participant(path: Column) -> Column:
    """P07, or V07 for a leading number, else P??."""
    stem = base_name(path)
    return F.coalesce(F.concat(F.lit("P"), _two_digits(_group(stem, r"[Pp](\d+)"))), F.concat(F.lit("V"), _two_digits(_group(stem, r"^\s*(\d+)"))), F.lit("P??"))


def manifest_view(path: Column) -> Column:
    """The camera's view by the words of the name, the first that applies."""
    name = F.lower(base_name(path))
    has = name.contains
    return (F.when(has("top"), "top").when(has("side") & has("rear"), "side_rear").when(has("side") & has("front"), "side_front")
            .when(has("front"), "front").when(has("rear"), "side_rear").otherwise("unknown"))


def manifest_trial(path: Column) -> Column:
    """T and one or two digits not followed by a letter or digit; T01 if there is none."""
    return F.coalesce(F.concat(F.lit("T"), _two_digits(_group(base_name(path), r"[Tt](\d{1,2})(?![A-Za-z0-9])"))), F.lit("T01"))


#: Words that follow a participant's number but are no names.
NAME_STOPS = ("side", "front", "top", "view", "raw", "features", "min", "3min", "rear", "tread", "p")


def name_token(stem: Column) -> Column:
    """The first word of three letters or more after P, a number and an underscore that is no stop word, in lower case;
    an ending _raw or _raw_features doesn't count."""
    bare = F.regexp_replace(stem, r"_raw(_features)?(\.csv)?$", "")
    words = F.transform(F.regexp_extract_all(bare, F.lit(r"[pP]\d+_([a-zA-Z]+)"), F.lit(1)), F.lower)
    return F.get(F.filter(words, lambda w: ~w.isin(*NAME_STOPS) & (F.length(w) >= 3)), F.lit(0))


def sanitized(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def csv_quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def natural_key(name: Column) -> Column:
    """The first number in a name; those without one come last."""
    return F.coalesce(_group(name, r"(\d+)").try_cast("long"), F.lit(1_000_000_000))


def band(value: Column, low: float, high: float, labels: tuple[str, str, str]) -> Column:
    return F.when(value.isNull(), "unknown").when(value < low, labels[0]).when(value < high, labels[1]).otherwise(labels[2])


def posture_band(angle: Column) -> Column:
    return band(angle, 20, 45, ("horizontal", "inclined", "near-vertical"))


def stability_band(angle_std: Column) -> Column:
    return band(angle_std, 8, 14, ("high", "moderate", "low"))


def activity_band(speed: Column) -> Column:
    return band(speed, 2.5, 5.0, ("low", "moderate", "high"))


def drift_sign(slope: Column) -> Column:
    """Missing drift counts as stable."""
    return F.when(slope < -0.05, "rising").when(slope > 0.05, "sinking").otherwise("stable")


def symmetry_label(asymmetry: Column) -> Column:
    return F.when(asymmetry.isNull(), "unknown").when(asymmetry < 0.3, "balanced").otherwise("asymmetric")


def overlay_tag(angle: Column) -> Column:
    return F.when(angle < 20, "FLAT").when(angle < 45, "PARTIAL").when(angle.isNotNull(), "UPRIGHT")


def kappa_text(kappa: Column) -> Column:
    return (F.when(kappa < 0.2, "slight").when(kappa < 0.4, "fair").when(kappa < 0.6, "moderate").when(kappa < 0.8, "substantial")
            .when(kappa.isNotNull(), "almost perfect"))


def reversed_rating(value: Column) -> Column:
    """2 - value: posture as trunk position, passive-active as activity."""
    return 2 - value


def floating_outcome(float_label: Column, passive_active: Column) -> Column:
    """0 and 1 as they are; 2 is 3 if passive and 2 if not."""
    return F.when(float_label.isin(0, 1), float_label).when(float_label == 2, F.when(passive_active == 0, 3).otherwise(2))


def cumulative_class(outcome: Column) -> Column:
    """Classes 2 and 3 count as one."""
    return F.when(outcome.isin(0, 1), outcome).when(outcome.isin(2, 3), 2)


def score_total(*parts: Column) -> Column:
    """The sum of all parts; NULL if one is missing."""
    out = F.lit(0)
    for p in parts:
        out = out + p
    return out


def confidence_weight(confidence: Column) -> Column:
    return F.when(confidence == 2, 1.0).when(confidence == 1, 0.6).when(confidence == 0, 0.25).otherwise(0.8)


def effort(arm_speed: Column, leg_speed: Column) -> Column:
    return mean_present(arm_speed, leg_speed)


def alignment(angle: Column, steep: float = 45.0) -> Column:
    """Missing angle: vertical, as all that is not below a bound."""
    return F.when(angle < 20, "horizontal").when(angle < steep, "angled").otherwise("vertical")


def effort_level(value: Column, threshold: Column) -> Column:
    return F.when(value < 0.6 * threshold, "low").when(value < threshold, "moderate").otherwise("high")


#: The reasons of the rule classifier, and the names of behaviour clusters.
SINKING = "sinking (hips dropping over time)"
STRUGGLING = "unstable and working hard (struggling)"
STABLE = "stable, head clear, low effort, staying at the surface"
MAINTAINING = "maintaining with effort or mild instability"
EFFICIENT = "efficient float (flatter body, low effort)"
ASSISTED = "movement-assisted float (flatter body, high effort)"
RECOVERING = "struggling / recovery (steeper body, high effort)"
INACTIVE = "sinking / vertical / inactive (steeper body, low effort)"


def rule_class(angle_std: Column, slope: Column, effort_value: Column, effort_threshold: Column, std_limit: float = 12.0, sink_limit: float = 0.05,
               strict: bool = False) -> dict[str, Column]:
    """float_pred 0 (sinking or struggling), 1 (maintaining) or 2 (floating), and the reason. A missing measure passes
    its test; with strict it makes the class NULL."""
    sinks, unstable, works = holds(slope > sink_limit), holds(angle_std > std_limit), holds(effort_value > effort_threshold)
    low, good = sinks | (unstable & works), ~sinks & ~unstable & ~works
    predicted = F.when(low, 0).when(good, 2).otherwise(1)
    if strict:
        predicted = F.when(slope.isNotNull() & angle_std.isNotNull() & effort_value.isNotNull(), predicted)
    reason = F.when(sinks, SINKING).when(low, STRUGGLING).when(good, STABLE).otherwise(MAINTAINING)
    return {"float_pred": predicted, "reason": reason}


def quadrant(flatter: Column, high: Column) -> Column:
    """A cluster's name by posture and effort."""
    return F.when(flatter & ~high, EFFICIENT).when(flatter & high, ASSISTED).when(~flatter & high, RECOVERING).otherwise(INACTIVE)


def class_name(value: Column, names: tuple[str, ...]) -> Column:
    """The class's name, or its number where there is none."""
    return F.coalesce(F.get(F.array(*map(F.lit, names)), value.cast("int")), value.cast("string"))


def clip_window(start: Column, window: float = 3.0, clip: float = 8.0) -> dict[str, Column]:
    """Start and end of a clip centred on a window, not before 0, to one decimal."""
    low = F.bround(F.greatest(F.lit(0.0), start + window / 2 - clip / 2), 1)
    return {"clip_start": low, "clip_end": low + clip}


def clip_file(participant: Column, start: Column) -> Column:
    """The participant and the start's whole seconds, cut off."""
    return F.format_string("%s__%04d.mp4", participant, start.cast("int"))


def abstention(reliable: Column, total: Column, confidence: Column, least_share: float = 0.40, least_confidence: float = 0.55) -> Column:
    """UNABLE without enough reliable windows, UNCERTAIN with little confidence, else OK."""
    return (F.when((reliable == 0) | (reliable / total < least_share), "UNABLE").when(confidence < least_confidence, "UNCERTAIN").otherwise("OK"))


#: What is said of a feature that is far from the profile; %v is the window's value, %r the profile's.
MESSAGES = {
    "trunk_angle_med": "Body angle %v deg from flat (ideal ~%r). Press chest down to raise hips.",
    "hip_depth_med": "Hips sitting low in the water. Lift the hips toward the surface.",
    "head_sub_frac": "Head below the surface %v of the time. Keep the head back, airway clear.",
    "arm_speed": "Arm/hand speed differs from a steady float (yours %v body-len/s).",
    "leg_speed": "Leg speed differs from a steady float (yours %v body-len/s).",
    "leg_asym": "Left/right leg cadence uneven (asymmetry %v). Balance the kick.",
    "arm_asym": "Left/right arm cadence uneven (asymmetry %v). Balance the arms.",
    "trunk_angle_std": "Body angle unsteady (varies %v deg). Hold a steadier position.",
}
#: Their numbers: whole degrees, a whole percentage, else two decimals.
_DIGITS = {"trunk_angle_med": "%.0f", "trunk_angle_std": "%.0f", "head_sub_frac": "%.0f%%"}


def profile_message(feature: str, value: Column, ideal: Column) -> Column:
    shown = lambda c: F.format_string(_DIGITS.get(feature, "%.2f"), 100 * c if feature == "head_sub_frac" else c)
    return F.replace(F.replace(F.lit(MESSAGES[feature]), F.lit("%v"), shown(value)), F.lit("%r"), shown(ideal))


def feature_message(feature: Column, z: Column, texts: dict[str, tuple[str, str]]) -> Column:
    """The text for a feature that is too high (first) or too low (second)."""
    out = F.lit(None).cast("string")
    for name, (high, low) in texts.items():
        out = F.when(feature == name, F.when(z > 0, high).otherwise(low)).otherwise(out)
    return out
