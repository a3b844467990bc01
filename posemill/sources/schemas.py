"""Explicit schemas of the tables; nothing is inferred from headers."""

from __future__ import annotations

#: The landmarks of a frame, in the order of the source's columns.
LANDMARKS = (
    "nose", "left_eye_inner", "left_eye", "left_eye_outer", "right_eye_inner", "right_eye", "right_eye_outer", "left_ear", "right_ear",
    "mouth_left", "mouth_right", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist", "left_pinky",
    "right_pinky", "left_index", "right_index", "left_thumb", "right_thumb", "left_hip", "right_hip", "left_knee", "right_knee",
    "left_ankle", "right_ankle", "left_heel", "right_heel", "left_foot_index", "right_foot_index",
)
FRAMES = ", ".join(["video_id string", "participant_id string", "camera_view string", "frame int", "time_sec double",
                    *[f"{p}_{c} double" for p in LANDMARKS for c in ("x", "y", "z", "visibility")]])
_SPEEDS = ("arm_freq_l", "arm_freq_r", "leg_freq_l", "leg_freq_r", "arm_speed_l", "arm_speed_r", "leg_speed_l", "leg_speed_r", "arm_speed", "leg_speed", "arm_asym", "leg_asym")
WINDOWS = ", ".join([
    "video_id string", "participant_id string", "pid string", "view string", "start_s double", "end_s double",
    *[f"{c} double" for c in ("trunk_angle_med", "trunk_angle_std", "trunk_angle_slope", "hip_y_med", "hip_y_std", "hip_y_slope", "ankle_y_med", "knee_angle_med_deg", *_SPEEDS,
                              "torso_valid_pct", "valid_pct", "left_arm_valid_pct", "right_arm_valid_pct", "left_leg_valid_pct", "right_leg_valid_pct",
                              "mean_torso_conf", "mean_arm_conf", "mean_leg_conf", "nose_low_vis_frac")]])
#: Columns of the earlier generation of windows that the current one has not.
LEGACY = "hip_depth_med double, hip_depth_std double, ankle_depth double, hip_depth_slope double, head_sub_frac double, mean_pose_conf double"
LABELS = ("source string, participant string, seg_id int, start_s double, end_s double, float_label int, passive_active int, posture int, stability int, "
          "label_confidence int, exclude int, annotator_id string, annotation_round int, notes string, reason string")
EXPERT = ("participant string, floating_outcome int, activity int, trunk_position int, head_position int, airway string, overall_score int, window_start double, window_end double")
SPLITS = "participant string, split string"
CLIPS = "clip string, participant string, source string, raw_stem string, start_s double, end_s double, seg_id int, cluster int, reason string"
MANIFEST = ("video_id string, participant_id string, trial_id string, view string, filename string, fps double, duration_s double, width int, height int, frames int, "
            "exercise string, readable boolean, sha256 string")
#: Names of one column in different generations of the tables.
ALIASES = {"pid": "participant_id", "valid_pct": "torso_valid_pct", "torso_valid_pct": "valid_pct", "source": "video_id"}
