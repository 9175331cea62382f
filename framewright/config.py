"""Thresholds of the checks."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    # Names and defaults of the thresholds.
    gap_factor: float = 1.5
    idle_fraction_of_p75: float = 0.1
    idle_smoothing_s: float = 0.2
    trim_pad_s: float = 0.25
    min_trimmable_idle_s: float = 1.0
    max_idle_fraction: float = 0.4
    max_pause_s: float = 3.0
    spike_factor: float = 6.0
    stale_state_max_fraction: float = 0.1
    outlier_z: float = 3.5
    min_relative_length_diff: float = 0.25
    jerk_z: float = -3.0
    min_ldlj_diff: float = 1.0
    sync_max_lag_s: float = 0.5
    sync_min_peak_corr: float = 0.4
    sync_corr_min_drop: float = 0.25
    sync_lag_outlier_frames: float = 2.0
    dedupe_resample_len: int = 50
    dedupe_z: float = 3.0
    gripper_active_frac: float = 0.5
    gripper_hysteresis_frac: float = 0.15
    gripper_chatter_window_s: float = 1.0
    gripper_chatter_min_toggles: int = 4
    camera_dark_mean_max: float = 0.03
    camera_dark_std_max: float = 0.02
    video_decode_max_samples: int = 20
    video_dark_run_min_frac: float = 0.15
    video_freeze_max_abs_diff: float = 0.03
    angular_wrap_tol: float = 0.05
    angular_wrap_reach: float = 0.3
    angular_pair_cancel_frac: float = 0.25
    smoothness_dim_outlier_z: float = 4.0
    smoothness_ramp_gap_frames: int = 10

    def override(self, **values) -> Config:
        """A copy with other values. Unknown names and values of the wrong type (a bool is no number) are errors."""
        kinds = {f.name: int if isinstance(f.default, int) else float for f in fields(self)}
        done = {}
        for name, value in values.items():
            if name not in kinds:
                raise ValueError(f"unknown threshold {name!r}; known: {', '.join(sorted(kinds))}")
            if isinstance(value, bool) or not isinstance(value, (int, float)) or (kinds[name] is int and value != int(value)):
                raise ValueError(f"threshold {name!r} needs {'a whole number' if kinds[name] is int else 'a number'}, not {value!r}")
            done[name] = kinds[name](value)
        return replace(self, **done)

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """Overrides from a TOML file."""
        try:
            values = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        except tomllib.TOMLDecodeError as e:
            raise ValueError(f"{path} is no valid TOML: {e}") from e
        return cls().override(**values)


#: Every check that can be disabled, in the order of its flags.
CHECKS = ("timing", "metadata", "integrity", "video_sync", "camera", "video_freeze", "idle", "smoothness", "stale_state", "sync", "gripper_chatter", "length", "duplicate")
