"""Key columns and column roles."""

from __future__ import annotations

from dataclasses import dataclass

KEYS = ("scenario_id", "drop_id", "target_id")
SCENE = ("scenario_id", "drop_id")
#: Columns that two mutual nearest neighbours share.
MATCH_COLS = ("scenario_id", "drop_id", "nn_norm_range_sep")
#: Names of the range-error regimes, by label.
REGIMES = ("bulk", "sideband+", "sideband-", "far+", "far-", "near")


#: The features of the models, in the order of their tables.
INDEP_FEATURES = (
    "bistatic_range_m", "log_R", "az_off_boresight", "rx_elevation_deg", "radial_velocity", "abs_bistatic_doppler_hz", "speed", "abs_frac_u", "abs_frac_v", "n_mpc", "rss_max", "rss_total_db",
    "k_factor_db", "dom_excess_delay", "rms_delay_spread", "aoa_spread_w", "zoa_spread_w", "first_rss_minus_dom", "n_targets", "nn_norm_range_sep", "nn_norm_ang_sep",
)
SHARED_FEATURES = ("n_targets", "nn_norm_range_sep", "nn_norm_ang_sep")
POSITION_FEATURES = (
    "bistatic_range_m", "abs_bistatic_doppler_hz", "log_R", "rx_elevation_deg", "rx_azimuth_deg", "az_off_boresight", "frac_u", "frac_v", "abs_frac_u", "abs_frac_v", "u_true", "v_true", "n_mpc", "rss_max",
    "rss_total_db", "k_factor_db", "dom_excess_delay", "rms_delay_spread", "aoa_spread_w", "zoa_spread_w", "first_rss_minus_dom", "n_targets", "nn_norm_range_sep", "nn_norm_ang_sep",
)
POSITION_LABELS = ("position_error_3d_m", "range_error_m", "rx_azimuth_error_deg", "rx_elevation_error_deg", "slip_v", "slip_u")
#: Levels of the conditional quantiles.
LEVELS = (0.005, 0.01, 0.025, *(i / 20 for i in range(1, 20)), 0.975, 0.99, 0.995)


def union(*lists: tuple[str, ...]) -> tuple[str, ...]:
    """Names of all lists, each once, in order."""
    return tuple(dict.fromkeys(name for names in lists for name in names))


@dataclass(frozen=True)
class Roles:
    """Which columns of one frame are tags, labels and features."""

    tags: tuple[str, ...]
    labels: tuple[str, ...]
    features: tuple[str, ...]


PAIR_OWN = tuple(f for f in INDEP_FEATURES if f not in SHARED_FEATURES)
PAIR_FEATURES = (*(f"{f}_{side}" for f in PAIR_OWN for side in "ab"), *SHARED_FEATURES)
INDEPENDENT = Roles(KEYS, ("detected",), INDEP_FEATURES)
PAIRS = Roles((*SCENE, "target_id_a", "target_id_b"), ("detected_a", "detected_b", "score"), PAIR_FEATURES)
POSITION = Roles(KEYS, POSITION_LABELS, POSITION_FEATURES)
CLASSIFIER = Roles(KEYS, ("detected",), union(INDEP_FEATURES, (*PAIR_OWN, *SHARED_FEATURES)))
