"""Declared schemas (DDL) of every table the engine reads or writes."""

from __future__ import annotations

RUN_KEY = ["kernel", "dataset", "scenario_id", "source", "target", "prep"]

SIGNALS = (
    "signal_id long, domain int, fault_type string, crack_size string, label int, is_anomaly int, "
    "sampling_rate int, load_torque_nm double, radial_force_n double, data array<double>"
)
WINDOWS = ("signal_id long, domain int, fault_type string, is_anomaly int, split string, win_idx long, x array<double>")
FEATURES = ("signal_id long, domain int, fault_type string, is_anomaly int, split string, win_idx long, features array<float>")
MODELS = (
    "scenario_id string, kernel string, gamma double, coef0 double, degree double, c double, r2 double, "
    "center_norm_sq double, n_sv int, tier int, iterations int, gap double, error string, prep string"
)
SUPPORT_VECTORS = ("scenario_id string, sv_idx int, alpha double, x array<double>, prep string")
RUN_COLUMNS = "kernel string, dataset string, scenario_id string, source string, target string, prep string"
DISTANCES = f"grp string, signal_id long, win_idx long, d double, r double, rho_inner double, rho_outer double, {RUN_COLUMNS}"
STREAM = f"stream_pos long, decision int, score double, y_true int, r_trace double, latency_s double, r_pretrain double, r_final double, {RUN_COLUMNS}"
RUN_METRICS = (
    "kernel string, dataset string, scenario_id string, source string, target string, prep string, otta_mode string, r double, r_final double, "
    "mmd2 double, wasserstein_1d_distance double, n_source_train long, n_target_normal long, n_target_fault long, feature_dim int, n_warmup long, "
    "buffer_size long, rho_inner double, rho_outer double, n_sv int, error string"
)
ZONE_JSON = (
    "zone_combinations array<struct<r_inner_percentile:double,r_outer_percentile:double,r_inner:double,r_outer:double,"
    "by_group:map<string,struct<count:long,inner_pct:double,adaptation_pct:double,outer_pct:double,mean_d:double,std_d:double>>>>"
)
EVENTS = ("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
