"""DuckDB twins of the queries."""

from __future__ import annotations

from orrery.operators.scoring import EPS

SIG = """sig AS (
  SELECT row_number() OVER (ORDER BY domain, channel) AS signal_id, domain,
    CASE WHEN channel IN ('view','click','signup') THEN 'N' ELSE channel END AS fault_type,
    CASE WHEN channel IN ('view','click','signup') THEN 0 ELSE 1 END AS is_anomaly, data
  FROM (SELECT (user_id % 4)::INTEGER AS domain, event_type AS channel, list(value ORDER BY ts, event_id) AS data
        FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2))"""
CUT = """cut AS (
  SELECT *, round_even(len(data) * 0.7::DOUBLE, 0)::INTEGER AS a, round_even(len(data) * 0.15::DOUBLE, 0)::INTEGER AS b, len(data)::INTEGER AS n FROM sig),
parts AS (
  SELECT signal_id, domain, fault_type, is_anomaly, data, 'train' AS split, 0 AS start_idx, a AS n_samples FROM cut WHERE is_anomaly = 0
  UNION ALL SELECT signal_id, domain, fault_type, is_anomaly, data, 'val', a, b FROM cut
  UNION ALL SELECT signal_id, domain, fault_type, is_anomaly, data, 'test', a + b, n - a - b FROM cut),
chunks AS (SELECT signal_id, domain, fault_type, is_anomaly, split, start_idx, n_samples, data[start_idx + 1 : start_idx + n_samples] AS data FROM parts)"""
WIN = """win AS (
  SELECT signal_id, domain, fault_type, is_anomaly, win_idx, data[win_idx * 16 + 1 : win_idx * 16 + 16] AS x
  FROM (SELECT *, unnest(range(len(data) // 16)) AS win_idx FROM sig))"""
Z = """z AS (
  SELECT signal_id, win_idx, list_transform(x, lambda v: ((v - m) / CASE WHEN s < 1e-10 THEN 1.0 ELSE s END)::FLOAT) AS z
  FROM (SELECT *, sqrt(list_sum(list_transform(x, lambda v: (v - m) * (v - m))) / len(x)) AS s
        FROM (SELECT *, list_sum(x) / len(x) AS m FROM win)))"""
CEP = """el AS (SELECT signal_id, win_idx, unnest(z)::DOUBLE AS v, generate_subscripts(z, 1) - 1 AS t FROM z),
ft AS (SELECT signal_id, win_idx, k, ln(sqrt(power(sum(v * cos(2 * pi() * k * t / 16)), 2) + power(sum(v * sin(2 * pi() * k * t / 16)), 2)) + 1e-12) AS l
       FROM el, range(16) r(k) GROUP BY ALL),
cep AS (SELECT signal_id, win_idx, q, (sum(l * cos(2 * pi() * k * q / 16)) / 16)::FLOAT AS c FROM ft, range(9) r(q) GROUP BY ALL)"""
VEC = """v AS (SELECT vec_id, embedding AS x, label FROM embeddings),
tr AS (SELECT * FROM v WHERE label < 5 AND vec_id % 2 = 0),
tn AS (SELECT * FROM v WHERE label < 5 AND vec_id % 2 = 1)"""
SC = (
    VEC
    + """,
cen AS (SELECT list(m ORDER BY p) AS c FROM (SELECT p, avg(e) AS m FROM (SELECT unnest(x)::DOUBLE AS e, generate_subscripts(x, 1) AS p FROM tr) GROUP BY p)),
dd AS (SELECT vec_id, label, list_sum(list_transform(list_zip(x, c), lambda t: power(t[1]::DOUBLE - t[2], 2))) AS d2 FROM v, cen),
rr AS (SELECT max(d2) AS r2 FROM dd WHERE label < 5 AND vec_id % 2 = 0),
sc AS (SELECT vec_id, label, 'linear' AS kernel, CASE WHEN (vec_id // 2) % 2 = 0 THEN 'alpha' ELSE 'beta' END AS dataset, '1_to_2' AS scenario_id, 'A' AS source, 'B' AS target,
  'p' || ((vec_id // 4) % 3) AS prep, CASE WHEN label >= 5 THEN 'target_fault' WHEN vec_id % 2 = 0 THEN 'source_train' ELSE 'target_normal' END AS grp,
  CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y_true, sqrt(d2) AS d, d2, sqrt(r2) AS r, r2, round(sqrt(d2), 6) AS score,
  CASE WHEN round(sqrt(d2), 9) > round(sqrt(r2) * 0.99, 9) THEN 1 ELSE 0 END AS y_pred FROM dd, rr)"""
)
ST = """st AS (
  SELECT scenario_id, event_type, y_true, row_number() OVER (PARTITION BY scenario_id ORDER BY y_true, CASE WHEN y_true = 1 THEN event_type END NULLS FIRST, ts, event_id) - 1 AS stream_pos,
    CASE WHEN value < 5 THEN 0 WHEN value < 20 THEN 1 ELSE 2 END AS decision, 20.0::DOUBLE - value AS score, 1.0::DOUBLE + value / 100 AS r_trace, value / 1000 AS latency_s, 1.0::DOUBLE AS r_pretrain, 1.25::DOUBLE AS r_final
  FROM (SELECT *, 's' || (user_id % 4) AS scenario_id, CASE WHEN event_type IN ('view','click','signup') THEN 0 ELSE 1 END AS y_true FROM events))"""
K = "kernel, dataset, scenario_id, source, target, prep"


def _cm(src: str, name: str, by: str = K) -> str:
    return f"""{name} AS (SELECT {by}, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn,
  count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn FROM {src} GROUP BY {by})"""


def _auc(src: str, name: str, score: str = "score", by: str = K) -> str:
    return f"""{name} AS (SELECT {by}, CASE WHEN p > 0 AND n > 0 THEN (sp - p * (p + 1) / 2.0) / (p::DOUBLE * n) END AS auc FROM (
  SELECT {by}, sum(y_true) AS p, sum(1 - y_true) AS n, sum(CASE WHEN y_true = 1 THEN mid END) AS sp FROM (
    SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {score}) + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0 AS mid FROM {src}) GROUP BY {by}))"""


RATES = """CASE WHEN tp+tn+fp+fn > 0 THEN (tp+tn) / (tp+tn+fp+fn)::DOUBLE ELSE 0 END AS accuracy, CASE WHEN tp+fp > 0 THEN tp / (tp+fp)::DOUBLE ELSE 0 END AS prec,
  CASE WHEN tp+fn > 0 THEN tp / (tp+fn)::DOUBLE ELSE 0 END AS recall, CASE WHEN 2*tp+fp+fn > 0 AND tp > 0 THEN 2 * tp / (2*tp+fp+fn)::DOUBLE ELSE 0 END AS f1"""


def _perf(src: str, name: str) -> str:
    return f"{_cm(src, name + '_c')}, {_auc(src, name + '_a')}, {name} AS (SELECT {K}, tp, tn, fp, fn, {RATES}, auc FROM {name}_c JOIN {name}_a USING ({K}) WHERE auc IS NOT NULL)"


def _pivot(m: str, name: str) -> str:
    return f"""{name} AS (SELECT prep, alpha, beta, list_avg(list_filter([alpha, beta], lambda t: t IS NOT NULL)) AS overall
  FROM (SELECT prep, avg(CASE WHEN dataset = 'alpha' THEN {m} END) AS alpha, avg(CASE WHEN dataset = 'beta' THEN {m} END) AS beta FROM perf GROUP BY prep))"""


ADAPT = """ad AS (SELECT * REPLACE (CASE WHEN round(d, 9) > round(r * 0.985, 9) THEN 1 ELSE 0 END AS y_pred, round(-d * (vec_id % 7), 6) AS score) FROM sc)"""
CMP = f"""cmp AS (SELECT {K}, round(b.auc, 6) AS auc_base, round(b.f1, 6) AS f1_base, round(b.recall, 6) AS recall_base, round(a.auc, 6) AS auc_adapted, round(a.f1, 6) AS f1_adapted, round(a.recall, 6) AS recall_adapted
  FROM perf b JOIN aperf a USING ({K}))"""
ZONES = """zones AS (SELECT dataset, prep, grp, count(*) AS n, count(*) FILTER (d < ri) * 100.0 / count(*) AS inner_pct, count(*) FILTER (d >= ri AND d <= ro) * 100.0 / count(*) AS adaptation_pct,
  count(*) FILTER (d > ro) * 100.0 / count(*) AS outer_pct, avg(d) AS mean_d, stddev_pop(d) AS std_d FROM (SELECT *, round(r * 0.98, 9) AS ri, round(r * 1.0 * 0.999, 9) AS ro FROM sc) GROUP BY 1, 2, 3)"""
PCT = "CASE WHEN count(d) > 0 THEN quantile_cont(d / r, {}) END"


def _kernel(expr: str) -> str:
    return f"""WITH {VEC}, kk AS (SELECT tr.vec_id AS i, list_sum(list_transform(list_zip(tr.x, tn.x), lambda t: t[1]::DOUBLE * t[2]::DOUBLE)) AS g,
  list_sum(list_transform(list_zip(tr.x, tn.x), lambda t: power(t[1]::DOUBLE - t[2]::DOUBLE, 2))) AS d2 FROM tr, tn)
SELECT i, count(*) AS n, round(avg({expr}), 6) AS mean_k, round(max({expr}), 6) AS max_k, round(min({expr}), 6) AS min_k FROM kk GROUP BY i"""


R6 = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)

ORACLE = {
    "domain_split": f"WITH {SIG} SELECT signal_id, CASE domain WHEN 0 THEN 'source' ELSE 'target' END AS side, fault_type, is_anomaly, len(data)::INTEGER AS n FROM sig WHERE domain IN (0, 1)",
    "temporal_split": f"WITH {SIG}, {CUT} SELECT signal_id, split, start_idx, n_samples, round(coalesce(list_sum(data), 0), 6) AS total FROM chunks",
    "window_signal": f"""WITH {SIG}, {CUT}, w AS (SELECT *, unnest(range(CASE WHEN len(data) >= 16 THEN (len(data) - 16) // 8 + 1 ELSE 0 END)) AS win_idx FROM chunks)
SELECT signal_id, split, win_idx, data[win_idx * 8 + 1] AS first, data[win_idx * 8 + 16] AS last, 16 AS n FROM w""",
    "source_val_union": f"WITH {SIG}, {CUT} SELECT domain, is_anomaly, count(*) AS n_signals, sum(n_samples)::BIGINT AS n_samples FROM chunks WHERE split = 'val' GROUP BY 1, 2",
    "znorm": f"WITH {SIG}, {WIN}, {Z} SELECT signal_id, win_idx, (generate_subscripts(z, 1) - 1)::INTEGER AS pos, round(unnest(z)::DOUBLE, 5) AS z FROM z",
    "cepstrum": f"WITH {SIG}, {WIN}, {Z}, {CEP} SELECT signal_id, win_idx, q::INTEGER AS q, round(c::DOUBLE, 4) AS c FROM cep",
    "liftered_features": f"WITH {SIG}, {WIN}, {Z}, {CEP} SELECT signal_id, win_idx, 4 AS n, round(c::DOUBLE, 4) AS c1 FROM cep WHERE q = 1",
    "target_stream_order": f"""WITH {SIG}, {WIN} SELECT domain, row_number() OVER (ORDER BY is_anomaly, CASE WHEN is_anomaly = 1 THEN fault_type END NULLS FIRST, signal_id, win_idx) - 1 AS stream_pos,
  signal_id, win_idx, fault_type, is_anomaly FROM win WHERE domain = 1""",
    "label_map": f"WITH {SC} SELECT prep, CASE prep WHEN 'p0' THEN 'cepstrum' WHEN 'p1' THEN 'z-score' ELSE prep END AS prep_label, count(*) AS n FROM sc GROUP BY 1, 2",
    "domain_map": """WITH d AS (SELECT DISTINCT (user_id % 4)::INTEGER AS k FROM events), n AS (SELECT k, CASE k WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE k::VARCHAR END AS nm FROM d)
SELECT a.k AS source, b.k AS target, a.nm || '->' || b.nm AS scenario FROM n a, n b WHERE a.k <> b.k""",
    "scenario_pairs": "WITH d AS (SELECT DISTINCT (user_id % 4)::INTEGER AS k FROM events) SELECT a.k AS source, b.k AS target FROM d a, d b WHERE a.k <> b.k",
    "run_key": """WITH p AS (SELECT vec_id, CASE label WHEN 0 THEN 'rbf/alpha/1797_to_' || vec_id || '/p4' WHEN 1 THEN 'beta/' || vec_id || '_to_900/p4' WHEN 2 THEN 'beta/x_to_' || vec_id || '/p4' ELSE 'x/' || vec_id END AS path FROM embeddings),
q AS (SELECT *, string_split(path, '/') AS s FROM p), t AS (SELECT *, CASE WHEN len(s) IN (3, 4) THEN s[-2] END AS scenario_id FROM q)
SELECT vec_id, path, CASE len(s) WHEN 4 THEN s[1] WHEN 3 THEN 'linear' END AS kernel, CASE WHEN len(s) IN (3, 4) THEN s[-3] END AS dataset, scenario_id,
  TRY_CAST(string_split(scenario_id, '_to_')[1] AS INTEGER) AS source_rpm, TRY_CAST(string_split(scenario_id, '_to_')[2] AS INTEGER) AS target_rpm, CASE WHEN len(s) IN (3, 4) THEN s[-1] END AS preprocessing FROM t""",
    "recording_name": """SELECT vec_id, CASE WHEN label < 5 THEN 'n_' || (label % 5) || '.mat' ELSE 'IR_007_' || (label - 5) || '.mat' END AS file, CASE WHEN label < 5 THEN 'N' ELSE 'IR' END AS fault_type,
  CASE WHEN label < 5 THEN '000' ELSE '007' END AS crack_size, CASE label % 5 WHEN 0 THEN 1797 WHEN 1 THEN 1772 WHEN 2 THEN 1750 WHEN 3 THEN 1730 END AS rpm, CASE WHEN label < 5 THEN 0 ELSE 1 END AS is_anomaly FROM embeddings""",
    "kernel_matrix": _kernel("g"),
    "rbf_kernel": _kernel("exp(-0.5 * d2)"),
    "poly_kernel": _kernel("power(g + 1.0, 3)"),
    "kernel_diag": f"WITH {VEC}, n AS (SELECT vec_id, list_sum(list_transform(x, lambda t: t::DOUBLE * t::DOUBLE)) AS s FROM v) SELECT vec_id, round(s, 6) AS lin, 1.0::DOUBLE AS rbf, round(power(s + 1, 3), 6) AS poly, round(s, 6) AS norm2 FROM n",
    "svdd_distance": f"WITH {SC} SELECT vec_id, {R6('d', 'r')} FROM sc",
    "rbf_distance": f"""WITH {VEC}, pairs AS (SELECT v.vec_id, avg(exp(-0.5 * list_sum(list_transform(list_zip(v.x, tr.x), lambda t: power(t[1]::DOUBLE - t[2]::DOUBLE, 2))))) AS k FROM v, tr GROUP BY v.vec_id),
n AS (SELECT avg(k) AS norm FROM pairs JOIN tr USING (vec_id)) SELECT vec_id, round(greatest(1 - 2 * k + norm, 0), 6) AS d2 FROM pairs, n""",
    "svdd_predict": f"WITH {SC} SELECT vec_id, CASE WHEN round(r2, 9) - round(d2, 9) >= 0 THEN 1 ELSE -1 END AS pred, round(r2 - d2, 6) AS decision FROM sc",
    "zone_decision": f"WITH {SC} SELECT vec_id, CASE WHEN d2 < power(r * 0.98, 2) THEN 0 WHEN d2 > power(r * 1.0 - 1e-9, 2) THEN 2 ELSE 1 END AS zone FROM sc",
    "r2_tiers": f"""WITH {SC}, a AS (SELECT label, CASE WHEN label < 3 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS c, d2, CASE WHEN label < 3 THEN (vec_id % 4) / 10.0::DOUBLE WHEN label < 7 THEN (vec_id % 2) / 2.0::DOUBLE ELSE 0.0::DOUBLE END AS al FROM sc),
t AS (SELECT label, c, avg(CASE WHEN al > 1.1920929e-6 AND al < c - 1.1920929e-6 THEN d2 END) AS t1, max(CASE WHEN al > 1.1920929e-6 THEN d2 END) AS t2, quantile_cont(d2, 0.95) AS t3 FROM a GROUP BY label, c)
SELECT label, c, round(coalesce(t1, t2, t3), 6) AS r2, CASE WHEN t1 IS NOT NULL THEN 1 WHEN t2 IS NOT NULL THEN 2 ELSE 3 END AS tier FROM t""",
    "topk_alpha": f"""WITH RECURSIVE {SC}, a AS (SELECT label, vec_id AS sv_idx, round(d, 6) + 1e-3::DOUBLE * (vec_id % 5) AS alpha FROM sc), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY alpha DESC, sv_idx)::INTEGER AS rank FROM a),
g AS (SELECT label, list(alpha ORDER BY rank) AS al, list(sv_idx ORDER BY rank) AS sv FROM k WHERE rank <= 20 GROUP BY label),
fold(label, i, w) AS (
  SELECT label, 0, list_transform(al, lambda x: least(x / list_sum(al), 0.06::DOUBLE)) FROM g
  UNION ALL
  SELECT label, i + 1, CASE WHEN abs(lack) <= {EPS} OR k = 0 THEN w ELSE list_transform(w, lambda x: CASE WHEN x > 0 AND x < 0.06::DOUBLE - {EPS} THEN greatest(least(x + lack / k, 0.06::DOUBLE), 0) ELSE x END) END
  FROM (SELECT *, 1 - list_sum(w) AS lack, len(list_filter(w, lambda x: x > 0 AND x < 0.06::DOUBLE - {EPS})) AS k FROM fold WHERE i < 50))
SELECT label, unnest(sv) AS sv_idx, round(unnest(w), 6) AS alpha, generate_subscripts(w, 1)::INTEGER AS rank FROM fold JOIN g USING (label) WHERE i = 50""",
    "buffer_size": "SELECT label, count(*) AS n, greatest(least(count(*) * 3, 100), ceil(round(0.1::DOUBLE * count(*), 9)) + 1)::BIGINT AS size FROM embeddings GROUP BY label",
    "warmup_length": f"WITH {ST} SELECT scenario_id, floor(count(*) FILTER (y_true = 0) * 0.1)::BIGINT AS warmup FROM st GROUP BY 1",
    "confusion_matrix": f"WITH {SC}, {_cm('sc', 'c')} SELECT * FROM c",
    "auc": f"WITH {SC}, {_auc('sc', 'a')} SELECT {K}, round(auc, 6) AS auc FROM a",
    "ad_performance": f"WITH {SC}, {_perf('sc', 'perf')} SELECT {K}, tp, tn, fp, fn, {R6('accuracy', 'prec', 'recall', 'f1', 'auc')} FROM perf",
    "otta_performance": f"""WITH {ST}, s2 AS (SELECT *, CASE WHEN decision = 2 THEN 1 ELSE 0 END AS y_pred, -score AS neg FROM st), {_cm('s2', 'c', 'scenario_id')}, {_auc('s2', 'a', 'neg', 'scenario_id')},
o AS (SELECT scenario_id, count(*) FILTER (decision = 0 AND y_true = 0) AS n_skip_normal, count(*) FILTER (decision = 0 AND y_true = 1) AS n_skip_fault, count(*) FILTER (decision = 1 AND y_true = 0) AS n_adapt_normal,
  count(*) FILTER (decision = 1 AND y_true = 1) AS n_adapt_fault, count(*) FILTER (decision = 2 AND y_true = 0) AS n_anomaly_normal, count(*) FILTER (decision = 2 AND y_true = 1) AS n_anomaly_fault,
  coalesce(min(CASE WHEN y_true = 1 AND decision = 2 THEN stream_pos END) - min(CASE WHEN y_true = 1 THEN stream_pos END), CASE WHEN max(y_true) = 1 THEN -1 END) AS delay,
  round(avg(r_trace), 6) AS r_mean, round(stddev_pop(r_trace), 6) AS r_std, 1.0::DOUBLE AS r_pretrain, 1.25::DOUBLE AS r_final, 25.0::DOUBLE AS r_growth_pct FROM st GROUP BY 1),
m AS (SELECT scenario_id, tp, tn, fp, fn, {RATES}, auc FROM c JOIN a USING (scenario_id)) SELECT scenario_id, tp, tn, fp, fn, {R6('accuracy', 'prec', 'recall', 'f1', 'auc')}, o.* EXCLUDE (scenario_id) FROM m JOIN o USING (scenario_id)""",
    "decision_rates": f"""WITH {ST} SELECT scenario_id, count(*) FILTER (decision = 0 AND y_true = 0) AS n_skip_normal, count(*) FILTER (decision = 0 AND y_true = 1) AS n_skip_fault, count(*) FILTER (decision = 1 AND y_true = 0) AS n_adapt_normal,
  count(*) FILTER (decision = 1 AND y_true = 1) AS n_adapt_fault, count(*) FILTER (decision = 2 AND y_true = 0) AS n_anomaly_normal, count(*) FILTER (decision = 2 AND y_true = 1) AS n_anomaly_fault FROM st GROUP BY 1""",
    "latency_stats": f"WITH {ST} SELECT scenario_id, round(avg(latency_s * 1000), 6) AS mean_ms, round(quantile_cont(latency_s * 1000, 0.5), 6) AS p50_ms, round(quantile_cont(latency_s * 1000, 0.99), 6) AS p99_ms, round(max(latency_s * 1000), 6) AS max_ms, round(sum(latency_s), 6) AS total_s FROM st GROUP BY 1",
    "detection_delay": f"""WITH {ST}, u AS (SELECT * FROM st UNION ALL SELECT * REPLACE (scenario_id || 'n' AS scenario_id) FROM st WHERE y_true = 0)
SELECT scenario_id, CASE WHEN f IS NULL THEN NULL WHEN h IS NULL THEN -1 ELSE h - f END AS delay FROM (SELECT scenario_id, min(CASE WHEN y_true = 1 THEN stream_pos END) AS f, min(CASE WHEN y_true = 1 AND decision = 2 THEN stream_pos END) AS h FROM u GROUP BY 1)""",
    "distance_ratio": f"""WITH {SC}, g AS (SELECT {K}, grp FROM (SELECT DISTINCT {K} FROM sc WHERE r > 0), (VALUES ('source_train'), ('source_val'), ('target_normal'), ('target_fault')) t(grp))
SELECT {K}, grp, count(d) AS n, round(avg(d / r), 6) AS mean, round(stddev_pop(d / r), 6) AS std, {', '.join(f'round({PCT.format(p / 100)}, 6) AS p{p}' for p in (5, 25, 50, 75, 95))} FROM g LEFT JOIN sc USING ({K}, grp) GROUP BY {K}, grp""",
    "cm_by_dataset": f"""WITH {SC}, {_cm('sc', 'c', 'dataset, prep')} SELECT dataset, prep, tp, tn, fp, fn, round(CASE WHEN tn+fp > 0 THEN tn/(tn+fp)::DOUBLE ELSE 0 END, 6) AS tn_rate, round(CASE WHEN tn+fp > 0 THEN fp/(tn+fp)::DOUBLE ELSE 0 END, 6) AS fp_rate,
  round(CASE WHEN tp+fn > 0 THEN fn/(tp+fn)::DOUBLE ELSE 0 END, 6) AS fn_rate, round(CASE WHEN tp+fn > 0 THEN tp/(tp+fn)::DOUBLE ELSE 0 END, 6) AS tp_rate FROM c""",
    "metric_pivot": f"WITH {SC}, {_perf('sc', 'perf')}, {_pivot('auc', 'pv')} SELECT prep, {R6('alpha', 'beta', 'overall')} FROM pv",
    "baseline_vs_otta": f"""WITH {SC}, {ADAPT}, {_perf('sc', 'perf')}, {_perf('ad', 'aperf')}, {CMP} SELECT *, round(auc_adapted - auc_base, 6) AS delta_auc, round(f1_adapted - f1_base, 6) AS delta_f1, round(recall_adapted - recall_base, 6) AS delta_recall FROM cmp""",
    "delta_box": f"""WITH {SC}, {ADAPT}, {_perf('sc', 'perf')}, {_perf('ad', 'aperf')}, {CMP}, q AS (SELECT prep, auc_adapted - auc_base AS x FROM cmp)
SELECT prep, count(*) AS n, round(quantile_cont(x, 0.0), 6) AS lo, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS med, round(quantile_cont(x, 0.75), 6) AS q3, round(quantile_cont(x, 1.0), 6) AS hi FROM q GROUP BY prep""",
    "zone_ratio": f"WITH {SC}, {ZONES} SELECT dataset, prep, grp, n, {R6('inner_pct', 'adaptation_pct', 'outer_pct', 'mean_d', 'std_d')} FROM zones",
    "tradeoff": f"""WITH {SC}, {ZONES}, {_perf('sc', 'perf')}, {_pivot('auc', 'pa')}, {_pivot('f1', 'pf')}, z AS (SELECT prep, avg(inner_pct) AS inner_pct, avg(adaptation_pct) AS adaptation_pct, avg(outer_pct) AS outer_pct FROM zones WHERE grp = 'target_normal' GROUP BY prep)
SELECT z.prep, round(inner_pct, 4) AS inner_pct, round(adaptation_pct, 4) AS adaptation_pct, round(outer_pct, 4) AS outer_pct, round(pa.overall, 4) AS auc, round(pf.overall, 4) AS f1 FROM z LEFT JOIN pa USING (prep) LEFT JOIN pf USING (prep)""",
    "zone_flatten": f"""WITH {SC}, {ZONES} SELECT dataset, prep, 50.0::DOUBLE AS r_inner_percentile, 95.0::DOUBLE AS r_outer_percentile, 0.5::DOUBLE AS r_inner, 1.5::DOUBLE AS r_outer, grp, n AS count, {R6('inner_pct', 'adaptation_pct', 'outer_pct', 'mean_d', 'std_d')} FROM zones""",
    "run_summary": f"WITH {SC} SELECT dataset, prep, round(max(r), 6) AS r_pretrain, count(*) AS n_stream, NULL::DOUBLE AS mmd2 FROM sc GROUP BY 1, 2",
    "median_gamma": f"WITH {VEC} SELECT round(1 / median(list_sum(list_transform(list_zip(a.x, b.x), lambda t: power(t[1]::DOUBLE - t[2]::DOUBLE, 2)))), 6) AS gamma FROM tr a, tr b WHERE a.vec_id < b.vec_id",
    "mmd2": f"""WITH {VEC}, p AS (SELECT 's' AS g, x FROM tr UNION ALL SELECT 't', x FROM tn),
k AS (SELECT a.g || b.g AS gg, avg(exp(-0.5 * list_sum(list_transform(list_zip(a.x, b.x), lambda t: power(t[1]::DOUBLE - t[2]::DOUBLE, 2))))) AS m FROM p a, p b GROUP BY 1)
SELECT round(sum(CASE gg WHEN 'ss' THEN m WHEN 'tt' THEN m WHEN 'st' THEN -2 * m END), 8) AS mmd2 FROM k""",
    "wasserstein": f"""WITH {SC}, p AS (SELECT dataset, round(d, 9) AS v, count(*) FILTER (grp = 'source_train') AS a, count(*) FILTER (grp = 'target_normal') AS b FROM sc WHERE grp <> 'target_fault' GROUP BY 1, 2),
c AS (SELECT dataset, sum(a) OVER w AS ca, sum(b) OVER w AS cb, lead(v) OVER w - v AS dv, sum(a) OVER (PARTITION BY dataset) AS na, sum(b) OVER (PARTITION BY dataset) AS nb FROM p WINDOW w AS (PARTITION BY dataset ORDER BY v))
SELECT dataset, round(sum(abs(ca / na - cb / nb) * coalesce(dv, 0)), 8) AS w1 FROM c GROUP BY dataset""",
    "polar_bounds": f"""WITH {SC}, b AS (SELECT dataset, prep, max(r) AS r, max(r) * 0.98 AS r_inner, max(r) * 1.0 AS r_outer, greatest(max(r), max(r) * 1.0, max(CASE WHEN grp <> 'target_fault' THEN d END)) * 1.3 AS r_max FROM sc GROUP BY 1, 2)
SELECT dataset, prep, round(b.r, 6) AS r, round(r_inner, 6) AS r_inner, round(r_outer, 6) AS r_outer, round(r_max, 6) AS r_max, count(*) FILTER (grp = 'target_fault' AND d > r_max) AS n_clipped FROM b JOIN sc USING (dataset, prep) GROUP BY ALL""",
    "r_trace_panel": f"""WITH {ST} SELECT scenario_id, min(CASE WHEN y_true = 1 THEN stream_pos END) AS first_fault, max(CASE WHEN y_true = 1 THEN stream_pos END) AS last_fault, floor(count(*) FILTER (y_true = 0) * 0.1)::BIGINT AS warmup,
  count(*) FILTER (decision = 1 AND y_true = 0) AS adapted_normal, count(*) FILTER (decision = 1 AND y_true = 1) AS adapted_fault, round(min(r_trace), 6) AS r_min, round(max(r_trace), 6) AS r_max FROM st GROUP BY 1""",
    "r_trace_points": f"WITH {ST} SELECT scenario_id, stream_pos, round(r_trace, 6) AS r_trace, CASE y_true WHEN 0 THEN 'adapted_normal' ELSE 'adapted_fault' END AS kind FROM st WHERE decision = 1",
    "svdd_fit_closed_form": f"""WITH {VEC}, t AS (SELECT 'k' || (label % 5) AS scenario_id, vec_id, x FROM tr), n AS (SELECT scenario_id, count(*) AS n_sv FROM t GROUP BY 1),
c AS (SELECT scenario_id, list(m ORDER BY p) AS c FROM (SELECT scenario_id, p, avg(e) AS m FROM (SELECT scenario_id, unnest(x)::DOUBLE AS e, generate_subscripts(x, 1) AS p FROM t) GROUP BY 1, 2) GROUP BY 1)
SELECT scenario_id, any_value(n_sv)::INTEGER AS n_sv, 2 AS tier, round(max(list_sum(list_transform(list_zip(x, c), lambda q: power(q[1]::DOUBLE - q[2], 2)))), 5) AS r2 FROM t JOIN c USING (scenario_id) JOIN n USING (scenario_id) GROUP BY 1""",
    "znorm_long": """WITH sig AS (SELECT (l_orderkey % 8)::BIGINT AS signal_id, list(l_extendedprice::DOUBLE ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS x FROM lineitem GROUP BY 1),
w AS (SELECT signal_id, i::BIGINT AS win_idx, x[i * 1024 + 1:i * 1024 + 2048] AS x FROM (SELECT signal_id, x, unnest(range(0, CASE WHEN len(x) >= 2048 THEN (len(x) - 2048) // 1024 + 1 ELSE 0 END)) AS i FROM sig)),
m AS (SELECT *, list_avg(x) AS mean FROM w), s AS (SELECT *, sqrt(list_avg(list_transform(x, lambda v: (v - mean) * (v - mean)))) AS sd FROM m),
z AS (SELECT signal_id, win_idx, list_transform(x, lambda v: ((v - mean) / CASE WHEN sd < 1e-10 THEN 1 ELSE sd END)::FLOAT) AS z FROM s)
SELECT signal_id, win_idx, len(z)::INTEGER AS n, round(z[1]::DOUBLE, 4) AS first, round(z[2048]::DOUBLE, 4) AS last, round(list_max(z)::DOUBLE, 4) AS top FROM z""",
    "bearing_name": """WITH v AS (SELECT vec_id, CASE WHEN label < 5 THEN 'N15_M07_F10' WHEN label < 9 THEN 'N09_M07_F10' ELSE 'N99_M00_F00' END AS c, (['K001', 'KI04', 'KA30', 'X1'])[vec_id % 4 + 1] AS b FROM embeddings)
SELECT vec_id, c || '_' || b || '_' || (vec_id % 20 + 1) || '.mat' AS file, CASE b WHEN 'K001' THEN 'N' WHEN 'KI04' THEN 'IR' WHEN 'KA30' THEN 'OR' END AS fault_type, CASE c WHEN 'N15_M07_F10' THEN 1500 WHEN 'N09_M07_F10' THEN 900 END AS rpm,
  CASE WHEN c <> 'N99_M00_F00' THEN 0.7::DOUBLE END AS load_torque_nm, CASE WHEN c <> 'N99_M00_F00' THEN 1000::DOUBLE END AS radial_force_n, 64 AS sampling_rate, CASE b WHEN 'K001' THEN 0 WHEN 'KI04' THEN 1 WHEN 'KA30' THEN 2 END AS label, CASE WHEN b <> 'X1' THEN (b <> 'K001')::INTEGER END AS is_anomaly FROM v""",
    "channel_pick": "SELECT vec_id, CASE WHEN label % 2 = 0 THEN vec_id + 1 WHEN label < 3 THEN vec_id END::DOUBLE AS drive_end, CASE WHEN label >= 3 THEN vec_id END::DOUBLE AS vibration FROM embeddings",
    "value_replace": f"WITH {SC} SELECT CASE prep WHEN 'p2' THEN 'p1' ELSE prep END AS prep, count(*) AS n FROM sc GROUP BY 1",
    "kept_signals": "SELECT nullif(label, 0)::INTEGER AS label, count(*) AS n FROM embeddings WHERE label <> 7 GROUP BY 1",
    "seeded_order": "SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('42#' || vec_id), vec_id) - 1 AS shuffle_pos FROM embeddings",
    "polar_points": f"""WITH {SC}, t AS (SELECT *, md5(vec_id::VARCHAR) AS h FROM sc), n AS (SELECT *, row_number() OVER (PARTITION BY dataset, prep, grp ORDER BY h, vec_id) AS k, ('0x' || substr(h, 1, 8))::BIGINT / 4294967296.0::DOUBLE * 6.283185307179586::DOUBLE AS turn FROM t)
SELECT dataset, prep, grp, vec_id, round(d * cos(turn), 6) AS px, round(d * sin(turn), 6) AS py FROM n WHERE k <= 500""",
    "svdd_optimality": f"""WITH {VEC} SELECT 'k' || (label % 5) AS scenario_id, count(*) AS n_rows, round(1 / (0.1::DOUBLE * count(*)), 9) AS c, true AS sums_to_one, true AS in_box, true AS optimal, true AS large_agrees
FROM tr GROUP BY 1""",
    "model_performance": f"""WITH {VEC}, t AS (SELECT 'k' || (label % 5) AS scenario_id, x FROM tr),
c AS (SELECT scenario_id, list(m ORDER BY p) AS c FROM (SELECT scenario_id, p, avg(e) AS m FROM (SELECT scenario_id, unnest(x)::DOUBLE AS e, generate_subscripts(x, 1) AS p FROM t) GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT scenario_id, max(list_sum(list_transform(list_zip(x, c), lambda q: power(q[1]::DOUBLE - q[2], 2)))) AS r2 FROM t JOIN c USING (scenario_id) GROUP BY 1),
j AS (SELECT scenario_id, (label >= 5)::INTEGER AS y_true, round(sqrt(list_sum(list_transform(list_zip(x, c), lambda q: power(q[1]::DOUBLE - q[2], 2)))), 5) AS score, round(sqrt(r2), 5) AS radius
  FROM (SELECT *, 'k' || (label % 5) AS scenario_id FROM v WHERE NOT (label < 5 AND vec_id % 2 = 0)) JOIN c USING (scenario_id) JOIN r USING (scenario_id)),
jj AS (SELECT *, (score > radius)::INTEGER AS y_pred FROM j), {_cm('jj', 'm', 'scenario_id')}, {_auc('jj', 'a', by='scenario_id')},
perf AS (SELECT scenario_id, tp, tn, fp, fn, {RATES}, auc FROM m JOIN a USING (scenario_id) WHERE auc IS NOT NULL)
SELECT scenario_id, tp, tn, fp, fn, {', '.join(f'round({x}, 5) AS {x}' for x in ('accuracy', 'prec', 'recall', 'f1', 'auc'))} FROM perf""",
}
ORACLE["chunk_windows"] = ORACLE["window_signal"]
