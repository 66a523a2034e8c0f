"""The contract queries once more, as plain SQL over the same tables.

These texts are written against the raw tables only and share no code with the
operators, so agreement is evidence for both.
"""

from __future__ import annotations

from . import evidence_sql

_JOBS = """
h AS (SELECT l_orderkey, MIN(l_suppkey) AS node_id FROM lineitem GROUP BY l_orderkey),
b AS (SELECT o.*, h.node_id, (o_orderkey * 7919) % 100 AS r, 60 + (o_orderkey * 31) % 7200 AS secs
      FROM orders o JOIN h ON h.l_orderkey = o.o_orderkey),
s AS (SELECT *, CASE WHEN o_orderkey % 997 = 0 THEN 'RUNNING'
        WHEN r < 8 + CASE WHEN node_id % 10 = 0 THEN 30 ELSE 0 END
               + CASE o_custkey % 120 WHEN 7 THEN 50 WHEN 50 THEN 80 ELSE 0 END
          THEN CASE o_orderkey % 3 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'TIMEOUT' ELSE 'OUT_OF_MEMORY' END
        WHEN r >= 93 THEN 'CANCELLED by 0' ELSE 'COMPLETED' END AS state FROM b),
acct_jobs AS (
SELECT 'c1' AS cluster, o_orderkey AS job_id,
  CONCAT('job-', SUBSTR('abcdefgh', CAST(o_custkey % 8 AS INT) + 1, 1), '-', o_orderkey % 5) AS name,
  CONCAT('u', o_custkey % 40) AS user_name, CONCAT('p', o_custkey % 3) AS partition_name, state,
  CASE WHEN o_custkey % 4 = 0 THEN o_custkey % 3 + 1 ELSE 0 END AS gpus,
  1 + o_orderkey % 16 AS cpus, CASE WHEN o_orderkey % 9 = 0 THEN 2 ELSE 1 END AS n_nodes, node_id,
  CASE WHEN o_orderkey % 9 = 0
    THEN CONCAT('node-[', LPAD(CAST(node_id AS STRING), 4, '0'), '-', LPAD(CAST(node_id + 1 AS STRING), 4, '0'), ']')
    ELSE CONCAT('node-', LPAD(CAST(node_id AS STRING), 4, '0')) END AS node_list,
  CASE WHEN o_orderkey % 1009 = 0 THEN NULL ELSE secs END AS elapsed_s,
  CASE WHEN state = 'TIMEOUT' THEN secs ELSE 3600 * (1 + o_custkey % 4) END AS timelimit_s,
  o_orderdate AS submit_ts, o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 86400) AS start_ts,
  CASE WHEN state = 'RUNNING' THEN NULL ELSE o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 86400 + secs) END AS end_ts,
  (1 + o_orderkey % 16) * 1073741824 AS mem_limit_bytes
FROM s)"""

_STEPS = """
acct_steps AS (
SELECT 'c1' AS cluster, l_orderkey AS job_id, l_linenumber AS pos,
  CASE l_linenumber WHEN 1 THEN 'batch' WHEN 7 THEN 'extern' ELSE CONCAT('', l_linenumber - 2) END AS step,
  CASE WHEN l_orderkey % 13 = 0 THEN 0.5e0 ELSE SUM(l_quantity) * 20 END AS total_cpu_s,
  CASE WHEN l_orderkey % 13 = 0 THEN 0.1e0 ELSE SUM(l_quantity) * (l_orderkey % 10) END AS system_cpu_s,
  CAST(SUM(l_quantity) AS BIGINT) * 150000000 AS max_rss_bytes,
  CAST(FLOOR(AVG(l_quantity)) AS BIGINT) * 100000000 AS ave_rss_bytes,
  COUNT(*) AS ntasks,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(SUM(l_quantity) AS BIGINT) * 300000000 END AS read_bytes,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(SUM(l_quantity) AS BIGINT) * 200000000 END AS write_bytes
FROM lineitem GROUP BY l_orderkey, l_linenumber)"""

_ATTEMPTS = """
acct_attempts AS (
SELECT cluster, job_id, k AS attempt, CASE job_id % 2 WHEN 0 THEN 'NODE_FAIL' ELSE 'PREEMPTED' END AS state,
  300 * (k + job_id % 4) AS elapsed_s, start_ts - INTERVAL '1' SECOND * (k * 1800) AS end_ts
FROM acct_jobs CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k) a WHERE job_id % 5 = 0 AND k <= 1 + job_id % 2)"""

_METRICS = """
sr AS (SELECT job_id, COUNT(*) AS step_count, MAX(ntasks) AS tasks,
  SUM(total_cpu_s) FILTER (WHERE step <> 'extern') AS s_total,
  SUM(system_cpu_s) FILTER (WHERE step <> 'extern') AS s_system,
  MAX(max_rss_bytes) AS peak_all,
  MAX(max_rss_bytes) FILTER (WHERE step <> 'extern') AS peak_work,
  MAX(max_rss_bytes) FILTER (WHERE step = 'extern') AS peak_extern,
  MAX(ave_rss_bytes) FILTER (WHERE step <> 'extern') AS s_ave,
  MAX(CASE WHEN step <> 'extern' AND max_rss_bytes <> 0 AND ave_rss_bytes <> 0
      THEN max_rss_bytes / CAST(ave_rss_bytes AS DOUBLE) END) AS s_imbalance,
  COUNT(*) FILTER (WHERE step <> 'extern' AND max_rss_bytes <> 0) AS spread_n,
  MIN(CASE WHEN step <> 'extern' AND max_rss_bytes <> 0 THEN max_rss_bytes END) AS spread_lo,
  MAX(CASE WHEN step <> 'extern' AND max_rss_bytes <> 0 THEN max_rss_bytes END) AS spread_hi,
  COALESCE(SUM(read_bytes) FILTER (WHERE step <> 'extern'), MAX(read_bytes)) AS read_bytes,
  COALESCE(SUM(write_bytes) FILTER (WHERE step <> 'extern'), MAX(write_bytes)) AS write_bytes
  FROM acct_steps GROUP BY job_id),
m0 AS (SELECT j.*, COALESCE(sr.step_count, 0) AS step_count, COALESCE(sr.tasks, 0) AS task_count,
  sr.read_bytes, sr.write_bytes,
  j.state = 'RUNNING' AS open_ended,
  CASE WHEN j.state <> 'RUNNING' THEN sr.s_total END AS total_cpu,
  CASE WHEN j.state <> 'RUNNING' THEN sr.s_system END AS system_cpu,
  CAST(j.elapsed_s * j.cpus AS DOUBLE) AS cpu_time,
  CASE WHEN j.state <> 'RUNNING' THEN
    CASE WHEN sr.peak_all > j.mem_limit_bytes AND sr.peak_work <= j.mem_limit_bytes
          AND sr.peak_extern = sr.peak_all THEN sr.peak_work ELSE sr.peak_all END END AS max_rss,
  CASE WHEN j.state <> 'RUNNING' THEN sr.s_ave END AS ave_rss,
  CASE WHEN j.state <> 'RUNNING' THEN sr.s_imbalance END AS imbalance,
  CASE WHEN j.state <> 'RUNNING' AND sr.spread_n >= 2 THEN sr.spread_hi / CAST(sr.spread_lo AS DOUBLE) END AS step_spread
  FROM acct_jobs j LEFT JOIN sr ON sr.job_id = j.job_id),
m AS (SELECT *,
  state IN ('FAILED', 'TIMEOUT', 'OUT_OF_MEMORY') AS failed,
  state = 'COMPLETED' AS completed, state LIKE 'CANCELLED%' AS cancelled,
  elapsed_s IS NOT NULL AND NOT open_ended AS usable,
  COALESCE(NOT open_ended AND elapsed_s > 300 AND total_cpu < 10, FALSE) AS noop,
  cpus / CAST(CASE WHEN task_count > 0 THEN task_count ELSE n_nodes END AS DOUBLE) AS cpus_per_task,
  total_cpu / cpu_time AS cpu_util,
  CASE WHEN gpus > 0 THEN elapsed_s * gpus / 3600.0e0 END AS gpu_hours,
  elapsed_s * cpus / 3600.0e0 AS core_hours,
  REGEXP_REPLACE(name, '[0-9]+', '#', 'g') AS folded,
  CASE WHEN gpus > 0 THEN 'gpu' ELSE 'cpu' END AS kind,
  COALESCE(read_bytes + write_bytes, read_bytes, write_bytes) AS io_bytes
  FROM m0)"""

_ALL = "WITH " + ",".join([_JOBS, _STEPS, _METRICS])

_WORKLOADS = _ALL + """,
w0 AS (SELECT folded AS workload_name, partition_name AS workload_partition, kind AS workload_kind,
  user_name AS workload_user,
  COUNT(*) FILTER (WHERE usable) AS runs,
  COUNT(*) FILTER (WHERE usable AND completed) AS completed,
  COUNT(*) FILTER (WHERE usable AND failed) AS failed,
  COUNT(*) FILTER (WHERE usable AND cancelled) AS cancelled,
  COUNT(*) FILTER (WHERE usable AND noop) AS noop,
  COUNT(*) FILTER (WHERE usable AND (failed OR noop)) AS problems,
  COALESCE(SUM(gpu_hours) FILTER (WHERE usable), 0) AS gpu_hours,
  COALESCE(SUM(core_hours) FILTER (WHERE usable), 0) AS core_hours,
  COALESCE(SUM(gpu_hours) FILTER (WHERE usable AND (failed OR noop)), 0) AS wasted_gpu_hours,
  MIN(start_ts) FILTER (WHERE usable) AS first_seen,
  MAX(start_ts) FILTER (WHERE usable) AS last_seen,
  COUNT(*) FILTER (WHERE open_ended) AS excluded,
  COUNT(DISTINCT CASE WHEN usable THEN name END) AS distinct_names,
  MIN(CASE WHEN usable THEN name END) AS one_name,
  BOOL_OR(usable AND CONTAINS(name, 'b-3')) AS named_so
  FROM m GROUP BY 1, 2, 3, 4),
w AS (SELECT *, CASE WHEN distinct_names = 1 THEN one_name ELSE workload_name END AS label,
  CASE WHEN completed + failed > 0 THEN failed / CAST(completed + failed AS DOUBLE) END AS failure_rate,
  noop / CAST(runs AS DOUBLE) AS noop_rate,
  gpu_hours * 16 + core_hours AS cost FROM w0 WHERE runs > 0),
ws AS (SELECT *, CASE WHEN runs >= 3 AND failure_rate >= 0.5 THEN 'crit'
  WHEN runs >= 3 AND noop_rate >= 0.25 THEN 'crit'
  WHEN failure_rate >= 0.2 OR noop_rate >= 0.1 THEN 'warn' ELSE 'ok' END AS severity FROM w)
"""

_WKEY = "workload_name, workload_partition, workload_kind, workload_user"
_WSELECT = f"""{_WKEY}, label, severity, runs, completed, failed, cancelled, noop, problems,
  CAST(excluded AS BIGINT) AS excluded, distinct_names, ROUND(gpu_hours, 6) AS gpu_hours,
  ROUND(core_hours, 6) AS core_hours, ROUND(wasted_gpu_hours, 6) AS wasted_gpu_hours,
  ROUND(cost, 6) AS cost, ROUND(failure_rate, 6) AS failure_rate, ROUND(noop_rate, 6) AS noop_rate,
  CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen"""


def _rates(counts: str, strata: str = "") -> str:
    """Exact-test table over a CTE ``c(<strata>, entity, trials, bad)``."""
    by = f"PARTITION BY {strata}" if strata else ""
    lead = f"{strata}, " if strata else ""
    return counts + f""",
t AS (SELECT *, SUM(trials) OVER ({by}) AS all_trials, SUM(bad) OVER ({by}) AS all_hits FROM c),
x AS (SELECT *, all_trials - trials AS on_, all_hits - bad AS ob,
  bad / CAST(trials AS DOUBLE) AS rate,
  CASE WHEN all_trials > trials THEN (all_hits - bad) / CAST(all_trials - trials AS DOUBLE) END AS comparison
  FROM t WHERE trials >= 10),
d AS (SELECT *, CASE WHEN rate > comparison THEN 'worse' WHEN rate < comparison THEN 'better' END AS direction,
  CAST(all_trials AS BIGINT) AS tot, CAST(all_hits AS BIGINT) AS mk,
  GREATEST(0, trials - (all_trials - all_hits)) AS lo, LEAST(trials, all_hits) AS hi FROM x),
k AS (SELECT {lead}entity, UNNEST(CASE WHEN direction = 'worse' THEN RANGE(CAST(bad AS BIGINT), CAST(hi AS BIGINT) + 1)
    ELSE RANGE(CAST(lo AS BIGINT), CAST(bad AS BIGINT) + 1) END) AS i, tot, mk, trials FROM d WHERE direction IS NOT NULL),
tail AS (SELECT {lead}entity, SUM(EXP(LGAMMA(mk + 1) - LGAMMA(i + 1) - LGAMMA(mk - i + 1)
    + LGAMMA(tot - mk + 1) - LGAMMA(trials - i + 1) - LGAMMA(tot - mk - trials + i + 1)
    - LGAMMA(tot + 1) + LGAMMA(trials + 1) + LGAMMA(tot - trials + 1))) AS p FROM k GROUP BY ALL),
p AS (SELECT d.*, CASE WHEN d.direction IS NULL OR mk <= 0 OR mk >= tot THEN 1.0e0 ELSE LEAST(1.0e0, 2 * tail.p) END AS p_value
  FROM d LEFT JOIN tail USING ({lead}entity)),
q AS (SELECT *, ROW_NUMBER() OVER ({by} ORDER BY p_value) AS rk, COUNT(*) OVER ({by}) AS n_tests FROM p),
r AS (SELECT *, COALESCE(MAX(CASE WHEN p_value <= 0.05e0 * rk / n_tests THEN rk END) OVER ({by}), 0) AS cut FROM q),
wl AS (SELECT *,
  GREATEST(0e0, (rate + 1.96*1.96/(2e0*trials) - 1.96*SQRT(rate*(1-rate)/trials + 1.96*1.96/(4e0*trials*trials))) / (1 + 1.96*1.96/CAST(trials AS DOUBLE))) AS ci_low,
  LEAST(1e0, (rate + 1.96*1.96/(2e0*trials) + 1.96*SQRT(rate*(1-rate)/trials + 1.96*1.96/(4e0*trials*trials))) / (1 + 1.96*1.96/CAST(trials AS DOUBLE))) AS ci_high
  FROM r),
v AS (SELECT *, CASE WHEN comparison IS NULL THEN 'unknown'
  WHEN rk <= cut AND direction = 'worse' AND ci_low > comparison THEN 'worse'
  WHEN rk <= cut AND direction = 'better' AND ci_high < comparison THEN 'better' ELSE 'inconclusive' END AS verdict FROM wl)
"""


_RATE_COLUMNS = """CAST(bad AS BIGINT) AS bad, CAST(trials AS BIGINT) AS trials, ROUND(rate, 6) AS rate,
  ROUND(ci_low, 6) AS ci_low, ROUND(ci_high, 6) AS ci_high, ROUND(comparison, 6) AS comparison,
  direction, ROUND(p_value, 6) AS p_value, verdict"""

_SUPPLIERS = """WITH c AS (SELECT l_suppkey AS entity, COUNT(*) AS trials,
  COUNT(*) FILTER (WHERE l_returnflag = 'R') AS bad FROM lineitem GROUP BY 1)"""
_SUPPLIERS_BY_BRAND = """WITH c AS (SELECT p_brand, l_suppkey AS entity, COUNT(*) AS trials,
  COUNT(*) FILTER (WHERE l_returnflag = 'R') AS bad
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""
_PLACED = """,
pl AS (SELECT folded, user_name, failed, node_id + UNNEST(RANGE(CAST(n_nodes AS BIGINT))) AS n FROM m
  WHERE usable AND NOT cancelled AND state <> 'OUT_OF_MEMORY')"""
_NODES = _ALL + _PLACED + """,
c AS (SELECT CONCAT('node-', LPAD(CAST(n AS STRING), 4, '0')) AS entity, COUNT(*) AS trials,
  COUNT(*) FILTER (WHERE failed) AS bad FROM pl GROUP BY 1)"""
_SUMMARY = """
SELECT ROUND(SUM(bad) / CAST(SUM(trials) AS DOUBLE), 6) AS baseline, CAST(SUM(trials) AS BIGINT) AS trials,
  CAST(SUM(bad) AS BIGINT) AS hits, COUNT(*) FILTER (WHERE trials >= 10) AS tested,
  COUNT(*) FILTER (WHERE trials < 10) AS skipped,
  (SELECT COUNT(*) FROM v WHERE verdict = 'inconclusive'
     AND (ci_low > all_hits / CAST(all_trials AS DOUBLE) OR ci_high < all_hits / CAST(all_trials AS DOUBLE))) AS held_back,
  (SELECT COUNT(*) FROM v WHERE verdict = 'worse') AS worse,
  (SELECT COUNT(*) FROM v WHERE verdict = 'better') AS better,
  0.95e0 AS confidence_level, 0.05e0 AS fdr_alpha FROM c"""

_U = f"SELECT *, folded AS workload_name, partition_name AS workload_partition, kind AS workload_kind, user_name AS workload_user FROM m WHERE usable"

_SIZING = _ALL + f""",
u AS ({_U}),
z AS (SELECT {_WKEY}, COUNT(*) AS runs,
  ARG_MAX(timelimit_s, ROW(start_ts, job_id)) AS t_current,
  COUNT(*) FILTER (WHERE completed AND NOT noop AND elapsed_s > 0) AS t_fit,
  MAX(elapsed_s) FILTER (WHERE completed AND NOT noop AND elapsed_s > 0) AS t_longest,
  COUNT(*) FILTER (WHERE state = 'TIMEOUT') AS t_timeouts,
  COUNT(*) FILTER (WHERE state = 'TIMEOUT' AND noop) AS t_hung,
  MAX(timelimit_s) FILTER (WHERE state = 'TIMEOUT' AND NOT noop) AS t_floor,
  ARG_MAX(mem_limit_bytes, ROW(start_ts, job_id)) AS m_current,
  COUNT(*) FILTER (WHERE state = 'OUT_OF_MEMORY') AS m_oom,
  MAX(mem_limit_bytes) FILTER (WHERE state = 'OUT_OF_MEMORY') AS m_floor,
  COUNT(*) FILTER (WHERE NOT noop AND max_rss > 0) AS m_measured,
  COUNT(*) FILTER (WHERE NOT noop AND max_rss > mem_limit_bytes) AS m_over,
  COUNT(*) FILTER (WHERE NOT noop AND max_rss > 0 AND max_rss <= mem_limit_bytes) AS m_fit,
  MAX(max_rss) FILTER (WHERE NOT noop AND max_rss > 0 AND max_rss <= mem_limit_bytes) AS m_peak,
  ARG_MAX(cpus_per_task, ROW(start_ts, job_id)) AS c_current,
  COUNT(*) FILTER (WHERE NOT noop AND cpu_util IS NOT NULL) AS c_fit,
  MAX(cpu_util * cpus_per_task) FILTER (WHERE NOT noop) AS c_peak
  FROM u GROUP BY 1, 2, 3, 4)"""


def _by_change(target: str, current: str) -> str:
    return f"CASE WHEN {target} > {current} * 1.2e0 THEN 'raise' WHEN {target} < {current} * 0.8e0 THEN 'lower' ELSE 'keep' END"


_WALL = _SIZING + """,
veto AS (SELECT *, t_hung >= 3 AND t_hung >= 0.5 * t_timeouts AND t_hung >= 0.2 * runs AS vetoed,
  GREATEST(CEIL(t_longest * 1.25e0 / CASE WHEN t_longest * 1.25e0 < 3600 THEN 300 ELSE 900 END) * CASE WHEN t_longest * 1.25e0 < 3600 THEN 300 ELSE 900 END,
    COALESCE(CEIL(t_floor * 1.25e0 / CASE WHEN t_floor * 1.25e0 < 3600 THEN 300 ELSE 900 END) * CASE WHEN t_floor * 1.25e0 < 3600 THEN 300 ELSE 900 END, 0)) AS target FROM z),
f AS (SELECT *, CASE WHEN vetoed OR t_fit < 3 THEN 'unknown' ELSE """ + _by_change("target", "t_current") + " END AS verdict FROM veto)\n"
_MEM = _SIZING + """,
tg AS (SELECT *, CASE WHEN m_oom > 0 THEN GREATEST(CEIL(m_floor * 1.3e0 / 1073741824), CASE WHEN m_fit >= 3 THEN CEIL(m_peak * 1.3e0 / 1073741824) ELSE 0 END)
   WHEN m_fit >= 3 THEN CEIL(m_peak * 1.3e0 / 1073741824) END AS target FROM z),
f AS (SELECT *, CASE WHEN target IS NULL THEN 'unknown' ELSE """ + _by_change("target * 1073741824", "m_current") + " END AS verdict FROM tg)\n"
_CPU = _SIZING + """,
tg AS (SELECT *, GREATEST(CEIL(c_peak * 1.2e0), 1) AS wanted, 24 AS ceiling FROM z),
cl AS (SELECT *, LEAST(wanted, ceiling) AS target, wanted > ceiling AND c_current >= ceiling AS saturated FROM tg),
f AS (SELECT *, CASE WHEN c_fit < 3 THEN 'unknown' WHEN saturated THEN 'capped' ELSE """ + _by_change("target", "c_current") + " END AS verdict FROM cl)\n"

_MEMORY = _ALL + f""",
u AS ({_U}),
om AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {_WKEY} ORDER BY job_id) AS rn,
   LAG(mem_limit_bytes) OVER (PARTITION BY {_WKEY} ORDER BY job_id) AS prev FROM u WHERE state = 'OUT_OF_MEMORY'),
mw AS (SELECT {_WKEY}, COUNT(*) AS oom_kills, MIN(mem_limit_bytes) AS smallest_limit, MAX(mem_limit_bytes) AS largest_limit,
   COUNT(*) FILTER (WHERE prev IS NULL OR prev <> mem_limit_bytes) AS n_runs,
   COUNT(*) FILTER (WHERE mem_limit_bytes < prev) AS n_decreases FROM om GROUP BY 1, 2, 3, 4 HAVING COUNT(*) >= 3),
kl AS (SELECT {_WKEY}, mem_limit_bytes, MIN(job_id) AS killed FROM u WHERE state = 'OUT_OF_MEMORY' GROUP BY 1, 2, 3, 4, 5),
ct AS (SELECT {_WKEY}, MIN(u.job_id) AS contradicting_job FROM u JOIN kl USING ({_WKEY}, mem_limit_bytes)
   WHERE completed AND u.job_id > killed GROUP BY 1, 2, 3, 4)"""

_REPEAT = _ALL + f""",
u AS ({_U}),
g AS (SELECT {_WKEY}, COUNT(*) AS runs, COUNT(*) FILTER (WHERE failed) AS failures,
  COUNT(*) FILTER (WHERE completed) AS completed, COUNT(*) FILTER (WHERE failed AND noop) AS hung,
  COALESCE(SUM(gpu_hours) FILTER (WHERE failed), 0) AS wasted FROM u GROUP BY 1, 2, 3, 4),
st AS (SELECT {_WKEY}, state, COUNT(*) AS n FROM u WHERE failed GROUP BY 1, 2, 3, 4, 5),
dm AS (SELECT {_WKEY}, ARG_MAX(state, ROW(n, state)) AS dominant_state, MAX(n) AS dominant_count FROM st GROUP BY 1, 2, 3, 4)"""

_REQUEUE = "WITH " + ",".join([_JOBS, _STEPS, _METRICS, _ATTEMPTS]) + f""",
u AS ({_U}),
ra AS (SELECT {_WKEY}, a.job_id, a.state, a.elapsed_s FROM u JOIN acct_attempts a ON a.job_id = u.job_id WHERE a.end_ts IS NOT NULL),
g AS (SELECT {_WKEY}, COUNT(*) AS runs FROM u GROUP BY 1, 2, 3, 4),
rg AS (SELECT {_WKEY}, COUNT(*) AS attempts, COUNT(DISTINCT job_id) AS requeued, SUM(elapsed_s) AS abandoned FROM ra GROUP BY 1, 2, 3, 4),
rs AS (SELECT {_WKEY}, state, COUNT(*) AS n FROM ra GROUP BY 1, 2, 3, 4, 5),
rd AS (SELECT {_WKEY}, ARG_MAX(state, ROW(n, state)) AS dominant_state, MAX(n) AS dominant_count FROM rs GROUP BY 1, 2, 3, 4)"""

_FINDINGS = _ALL + """,
r0 AS (SELECT *, max_rss > mem_limit_bytes AS over, system_cpu / total_cpu AS share,
   io_bytes / CAST(elapsed_s AS DOUBLE) AS rate,
   SUBSTR(user_name, 2) AS uid FROM m),
fa AS (SELECT job_id, UNNEST([
  CASE WHEN open_ended THEN '2|open-record' END,
  CASE WHEN state = 'TIMEOUT' AND noop THEN '0|timeout-hang' END,
  CASE WHEN state = 'TIMEOUT' AND NOT noop THEN '0|timeout-real' END,
  CASE WHEN completed AND NOT noop AND elapsed_s / CAST(timelimit_s AS DOUBLE) < 0.5 THEN '2|walltime-slack' END,
  CASE WHEN state = 'OUT_OF_MEMORY' THEN '0|host-oom' END,
  CASE WHEN state <> 'OUT_OF_MEMORY' AND over THEN '1|rss-above-limit' END,
  CASE WHEN completed AND NOT noop AND max_rss / CAST(mem_limit_bytes AS DOUBLE) < 0.35
     AND mem_limit_bytes - max_rss >= 34359738368 THEN '2|memory-slack' END,
  CASE WHEN state NOT IN ('TIMEOUT', 'OUT_OF_MEMORY') AND noop THEN '0|noop-allocation' END,
  CASE WHEN state NOT IN ('TIMEOUT', 'OUT_OF_MEMORY') AND NOT open_ended AND NOT noop AND elapsed_s >= 120 AND cpus > 1
     AND cpu_util < 0.15 THEN '1|cpu-overrequest' END,
  CASE WHEN NOT open_ended AND NOT noop AND system_cpu <= total_cpu AND total_cpu >= 60 AND share >= 0.3 THEN '1|system-cpu-heavy' END,
  CASE WHEN NOT open_ended AND io_bytes >= 10737418240 AND rate >= 104857600 THEN '1|io-heavy' END,
  CASE WHEN NOT open_ended AND task_count > 1 AND imbalance >= 2 THEN '2|task-memory-imbalance' END,
  CASE WHEN cancelled AND uid <> '0' THEN '2|cancelled-by-other' END,
  CASE WHEN cancelled AND uid = '0' THEN '2|cancelled' END,
  CASE WHEN gpus > 0 AND NOT open_ended AND NOT noop AND state <> 'OUT_OF_MEMORY' AND cpu_util < 0.02 THEN '1|gpu-suspect-idle' END
  ]) AS f, UNNEST(RANGE(15)) AS pos FROM r0),
fi AS (SELECT job_id, pos, CAST(SUBSTR(f, 1, 1) AS INT) AS rank, SUBSTR(f, 3) AS code,
  CASE SUBSTR(f, 1, 1) WHEN '0' THEN 'critical' WHEN '1' THEN 'warning' ELSE 'info' END AS severity FROM fa WHERE f IS NOT NULL)"""


def _pick(flag: str, target: str, current: str, observed: str) -> str:
    return f"""SELECT {_WKEY}, CAST(runs AS BIGINT) AS runs, '{flag}' AS flag, verdict,
  ROUND(CAST({current} AS DOUBLE), 6) AS requested,
  CASE WHEN verdict <> 'unknown' THEN CAST({target} AS DOUBLE) END AS target,
  ROUND(CAST({observed} AS DOUBLE), 6) AS observed FROM f"""


_ORDERS = {
    "cost": "cost DESC, runs DESC", "failures": "problems DESC, cost DESC", "rate": "COALESCE(failure_rate, 0) DESC, runs DESC",
    "recent": "last_seen IS NULL, last_seen DESC, workload_name", "runs": "runs DESC, workload_name", "name": "LOWER(workload_name), workload_partition",
}


def oracle_sql() -> dict[str, str]:
    return evidence_sql.SQL | {
        "workload_orders": _WORKLOADS + " UNION ALL ".join(
            f"SELECT * FROM (SELECT '{mode}' AS mode, {_WKEY}, ROW_NUMBER() OVER (ORDER BY {order}, {_WKEY}) AS place FROM ws) WHERE place <= 25"
            for mode, order in _ORDERS.items()
        ),
        "entity_rates_supplier": _rates(_SUPPLIERS) + f"SELECT entity AS l_suppkey, {_RATE_COLUMNS} FROM v",
        "entity_rates_supplier_summary": _rates(_SUPPLIERS) + _SUMMARY,
        "entity_rates_supplier_stratified": _rates(_SUPPLIERS_BY_BRAND, "p_brand")
        + f"SELECT p_brand, entity AS l_suppkey, {_RATE_COLUMNS} FROM v",
        "entity_rates_biased": _rates(_NODES) + f"SELECT entity AS node, {_RATE_COLUMNS} FROM v",
        "entity_rates_biased_summary": _rates(_NODES) + _SUMMARY,
        "dominant_stratum": _ALL + """
SELECT folded AS workload_name, user_name AS workload_user, folded AS label,
  COUNT(*) FILTER (WHERE failed AND NOT cancelled AND state <> 'OUT_OF_MEMORY') AS events,
  COUNT(*) FILTER (WHERE NOT cancelled AND state <> 'OUT_OF_MEMORY') AS runs
FROM m WHERE usable GROUP BY 1, 2 ORDER BY events DESC, runs DESC, COUNT(*) DESC, 1, 2 LIMIT 1""",
        "exclude_top8": _rates(_NODES) + """, bad_nodes AS (SELECT entity, ROW_NUMBER() OVER (ORDER BY rate DESC, entity) AS k FROM v WHERE verdict = 'worse'),
top AS (SELECT CAST(SUBSTR(entity, 6) AS INT) AS n FROM bad_nodes WHERE k <= 8),
isl AS (SELECT n, n - ROW_NUMBER() OVER (ORDER BY n) AS g FROM top),
runs AS (SELECT MIN(n) AS a, MAX(n) AS b FROM isl GROUP BY g),
txt AS (SELECT STRING_AGG(CASE WHEN a = b THEN LPAD(CAST(a AS STRING), 4, '0') ELSE CONCAT(LPAD(CAST(a AS STRING), 4, '0'), '-', LPAD(CAST(b AS STRING), 4, '0')) END, ',' ORDER BY a) AS t, COUNT(*) AS c, MAX(b - a) AS wide FROM runs)
SELECT LEAST(COUNT(*), 8) AS shown, GREATEST(COUNT(*) - 8, 0) AS left_out,
  (SELECT CASE WHEN c = 1 AND wide = 0 THEN CONCAT('node-', t) ELSE CONCAT('node-[', t, ']') END FROM txt) AS exclude FROM bad_nodes""",
        "node_notes": _rates(_ALL + _PLACED + """,
c AS (SELECT folded, user_name, CONCAT('node-', LPAD(CAST(n AS STRING), 4, '0')) AS entity, COUNT(*) AS trials,
  COUNT(*) FILTER (WHERE failed) AS bad FROM pl GROUP BY 1, 2, 3)""", "folded, user_name") + """,
jh AS (SELECT job_id, folded, user_name, CONCAT('node-', LPAD(CAST(node_id + UNNEST(RANGE(CAST(n_nodes AS BIGINT))) AS STRING), 4, '0')) AS entity FROM m)
SELECT CAST(job_id AS BIGINT) AS job_id, ARG_MAX(entity, ROW(rate, entity)) AS noted_node FROM jh JOIN v USING (folded, user_name, entity) WHERE verdict = 'worse' GROUP BY 1""",
        "job_metrics_cpu": _ALL + """
SELECT CAST(job_id AS BIGINT) AS job_id, ROUND(total_cpu, 6) AS total_cpu, ROUND(system_cpu, 6) AS system_cpu,
  ROUND(total_cpu - system_cpu, 6) AS user_cpu,
  ROUND(CASE WHEN total_cpu >= 1 AND system_cpu <= total_cpu THEN system_cpu / total_cpu END, 6) AS system_share,
  ROUND(cpu_time, 6) AS cpu_time, ROUND(cpu_util, 6) AS cpu_utilization, ROUND(cpu_util * cpus, 6) AS cores_busy,
  ROUND(cpus_per_task, 6) AS cpus_per_task, CAST(task_count AS BIGINT) AS task_count, CAST(gpus AS BIGINT) AS gpu_count,
  ROUND(gpu_hours, 6) AS gpu_hours, ROUND(core_hours, 6) AS core_hours,
  ROUND(elapsed_s / CAST(timelimit_s AS DOUBLE), 6) AS walltime_used, noop AS is_noop FROM m""",
        "job_metrics_memory": _ALL + """
SELECT CAST(job_id AS BIGINT) AS job_id, CAST(max_rss AS BIGINT) AS max_rss, CAST(ave_rss AS BIGINT) AS ave_rss,
  CAST(mem_limit_bytes AS BIGINT) AS mem_limit, CAST(mem_limit_bytes * n_nodes AS BIGINT) AS mem_limit_total,
  ROUND(max_rss / CAST(mem_limit_bytes AS DOUBLE), 6) AS mem_utilization,
  ROUND(imbalance, 6) AS rss_task_imbalance, ROUND(step_spread, 6) AS rss_step_spread,
  NOT open_ended AND NOT COALESCE(max_rss > mem_limit_bytes, FALSE) AS peak_trustworthy FROM m""",
        "job_metrics_io": _ALL + """
SELECT CAST(job_id AS BIGINT) AS job_id, CAST(read_bytes AS BIGINT) AS read_bytes, CAST(write_bytes AS BIGINT) AS write_bytes,
  CAST(io_bytes AS BIGINT) AS io_bytes, ROUND(io_bytes / CAST(elapsed_s AS DOUBLE), 3) AS io_rate,
  CAST(step_count AS BIGINT) AS step_count FROM m""",
        "workload_rollup": _WORKLOADS + f"SELECT {_WSELECT} FROM ws",
        "workload_top_cost": _WORKLOADS + f"SELECT {_WSELECT} FROM ws ORDER BY ws.cost DESC, ws.runs DESC, 1, 2, 3, 4 LIMIT 25",
        "workload_search": _WORKLOADS + f"SELECT {_WSELECT} FROM ws WHERE named_so AND (ws.failed > 0 OR ws.noop > 0)",
        "tail_share": _WORKLOADS + """, o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY cost DESC, runs DESC, workload_name, workload_partition, workload_kind, workload_user) AS k FROM w)
SELECT COUNT(*) FILTER (WHERE k <= 20) AS shown, COUNT(*) FILTER (WHERE k > 20) AS hidden,
  CAST(COALESCE(SUM(runs) FILTER (WHERE k > 20), 0) AS BIGINT) AS hidden_runs,
  ROUND(COALESCE(SUM(cost) FILTER (WHERE k > 20), 0) / SUM(cost), 6) AS hidden_cost_share FROM o""",
        "idle_workload": _WORKLOADS + """SELECT workload_name, workload_partition, workload_kind, workload_user, ROUND(wasted_gpu_hours, 6) AS wasted_gpu_hours, ROUND(gpu_hours, 6) AS gpu_hours
FROM (SELECT * FROM w ORDER BY wasted_gpu_hours DESC, cost DESC, runs DESC, 1, 2, 3, 4 LIMIT 1) WHERE wasted_gpu_hours >= 1 AND (wasted_gpu_hours / gpu_hours >= 0.1 OR wasted_gpu_hours >= 100)""",
        "goodput": _ALL + """, g AS (SELECT COUNT(*) FILTER (WHERE usable) AS jobs, COUNT(*) FILTER (WHERE usable AND completed) AS completed,
  COUNT(*) FILTER (WHERE usable AND failed) AS failed, COUNT(*) FILTER (WHERE usable AND cancelled) AS cancelled,
  COUNT(*) FILTER (WHERE usable AND NOT completed AND NOT failed AND NOT cancelled) AS unclassified,
  COUNT(*) FILTER (WHERE usable AND noop) AS noop_jobs,
  COALESCE(SUM(gpu_hours) FILTER (WHERE usable), 0) AS gt, COALESCE(SUM(gpu_hours) FILTER (WHERE usable AND completed), 0) AS gc,
  COALESCE(SUM(gpu_hours) FILTER (WHERE usable AND noop), 0) AS gn, COALESCE(SUM(core_hours) FILTER (WHERE usable), 0) AS ct,
  COUNT(*) FILTER (WHERE open_ended) AS excluded_open_records, 0::BIGINT AS excluded_unparsed,
  COUNT(*) - COUNT(*) FILTER (WHERE usable) - COUNT(*) FILTER (WHERE open_ended) AS excluded_no_elapsed,
  CAST(COUNT(*) + SUM(step_count) AS BIGINT) AS parsed_rows FROM m)
SELECT jobs, completed, failed, cancelled, unclassified, noop_jobs, ROUND(gt, 6) AS gpu_hours_total, ROUND(gc, 6) AS gpu_hours_completed,
  ROUND(gn, 6) AS gpu_hours_noop, ROUND(ct, 6) AS core_hours_total, excluded_open_records, excluded_unparsed, excluded_no_elapsed, parsed_rows,
  ROUND(gc / gt, 6) AS gpu_goodput, ROUND(gn / gt, 6) AS gpu_noop_fraction,
  ROUND(completed / CAST(completed + failed + cancelled AS DOUBLE), 6) AS completion_rate FROM g""",
        "span_concurrency": _ALL + """, g AS (SELECT MIN(start_ts) AS a, MAX(end_ts) AS b, SUM(gpu_hours) AS gh FROM m WHERE usable)
SELECT CAST(a AS VARCHAR) AS first_start, CAST(b AS VARCHAR) AS last_end, ROUND(gh, 6) AS gpu_hours_total,
  ROUND(EPOCH(b - a) / 3600.0e0, 6) AS span_hours, ROUND(gh / (EPOCH(b - a) / 3600.0e0), 6) AS gpu_concurrency FROM g""",
        "job_search": _ALL + """SELECT CAST(job_id AS BIGINT) AS job_id, state, node_list FROM m WHERE (failed OR noop)
  AND (node_id = 20 OR (n_nodes = 2 AND node_id = 19))""",
        "problem_listing": _ALL + """SELECT CAST(job_id AS BIGINT) AS job_id, name, state, CAST(start_ts AS VARCHAR) AS start FROM m WHERE usable AND (failed OR noop)
  ORDER BY start_ts DESC, CAST(job_id AS VARCHAR) DESC LIMIT 25""",
        "repeat_failures": _REPEAT + f"""
SELECT {_WKEY}, CAST(runs AS BIGINT) AS runs, failures, completed, hung, ROUND(wasted, 6) AS wasted_gpu_hours, dominant_state, dominant_count,
  CASE WHEN failures / CAST(runs AS DOUBLE) > 0.8 THEN 'critical' ELSE 'warning' END AS severity
FROM g JOIN dm USING ({_WKEY}) WHERE runs >= 5 AND failures >= 5 AND failures >= 0.5 * runs""",
        "requeue_pattern": _REQUEUE + f"""
SELECT {_WKEY}, CAST(runs AS BIGINT) AS runs, requeued, attempts, CAST(abandoned AS DOUBLE) AS abandoned_seconds, dominant_state, dominant_count
FROM g JOIN rg USING ({_WKEY}) JOIN rd USING ({_WKEY}) WHERE requeued >= 3 AND requeued >= 0.1 * runs""",
        "noop_top": _ALL + """SELECT CAST(job_id AS BIGINT) AS job_id, ROUND(CASE WHEN gpu_hours > 0 THEN gpu_hours ELSE elapsed_s / 3600.0e0 END, 6) AS held_hours
FROM m WHERE usable AND noop ORDER BY CASE WHEN gpu_hours > 0 THEN gpu_hours ELSE elapsed_s / 3600.0e0 END DESC, job_id LIMIT 10""",
        "noop_summary": _ALL + """SELECT COUNT(*) AS noop_jobs, ROUND(COALESCE(SUM(gpu_hours), 0), 6) AS gpu_hours, COUNT(*) FILTER (WHERE elapsed_s <= 900) AS quick FROM m WHERE usable AND noop""",
        "memory_search_walk": _MEMORY + f"""
SELECT {_WKEY}, oom_kills, CAST(smallest_limit AS BIGINT) AS smallest_limit, CAST(largest_limit AS BIGINT) AS largest_limit, n_runs,
  smallest_limit < largest_limit AS searching, n_decreases = 0 AS monotone FROM mw""",
        "memory_contradiction": _MEMORY + f"""
SELECT {_WKEY}, CAST(contradicting_job AS BIGINT) AS contradicting_job FROM mw JOIN ct USING ({_WKEY})""",
        "patterns_report": _REPEAT + "," + _ATTEMPTS + f""",
rf AS (SELECT {_WKEY}, wasted, failures, ROW_NUMBER() OVER (ORDER BY wasted DESC, failures DESC, {_WKEY}) AS k FROM g
  WHERE runs >= 5 AND failures >= 5 AND failures >= 0.5 * runs),
om AS (SELECT {_WKEY}, COUNT(*) AS n FROM u WHERE state = 'OUT_OF_MEMORY' GROUP BY 1, 2, 3, 4 HAVING COUNT(*) >= 3),
ok AS (SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC, {_WKEY}) AS k FROM om),
ra AS (SELECT {_WKEY}, a.job_id, a.elapsed_s FROM u JOIN acct_attempts a ON a.job_id = u.job_id WHERE a.end_ts IS NOT NULL),
rg AS (SELECT {_WKEY}, COUNT(DISTINCT job_id) AS requeued, SUM(elapsed_s) AS abandoned FROM ra GROUP BY 1, 2, 3, 4),
rq AS (SELECT {_WKEY}, abandoned, requeued, ROW_NUMBER() OVER (ORDER BY abandoned DESC, requeued DESC, {_WKEY}) AS k FROM g JOIN rg USING ({_WKEY})
  WHERE requeued >= 3 AND requeued >= 0.1 * runs)
SELECT 'repeat' AS scope, 0 AS position, {_WKEY}, ROUND(CAST(wasted AS DOUBLE), 6) AS weight, CAST(failures AS BIGINT) AS hits FROM rf WHERE k <= 4
UNION ALL SELECT 'memory', 0, {_WKEY}, CAST(n AS DOUBLE), n FROM ok WHERE k <= 4
UNION ALL SELECT 'requeue', 0, {_WKEY}, CAST(abandoned AS DOUBLE), requeued FROM rq WHERE k <= 4
UNION ALL SELECT 'repeat', 1, NULL, NULL, NULL, NULL, ROUND(CAST(SUM(wasted) AS DOUBLE), 6), CAST(SUM(failures) AS BIGINT) FROM rf WHERE k > 4 HAVING COUNT(*) > 0
UNION ALL SELECT 'memory', 1, NULL, NULL, NULL, NULL, CAST(SUM(n) AS DOUBLE), CAST(SUM(n) AS BIGINT) FROM ok WHERE k > 4 HAVING COUNT(*) > 0
UNION ALL SELECT 'requeue', 1, NULL, NULL, NULL, NULL, CAST(SUM(abandoned) AS DOUBLE), CAST(SUM(requeued) AS BIGINT) FROM rq WHERE k > 4 HAVING COUNT(*) > 0""",
        "sizing_walltime": _WALL + _pick("--time", "target", "t_current", "t_longest"),
        "sizing_memory": _MEM + _pick("--mem", "target", "m_current", "CASE WHEN m_oom > 0 THEN m_floor ELSE m_peak END"),
        "sizing_cpu": _CPU + _pick("--cpus-per-task", "target", "c_current", "CASE WHEN c_fit >= 3 THEN c_peak END"),
        "latest_request": _SIZING + f"SELECT {_WKEY}, CAST(t_current AS DOUBLE) AS timelimit, CAST(m_current AS BIGINT) AS mem_limit, ROUND(c_current, 6) AS cpus_per_task FROM z",
        "p95_nearest_rank": """WITH o AS (SELECT l_returnflag, l_extendedprice AS v, ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS k,
  COUNT(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, ROUND(v, 6) AS p95 FROM o WHERE k = GREATEST(CEIL(0.95e0 * n), 1)""",
        "findings_by_code": _FINDINGS + "SELECT code, severity, COUNT(*) AS findings, COUNT(DISTINCT job_id) AS jobs FROM fi GROUP BY 1, 2",
        "findings_worst_per_job": _FINDINGS + "SELECT CAST(job_id AS BIGINT) AS job_id, ARG_MIN(code, ROW(rank, pos)) AS code, ARG_MIN(severity, ROW(rank, pos)) AS severity, COUNT(*) AS findings FROM fi GROUP BY 1",
        "findings_strict": _FINDINGS + "SELECT BOOL_OR(severity = 'critical') AS any_critical FROM fi",
        "hostlist_expand_count": _ALL + "SELECT CONCAT('node-', LPAD(CAST(n AS STRING), 4, '0')) AS node, COUNT(*) AS placements FROM (SELECT node_id + UNNEST(RANGE(CAST(n_nodes AS BIGINT))) AS n FROM acct_jobs) GROUP BY 1",
        "fold_names": """WITH """ + _JOBS + """ SELECT REGEXP_REPLACE(name, '[0-9]+', '#', 'g') AS folded, COUNT(*) AS jobs, COUNT(DISTINCT name) AS names FROM acct_jobs GROUP BY 1
UNION ALL SELECT REGEXP_REPLACE(c_name, '[0-9]+', '#', 'g'), COUNT(*), COUNT(DISTINCT c_name) FROM customer GROUP BY 1""",
        "event_failure_runs": """WITH e AS (SELECT user_id, event_id, event_type = 'error' AS hit, SUM(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events),
r AS (SELECT user_id, g, COUNT(*) AS len FROM e WHERE hit GROUP BY 1, 2),
t AS (SELECT user_id, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE hit) AS events FROM e GROUP BY 1)
SELECT t.user_id, t.n_rows, t.events, COALESCE(x.event_runs, 0) AS event_runs, COALESCE(x.longest_run, 0) AS longest_run FROM t
LEFT JOIN (SELECT user_id, COUNT(*) AS event_runs, MAX(len) AS longest_run FROM r GROUP BY 1) x ON x.user_id = t.user_id""",
        "sizing_routing": _SIZING + """,
t1 AS (SELECT *, t_hung >= 3 AND t_hung >= 0.5 * t_timeouts AND t_hung >= 0.2 * runs AS vetoed,
  GREATEST(CEIL(t_longest * 1.25e0 / CASE WHEN t_longest * 1.25e0 < 3600 THEN 300 ELSE 900 END) * CASE WHEN t_longest * 1.25e0 < 3600 THEN 300 ELSE 900 END,
    COALESCE(CEIL(t_floor * 1.25e0 / CASE WHEN t_floor * 1.25e0 < 3600 THEN 300 ELSE 900 END) * CASE WHEN t_floor * 1.25e0 < 3600 THEN 300 ELSE 900 END, 0)) AS t_target,
  CASE WHEN m_oom > 0 THEN GREATEST(CEIL(m_floor * 1.3e0 / 1073741824), CASE WHEN m_fit >= 3 THEN CEIL(m_peak * 1.3e0 / 1073741824) ELSE 0 END)
   WHEN m_fit >= 3 THEN CEIL(m_peak * 1.3e0 / 1073741824) END AS m_target, GREATEST(CEIL(c_peak * 1.2e0), 1) AS c_target FROM z),
t2 AS (SELECT runs, CASE WHEN vetoed OR t_fit < 3 THEN 'unknown' ELSE """ + _by_change("t_target", "t_current") + """ END AS a,
  CASE WHEN m_target IS NULL THEN 'unknown' ELSE """ + _by_change("m_target * 1073741824", "m_current") + """ END AS b,
  CASE WHEN c_fit < 3 THEN 'unknown' ELSE """ + _by_change("c_target", "c_current") + """ END AS c FROM t1)
SELECT CASE WHEN a IN ('raise', 'lower') OR b IN ('raise', 'lower') OR c IN ('raise', 'lower') THEN 'has_advice'
  WHEN a = 'unknown' AND b = 'unknown' AND c = 'unknown' THEN 'too_few_runs' ELSE 'already_right' END AS status,
  COUNT(*) AS workloads, CAST(SUM(runs) AS BIGINT) AS runs FROM t2 GROUP BY 1""",
        "parse_roundtrip": _ALL + """
SELECT CAST(job_id AS BIGINT) AS job_id, CAST(cpus AS BIGINT) AS cpu_count, CAST(n_nodes AS BIGINT) AS node_count, CAST(gpus AS BIGINT) AS gpu_count,
  CAST(mem_limit_bytes AS BIGINT) AS mem_limit, CAST(max_rss AS BIGINT) AS max_rss, CAST(read_bytes AS BIGINT) AS read_bytes,
  CAST(write_bytes AS BIGINT) AS write_bytes, CAST(step_count AS BIGINT) AS step_count, CAST(elapsed_s AS DOUBLE) AS elapsed,
  CAST(timelimit_s AS DOUBLE) AS timelimit, ROUND(total_cpu, 6) AS total_cpu, ROUND(system_cpu, 6) AS system_cpu,
  name, user_name AS user, partition_name AS partition, state, node_list, CAST(submit_ts AS VARCHAR) AS submit,
  CAST(start_ts AS VARCHAR) AS start, CAST(end_ts AS VARCHAR) AS end, CASE WHEN job_id % 3 = 0 THEN 24::BIGINT END AS submit_chars FROM m""",
        "requeue_fold": "WITH " + _JOBS + "," + _ATTEMPTS + """,
f AS (SELECT *, (job_id + attempt) % 4 = 0 AS other FROM acct_attempts),
g AS (SELECT *, MAX(CASE WHEN other THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY attempt) = 0 AS kept FROM f),
n AS (SELECT *, COUNT(*) OVER (PARTITION BY job_id) AS c FROM g WHERE kept)
SELECT CAST(job_id AS BIGINT) AS job_id, 'attempt' AS role, c - attempt + 1 AS attempt, state, CAST(elapsed_s AS BIGINT) AS elapsed_s FROM n
UNION ALL SELECT CAST(job_id AS BIGINT), 'other', NULL, state, CAST(elapsed_s AS BIGINT) FROM g WHERE NOT kept
UNION ALL SELECT CAST(job_id AS BIGINT), 'job', NULL, state, CAST(elapsed_s AS BIGINT) FROM acct_jobs""",
        "window_scan": "WITH " + _JOBS + "," + _STEPS + """
SELECT CAST(j.job_id AS BIGINT) AS job_id, j.state, COUNT(*) AS steps FROM acct_jobs j JOIN acct_steps t ON t.job_id = j.job_id
WHERE (end_ts IS NULL OR end_ts >= TIMESTAMP '1998-01-01') AND start_ts <= TIMESTAMP '1998-07-01' AND partition_name = 'p1'
  AND state IN ('FAILED', 'TIMEOUT') GROUP BY 1, 2""",
        "refresh_changed": "WITH " + _JOBS + """
SELECT CAST(job_id AS BIGINT) AS job_id, CASE WHEN job_id % 17 = 0 THEN 'new'
  WHEN job_id % 11 = 0 AND state <> 'RUNNING' THEN 'changed' ELSE 'reuse' END AS action FROM acct_jobs""",
        "live_reconcile": "WITH " + _JOBS + """
SELECT state, CASE WHEN state = 'RUNNING' THEN job_id % 2 = 1 END AS live, state = 'RUNNING' AS open_ended, COUNT(*) AS jobs FROM acct_jobs GROUP BY 1, 2, 3""",
        "live_merge": "WITH " + _JOBS + "," + _STEPS + """,
r AS (SELECT job_id, SUM(total_cpu_s * ntasks) FILTER (WHERE step <> 'extern') AS cpu,
  MAX(max_rss_bytes) AS peak, MAX(max_rss_bytes) FILTER (WHERE step <> 'extern') AS work_peak,
  MAX(max_rss_bytes) FILTER (WHERE step = 'extern') AS extern_peak,
  MAX(ave_rss_bytes) FILTER (WHERE step <> 'extern') AS ave FROM acct_steps GROUP BY 1),
x AS (SELECT j.*, r.*, user_name = 'u10' AS mine,
  CASE WHEN peak > mem_limit_bytes AND work_peak <= mem_limit_bytes AND extern_peak = peak THEN work_peak ELSE peak END AS best
  FROM acct_jobs j JOIN r ON r.job_id = j.job_id WHERE j.job_id % 10 = 0 OR j.state = 'RUNNING')
SELECT CAST(job_id AS BIGINT) AS job_id, CASE WHEN mine AND job_id % 10 = 0 THEN ROUND(cpu, 6) END AS total_cpu,
  CASE WHEN mine AND job_id % 10 = 0 THEN CAST(best AS BIGINT) END AS max_rss, CASE WHEN mine AND job_id % 10 = 0 THEN CAST(ave AS BIGINT) END AS ave_rss,
  mine AND job_id % 10 = 0 AS live_metrics, NOT mine AS foreign_owner FROM x""",
        "partition_ceiling": """SELECT CONCAT('p', s_nationkey) AS partition, CAST(MAX(s_suppkey % 64 + 1) AS BIGINT) AS max_cores,
  CAST(MAX(CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey * 1000 END) AS BIGINT) AS max_mem_mb FROM supplier GROUP BY 1""",
        "job_report": _FINDINGS + """,
fj AS (SELECT job_id, COUNT(*) AS findings, ARG_MIN(code, ROW(rank, pos)) AS first_code FROM fi GROUP BY 1),
sj AS (SELECT job_id, COUNT(*) AS steps, ARG_MIN(CONCAT(job_id, '.', step), pos) AS first_step FROM acct_steps GROUP BY 1)
SELECT CAST(m.job_id AS BIGINT) AS job_id, SPLIT_PART(state, ' ', 1) AS state, CAST(elapsed_s AS DOUBLE) AS elapsed, steps, findings, first_code, first_step
FROM m LEFT JOIN fj ON fj.job_id = m.job_id LEFT JOIN sj ON sj.job_id = m.job_id""",
        "log_name_match": "WITH " + _JOBS + """
SELECT CAST(job_id AS BIGINT) AS job_id, CASE WHEN job_id % 3 = 0 THEN CONCAT('/work/', user_name, '/logs/slurm-', job_id, '.out')
  WHEN job_id % 6 = 1 THEN CONCAT('/work/', user_name, '/logs/x-', LPAD(CAST(job_id AS STRING), 10, '0'), '.err')
  ELSE CONCAT('/work/', user_name, '/run_', job_id, '_x.log') END AS path FROM acct_jobs WHERE job_id % 6 IN (0, 1, 3, 4)""",
        "time_window_match": """WITH i AS (SELECT o_orderkey AS iid, o_custkey % 10 AS g, 1704067200000 + (o_orderkey * 7919) % 2592000 * 1000 AS a,
  (60 + (o_orderkey * 31) % 7200) * 1000 AS len FROM orders),
p AS (SELECT event_id AS pid, user_id % 10 AS g, EPOCH_US(ts) // 1000 AS t, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS c FROM events)
SELECT iid AS job_id, COUNT(*) AS candidates, ARG_MIN(pid, ROW(c, ABS(t - a - len), pid)) AS event_id, CAST(ARG_MIN(ABS(t - a - len), ROW(c, ABS(t - a - len), pid)) AS BIGINT) AS distance_ms
FROM i JOIN p ON p.g = i.g AND t >= a - 60000 AND t <= a + len + 600000 GROUP BY 1""",
        # All pairs in order; every round keeps those that are first for both sides and drops what they exclude.
        "greedy_assign": """WITH RECURSIVE i AS (SELECT o_orderkey AS iid, o_custkey % 10 AS g, 1704067200000 + (o_orderkey * 7919) % 2592000 * 1000 AS a,
  (60 + (o_orderkey * 31) % 7200) * 1000 AS len FROM orders),
p AS (SELECT event_id AS pid, user_id % 10 AS g, EPOCH_US(ts) // 1000 AS t, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS c FROM events),
x AS (SELECT iid, pid, CAST(ABS(t - a - len) AS BIGINT) AS d, ROW_NUMBER() OVER (ORDER BY c, ABS(t - a - len), iid, pid) AS k
  FROM i JOIN p ON p.g = i.g AND t >= a - 60000 AND t <= a + len + 600000),
r AS (SELECT iid, pid, d, k, FALSE AS taken FROM x UNION ALL
  SELECT iid, pid, d, k, m FROM (
    SELECT *, MAX(m) OVER (PARTITION BY iid) OR MAX(m) OVER (PARTITION BY pid) AS excluded FROM (
      SELECT iid, pid, d, k, k = MIN(k) OVER (PARTITION BY iid) AND k = MIN(k) OVER (PARTITION BY pid) AS m FROM r WHERE NOT taken))
  WHERE m OR NOT excluded)
SELECT iid AS job_id, pid AS event_id, d AS distance_ms FROM r WHERE taken""",
        "traceback_markers": "WITH " + _JOBS + """
SELECT CAST(job_id AS BIGINT) AS job_id, job_id % 3 <> 0 AS device_memory, job_id % 3 <> 0 AS collective, job_id % 3 = 0 AS import_error,
  CASE WHEN job_id % 3 = 0 THEN CONCAT('[rank0]: Traceback (most recent call last):', CHR(10), '  ...', CHR(10), '    two', CHR(10), '    three', CHR(10), '    four', CHR(10), '[rank0]: ImportError: No module named m', job_id % 7) END AS traceback,
  CASE WHEN job_id % 3 = 0 THEN CONCAT('    one', CHR(10), '    two', CHR(10), '    three', CHR(10), '    four', CHR(10), '[rank0]: ImportError: No module named m', job_id % 7, CHR(10), 'end')
   ELSE CONCAT('b', CHR(10), 'c', CHR(10), 'CUDA out of memory ', job_id % 9, CHR(10), 'NCCL WARN ', job_id % 5, CHR(10), 'd', CHR(10), 'e') END AS excerpt FROM acct_jobs""",
        "log_excerpts": r"""WITH l AS (SELECT doc_id, text, [REGEXP_REPLACE(x, '\s+$', '') for x in STRING_SPLIT(text, CHR(10)) if REGEXP_MATCHES(x, '\S')] AS k FROM documents)
SELECT doc_id, MD5(ARRAY_TO_STRING(LIST_SLICE(k, GREATEST(LEN(k) - 5, 1), LEN(k)), CHR(10))) AS excerpt_md5,
  REGEXP_MATCHES(LOWER(text), 'modulenotfounderror|importerror|no module named') AS import_error FROM l""",
    }
