"""The evidence queries as plain SQL over the raw tables; shares no code with the operators."""

from __future__ import annotations

_WIDE = """
xj AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS at, 60 + o_orderkey * 131 % 90000 AS el,
  ['COMPLETED', 'FAILED', 'CANCELLED by 0', 'CANCELLED by 77', 'CANCELLED', 'NODE_FAIL', 'BOOT_FAIL', 'DEADLINE', 'PREEMPTED',
   'OUT_OF_MEMORY', 'TIMEOUT', 'FAILED', 'RUNNING', 'COMPLETED', 'FAILED', 'COMPLETED'][1 + o_orderkey % 16] AS state,
  [0, 1, 127, 137, 2, 0, 3, NULL][1 + o_orderkey // 16 % 8] AS exit_code, [0, 0, 0, 0, 15, 9, 40, NULL][1 + o_orderkey // 16 % 8] AS signal,
  CASE WHEN o_orderkey % 3 = 0 THEN '77' ELSE CAST(o_custkey % 40 AS VARCHAR) END AS uid,
  o_custkey % 3 AS gpus, 1 + o_orderkey % 8 AS cpus, 1 + o_orderkey % 2 AS nodes, (1 + o_orderkey % 128) * 1073741824 AS mem,
  'n' || (o_custkey % 11) AS node FROM orders),
xs AS (SELECT *, l_orderkey AS k, l_linenumber AS n, 1 + (l_orderkey + l_linenumber) % 4 AS tasks, q * 100000000 AS rss,
  CAST(FLOOR(q * 100000000 / CAST(1 + l_orderkey % 3 AS DOUBLE)) AS BIGINT) AS ave, l_linenumber <> 7 AS work,
  CASE WHEN l_orderkey % 7 <> 0 THEN 100e0 - (l_orderkey + l_linenumber) % 5 * 12 END AS low
  FROM (SELECT l_orderkey, l_linenumber, CAST(SUM(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2)),
xr AS (SELECT k, COUNT(*) AS steps, MAX(tasks) AS tasks,
  CAST(SUM(q * (k % 5) * 3) FILTER (WHERE work) AS DOUBLE) AS total, CAST(SUM(q * (k % 5)) FILTER (WHERE work) AS DOUBLE) AS kernel,
  MAX(rss) AS peak_all, MAX(rss) FILTER (WHERE work) AS peak_work, MAX(rss) FILTER (WHERE NOT work) AS peak_extern,
  MAX(rss / CAST(ave AS DOUBLE)) FILTER (WHERE work AND ave > 0) AS imbalance,
  MAX(CASE WHEN k % 6 <> 0 THEN rss * 3 END) AS vmsize, MAX(k % 4 * n * 200) AS pages,
  ARG_MIN(GREATEST(0e0, (100e0 - low) / 100e0), n) FILTER (WHERE work AND tasks > 1 AND low IS NOT NULL) AS spread,
  ARG_MIN('m' || n, n) FILTER (WHERE work AND tasks > 1 AND low IS NOT NULL) AS slow_node,
  MAX(CASE WHEN work AND tasks > 1 AND low IS NOT NULL THEN CAST(k % 9 AS VARCHAR) END) AS slow_task,
  ARG_MIN(['2.40G', '1200M', '2500000K', '0', '9999G', '3100000000'][1 + (k + n) % 6], n) FILTER (WHERE work) AS clock,
  ARG_MIN([2.4e9, 1.2e9, 2.5e9, NULL, NULL, 3.1e9][1 + (k + n) % 6], n) FILTER (WHERE work AND (k + n) % 6 NOT IN (3, 4)) AS hz,
  MAX(CASE WHEN work AND k % 4 = 1 THEN k * 7 % 101 / 100e0 END) AS util,
  MAX(CASE WHEN k % 4 = 1 THEN q * CAST(1048576000 AS BIGINT) END) AS gmem, MAX(CASE WHEN k % 2 = 0 THEN q * 1000 END) AS energy
  FROM xs GROUP BY k),
xm0 AS (SELECT xj.*, steps, COALESCE(xr.tasks, 0) AS tasks, vmsize, pages, spread, slow_node, slow_task, clock, hz, util, gmem, energy, imbalance, total, kernel, state = 'RUNNING' AS open,
  CASE WHEN peak_all > mem AND peak_work <= mem AND peak_extern = peak_all THEN peak_work ELSE peak_all END AS rss
  FROM xj LEFT JOIN xr USING (k)),
xm AS (SELECT *, COALESCE(NOT open AND el > 300 AND total < 10, FALSE) AS noop, SPLIT_PART(state, ' ', 1) AS word FROM xm0),
xp AS (SELECT xs.k, ARG_MIN('r' || n, n) AS peak_node, ARG_MIN(CAST(n % 3 AS VARCHAR), n) AS peak_task FROM xs JOIN xm ON xm.k = xs.k AND xs.rss = xm.rss AND xm.word <> 'RUNNING' GROUP BY 1)"""

# Figures of running jobs are those of their running steps: none here.
_GOING = "word = 'RUNNING'"


def _duration(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN 'n/a' WHEN ROUND_EVEN({x}, 2) < 1 THEN PRINTF('%.2fs', CAST({x} AS DOUBLE)) WHEN ROUND_EVEN({x}, 1) < 60 THEN PRINTF('%.1fs', CAST({x} AS DOUBLE))
  ELSE CASE WHEN ROUND_EVEN({x}, 0) >= 86400 THEN CAST(CAST(ROUND_EVEN({x}, 0) AS BIGINT) // 86400 AS VARCHAR) || '-' ELSE '' END
    || PRINTF('%02d:%02d:%02d', CAST(ROUND_EVEN({x}, 0) AS BIGINT) % 86400 // 3600, CAST(ROUND_EVEN({x}, 0) AS BIGINT) % 3600 // 60, CAST(ROUND_EVEN({x}, 0) AS BIGINT) % 60) END"""


def _share(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'n/a' WHEN {x} * 100 > 0 AND {x} * 100 < 0.05 THEN '<0.1%' WHEN {x} * 100 >= 99.95 AND {x} * 100 < 100 THEN '>99.9%' ELSE PRINTF('%.1f%%', {x} * 100e0) END"


def _bytes(x: str) -> str:
    steps = " ".join(
        f"WHEN {x} >= {1024 ** p}e0 * 1023.95e0 / 1024e0 THEN PRINTF('%.1f {unit}', {x} / {1024 ** p}e0)"
        for unit, p in (("PiB", 5), ("TiB", 4), ("GiB", 3), ("MiB", 2), ("KiB", 1))
    )
    return f"CASE WHEN {x} IS NULL THEN 'n/a' {steps} ELSE CAST(CAST(TRUNC({x}) AS BIGINT) AS VARCHAR) || ' B' END"


_EXITS = f"""WITH {_WIDE},
e AS (SELECT *, COALESCE(NULLIF(signal, 0), CASE WHEN exit_code = 137 THEN 9 END) AS killer,
  NULLIF(REGEXP_EXTRACT(state, '^CANCELLED by ([0-9]+)$', 1), '') AS by_, exit_code IN (127, 137) OR COALESCE(signal <> 0, FALSE) AS above FROM xm),
f AS (SELECT *, COALESCE(word = 'CANCELLED' AND by_ <> uid, FALSE) AS other,
  COALESCE(CASE killer WHEN 9 THEN 'SIGKILL' WHEN 15 THEN 'SIGTERM' END, 'signal ' || killer) AS named FROM e)
SELECT k AS job_id, t.* FROM f, LATERAL (SELECT UNNEST([
  CASE WHEN other THEN {{'code': 'cancelled-by-other', 'severity': 'info', 'title': CASE WHEN by_ = '0' THEN 'Cancelled by root' ELSE 'Cancelled by another user' END,
    'evidence': 'Ended by uid ' || by_ || ', owner is uid ' || uid || '.',
    'action': CASE WHEN by_ = '0' THEN 'Check for maintenance or a policy limit before resubmitting.' ELSE 'Ask the holder of uid ' || by_ || '.' END}} END,
  CASE WHEN word = 'CANCELLED' AND NOT other THEN {{'code': 'cancelled', 'severity': 'info', 'title': 'Cancelled, not failed',
    'evidence': 'Left out of failure rates: a deliberate stop and an abandoned run look the same.', 'action': ''}} END,
  CASE word WHEN 'NODE_FAIL' THEN {{'code': 'node-failed', 'severity': 'warning', 'title': 'The node failed', 'evidence': 'The machine died; small CPU or memory totals are missing data.',
    'action': 'Resubmit; the node table tells whether one machine stands out.'}}
   WHEN 'BOOT_FAIL' THEN {{'code': 'boot-failed', 'severity': 'warning', 'title': 'The node did not boot', 'evidence': 'Nothing of the job ran.', 'action': 'Resubmit; the node table tells whether one machine stands out.'}}
   WHEN 'DEADLINE' THEN {{'code': 'deadline', 'severity': 'critical', 'title': 'Killed at its deadline', 'evidence': 'The deadline passed; it is not the time limit.', 'action': 'Move the deadline or submit earlier.'}}
   WHEN 'PREEMPTED' THEN {{'code': 'preempted', 'severity': 'info', 'title': 'Preempted, not failed', 'evidence': 'The allocation was reclaimed for other work.', 'action': 'Requeue, or use a priority class that keeps its allocation.'}} END,
  CASE WHEN exit_code = 127 THEN {{'code': 'command-not-found', 'severity': 'critical', 'title': 'Command not found (exit 127)', 'evidence': 'The shell did not find an executable.',
    'action': 'Check module loads and environment activation order.'}} END,
  CASE WHEN killer IS NOT NULL AND word NOT IN ('OUT_OF_MEMORY', 'TIMEOUT', 'CANCELLED', 'PREEMPTED', 'NODE_FAIL') THEN {{'code': CASE WHEN killer = 9 THEN 'sigkill' ELSE 'signal-kill' END,
    'severity': 'critical', 'title': 'Killed by ' || named, 'evidence': 'Signal ' || killer || ' with state ' || word || ': no scheduler limit explains it.',
    'action': 'Look for a wrapper, a timeout in the script or the node''s own memory killer.'}} END,
  CASE WHEN word = 'FAILED' AND exit_code <> 0 THEN {{'code': 'exit-nonzero-nolog', 'severity': 'warning',
    'title': CASE WHEN above THEN 'Exit ' || exit_code || ', no log to confirm it' WHEN exit_code = 1 THEN 'Exit 1, no log to explain it' ELSE 'Exit ' || exit_code || ', no log to explain it' END,
    'evidence': CASE WHEN above THEN 'The status is known, the command and progress are not.' WHEN exit_code = 1 THEN 'Exit 1 is any interpreter error; the log would tell which.' ELSE 'Exit ' || exit_code || ' alone names no cause.' END,
    'action': 'Record the error output at a known path.'}} END
]) AS r) u, LATERAL (SELECT r.code AS code, r.severity AS severity, r.title AS title, r.evidence AS evidence, r.action AS action) t WHERE r IS NOT NULL"""

_FIGURES = f"""WITH {_WIDE},
f AS (SELECT *, gpus > 0 AND NOT open AND NOT noop AS held, NOT open AND tasks > 1 AS parallel FROM xm)
SELECT k AS job_id, t.* FROM f, LATERAL (SELECT UNNEST([
  CASE WHEN word = 'COMPLETED' AND NOT noop AND rss / CAST(mem AS DOUBLE) < 0.35 AND mem - rss >= 34359738368 THEN {{'code': 'memory-slack', 'severity': 'info', 'title': 'Far more memory reserved than touched',
    'evidence': 'Peak ' || {_bytes('rss')} || ' of ' || {_bytes('mem')} || ' (' || {_share('rss / CAST(mem AS DOUBLE)')} || '), ' || {_bytes('(mem - rss)')} || ' unused.',
    'action': 'Try --mem=' || GREATEST(CAST(CEIL(FLOOR(rss * 1.3e0) / 1073741824e0) AS BIGINT), 1) || 'G (peak plus 30%); the peak is the control group''s own high-water mark.' || CASE WHEN el // 30 + 1 <= 5 THEN ' Thinly sampled: ' || 'no more than ' || (el // 30 + 1) || CASE WHEN el // 30 = 0 THEN ' sample' ELSE ' samples' END || ' in ' || el || 's' || '.' ELSE '' END}} END,
  CASE WHEN held AND util < 0.05 THEN {{'code': 'gpu-idle', 'severity': 'critical', 'title': 'GPUs barely used',
    'evidence': gpus || ' GPU(s) for ' || {_duration('el')} || ' at ' || {_share('util')} || ' measured utilization.', 'action': 'Check the input pipeline before asking for more devices.'}} END,
  CASE WHEN held AND util >= 0.05 AND util < 0.40 THEN {{'code': 'gpu-underused', 'severity': 'warning', 'title': 'GPUs partly busy',
    'evidence': gpus || ' GPU(s) for ' || {_duration('el')} || ' at ' || {_share('util')} || ' measured utilization.', 'action': 'Raise the work per step.'}} END,
  CASE WHEN parallel AND spread >= 0.25 THEN {{'code': 'straggler', 'severity': 'warning', 'title': 'One task fell behind',
    'evidence': 'The slowest task used ' || {_share('spread')} || ' less CPU than the mean of ' || tasks || ' tasks. Task ' || slow_task || ' on ' || slow_node || '.',
    'action': 'Compare the ranks: the one that reports an error is often the victim.'}} END,
  CASE WHEN NOT open AND pages >= 1000 THEN {{'code': 'paging', 'severity': 'warning', 'title': 'The job was paging', 'evidence': FORMAT('{{:,}}', pages) || ' major page faults.',
    'action': 'Raise the memory request or shrink the working set.'}} END,
  CASE WHEN k % 10 = 3 THEN {{'code': 'node-history', 'severity': 'info', 'title': 'This node has a history', 'evidence': 'node ' || node || ' fails often', 'action': 'Consider excluding it if this repeats.'}} END
]) AS r) u, LATERAL (SELECT r.code AS code, r.severity AS severity, r.title AS title, r.evidence AS evidence, r.action AS action) t WHERE r IS NOT NULL"""

_METRICS = f"""WITH {_WIDE}
SELECT k AS job_id, CASE WHEN NOT {_GOING} THEN vmsize END AS max_vmsize, CASE WHEN NOT {_GOING} THEN pages END AS max_pages, gmem AS gpu_mem_peak_bytes, energy AS energy_joules, gpus AS gpu_count,
  ROUND(hz, 6) AS cpu_freq_hz, ROUND(spread, 6) AS straggler_spread, ROUND(util, 6) AS gpu_utilization,
  CASE WHEN NOT {_GOING} THEN ROUND(vmsize / CAST(rss AS DOUBLE), 6) END AS vmsize_to_rss, CASE WHEN NOT {_GOING} THEN ROUND(imbalance, 6) END AS rss_task_imbalance,
  peak_node AS max_rss_node, peak_task AS max_rss_task, slow_node AS slowest_node, slow_task AS slowest_task, clock AS cpu_freq, word AS base_state,
  ['backfill', 'main', 'submit', NULL][1 + k % 4] AS scheduled_by, CASE WHEN NOT {_GOING} AND rss IS NOT NULL THEN 'accounting (final)' END AS peak_source,
  CASE WHEN {_GOING} THEN 'in_progress_unflushed' WHEN rss IS NULL THEN 'not_gathered' END AS peak_missing_reason, exit_code, signal,
  word IN ('FAILED', 'TIMEOUT', 'OUT_OF_MEMORY', 'NODE_FAIL', 'BOOT_FAIL', 'DEADLINE') AS is_failed, word = 'COMPLETED' AS is_completed, word = 'CANCELLED' AS is_cancelled,
  open AS open_ended, NOT {_GOING} AND NOT COALESCE(rss > mem, FALSE) AS peak_trustworthy
FROM xm LEFT JOIN xp USING (k)"""

_SHARDS = r"""
sd AS (SELECT doc_id AS k, doc_id % 8 AS shard, REGEXP_REPLACE(REGEXP_REPLACE(text, '[^\x20-\x7E\n]', '.', 'g'), '(?i)traceback', 'tracing', 'g') AS body FROM documents),
st AS (SELECT *, '[rank1]: Traceback (most recent call last):' || CHR(10) || '[rank1]:   File x.py, line ' || k || CHR(10) || '    a' || CHR(10) || CHR(10) || '    b' || CHR(10) || '    c' || CHR(10)
  || '    d' || CHR(10) || '[rank1]: ValueError: ' || k || CHR(10) || 'after' AS trace FROM sd),
sv AS (SELECT k, shard, CONCAT_WS(CHR(10), body, CASE WHEN shard = 0 AND k % 16 = 8 THEN 'RuntimeError: CUDA out of memory' WHEN shard = 1 AND k % 3 = 1 THEN 'NCCL WARN x'
  WHEN shard = 2 AND k % 16 = 2 THEN trace || CHR(10) || 'ModuleNotFoundError: y' WHEN shard = 3 AND k % 48 = 3 THEN trace
  WHEN shard = 4 THEN 'Traceback (most recent call last):' || CHR(10) || '  cut off' || CHR(10) END) AS v FROM st),
sl AS (SELECT shard, k, UNNEST(STRING_SPLIT(v, CHR(10))) AS line, GENERATE_SUBSCRIPTS(STRING_SPLIT(v, CHR(10)), 1) AS i FROM sv),
so AS (SELECT shard, line, ROW_NUMBER() OVER (PARTITION BY shard ORDER BY k, i) AS n,
  STARTS_WITH(LTRIM(REGEXP_REPLACE(line, '^\s*\[rank[^\]]*\]: ', '')), 'Traceback (most recent call last)') AS header,
  REGEXP_MATCHES(REGEXP_REPLACE(line, '^\s*\[rank[^\]]*\]: ', ''), '^\S') AS stops, REGEXP_MATCHES(line, '\S') AS told FROM sl),
sh AS (SELECT shard, MAX(n) FILTER (WHERE header) AS h, BOOL_OR(REGEXP_MATCHES(LOWER(line), 'cuda out of memory')) AS device_memory,
  BOOL_OR(REGEXP_MATCHES(LOWER(line), 'nccl warn')) AS collective, BOOL_OR(REGEXP_MATCHES(LOWER(line), 'modulenotfounderror|importerror|no module named')) AS import_error FROM so GROUP BY 1),
se AS (SELECT shard, h, COALESCE(MIN(n) FILTER (WHERE stops AND n > h), MAX(n)) AS e FROM so JOIN sh USING (shard) GROUP BY 1, 2),
sb AS (SELECT shard, LIST(RTRIM(line) ORDER BY n) AS t FROM so JOIN se USING (shard) WHERE told AND n BETWEEN h AND e GROUP BY 1),
sx AS (SELECT shard, LIST(RTRIM(line) ORDER BY n) AS x FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY shard ORDER BY n DESC) AS back FROM so WHERE told) WHERE back <= 6 GROUP BY 1),
sg AS (SELECT shard, FALSE AS blank, device_memory, collective, import_error,
  CASE WHEN LEN(t) > 6 THEN ARRAY_TO_STRING([t[1], '  ...'] || t[-4:], CHR(10)) ELSE ARRAY_TO_STRING(t, CHR(10)) END AS traceback, ARRAY_TO_STRING(x, CHR(10)) AS excerpt
  FROM sh LEFT JOIN sb USING (shard) LEFT JOIN sx USING (shard))"""

_WITH_LOGS = f"""WITH {_WIDE}, {_SHARDS},
f AS (SELECT xm.*, sg.*, sg.shard IS NULL AS nolog, exit_code IN (127, 137) OR COALESCE(signal <> 0, FALSE) AS above,
  word IN ('FAILED', 'TIMEOUT', 'OUT_OF_MEMORY', 'NODE_FAIL', 'BOOT_FAIL', 'DEADLINE') AS failed FROM xm LEFT JOIN sg ON xm.k % 5 <> 0 AND sg.shard = xm.k % 8)
SELECT k AS job_id, t.* FROM f, LATERAL (SELECT UNNEST([
  CASE WHEN nolog AND word = 'FAILED' AND exit_code <> 0 THEN {{'code': 'exit-nonzero-nolog', 'severity': 'warning',
    'title': CASE WHEN above THEN 'Exit ' || exit_code || ', no log to confirm it' WHEN exit_code = 1 THEN 'Exit 1, no log to explain it' ELSE 'Exit ' || exit_code || ', no log to explain it' END,
    'evidence': CASE WHEN above THEN 'The status is known, the command and progress are not.' WHEN exit_code = 1 THEN 'Exit 1 is any interpreter error; the log would tell which.' ELSE 'Exit ' || exit_code || ' alone names no cause.' END,
    'action': 'Record the error output at a known path.'}} END,
  CASE WHEN gpus > 0 AND device_memory THEN {{'code': 'cuda-oom', 'severity': 'critical', 'title': 'GPU out of memory', 'evidence': 'A device allocation failed; host memory is not involved.',
    'action': 'Reduce the batch size, checkpoint activations or shard.'}} END,
  CASE WHEN gpus > 0 AND (gpus > 1 OR tasks > 1 OR nodes > 1) AND collective THEN {{'code': 'nccl', 'severity': 'critical', 'title': 'Collective communication failed',
    'evidence': 'Collective-library errors in the log, usually a symptom of one rank that stopped.', 'action': 'Compare all ranks.'}} END,
  CASE WHEN import_error THEN {{'code': 'import-error', 'severity': 'critical', 'title': 'A Python import failed', 'evidence': 'Import failure in the log.', 'action': 'Pin the environment and record it with the run.'}} END,
  CASE WHEN traceback IS NOT NULL THEN {{'code': 'traceback', 'severity': 'info', 'title': 'Last traceback in the log', 'evidence': traceback, 'action': ''}} END,
  CASE WHEN NOT nolog AND traceback IS NULL AND failed THEN {{'code': 'log-tail', 'severity': 'info', 'title': 'End of the log', 'evidence': excerpt, 'action': ''}} END
]) AS r) u, LATERAL (SELECT r.code AS code, r.severity AS severity, r.title AS title, r.evidence AS evidence, r.action AS action) t WHERE r IS NOT NULL"""

_ASSIGN = """WITH RECURSIVE j AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS id, EPOCH_MS(o_orderdate) AS a, (60 + o_orderkey * 131 % 90000) * 1000 AS len, o_orderkey % 16 = 12 AS going,
  '/work/u' || (LENGTH('u' || (o_custkey % 40)) + o_orderkey % 2) AS home FROM orders),
i AS (SELECT *, a + len AS e FROM j WHERE k % 3 <> 0 AND NOT going),
p AS (SELECT home, home || '/logs/q' || TRANSLATE(id, '0123456789', 'abcdefghij') || '.log' AS path, a + len + (k * 37 % 900 - 120) * 1000 AS t, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS c
  FROM j WHERE k % 3 = 1 AND NOT going),
x AS (SELECT k, path, ROW_NUMBER() OVER (ORDER BY c, ABS(t - e), id, path) AS o FROM i JOIN p ON p.home = i.home AND t >= a - 60000 AND t <= e + 600000),
r AS (SELECT k, path, o, FALSE AS taken FROM x UNION ALL
  SELECT k, path, o, m FROM (
    SELECT *, MAX(m) OVER (PARTITION BY k) OR MAX(m) OVER (PARTITION BY path) AS excluded FROM (
      SELECT k, path, o, o = MIN(o) OVER (PARTITION BY k) AND o = MIN(o) OVER (PARTITION BY path) AS m FROM r WHERE NOT taken))
  WHERE m OR NOT excluded)
SELECT j.k AS job_id, CASE WHEN j.k % 3 = 0 THEN home || '/logs/slurm-' || id || '.out' ELSE r.path END AS path, r.path IS NOT NULL AS inferred
FROM j LEFT JOIN r ON r.k = j.k AND r.taken"""

SQL = {
    "assign_logs": _ASSIGN,
    "metrics_wide": _METRICS,
    "findings_exits": _EXITS,
    "findings_figures": _FIGURES,
    "log_wide": f"WITH {_SHARDS} SELECT shard, blank, device_memory, collective, import_error, traceback, excerpt FROM sg",
    "findings_with_logs": _WITH_LOGS,
    "refresh_store": """WITH j AS (SELECT o_orderkey % 50000 = 1 AS moved, o_custkey = 1 AS late, CAST(o_orderdate AS DATE) AS d FROM orders),
e AS (SELECT *, CASE WHEN moved THEN d + 2 ELSE d END AS day FROM j),
touched AS (SELECT STRFTIME(day, '%Y-%m') AS m FROM e WHERE moved OR late UNION SELECT STRFTIME(d, '%Y-%m') FROM e WHERE moved AND NOT late)
SELECT STRFTIME(day, '%Y-%m') AS month, COUNT(*) AS jobs, COUNT(*) FILTER (WHERE moved) AS failed, STRFTIME(day, '%Y-%m') NOT IN (SELECT m FROM touched) AS files_kept FROM e GROUP BY 1, 4""",
    "stream_fold": """SELECT o_orderkey AS job_id, 'COMPLETED' AS state, STRFTIME(o_orderdate + INTERVAL '1' DAY * CASE WHEN o_orderkey % 7 = 0 THEN 3 ELSE 0 END, '%Y-%m-%d') AS day,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 30 + 100 ELSE o_orderkey % 50 + 1 END AS DOUBLE) AS cpu, CAST(o_orderkey % 7 = 0 AS BIGINT) AS attempts FROM orders""",
    "section_counters": """WITH j AS (SELECT *, o_orderkey % 10 = 0 AS wide FROM orders),
w AS (SELECT * FROM j WHERE NOT wide AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1997-01-01')
SELECT '1995-01-01' AS since, '1997-01-01' AS until, (SELECT COUNT(*) FROM j) AS records, (SELECT COUNT(*) FROM j WHERE wide) AS extra_fields,
  COUNT(*) AS jobs, COUNT(*) FILTER (WHERE o_orderkey % 4 = 0) AS failed FROM w""",
    "hostlist_wide": """WITH j AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 60000 = 1 THEN 1000 ELSE o_orderkey % 7 + 1 END AS n FROM orders),
r AS (SELECT k, CASE WHEN n >= k % 3 THEN CAST(v AS VARCHAR) ELSE (k % 3) || '-' || n END AS a, n FROM (SELECT k, n, UNNEST(CASE WHEN n >= k % 3 THEN RANGE(k % 3, n + 1) ELSE [0] END) AS v FROM j)),
c AS (SELECT k, 'r' || a || 'n' || b AS h FROM (SELECT k, a, UNNEST(LIST_TRANSFORM(RANGE(1, n + 1), lambda v: CASE WHEN LENGTH(CAST(v AS VARCHAR)) >= 3 THEN CAST(v AS VARCHAR) ELSE LPAD(CAST(v AS VARCHAR), 3, '0') END) || ['login']) AS b FROM r)
  UNION ALL SELECT k, 'x' || (k % 5) FROM j)
SELECT k AS job_id, COUNT(*) AS hosts, MIN(h) AS first, MAX(h) AS last FROM c GROUP BY 1""",
    "site_settings": """WITH s AS (SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 1 THEN 'jobacct_gather/cgroup' WHEN 2 THEN 'jobacct_gather/linux' END AS g,
  CASE s_suppkey % 4 WHEN 0 THEN 'cpu|mem' WHEN 1 THEN 'cpu|gres/gpu:a100|gres/gpuutil' ELSE 'gres/gpu' END AS t FROM supplier)
SELECT 'c' || k AS cluster, '24.' || (k % 12) AS version, g AS gather_type, t AS tres, [30, 45, NULL, NULL, NULL, 15][1 + k % 6] AS sampling_seconds,
  CONTAINS(g, 'cgroup') AS from_cgroup, k % 4 <> 0 AS tracks_gpu, k % 4 = 1 AS tracks_gpu_utilization FROM s""",
    "texts_of_figures": f"""WITH x AS (SELECT l_extendedprice * (l_partkey % 7) AS s, l_extendedprice * POW(10e0, l_linenumber * 2) AS b,
  CASE WHEN l_linenumber <> 4 THEN l_discount * l_tax / 8 END AS p, l_extendedprice * 1e5 + 1 AS hz FROM lineitem)
SELECT {_duration('s')} AS duration, {_bytes('b')} AS bytes, {_share('p')} AS share,
  CASE WHEN hz >= 1e9 THEN PRINTF('%.2f GHz', hz / 1e9) ELSE PRINTF('%.0f MHz', hz / 1e6) END AS clock, COUNT(*) AS rows FROM x GROUP BY ALL""",
}
