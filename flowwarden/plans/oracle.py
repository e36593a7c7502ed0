"""Hand-written DuckDB SQL for the registered queries, over the same tables."""

_FLOWS = """
ev AS (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
flows AS (
  SELECT event_id AS flow_id, ts, user_id AS src_id,
    k * 20 AS duration,
    CASE event_id % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' ELSE 'icmp' END AS protocol_type,
    CASE event_type WHEN 'view' THEN 'http' WHEN 'click' THEN 'smtp' WHEN 'signup' THEN 'ftp'
                    WHEN 'purchase' THEN 'eco_i' WHEN 'error' THEN 'domain_u' END AS service,
    CASE k % 5 WHEN 0 THEN 'SF' WHEN 1 THEN 'S0' WHEN 2 THEN 'REJ' WHEN 3 THEN 'RSTO' ELSE 'RSTR' END AS flag,
    CAST(floor(value * value * 4.0e0) AS BIGINT) AS src_bytes,
    (event_id * 17) % 5000 AS dst_bytes,
    CAST(floor(CAST((event_id*7)%400 AS DOUBLE) * CAST((event_id*7)%400 AS DOUBLE) / 400.0e0) AS BIGINT) AS "count",
    CAST(floor(CAST((event_id*11)%60 AS DOUBLE) * CAST((event_id*11)%60 AS DOUBLE) / 120.0e0) AS BIGINT) AS srv_count,
    CAST(k AS DOUBLE) * CAST(k AS DOUBLE) / 10000.0e0 AS serror_rate,
    CASE WHEN event_id % 9 < 6 THEN CAST(0 AS BIGINT) ELSE event_id % 8 END AS num_failed_logins,
    CAST(floor(CAST((event_id*13)%256 AS DOUBLE) * CAST((event_id*13)%256 AS DOUBLE) / 256.0e0) AS BIGINT) AS dst_host_count,
    CASE WHEN event_type = 'error' THEN 'neptune'
         WHEN event_type = 'signup' AND event_id % 10 = 0 THEN 'guess_passwd' ELSE 'normal' END AS class,
    event_id % 22 AS difficulty
  FROM ev)"""

_SCORED = """
labelled AS (SELECT *, CASE WHEN class IS NOT DISTINCT FROM 'normal' THEN 0 ELSE 1 END AS y FROM flows),
scored AS (
  SELECT *, round(1.0e0 / (1.0e0 + exp(-(-2.0e0
    + CASE WHEN src_bytes <= 50000 THEN -0.9e0 ELSE 1.6e0 END
    + CASE WHEN "count" <= 300 THEN -0.5e0 ELSE 1.5e0 END
    + CASE WHEN serror_rate <= 0.5e0 THEN -1.2e0 ELSE 1.7e0 END
    + CASE WHEN num_failed_logins <= 3 THEN -0.8e0 ELSE 1.2e0 END
    + CASE WHEN dst_host_count <= 100 THEN -0.7e0 ELSE 0.8e0 END
    + CASE WHEN srv_count <= 20 THEN -0.4e0 ELSE 0.5e0 END
    + CASE WHEN duration <= 1000 THEN -0.3e0 ELSE 0.6e0 END
    + CASE WHEN dst_bytes <= 2500 THEN 0.4e0 ELSE -0.4e0 END
    + CASE WHEN flag = 'S0' THEN 2.0e0 ELSE -0.6e0 END
    + CASE WHEN flag = 'REJ' THEN 1.1e0 ELSE -0.3e0 END
    + CASE WHEN protocol_type = 'icmp' THEN 0.9e0 ELSE -0.4e0 END
    + CASE WHEN service = 'domain_u' THEN 2.2e0 ELSE -0.9e0 END))), 6) AS p
  FROM labelled),
predicted AS (SELECT *, p AS intrusion_probability,
    CASE WHEN p >= 0.01e0 THEN 'intrusion' ELSE 'normal' END AS predicted_class FROM scored),
pointed AS (
  SELECT *, CASE WHEN predicted_class = 'normal' THEN 0 ELSE
      CASE WHEN src_bytes > 100000 THEN 3 WHEN src_bytes > 50000 THEN 2 WHEN src_bytes > 10000 THEN 1 ELSE 0 END
    + CASE WHEN "count" > 300 THEN 3 WHEN "count" > 100 THEN 2 WHEN "count" > 20 THEN 1 ELSE 0 END
    + CASE WHEN num_failed_logins > 5 THEN 3 WHEN num_failed_logins > 3 THEN 2 WHEN num_failed_logins > 1 THEN 1 ELSE 0 END
    + CASE WHEN serror_rate > 0.5e0 THEN 3 WHEN serror_rate > 0.3e0 THEN 2 WHEN serror_rate > 0.1e0 THEN 1 ELSE 0 END
    + CASE WHEN dst_host_count > 100 THEN 3 WHEN dst_host_count > 50 THEN 2 ELSE 0 END
    + CASE WHEN srv_count > 20 THEN 2 ELSE 0 END
    + CASE WHEN duration > 1000 THEN 1 ELSE 0 END
    + CASE WHEN p >= 0.9e0 THEN 3 WHEN p >= 0.7e0 THEN 2 WHEN p >= 0.5e0 THEN 1 ELSE 0 END END AS severity_score
  FROM predicted),
levelled AS (
  SELECT *, CASE WHEN predicted_class = 'normal' THEN 0 WHEN severity_score >= 8 THEN 3
                 WHEN severity_score >= 4 THEN 2 ELSE 1 END AS severity_level,
         format('{:.1f}%', p * 100) AS pct
  FROM pointed),
severity_dim(severity_level, severity_name, priority, description) AS (VALUES
  (0, 'NORMAL', 'None', 'Normal traffic, no threat detected'),
  (1, 'LOW RISK', 'Low', 'Suspicious activity detected, monitor'),
  (2, 'MEDIUM RISK', 'Medium', 'Likely intrusion, requires attention'),
  (3, 'HIGH RISK', 'High', 'Confirmed intrusion, immediate action needed')),
graded AS (
  SELECT l.*, d.severity_name, d.priority,
    CASE l.severity_level
      WHEN 0 THEN 'Normal traffic'
      WHEN 1 THEN 'LOW RISK: Monitor activity closely. Review logs and watch for patterns. Confidence: ' || pct || '.'
      WHEN 2 THEN 'MEDIUM RISK: Review immediately and monitor source. Likely intrusion with ' || pct
        || ' confidence. Check logs for similar activity.'
        || CASE WHEN src_bytes > 10000 THEN ' Large data transfer detected.' ELSE '' END
        || CASE WHEN "count" > 100 THEN ' Multiple connections detected.' ELSE '' END
      ELSE 'HIGH RISK - CRITICAL: Block source IP immediately! Serious attack detected with ' || pct
        || ' confidence. Initiate incident response.'
        || CASE WHEN num_failed_logins > 5 THEN ' Password attack in progress!' ELSE '' END
        || CASE WHEN src_bytes > 50000 THEN ' Possible data exfiltration!' ELSE '' END
        || CASE WHEN "count" > 200 THEN ' Active port scanning detected!' ELSE '' END END AS action_summary
  FROM levelled l JOIN severity_dim d ON d.severity_level = l.severity_level),
responded AS (
  SELECT *,
    CASE severity_level
      WHEN 1 THEN ['Allow the traffic but keep a close watch on it', 'Turn on detailed packet inspection']
      WHEN 2 THEN ['Mark this traffic for immediate security review', 'Slow down or limit data from this source',
                   'Activate intrusion detection systems']
      WHEN 3 THEN ['BLOCK this source IP immediately', 'Add IP to firewall blacklist',
                   'Drop all packets from this source', 'Cut off active connections']
        || CASE WHEN num_failed_logins > 5 THEN ['Lock user accounts - password guessing attack'] ELSE [] END
        || CASE WHEN src_bytes > 50000 THEN ['Large data transfer - investigate data theft'] ELSE [] END
        || CASE WHEN "count" > 200 THEN ['Block port scan - probing for weaknesses'] ELSE [] END
      ELSE ['Allow this traffic to pass through normally'] END AS immediate,
    CASE severity_level
      WHEN 1 THEN ['Watch connection frequency over next 5 minutes', 'Look for unusual patterns', 'Track data volume']
      WHEN 2 THEN ['Monitor this source IP in real-time', 'Check security logs for previous activity',
                   'Look up IP reputation online', 'Review past 24 hours of traffic from this source']
        || CASE WHEN src_bytes > 10000 THEN ['High outbound data - possible data theft'] ELSE [] END
        || CASE WHEN "count" > 100 THEN ['Many connections - possible network scan'] ELSE [] END
      WHEN 3 THEN ['Check if other IPs from same network are attacking', 'Look for signs of system compromise',
                   'Check if IP is part of known botnet', 'Review all traffic from past 24 hours',
                   'Identify targeted systems']
      ELSE [] END AS monitoring,
    CASE severity_level
      WHEN 1 THEN ['Save complete connection details', 'Store packet headers for analysis']
      WHEN 2 THEN ['Capture and save all packets', 'Add to security database', 'Create permanent audit log']
      WHEN 3 THEN ['Capture everything for forensic analysis', 'Save evidence in secure location',
                   'Create detailed logs for legal proceedings', 'Write full incident report']
      ELSE ['Keep basic logs for record-keeping purposes'] END AS logging
  FROM graded)"""

_SPLIT = """
quota AS (
  SELECT y, fl + CASE WHEN row_number() OVER (ORDER BY share - fl DESC, y) <= ceil(0.2e0 * n_all) - sum(fl) OVER ()
                      THEN 1 ELSE 0 END AS q
  FROM (SELECT y, n_all, ceil(0.2e0 * n_all) * n / CAST(n_all AS DOUBLE) AS share,
               floor(ceil(0.2e0 * n_all) * n / CAST(n_all AS DOUBLE)) AS fl
        FROM (SELECT y, count(*) AS n, (SELECT count(*) FROM labelled) AS n_all FROM labelled GROUP BY y))),
split AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.y ORDER BY md5('42:' || CAST(flow_id AS VARCHAR)), flow_id) <= q.q AS is_test
  FROM labelled l JOIN quota q ON q.y = l.y)"""

_STUMPS = """
stumps(i, feature, bound, lo, hi, cover, category) AS (VALUES
  (0, 'src_bytes', 50000.0e0, -0.9e0, 1.6e0, 0.87e0, 'Traffic Volume'),
  (1, 'count', 300.0e0, -0.5e0, 1.5e0, 0.75e0, 'Time-based Features'),
  (2, 'serror_rate', 0.5e0, -1.2e0, 1.7e0, 0.5e0, 'Time-based Features'),
  (3, 'num_failed_logins', 3.0e0, -0.8e0, 1.2e0, 0.5e0, 'Connection Metrics'),
  (4, 'dst_host_count', 100.0e0, -0.7e0, 0.8e0, 0.4e0, 'Time-based Features'),
  (5, 'srv_count', 20.0e0, -0.4e0, 0.5e0, 0.35e0, 'Time-based Features'),
  (6, 'duration', 1000.0e0, -0.3e0, 0.6e0, 0.5e0, 'Basic Flow Features'),
  (7, 'dst_bytes', 2500.0e0, 0.4e0, -0.4e0, 0.5e0, 'Traffic Volume'),
  (8, 'flag_S0', 0.5e0, -0.6e0, 2.0e0, 0.8e0, 'Basic Flow Features'),
  (9, 'flag_REJ', 0.5e0, -0.3e0, 1.1e0, 0.8e0, 'Basic Flow Features'),
  (10, 'protocol_type_icmp', 0.5e0, -0.4e0, 0.9e0, 0.67e0, 'Basic Flow Features'),
  (11, 'service_domain_u', 0.5e0, -0.9e0, 2.2e0, 0.8e0, 'Basic Flow Features')),
model AS (
  SELECT *, cover * lo + (1 - cover) * hi AS expected,
    cover * (1 - cover) * (lo - hi) * (lo - hi) / sum(cover * (1 - cover) * (lo - hi) * (lo - hi)) OVER () AS native
  FROM stumps),
base AS (SELECT -2.0e0 + sum(expected) AS base_value FROM model),
inputs AS (
  SELECT flow_id, predicted_class, p, unnest([
    {'i': 0, 'x': CAST(src_bytes AS DOUBLE)}, {'i': 1, 'x': CAST("count" AS DOUBLE)},
    {'i': 2, 'x': serror_rate}, {'i': 3, 'x': CAST(num_failed_logins AS DOUBLE)},
    {'i': 4, 'x': CAST(dst_host_count AS DOUBLE)}, {'i': 5, 'x': CAST(srv_count AS DOUBLE)},
    {'i': 6, 'x': CAST(duration AS DOUBLE)}, {'i': 7, 'x': CAST(dst_bytes AS DOUBLE)},
    {'i': 8, 'x': CASE WHEN flag = 'S0' THEN 1.0e0 ELSE 0.0e0 END},
    {'i': 9, 'x': CASE WHEN flag = 'REJ' THEN 1.0e0 ELSE 0.0e0 END},
    {'i': 10, 'x': CASE WHEN protocol_type = 'icmp' THEN 1.0e0 ELSE 0.0e0 END},
    {'i': 11, 'x': CASE WHEN service = 'domain_u' THEN 1.0e0 ELSE 0.0e0 END}]) AS u
  FROM predicted),
contrib AS (
  SELECT n.flow_id, n.predicted_class, n.p, m.i, m.feature, m.category, n.u.x AS x,
    CASE WHEN n.u.x <= m.bound THEN m.lo ELSE m.hi END - m.expected AS shap
  FROM inputs n JOIN model m ON m.i = n.u.i),
importance AS (
  SELECT c.feature, any_value(c.category) AS category, avg(abs(shap)) AS mean_abs_shap, any_value(m.native) AS native_importance
  FROM contrib c JOIN model m ON m.i = c.i GROUP BY c.feature),
long_raw AS (
  SELECT predicted_class, u.f AS feature, u.v AS v FROM (
    SELECT predicted_class, unnest([
      {'f': 'duration', 'v': CAST(duration AS DOUBLE)}, {'f': 'src_bytes', 'v': CAST(src_bytes AS DOUBLE)},
      {'f': 'dst_bytes', 'v': CAST(dst_bytes AS DOUBLE)}, {'f': 'count', 'v': CAST("count" AS DOUBLE)},
      {'f': 'srv_count', 'v': CAST(srv_count AS DOUBLE)}, {'f': 'serror_rate', 'v': serror_rate},
      {'f': 'num_failed_logins', 'v': CAST(num_failed_logins AS DOUBLE)},
      {'f': 'dst_host_count', 'v': CAST(dst_host_count AS DOUBLE)}]) AS u FROM predicted)),
raw_stats AS (
  SELECT predicted_class, feature, avg(v) AS mean, median(v) AS median, stddev_samp(v) AS std, min(v) AS min, max(v) AS max
  FROM long_raw GROUP BY 1, 2),
shap_means AS (SELECT predicted_class, feature, any_value(category) AS category, avg(shap) AS mean_shap
  FROM contrib GROUP BY 1, 2)"""

# canonical text of an alert and the chain over it, per span of 1000 flow ids
_CHAIN = r"""
entries AS (
  SELECT flow_id // 1000 AS segment, r.*, row_number() OVER (PARTITION BY flow_id // 1000 ORDER BY flow_id) AS block_index,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS "timestamp",
    concat_ws('|', strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), CAST(flow_id AS VARCHAR), CAST(CAST(p AS DECIMAL(38,9)) AS VARCHAR), CAST(severity_level AS VARCHAR),
      severity_name, priority, action_summary, array_to_string(immediate, '; '),
      array_to_string(monitoring[1:3], '; '),
      CAST(CAST(duration AS DECIMAL(38,9)) AS VARCHAR), protocol_type, service, flag,
      CAST(CAST(src_bytes AS DECIMAL(38,9)) AS VARCHAR), CAST(CAST(dst_bytes AS DECIMAL(38,9)) AS VARCHAR),
      CAST(CAST("count" AS DECIMAL(38,9)) AS VARCHAR), CAST(CAST(srv_count AS DECIMAL(38,9)) AS VARCHAR),
      CAST(CAST(serror_rate AS DECIMAL(38,9)) AS VARCHAR), CAST(CAST(num_failed_logins AS DECIMAL(38,9)) AS VARCHAR),
      CAST(CAST(dst_host_count AS DECIMAL(38,9)) AS VARCHAR), CAST(src_id AS VARCHAR), '\N') AS payload
  FROM responded r WHERE predicted_class = 'intrusion' AND severity_level > 0),
linked AS (
  SELECT segment, CAST(0 AS BIGINT) AS block_index, '0' AS previous_hash,
    sha256('0|0|' || "timestamp" || '|Threat Log Blockchain Initialized ' || CAST(segment AS VARCHAR)) AS hash
  FROM entries WHERE block_index = 1
  UNION ALL
  SELECT e.segment, e.block_index, l.hash, sha256(concat_ws('|', l.hash, CAST(e.block_index AS VARCHAR), e.payload))
  FROM linked l JOIN entries e ON e.segment = l.segment AND e.block_index = l.block_index + 1),
log AS (
  SELECT l.segment, CAST(l.block_index AS INTEGER) AS block_index, coalesce(e."timestamp", g."timestamp") AS "timestamp", e.flow_id AS sample_index, e.p AS intrusion_probability,
    e.severity_level, e.severity_name, e.priority, e.action_summary, e.immediate, e.protocol_type, e.src_id, e.src_bytes,
    l.previous_hash, l.hash
  FROM linked l LEFT JOIN entries e ON e.segment = l.segment AND e.block_index = l.block_index
  LEFT JOIN entries g ON g.segment = l.segment AND g.block_index = 1),
view_rows AS (
  SELECT segment, block_index AS id, "timestamp", CAST(src_id AS VARCHAR) AS source_ip, 'N/A' AS dest_ip, protocol_type AS protocol,
    severity_name AS type, intrusion_probability AS confidence, action_summary AS action, 'logged' AS status, hash,
    previous_hash, sample_index, severity_level, array_to_string(immediate, ' ; ') AS immediate_actions
  FROM log WHERE block_index > 0)"""

_EVAL = """
cells AS (
  SELECT count(*) FILTER (p < 0.01e0 AND y = 0) AS tn, count(*) FILTER (p >= 0.01e0 AND y = 0) AS fp,
         count(*) FILTER (p < 0.01e0 AND y = 1) AS fn, count(*) FILTER (p >= 0.01e0 AND y = 1) AS tp FROM scored),
sweep_raw AS (
  SELECT k / 100.0e0 AS threshold, count(*) FILTER (p < k / 100.0e0 AND y = 1) AS fn,
         count(*) FILTER (p >= k / 100.0e0 AND y = 0) AS fp, count(*) FILTER (p >= k / 100.0e0 AND y = 1) AS tp
  FROM range(1, 51) t(k), scored GROUP BY k),
sweep AS (
  SELECT threshold, fn, fp,
    round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 6) AS precision,
    round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 6) AS recall,
    round(CASE WHEN 2*tp + fp + fn = 0 THEN 0 ELSE 2*tp / CAST(2*tp + fp + fn AS DOUBLE) END, 6) AS f1 FROM sweep_raw),
metrics AS (
  SELECT round((tn + tp) / CAST(tn + fp + fn + tp AS DOUBLE), 6) AS accuracy,
    round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 6) AS precision,
    round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 6) AS recall,
    round(CASE WHEN 2*tp + fp + fn = 0 THEN 0 ELSE 2*tp / CAST(2*tp + fp + fn AS DOUBLE) END, 6) AS f1,
    round(100 * fp / CAST(tn + fp AS DOUBLE), 6) AS false_alarm_rate, fn AS false_negatives, fp AS false_positives
  FROM cells),
per_score AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scored GROUP BY p),
roc AS (
  SELECT p, pos, neg, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS np, sum(neg) OVER () AS nn
  FROM per_score WINDOW w AS (ORDER BY p DESC)),
auc AS (SELECT round(sum(CAST(neg AS DOUBLE) * (cp - pos + pos * 0.5e0)) / (max(np) * CAST(max(nn) AS DOUBLE)), 6) AS roc_auc FROM roc)"""

_BASE = f"WITH {_FLOWS},{_SCORED}"
_WITH_SPLIT = f"{_BASE},{_SPLIT}"
_WITH_MODEL = f"{_BASE},{_STUMPS}"
_WITH_EVAL = f"{_BASE},{_EVAL}"
_WITH_CHAIN = f"WITH RECURSIVE {_FLOWS},{_SCORED},{_CHAIN}"

_NUM = ["duration", "src_bytes", "dst_bytes", "count", "srv_count", "serror_rate", "num_failed_logins", "dst_host_count"]
_QNUM = ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in _NUM)
_ALL_NUMERIC = [
    "duration", "src_bytes", "dst_bytes", "land", "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in",
    "num_compromised", "root_shell", "su_attempted", "num_root", "num_file_creations", "num_shells", "num_access_files",
    "num_outbound_cmds", "is_host_login", "is_guest_login", "count", "srv_count", "serror_rate", "srv_serror_rate",
    "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate", "dst_host_count",
    "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate", "dst_host_same_src_port_rate",
    "dst_host_srv_diff_host_rate", "dst_host_serror_rate", "dst_host_srv_serror_rate", "dst_host_rerror_rate",
    "dst_host_srv_rerror_rate"]


def _dummies(vocab):
    return ", ".join(
        f"CASE WHEN {c} = '{v}' THEN 1.0e0 ELSE 0.0e0 END AS \"{c}_{v}\"" for c, values in vocab for v in values)


_SEEN = [("protocol_type", ["icmp", "tcp", "udp"]), ("service", ["domain_u", "eco_i", "ftp", "http", "smtp"]),
         ("flag", ["REJ", "RSTO", "RSTR", "S0", "SF"])]
_TRAINED = [("protocol_type", ["icmp", "tcp", "udp"]), ("service", ["domain_u", "ecr_i", "ftp", "http", "smtp"]),
            ("flag", ["REJ", "RSTO", "RSTR", "S0", "SF"])]

_CATEGORY_CASE = """CASE
  WHEN feature LIKE '%duration%' OR feature LIKE '%protocol\\_type%' ESCAPE '\\' OR feature LIKE '%service%' OR feature LIKE '%flag%'
    THEN 'Basic Flow Features'
  WHEN contains(feature, 'src_bytes') OR contains(feature, 'dst_bytes') OR contains(feature, 'land') THEN 'Traffic Volume'
  WHEN contains(feature, 'wrong_fragment') OR contains(feature, 'urgent') OR contains(feature, 'hot')
    OR contains(feature, 'num_failed_logins') THEN 'Connection Metrics'
  WHEN contains(feature, 'count') OR contains(feature, 'serror_rate') OR contains(feature, 'rerror_rate') THEN 'Time-based Features'
  WHEN contains(feature, 'dst_host_same_srv_rate') OR contains(feature, 'dst_host_diff_srv_rate')
    OR contains(feature, 'dst_host_same_src_port_rate') OR contains(feature, 'dst_host_srv_diff_host_rate') THEN 'Host-based Features'
  WHEN feature IN ('num_compromised', 'root_shell', 'su_attempted', 'num_root', 'num_file_creations', 'num_shells',
    'num_access_files', 'is_guest_login', 'is_host_login', 'num_outbound_cmds') THEN 'Content Features'
  ELSE 'Other/Encoded' END"""

_BAR_ORDER = "PARTITION BY flow_id ORDER BY round(abs(shap), 12) DESC, i"

# every block hashed anew from its fields, an amount of block 3 changed by ``change`` after it was logged
_CHECKED = r"""
checked AS (
  SELECT l.segment, l.block_index, l.hash AS stored, l.previous_hash, lag(l.hash) OVER s AS before, lag(l.block_index) OVER s AS index_before,
    sha256(concat_ws('|', l.previous_hash, CAST(l.block_index AS VARCHAR), CASE WHEN l.block_index = 0
      THEN l."timestamp" || '|Threat Log Blockchain Initialized ' || CAST(l.segment AS VARCHAR)
      ELSE concat_ws('|', l."timestamp", CAST(flow_id AS VARCHAR), CAST(CAST(p AS DECIMAL(38,9)) AS VARCHAR), CAST(e.severity_level AS VARCHAR),
        e.severity_name, e.priority, e.action_summary, array_to_string(e.immediate, '; '), array_to_string(monitoring[1:3], '; '),
        CAST(CAST(duration AS DECIMAL(38,9)) AS VARCHAR), e.protocol_type, service, flag,
        CAST(CAST(e.src_bytes + CASE WHEN l.block_index = 3 THEN {change} ELSE 0 END AS DECIMAL(38,9)) AS VARCHAR),
        CAST(CAST(dst_bytes AS DECIMAL(38,9)) AS VARCHAR), CAST(CAST("count" AS DECIMAL(38,9)) AS VARCHAR),
        CAST(CAST(srv_count AS DECIMAL(38,9)) AS VARCHAR), CAST(CAST(serror_rate AS DECIMAL(38,9)) AS VARCHAR),
        CAST(CAST(num_failed_logins AS DECIMAL(38,9)) AS VARCHAR), CAST(CAST(dst_host_count AS DECIMAL(38,9)) AS VARCHAR),
        CAST(e.src_id AS VARCHAR), '\N') END)) AS own
  FROM log l LEFT JOIN entries e ON e.segment = l.segment AND e.block_index = l.block_index
  WINDOW s AS (PARTITION BY l.segment ORDER BY l.block_index)),
verified AS (
  SELECT segment, count(*) AS blocks, min(CASE WHEN NOT fine THEN block_index END) AS first_bad_block, bool_and(fine) AS is_valid
  FROM (SELECT *, own = stored AND CASE WHEN block_index = 0 THEN previous_hash = '0'
               ELSE previous_hash = before AND block_index = index_before + 1 END AS fine FROM checked)
  GROUP BY segment)"""

_INDEXED = f"""{_BASE}, places AS (SELECT *, CAST(7 + row_number() OVER (ORDER BY place, value) AS INTEGER) AS index
    FROM (SELECT DISTINCT 0 AS place, 'protocol_type' AS "column", protocol_type AS value FROM flows
          UNION ALL SELECT DISTINCT 1, 'service', service FROM flows UNION ALL SELECT DISTINCT 2, 'flag', flag FROM flows) WHERE value IS NOT NULL)"""
_MODEL_FEATURES = _NUM + [f"{c}_{v}" for c, values in _TRAINED for v in values]
_LARGEST = [2000.0, 200000.0, 5000.0, 400.0, 60.0, 1.0, 8.0, 256.0]          # thresholds of numeric features; fixed values


def _walk(trees: int, depth: int) -> str:
    """Rows of all flows and trees: w0 at the roots, w1 one level down and so on."""
    split = """CASE WHEN (t + 3 * {level}) % 21 < 8 THEN largest[(t + 3 * {level}) % 21 + 1] * ((t * 13 + node * 7) % 32 + 0.5e0) / 32 ELSE 0.5e0 END"""
    levels = [f"w{n + 1} AS (SELECT * REPLACE (2 * node + CASE WHEN x[(t + 3 * {n}) % 21 + 1] <= {split.format(level=n)} THEN 1 ELSE 2 END AS node) FROM w{n})"
              for n in range(depth)]
    x = ", ".join([f'CAST("{c}" AS DOUBLE)' for c in _NUM] + [f"CASE WHEN {c} = '{v}' THEN 1.0e0 ELSE 0.0e0 END" for c, values in _TRAINED for v in values])
    largest = ", ".join(f"{b}e0" for b in _LARGEST)
    return f"""{_BASE}, w0 AS (SELECT flow_id, y, [{x}] AS x, [{largest}] AS largest, CAST(t AS BIGINT) AS t, CAST(0 AS BIGINT) AS node
        FROM labelled, range({trees}) r(t)), """ + ", ".join(levels)


_LEAVES = "SELECT flow_id, y, t, (t * 31 + node * 17) % 201 - 100 AS v FROM w8"
_REACHED = "reached AS (" + " UNION ALL ".join(
    f"SELECT {n} AS level, t, node, count(*) AS n, sum(y) AS ones FROM w{n} GROUP BY t, node" for n in range(9)) + ")"
_GAINS = f"""{_walk(500, 8)}, {_REACHED},
    held AS (SELECT *, ones - ones * ones / CAST(n AS DOUBLE) AS spread FROM reached),
    below AS (SELECT t, (node - 1) // 2 AS node, sum(spread) AS spread FROM held WHERE level > 0 GROUP BY 1, 2),
    gains AS (SELECT (h.t + 3 * level) % 21 AS f, sum(h.spread - b.spread) AS gain FROM held h JOIN below b ON b.t = h.t AND b.node = h.node GROUP BY 1),
    shares AS (SELECT [{", ".join(f"'{f}'" for f in _MODEL_FEATURES)}][r.f + 1] AS feature, coalesce(gain, 0) / sum(gain) OVER () AS importance
      FROM range(21) r(f) LEFT JOIN gains g ON g.f = r.f)"""

SQL = {
    "forest_scores": f"""{_walk(500, 8)}, leaves AS ({_LEAVES})
        SELECT flow_id, any_value(y) AS y, round(1 / (1 + exp(-sum(v) / 10000.0e0)), 6) AS intrusion_probability FROM leaves GROUP BY flow_id""",
    "forest_loss_curve": f"""{_walk(500, 8)}, leaves AS ({_LEAVES}),
        upto AS (SELECT t, y, sum(v) OVER (PARTITION BY flow_id ORDER BY t) / 10000.0e0 AS margin FROM leaves)
        SELECT CAST(t + 1 AS INTEGER) AS iteration, round(avg(ln(1 + exp(CASE WHEN y = 1 THEN -margin ELSE margin END))), 6) AS loss FROM upto GROUP BY t""",
    "forest_importance": f"{_GAINS} SELECT feature, round(importance, 6) AS importance FROM shares",
    "forest_top_features": f"{_GAINS} SELECT feature, round(importance, 6) AS importance FROM shares ORDER BY shares.importance DESC, feature LIMIT 15",
    "forest_shap": f"""{_walk(40, 3)},
        way AS (SELECT w1.flow_id, w1.t, w1.node AS n1, w2.node AS n2, w3.node AS n3, w1.x, w1.largest
          FROM w1 JOIN w2 ON w2.flow_id = w1.flow_id AND w2.t = w1.t JOIN w3 ON w3.flow_id = w1.flow_id AND w3.t = w1.t),
        -- a leaf 7..14 and whether the row goes its way at each of the three decisions on its path
        leaf AS (SELECT flow_id, t, leaf, (t * 31 + leaf * 17) % 201 - 100 AS v, (leaf - 1) // 2 AS p2, ((leaf - 1) // 2 - 1) // 2 AS p1, x, largest
          FROM way, range(7, 15) r(leaf)),
        passed AS (SELECT flow_id, t, v,
            CASE WHEN (x[t % 21 + 1] <= CASE WHEN t % 21 < 8 THEN largest[t % 21 + 1] * ((t * 13) % 32 + 0.5e0) / 32 ELSE 0.5e0 END) = (p1 = 1) THEN 1.0e0 ELSE 0.0e0 END AS o0,
            CASE WHEN (x[(t + 3) % 21 + 1] <= CASE WHEN (t + 3) % 21 < 8 THEN largest[(t + 3) % 21 + 1] * ((t * 13 + p1 * 7) % 32 + 0.5e0) / 32 ELSE 0.5e0 END)
              = (p2 % 2 = 1) THEN 1.0e0 ELSE 0.0e0 END AS o1,
            CASE WHEN (x[(t + 6) % 21 + 1] <= CASE WHEN (t + 6) % 21 < 8 THEN largest[(t + 6) % 21 + 1] * ((t * 13 + p2 * 7) % 32 + 0.5e0) / 32 ELSE 0.5e0 END)
              = (leaf % 2 = 1) THEN 1.0e0 ELSE 0.0e0 END AS o2,
            CASE WHEN p1 = 1 THEN 0.625e0 ELSE 0.375e0 END AS z0, CASE WHEN p2 % 2 = 1 THEN 0.625e0 ELSE 0.375e0 END AS z1,
            CASE WHEN leaf % 2 = 1 THEN 0.625e0 ELSE 0.375e0 END AS z2 FROM leaf),
        parts AS (
          SELECT flow_id, t % 21 AS f, v * (o0 - z0) * (o1*o2/3 + (o1*z2 + z1*o2)/6 + z1*z2/3) AS s FROM passed
          UNION ALL SELECT flow_id, (t + 3) % 21, v * (o1 - z1) * (o0*o2/3 + (o0*z2 + z0*o2)/6 + z0*z2/3) FROM passed
          UNION ALL SELECT flow_id, (t + 6) % 21, v * (o2 - z2) * (o0*o1/3 + (o0*z1 + z0*o1)/6 + z0*z1/3) FROM passed),
        base_ AS (SELECT round(sum(v * z0 * z1 * z2) / 10000.0e0, 6) AS base_value FROM passed WHERE flow_id = (SELECT min(flow_id) FROM flows))
        SELECT flow_id, [{", ".join(f"'{f}'" for f in _MODEL_FEATURES)}][f + 1] AS feature,
          floor(sum(s) / 10000.0e0 * 1e6 + 0.51e0) / 1e6 AS shap_value, base_value FROM parts, base_ GROUP BY flow_id, f, base_value""",
    "scan_flows": f"{_BASE} SELECT * REPLACE (strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts) FROM flows",
    "input_profile": f"{_BASE} SELECT count(*) AS n_rows, CAST(16 AS BIGINT) AS n_columns FROM flows",
    "csv_round_trip": f"{_BASE} SELECT * EXCLUDE (ts) FROM flows",
    "scored_flows": f"""{_BASE} SELECT flow_id, src_id, duration, protocol_type, service, flag, src_bytes, dst_bytes, "count",
        srv_count, serror_rate, num_failed_logins, dst_host_count, class, difficulty, intrusion_probability, predicted_class,
        severity_level, severity_name, action_summary, strftime(ts, '%Y-%m-%d') AS run_date FROM graded""",
    "log_export_info": f"""{_WITH_CHAIN} SELECT count(*) AS total_blocks, count(*) FILTER (block_index > 0) AS total_intrusions,
        count(DISTINCT segment) AS segments, true AS is_valid FROM log""",
    "log_read": f"""{_WITH_CHAIN} SELECT segment, block_index, "timestamp", sample_index, severity_level, severity_name, action_summary,
        array_to_string(immediate, ' ; ') AS immediate_actions, CAST(src_bytes AS DOUBLE) AS src_bytes, previous_hash, hash FROM log""",
    "log_read_documents": f"""{_WITH_CHAIN} SELECT segment, block_index, "timestamp", sample_index, severity_level, severity_name, action_summary,
        array_to_string(immediate, ' ; ') AS immediate_actions, CAST(src_bytes AS DOUBLE) AS src_bytes, previous_hash, hash FROM log""",
    "output_catalog": f"""{_WITH_CHAIN}, outputs AS (SELECT 'data' AS kind, count(*) AS n FROM flows
          UNION ALL SELECT 'data', count(*) FROM predicted WHERE predicted_class = 'intrusion' UNION ALL SELECT 'blockchain', count(*) FROM log)
        SELECT kind, count(*) AS outputs, CAST(sum(n) AS BIGINT) AS n_rows, '20240201_000000' AS newest_run FROM outputs GROUP BY kind""",
    "newest_output": f"""{_BASE} SELECT 'predictions_with_actions_' AS prefix, '20240201_000000' AS run, count(*) AS n_rows FROM predicted
        WHERE predicted_class = 'intrusion'""",
    "log_documents_info": f"""{_WITH_CHAIN} SELECT segment, count(*) AS total_blocks, count(*) - 1 AS total_intrusions,
        '2024-02-01 00:00:00' AS export_timestamp, true AS is_valid FROM log GROUP BY segment""",
    "clean_flows": f"""{_BASE} SELECT DISTINCT * EXCLUDE (difficulty) FROM (
        SELECT DISTINCT * EXCLUDE (flow_id, ts, src_id) REPLACE (CASE WHEN flow_id % 50 <> 0 THEN dst_bytes END AS dst_bytes) FROM flows)
        WHERE dst_bytes IS NOT NULL""",
    "label_flows": f"{_BASE} SELECT flow_id, class, y FROM labelled",
    "label_distribution": f"{_BASE} SELECT y, count(*) AS n FROM labelled GROUP BY y",
    "conform_flows": f"{_BASE} SELECT flow_id, " + ", ".join(
        f'CAST("{c}" AS DOUBLE) AS "{c}"' if c in _NUM else f"0.0e0 AS {c}" for c in _ALL_NUMERIC)
        + ", protocol_type, service, flag FROM flows",
    "category_vocab": f"""{_BASE} SELECT "column", value, CAST(row_number() OVER (PARTITION BY "column" ORDER BY value) AS INTEGER) AS position
        FROM (SELECT DISTINCT 'protocol_type' AS "column", protocol_type AS value FROM flows
              UNION ALL SELECT DISTINCT 'service', service FROM flows UNION ALL SELECT DISTINCT 'flag', flag FROM flows)""",
    "vocab_index": f"""{_INDEXED} SELECT "column", value, index FROM places""",
    "one_hot_sparse": f"""{_INDEXED}, mine AS (SELECT flow_id, string_agg(CAST(index AS VARCHAR), ',' ORDER BY index) AS own, count(*) AS n
          FROM flows f JOIN places p ON (p."column" = 'protocol_type' AND p.value = f.protocol_type) OR (p."column" = 'service' AND p.value = f.service)
            OR (p."column" = 'flag' AND p.value = f.flag) GROUP BY flow_id)
        SELECT flow_id, '0,1,2,3,4,5,6,7' || coalesce(',' || own, '') AS indices, {_QNUM},
          {" + ".join(f'CAST("{c}" AS DOUBLE)' for c in _NUM)} + coalesce(n, 0) AS total FROM flows LEFT JOIN mine USING (flow_id)""",
    "one_hot": f"{_BASE} SELECT flow_id, {_QNUM}, {_dummies(_SEEN)} FROM flows",
    "one_hot_aligned": f"{_BASE} SELECT flow_id, {_QNUM}, {_dummies(_TRAINED)} FROM flows",
    "stratified_split": f"{_WITH_SPLIT} SELECT flow_id, y, is_test FROM split",
    "scaler_stats": f"{_WITH_SPLIT} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, floor(m * 1e6 + 0.5) / 1e6 AS mean, floor(sqrt(greatest(q - m * m, 0)) * 1e6 + 0.5) / 1e6 AS std
            FROM (SELECT CAST(sum(CAST(CAST("{c}" AS DOUBLE) AS DECIMAL(28,9))) AS DOUBLE) / count("{c}") AS m,
                         CAST(sum(CAST(CAST("{c}" AS DOUBLE) * CAST("{c}" AS DOUBLE) AS DECIMAL(28,9))) AS DOUBLE) / count("{c}") AS q
                  FROM split WHERE NOT is_test)"""
        for c in _NUM),
    "scaled_flows": f"{_WITH_SPLIT} SELECT flow_id, " + ", ".join(
        f"""round((CAST("{c}" AS DOUBLE) - (SELECT avg("{c}") FROM split WHERE NOT is_test))
            / (SELECT CASE WHEN stddev_pop("{c}") = 0 THEN 1 ELSE stddev_pop("{c}") END FROM split WHERE NOT is_test), 6) AS "{c}" """
        for c in _NUM) + " FROM flows",
    "class_weights": f"{_BASE} SELECT flow_id, y, CASE WHEN y = 1 THEN 20.0e0 ELSE 1.0e0 END AS w FROM labelled",
    "predict_class": f"{_BASE} SELECT flow_id, intrusion_probability, predicted_class FROM predicted",
    "intrusions_only": f"{_BASE} SELECT flow_id, intrusion_probability FROM predicted WHERE predicted_class = 'intrusion'",
    "confidence_band": f"""{_BASE} SELECT flow_id, CASE WHEN p >= 0.7e0 THEN 'high' WHEN p >= 0.01e0 THEN 'medium' ELSE 'low' END
        AS confidence FROM scored""",
    "prediction_correctness": f"""{_BASE} SELECT flow_id, y, predicted_class, (predicted_class = 'intrusion') = (y = 1) AS correct
        FROM predicted""",
    "severity_score": f"{_BASE} SELECT flow_id, severity_score, severity_level FROM levelled",
    "severity_dim_join": f"""{_BASE} SELECT l.flow_id, d.* FROM levelled l JOIN severity_dim d ON d.severity_level = l.severity_level""",
    "playbook": f"""{_BASE} SELECT flow_id, severity_level, array_to_string(immediate, ' ; ') AS immediate_actions,
        array_to_string(monitoring, ' ; ') AS monitoring_actions, array_to_string(logging, ' ; ') AS logging_actions,
        CASE severity_level
          WHEN 1 THEN 'This traffic looks somewhat suspicious (we are ' || pct || ' confident it might be an intrusion).'
          WHEN 2 THEN 'This is likely a real intrusion attempt (' || pct || ' confident). Requires prompt attention.'
          ELSE 'This is a serious attack in progress (' || pct || ' confident). Block immediately!' END AS explanation,
        action_summary FROM responded WHERE predicted_class = 'intrusion'""",
    "indicators": f"""{_BASE}, signs AS (SELECT flow_id, list_filter([
          CASE WHEN src_bytes > 100000 THEN 'Extremely large outbound data - possible major data theft or DDoS'
               WHEN src_bytes > 50000 THEN 'Significant outbound data - might indicate data theft' END,
          CASE WHEN dst_bytes < 100 AND src_bytes > 10000 THEN 'One-sided traffic pattern - typical of data exfiltration' END,
          CASE WHEN "count" > 300 THEN 'Hundreds of connections - automated port scanning or DoS attack'
               WHEN "count" > 100 THEN 'Many rapid connections - automated scanning tools detected' END,
          CASE WHEN serror_rate > 0.5e0 THEN 'High SYN error rate - telltale sign of SYN flood attack' END,
          CASE WHEN num_failed_logins > 3 THEN CAST(num_failed_logins AS VARCHAR) || ' failed logins - password guessing attack' END,
          CASE WHEN dst_host_count > 100 THEN 'Connecting to many hosts - worm spreading or lateral movement' END
        ], lambda x: x IS NOT NULL) AS s FROM flows)
        SELECT flow_id, array_to_string(s, ' ; ') AS indicators, array_to_string(s[1:3], ' ; ') AS shown_indicators,
        CAST(len(s) AS INTEGER) AS n_indicators FROM signs""",
    "alerts": f"""{_BASE} SELECT flow_id AS sample_index, intrusion_probability, severity_level, severity_name, priority, action_summary,
        array_to_string(immediate, ' ; ') AS immediate_actions, array_to_string(monitoring[1:3], ' ; ') AS monitoring_actions,
        CAST(duration AS DOUBLE) AS nf_duration, protocol_type AS nf_protocol_type, service AS nf_service, flag AS nf_flag,
        CAST(src_bytes AS DOUBLE) AS nf_src_bytes, CAST(dst_bytes AS DOUBLE) AS nf_dst_bytes, CAST("count" AS DOUBLE) AS nf_count,
        CAST(srv_count AS DOUBLE) AS nf_srv_count, serror_rate AS nf_serror_rate,
        CAST(num_failed_logins AS DOUBLE) AS nf_num_failed_logins, CAST(dst_host_count AS DOUBLE) AS nf_dst_host_count,
        CAST(src_id AS VARCHAR) AS nf_src_ip FROM responded WHERE predicted_class = 'intrusion'""",
    "intrusion_details": f"""{_BASE} SELECT flow_id AS sample_index, intrusion_probability, severity_name, severity_level,
        CASE severity_level
          WHEN 1 THEN 'This traffic looks somewhat suspicious (' || pct || ' confident it might be an intrusion).'
          WHEN 2 THEN 'This is likely a real intrusion attempt (' || pct || ' confident). Requires prompt attention.'
          ELSE 'This is a serious attack in progress (' || pct || ' confident). Block immediately!' END AS explanation,
        action_summary AS action,
        CASE severity_level
          WHEN 1 THEN 'Allow the traffic but keep a close watch on it ; Turn on detailed packet inspection'
          WHEN 2 THEN 'Mark this traffic for immediate security review ; Slow down or limit data from this source ; Activate intrusion detection systems'
          ELSE 'BLOCK this source IP immediately ; Add IP to firewall blacklist ; Drop all packets from this source ; Cut off active connections'
          END AS immediate_actions,
        array_to_string(monitoring[1:3], ' ; ') AS monitoring_actions,
        CAST(src_bytes AS DOUBLE) AS src_bytes, CAST(dst_bytes AS DOUBLE) AS dst_bytes, CAST("count" AS DOUBLE) AS "count",
        CAST(srv_count AS DOUBLE) AS srv_count, serror_rate, CAST(duration AS DOUBLE) AS duration
        FROM responded WHERE predicted_class = 'intrusion' ORDER BY flow_id LIMIT 100""",
    "detection_summary": f"""{_BASE} SELECT count(*) AS total_samples, count(*) FILTER (predicted_class = 'intrusion') AS intrusions,
        count(*) FILTER (predicted_class = 'normal') AS normals,
        round(100 * (count(*) FILTER (predicted_class = 'intrusion') / CAST(count(*) AS DOUBLE)), 4) AS intrusion_pct,
        round(100 * (count(*) FILTER (predicted_class = 'normal') / CAST(count(*) AS DOUBLE)), 4) AS normal_pct FROM predicted""",
    "severity_breakdown": f"""{_BASE} SELECT d.severity_level, d.severity_name, count(g.flow_id) AS n,
        round(100 * (count(g.flow_id) / CAST((SELECT count(*) FROM flows) AS DOUBLE)), 4) AS pct
        FROM severity_dim d LEFT JOIN levelled g ON g.severity_level = d.severity_level GROUP BY 1, 2""",
    "normal_sample": f"""{_BASE} SELECT flow_id, round(1 - p, 6) AS confidence FROM predicted
        WHERE predicted_class = 'normal' AND flow_id % 100 = 0""",
    "score_stats": f"{_BASE} SELECT round(avg(p), 6) AS mean_p, min(p) AS min_p, max(p) AS max_p FROM scored",
    "confusion_matrix": f"""{_WITH_EVAL} SELECT 0 AS actual, 0 AS predicted, tn AS n FROM cells UNION ALL SELECT 0, 1, fp FROM cells
        UNION ALL SELECT 1, 0, fn FROM cells UNION ALL SELECT 1, 1, tp FROM cells""",
    "threshold_sweep": f"{_WITH_EVAL} SELECT * FROM sweep",
    "zero_fn_threshold": f"""{_WITH_EVAL} SELECT 'first' AS policy, * FROM sweep
        WHERE threshold = coalesce((SELECT min(threshold) FROM sweep WHERE fn = 0), 0.01e0)
        UNION ALL SELECT 'max', * FROM sweep WHERE threshold = coalesce((SELECT max(threshold) FROM sweep WHERE fn = 0), 0.01e0)""",
    "zero_fn_threshold_of_floods": f"""{_BASE}, floods AS (SELECT p, class = 'neptune' AND flag = 'S0' AND protocol_type = 'icmp' AS y FROM scored), raw AS (SELECT k / 100.0e0 AS threshold, count(*) FILTER (p < k / 100.0e0 AND y) AS fn,
          count(*) FILTER (p >= k / 100.0e0 AND NOT y) AS fp, count(*) FILTER (p >= k / 100.0e0 AND y) AS tp
          FROM range(1, 51) t(k), floods GROUP BY k),
        swept AS (SELECT threshold, fn, fp, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 6) AS precision,
          round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 6) AS recall,
          round(CASE WHEN 2*tp + fp + fn = 0 THEN 0 ELSE 2*tp / CAST(2*tp + fp + fn AS DOUBLE) END, 6) AS f1 FROM raw)
        SELECT 'first' AS policy, * FROM swept WHERE threshold = coalesce((SELECT min(threshold) FROM swept WHERE fn = 0), 0.01e0)
        UNION ALL SELECT 'max', * FROM swept WHERE threshold = coalesce((SELECT max(threshold) FROM swept WHERE fn = 0), 0.01e0)""",
    "threshold_sensitivity": f"""{_WITH_EVAL}, t(threshold) AS (VALUES (0.5e0), (0.4e0), (0.3e0), (0.2e0), (0.15e0), (0.1e0), (0.05e0), (0.01e0)),
        c AS (SELECT threshold, count(*) FILTER (p < threshold AND y = 1) AS fn, count(*) FILTER (p >= threshold AND y = 0) AS fp,
              count(*) FILTER (p >= threshold AND y = 1) AS tp FROM t, scored GROUP BY threshold)
        SELECT threshold, fn, fp,
          round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 6) AS precision,
          round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 6) AS recall,
          round(CASE WHEN 2*tp + fp + fn = 0 THEN 0 ELSE 2*tp / CAST(2*tp + fp + fn AS DOUBLE) END, 6) AS f1,
          abs(threshold - 0.01e0) < 0.001e0 AS is_chosen FROM c""",
    "eval_metrics": f"{_WITH_EVAL} SELECT * FROM metrics",
    "classification_report": f"""{_WITH_EVAL}, r AS (
        SELECT *, tn / CAST(tn + fn AS DOUBLE) AS p0, tn / CAST(tn + fp AS DOUBLE) AS r0, 2*tn / CAST(2*tn + fn + fp AS DOUBLE) AS f0,
          tp / CAST(tp + fp AS DOUBLE) AS p1, tp / CAST(tp + fn AS DOUBLE) AS r1, 2*tp / CAST(2*tp + fn + fp AS DOUBLE) AS f1,
          tn + fp AS n0, tp + fn AS n1 FROM cells)
        SELECT 'Normal' AS label, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, n0 AS support FROM r
        UNION ALL SELECT 'Intrusion', round(p1, 6), round(r1, 6), round(f1, 6), n1 FROM r
        UNION ALL SELECT 'accuracy', NULL, NULL, round((tn + tp) / CAST(n0 + n1 AS DOUBLE), 6), n0 + n1 FROM r
        UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n0 + n1 FROM r
        UNION ALL SELECT 'weighted avg', round((p0*n0 + p1*n1) / (n0 + n1), 6), round((r0*n0 + r1*n1) / (n0 + n1), 6),
          round((f0*n0 + f1*n1) / (n0 + n1), 6), n0 + n1 FROM r""",
    "roc_auc": f"{_WITH_EVAL} SELECT roc_auc FROM auc",
    "roc_curve": f"""{_WITH_EVAL} SELECT p AS threshold, round(cn / CAST(nn AS DOUBLE), 6) AS fpr, round(cp / CAST(np AS DOUBLE), 6) AS tpr
        FROM roc UNION ALL SELECT NULL, 0.0e0, 0.0e0""",
    "dashboard": f"""{_WITH_EVAL} SELECT accuracy, precision, recall, f1, roc_auc, 0.01e0 AS threshold, false_negatives, false_positives,
        'online' AS status FROM metrics, auc""",
    "chain_append": f"""{_WITH_CHAIN} SELECT segment, block_index, "timestamp", sample_index, severity_level, action_summary, previous_hash, hash FROM log""",
    "chain_heads": f"""{_WITH_CHAIN},
        h0 AS (SELECT segment AS id, arg_max(hash, block_index) AS head FROM log GROUP BY segment),
        e1 AS (SELECT id // 1000 AS g, id, head, row_number() OVER (PARTITION BY id // 1000 ORDER BY id) AS n FROM h0),
        c1 AS (SELECT g, CAST(0 AS BIGINT) AS n, sha256('0|0|Threat Log Blockchain Initialized ' || CAST(g AS VARCHAR)) AS hash
                 FROM (SELECT DISTINCT g FROM e1)
               UNION ALL SELECT e.g, e.n, sha256(concat_ws('|', c.hash, CAST(e.n AS VARCHAR), CAST(e.id AS VARCHAR), e.head))
                 FROM c1 c JOIN e1 e ON e.g = c.g AND e.n = c.n + 1),
        h1 AS (SELECT g AS id, max(n) AS cnt, arg_max(hash, n) AS head FROM c1 GROUP BY g),
        e2 AS (SELECT id // 1000 AS g, id, head, row_number() OVER (PARTITION BY id // 1000 ORDER BY id) AS n FROM h1),
        c2 AS (SELECT g, CAST(0 AS BIGINT) AS n, sha256('0|0|Threat Log Blockchain Initialized ' || CAST(g AS VARCHAR)) AS hash
                 FROM (SELECT DISTINCT g FROM e2)
               UNION ALL SELECT e.g, e.n, sha256(concat_ws('|', c.hash, CAST(e.n AS VARCHAR), CAST(e.id AS VARCHAR), e.head))
                 FROM c2 c JOIN e2 e ON e.g = c.g AND e.n = c.n + 1),
        h2 AS (SELECT g AS id, max(n) AS cnt, arg_max(hash, n) AS head FROM c2 GROUP BY g),
        e3 AS (SELECT CAST(0 AS BIGINT) AS g, id, head, row_number() OVER (ORDER BY id) AS n FROM h2),
        c3 AS (SELECT CAST(0 AS BIGINT) AS g, CAST(0 AS BIGINT) AS n, sha256('0|0|Threat Log Blockchain Initialized 0') AS hash
               UNION ALL SELECT e.g, e.n, sha256(concat_ws('|', c.hash, CAST(e.n AS VARCHAR), CAST(e.id AS VARCHAR), e.head))
                 FROM c3 c JOIN e3 e ON e.g = c.g AND e.n = c.n + 1)
        SELECT 1 AS level, id AS "group", cnt AS n_heads, head AS hash FROM h1
        UNION ALL SELECT 2, id, cnt, head FROM h2
        UNION ALL SELECT 3, g, max(n), arg_max(hash, n) FROM c3 GROUP BY g""",
    "chain_continued": f"""{_WITH_CHAIN} SELECT segment, block_index, "timestamp", sample_index, previous_hash, hash FROM log""",
    "chain_sealed": f"""{_WITH_CHAIN}, gone AS (SELECT DISTINCT segment FROM log WHERE segment % 7 = 0)
        SELECT DISTINCT 1 AS level, segment // 1000 AS "group" FROM gone
        UNION SELECT 2, segment // 1000000 FROM gone UNION SELECT 3, 0 FROM gone""",
    "chain_verify": f"""{_WITH_CHAIN}, {_CHECKED.format(change=0)} SELECT * FROM verified""",
    "chain_verify_tampered": f"""{_WITH_CHAIN}, {_CHECKED.format(change=1)} SELECT * FROM verified""",
    "log_validity": " UNION ALL ".join(f"""SELECT * FROM ({_WITH_CHAIN}, {_CHECKED.format(change=change)}
        SELECT '{state}' AS state, CAST(sum(blocks) AS BIGINT) AS total_blocks, CAST(sum(blocks - 1) AS BIGINT) AS total_intrusions,
        count(*) AS segments, bool_and(is_valid) AS is_valid FROM verified)""" for state, change in (("stored", 0), ("forged", 1))),
    "log_severity": f"""{_WITH_CHAIN} SELECT d.severity_name, count(l.sample_index) AS n
        FROM severity_dim d LEFT JOIN log l ON l.severity_name = d.severity_name WHERE d.severity_level > 0 GROUP BY 1""",
    "log_view": f"{_WITH_CHAIN} SELECT * FROM view_rows",
    "log_hash_prefix": f"""{_WITH_CHAIN} SELECT segment, id, left(hash, 40) || '...' AS shown_hash,
        left(previous_hash, 16) || '...' AS shown_previous FROM view_rows""",
    "run_stamps": f"""{_BASE} SELECT strftime(max(ts), '%Y%m%d_%H%M%S') AS run_stamp, count(*) AS n FROM flows GROUP BY CAST(ts AS DATE)""",
    "log_search": f"""{_WITH_CHAIN} SELECT segment, id, source_ip, dest_ip, type, hash FROM view_rows
        WHERE contains(source_ip, '12') OR contains(dest_ip, '12')""",
    "log_page": f"""{_WITH_CHAIN} SELECT row_number() OVER (ORDER BY segment, id) AS position, segment, id, sample_index, type, hash,
        count(*) OVER () AS total_entries, CAST(ceil(count(*) OVER () / 10.0e0) AS BIGINT) AS total_pages FROM view_rows
        ORDER BY position LIMIT 10 OFFSET 1190""",
    "log_page_after": f"""{_WITH_CHAIN} SELECT segment, id, sample_index, hash FROM view_rows
        WHERE (segment, id) > (2, 100) ORDER BY segment, id LIMIT 10""",
    "shap_scorecard": f"{_WITH_MODEL} SELECT flow_id, feature, round(x, 6) AS feature_value, round(shap, 6) AS shap_value FROM contrib",
    "beeswarm_data": f"""{_WITH_MODEL}, top AS MATERIALIZED (SELECT feature FROM importance ORDER BY mean_abs_shap DESC, feature LIMIT 25)
        SELECT flow_id, c.feature, round(x, 6) AS feature_value, round(shap, 6) AS shap_value FROM contrib c JOIN top ON top.feature = c.feature""",
    "explain_flow": f"""{_WITH_MODEL}, r AS (SELECT *, CASE WHEN shap > 0 THEN 'intrusion' ELSE 'normal' END AS direction,
          row_number() OVER (PARTITION BY flow_id, shap > 0 ORDER BY round(abs(shap), 12) DESC, i) AS rn FROM contrib WHERE shap <> 0)
        SELECT flow_id, direction, CAST(rn AS INTEGER) AS rank, feature, category, round(shap, 6) AS shap_value,
          round(x, 6) AS feature_value FROM r WHERE rn <= 15""",
    "explain_flow_top3": f"""{_WITH_MODEL}, r AS (SELECT *, CASE WHEN shap > 0 THEN 'intrusion' ELSE 'normal' END AS direction,
          row_number() OVER (PARTITION BY flow_id, shap > 0 ORDER BY round(abs(shap), 12) DESC, i) AS rn FROM contrib WHERE shap <> 0)
        SELECT flow_id, direction, CAST(rn AS INTEGER) AS rank, feature, category, round(shap, 6) AS shap_value,
          round(x, 6) AS feature_value FROM r WHERE rn <= 3""",
    "explain_header": f"""{_WITH_MODEL}, t AS (SELECT flow_id, sum(shap) AS total FROM contrib GROUP BY flow_id)
        SELECT g.flow_id, predicted_class, intrusion_probability, 0.01e0 AS threshold,
          CASE WHEN p >= 0.7e0 THEN 'high' WHEN p >= 0.01e0 THEN 'medium' ELSE 'low' END AS confidence,
          round(base_value, 6) AS base_value, round(total, 6) AS total_shap, round(total + base_value, 6) AS margin,
          round(1 / (1 + exp(-(total + base_value))), 6) AS after_sigmoid,
          CASE WHEN y = 1 THEN 'intrusion' ELSE 'normal' END AS actual_class, (predicted_class = 'intrusion') = (y = 1) AS correct
        FROM predicted g JOIN t ON t.flow_id = g.flow_id, base""",
    "category_contrib": f"""{_WITH_MODEL}, s AS (SELECT flow_id, category, round(sum(shap), 6) AS contribution FROM contrib GROUP BY 1, 2)
        SELECT *, CASE WHEN contribution > 0 THEN 'intrusion' ELSE 'normal' END AS direction FROM s""",
    "contrib_share": f"""{_WITH_MODEL}, s AS (SELECT flow_id, category, round(sum(shap), 6) AS c FROM contrib GROUP BY 1, 2)
        SELECT flow_id, CASE WHEN c > 0 THEN 'intrusion' ELSE 'normal' END AS direction, category,
          round(abs(c) / sum(abs(c)) OVER (PARTITION BY flow_id, c > 0), 6) AS share FROM s WHERE c <> 0""",
    "waterfall_data": f"""{_WITH_MODEL}, r AS (SELECT *, row_number() OVER ({_BAR_ORDER}) AS bar,
          sum(shap) OVER (PARTITION BY flow_id) + base_value AS margin FROM contrib, base),
        w AS (SELECT *, sum(shap) OVER (PARTITION BY flow_id ORDER BY bar) AS upto FROM r)
        SELECT flow_id, CAST(bar AS INTEGER) AS bar, feature, round(shap, 6) AS shap_value, round(margin - upto, 6) AS bar_from,
          round(margin - upto + shap, 6) AS bar_to FROM w""",
    "waterfall_folded": f"""{_WITH_MODEL}, r AS (SELECT *, row_number() OVER ({_BAR_ORDER}) AS rn,
          sum(shap) OVER (PARTITION BY flow_id) + base_value AS margin FROM contrib, base),
        f AS (SELECT flow_id, least(rn, 6) AS bar, CASE WHEN min(rn) < 6 THEN any_value(feature) ELSE '7 other features' END AS feature,
          sum(shap) AS shap, any_value(margin) AS margin FROM r GROUP BY flow_id, least(rn, 6)),
        w AS (SELECT *, sum(shap) OVER (PARTITION BY flow_id ORDER BY bar) AS upto FROM f)
        SELECT flow_id, CAST(bar AS INTEGER) AS bar, feature, round(shap, 6) AS shap_value, round(margin - upto, 6) AS bar_from,
          round(margin - upto + shap, 6) AS bar_to FROM w""",
    "feature_category_map": f"""{_BASE}, names AS (
        SELECT unnest([{", ".join(f"'{c}'" for c in _ALL_NUMERIC)}]) AS feature
        UNION ALL SELECT DISTINCT 'protocol_type_' || protocol_type FROM flows
        UNION ALL SELECT DISTINCT 'service_' || service FROM flows UNION ALL SELECT DISTINCT 'flag_' || flag FROM flows)
        SELECT feature, {_CATEGORY_CASE} AS category FROM names""",
    "global_importance": f"""{_WITH_MODEL} SELECT feature, category, round(mean_abs_shap, 6) AS mean_abs_shap,
        round(native_importance, 6) AS native_importance FROM importance ORDER BY mean_abs_shap DESC, feature LIMIT 30""",
    "importance_combined": f"""{_WITH_MODEL} SELECT feature, round(native_importance, 6) AS native_importance,
        round(mean_abs_shap, 6) AS mean_abs_shap FROM importance""",
    "importance_rank": f"""{_WITH_MODEL} SELECT feature, category, round(mean_abs_shap, 6) AS mean_abs_shap,
        round(native_importance, 6) AS native_importance,
        CAST(row_number() OVER (ORDER BY importance.mean_abs_shap DESC, feature) AS INTEGER) AS rank FROM importance""",
    "category_importance": f"""{_WITH_MODEL} SELECT category, round(sum(mean_abs_shap), 6) AS total_shap,
        round(sum(native_importance), 6) AS total_native, count(*) AS feature_count FROM importance GROUP BY category""",
    "category_summary": f"""{_WITH_MODEL} SELECT category, round(sum(mean_abs_shap), 6) AS mean_abs_shap_sum,
        round(avg(mean_abs_shap), 6) AS mean_abs_shap_mean, count(*) AS mean_abs_shap_count,
        round(sum(native_importance), 6) AS native_importance_sum, round(avg(native_importance), 6) AS native_importance_mean
        FROM importance GROUP BY category""",
    "intrusion_importance": f"""{_WITH_MODEL} SELECT feature, any_value(category) AS category, round(avg(abs(shap)), 6) AS mean_abs_shap,
        round(avg(shap), 6) AS mean_shap FROM contrib WHERE predicted_class = 'intrusion' GROUP BY feature
        ORDER BY avg(abs(shap)) DESC, feature LIMIT 25""",
    "intrusion_category": f"""{_WITH_MODEL}, i AS (SELECT feature, any_value(category) AS category, avg(abs(shap)) AS m FROM contrib
        WHERE predicted_class = 'intrusion' GROUP BY feature)
        SELECT category, round(sum(m), 6) AS total_impact, count(*) AS feature_count FROM i GROUP BY category""",
    "intrusion_feature_stats": f"""{_WITH_MODEL} SELECT r.feature, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std,
        round(min, 6) AS min, round(max, 6) AS max, round(mean_shap, 6) AS mean_shap
        FROM raw_stats r JOIN shap_means s ON s.feature = r.feature AND s.predicted_class = r.predicted_class
        WHERE r.predicted_class = 'intrusion' AND r.feature <> 'num_failed_logins'""",
    "class_compare_shap": f"""{_WITH_MODEL} SELECT a.feature, a.category, round(a.mean_shap, 6) AS intrusion_shap,
        round(b.mean_shap, 6) AS normal_shap, round(a.mean_shap - b.mean_shap, 6) AS difference,
        round(abs(a.mean_shap - b.mean_shap), 6) AS abs_difference
        FROM shap_means a JOIN shap_means b ON a.feature = b.feature AND a.predicted_class = 'intrusion' AND b.predicted_class = 'normal'
        ORDER BY abs(a.mean_shap - b.mean_shap) DESC, a.feature LIMIT 20""",
    "class_compare_raw": f"""{_WITH_MODEL}, j AS (SELECT r.*, s.mean_shap FROM raw_stats r JOIN shap_means s
          ON s.feature = r.feature AND s.predicted_class = r.predicted_class
          WHERE r.feature IN ('duration', 'src_bytes', 'dst_bytes', 'count', 'srv_count'))
        SELECT a.feature, round(a.mean, 6) AS intrusion_mean, round(a.median, 6) AS intrusion_median,
          round(a.mean_shap, 6) AS intrusion_mean_shap, round(b.mean, 6) AS normal_mean, round(b.median, 6) AS normal_median,
          round(b.mean_shap, 6) AS normal_mean_shap, round(a.mean - b.mean, 6) AS mean_difference,
          round(a.mean_shap - b.mean_shap, 6) AS shap_difference
        FROM j a JOIN j b ON a.feature = b.feature AND a.predicted_class = 'intrusion' AND b.predicted_class = 'normal'""",
    "network_feature_analysis": f"""{_WITH_MODEL} SELECT a.feature,
          CASE WHEN a.feature = 'duration' THEN 'Basic Flow Features' WHEN a.feature LIKE '%bytes' THEN 'Traffic Volume'
               WHEN a.feature = 'num_failed_logins' THEN 'Connection Metrics' ELSE 'Time-based Features' END AS category,
          round(a.mean, 6) AS intrusion_mean, round(a.median, 6) AS intrusion_median, round(a.std, 6) AS intrusion_std,
          round(b.mean, 6) AS normal_mean, round(b.median, 6) AS normal_median, round(b.std, 6) AS normal_std,
          round(a.mean - b.mean, 6) AS mean_difference
        FROM raw_stats a JOIN raw_stats b ON a.feature = b.feature AND a.predicted_class = 'intrusion' AND b.predicted_class = 'normal'""",
    "top_alerts": f"""{_WITH_MODEL}, best AS (SELECT flow_id, intrusion_probability FROM predicted WHERE predicted_class = 'intrusion'
          ORDER BY p DESC, flow_id LIMIT 10),
        r AS (SELECT *, row_number() OVER ({_BAR_ORDER}) AS rn FROM contrib WHERE flow_id IN (SELECT flow_id FROM best))
        SELECT b.flow_id, b.intrusion_probability, r.feature AS top_feature, round(r.shap, 6) AS top_shap
        FROM best b JOIN r ON r.flow_id = b.flow_id AND r.rn = 1""",
    "top_by_feature": f"""{_WITH_MODEL} SELECT flow_id, predicted_class, p AS intrusion_probability, round(shap, 6) AS shap_value FROM contrib
        WHERE feature = 'src_bytes' ORDER BY round(abs(shap), 12) DESC, flow_id LIMIT 10""",
    "search_range": f"""{_BASE} SELECT flow_id, CAST(src_bytes AS DOUBLE) AS feature_value, predicted_class, intrusion_probability,
        count(*) OVER () AS total_matches FROM predicted WHERE src_bytes BETWEEN 10000 AND 50000 ORDER BY flow_id LIMIT 15""",
    "compare_extremes": f"""{_BASE}, a AS (SELECT * FROM predicted ORDER BY p DESC, flow_id LIMIT 1),
        b AS (SELECT * FROM predicted ORDER BY p, flow_id LIMIT 1)
        SELECT a.flow_id AS flow_a, b.flow_id AS flow_b, a.predicted_class AS class_a, b.predicted_class AS class_b, a.p AS p_a, b.p AS p_b,
          f AS feature,
          CAST(CASE f WHEN 'duration' THEN a.duration WHEN 'src_bytes' THEN a.src_bytes WHEN 'dst_bytes' THEN a.dst_bytes
               WHEN 'count' THEN a."count" ELSE a.srv_count END AS DOUBLE) AS value_a,
          CAST(CASE f WHEN 'duration' THEN b.duration WHEN 'src_bytes' THEN b.src_bytes WHEN 'dst_bytes' THEN b.dst_bytes
               WHEN 'count' THEN b."count" ELSE b.srv_count END AS DOUBLE) AS value_b
        FROM a, b, (SELECT unnest(['duration', 'src_bytes', 'dst_bytes', 'count', 'srv_count']) AS f)""",
    "compare_two": f"""{_BASE}, a AS (SELECT * FROM predicted ORDER BY flow_id LIMIT 1), b AS (SELECT * FROM predicted ORDER BY flow_id DESC LIMIT 1)
        SELECT a.flow_id AS flow_a, b.flow_id AS flow_b, a.predicted_class AS class_a, b.predicted_class AS class_b, a.p AS p_a, b.p AS p_b,
          f AS feature,
          CAST(CASE f WHEN 'duration' THEN a.duration WHEN 'src_bytes' THEN a.src_bytes WHEN 'dst_bytes' THEN a.dst_bytes
               WHEN 'count' THEN a."count" ELSE a.srv_count END AS DOUBLE) AS value_a,
          CAST(CASE f WHEN 'duration' THEN b.duration WHEN 'src_bytes' THEN b.src_bytes WHEN 'dst_bytes' THEN b.dst_bytes
               WHEN 'count' THEN b."count" ELSE b.srv_count END AS DOUBLE) AS value_b
        FROM a, b, (SELECT unnest(['duration', 'src_bytes', 'dst_bytes', 'count', 'srv_count']) AS f)""",
    "anomaly_q99": f"""{_BASE}, hits AS (
        (SELECT flow_id FROM predicted WHERE duration > (SELECT quantile_cont(duration, 0.99) FROM predicted) ORDER BY flow_id LIMIT 5)
        UNION (SELECT flow_id FROM predicted WHERE src_bytes > (SELECT quantile_cont(src_bytes, 0.99) FROM predicted) ORDER BY flow_id LIMIT 5)
        UNION (SELECT flow_id FROM predicted WHERE dst_bytes > (SELECT quantile_cont(dst_bytes, 0.99) FROM predicted) ORDER BY flow_id LIMIT 5))
        SELECT flow_id, predicted_class, intrusion_probability FROM predicted WHERE flow_id IN (SELECT flow_id FROM hits)
        ORDER BY flow_id LIMIT 10""",
    "xai_export": f"""{_WITH_MODEL}, wide AS (SELECT flow_id, sum(shap) AS total, """ + ", ".join(
        f"round(any_value(shap) FILTER (feature = '{f}'), 6) AS shap_{f}" for f in (
            "src_bytes", "count", "serror_rate", "num_failed_logins", "dst_host_count", "srv_count", "duration", "dst_bytes",
            "flag_S0", "flag_REJ", "protocol_type_icmp", "service_domain_u")) + """ FROM contrib GROUP BY flow_id)
        SELECT p.flow_id, p.src_bytes, p.dst_bytes, p.service, p.flag, p.predicted_class AS prediction, p.p AS probability,
          CASE WHEN p.p >= 0.7e0 THEN 'high' WHEN p.p >= 0.01e0 THEN 'medium' ELSE 'low' END AS confidence,
          w.* EXCLUDE (flow_id, total), round(w.total, 6) AS total_shap
        FROM predicted p JOIN wide w ON w.flow_id = p.flow_id""",
    "xai_export_top5": f"""{_WITH_MODEL}, top AS MATERIALIZED (SELECT feature FROM importance ORDER BY mean_abs_shap DESC, feature LIMIT 5)
        SELECT flow_id, round(sum(shap), 6) AS total_shap, count(top.feature) AS n_shap,
          round(sum(round(shap, 6)) FILTER (top.feature IS NOT NULL), 5) AS top_shap
        FROM contrib c LEFT JOIN top ON top.feature = c.feature GROUP BY flow_id""",
    "run_report": f"""{_WITH_MODEL}, n AS (SELECT count(*) AS t, count(*) FILTER (predicted_class = 'intrusion') AS i FROM predicted)
        SELECT 'summary' AS section, 'total_samples' AS item, CAST(t AS DOUBLE) AS value FROM n
        UNION ALL SELECT 'summary', 'intrusions', i FROM n UNION ALL SELECT 'summary', 'normals', t - i FROM n
        UNION ALL SELECT 'summary', 'intrusion_pct', round(100 * (i / CAST(t AS DOUBLE)), 4) FROM n
        UNION ALL SELECT 'summary', 'normal_pct', round(100 * ((t - i) / CAST(t AS DOUBLE)), 4) FROM n
        UNION ALL SELECT 'summary', 'threshold', 0.01e0
        UNION ALL SELECT 'severity', d.severity_name, CAST(count(g.flow_id) AS DOUBLE) FROM severity_dim d
          LEFT JOIN levelled g ON g.severity_level = d.severity_level GROUP BY d.severity_name
        UNION ALL SELECT 'feature', feature, round(m, 6) FROM (SELECT feature, mean_abs_shap AS m FROM importance
          ORDER BY m DESC, feature LIMIT 10)""",
    "strip_emoji_text": r"""WITH c AS (SELECT doc_id, text AS raw, regexp_replace(text,
          '[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+', '', 'g')
          AS text FROM documents)
        SELECT doc_id, text, CAST(length(raw) - length(text) AS INTEGER) AS removed FROM c""",
    "stream_alerts": f"""{_BASE} SELECT flow_id AS sample_index, intrusion_probability, severity_level, severity_name, action_summary,
        array_to_string(immediate, ' ; ') AS immediate_actions FROM responded WHERE predicted_class = 'intrusion'""",
    "stream_severity": f"""{_BASE} SELECT strftime(ts, '%Y-%m-%d') AS day, severity_level, count(*) AS n FROM levelled GROUP BY 1, 2""",
}
SQL["stream_chain"] = SQL["chain_append"]

# the same reports for one flow, for a flow that is not there, and with limits that cut
_ONE = SQL["explain_flow"].replace("WHERE rn <= 15", "WHERE rn <= 15 AND flow_id = 42")
SQL |= {
    "explain_one_flow": _ONE,
    "explain_missing_flow": f"SELECT * FROM ({SQL['explain_header']}) WHERE flow_id = -1",
    "global_importance_top5": SQL["global_importance"].replace("LIMIT 30", "LIMIT 5"),
    "class_compare_shap_top5": SQL["class_compare_shap"].replace("LIMIT 20", "LIMIT 5"),
    "beeswarm_top5": SQL["beeswarm_data"].replace("LIMIT 25", "LIMIT 5"),
}
