"""Fixed values.

Every table here is data that has to equal the published formats for results to
match: column names, rule bounds, category tokens, message texts, file patterns.
They are listed plainly and in natural order; no logic lives in this module.
"""

# --- columns of a flow record, in file order -------------------------------

FLOW_COLUMNS = [
    ("duration", "long"), ("protocol_type", "string"), ("service", "string"),
    ("flag", "string"), ("src_bytes", "long"), ("dst_bytes", "long"),
    ("land", "long"), ("wrong_fragment", "long"), ("urgent", "long"),
    ("hot", "long"), ("num_failed_logins", "long"), ("logged_in", "long"),
    ("num_compromised", "long"), ("root_shell", "long"), ("su_attempted", "long"),
    ("num_root", "long"), ("num_file_creations", "long"), ("num_shells", "long"),
    ("num_access_files", "long"), ("num_outbound_cmds", "long"),
    ("is_host_login", "long"), ("is_guest_login", "long"), ("count", "long"),
    ("srv_count", "long"), ("serror_rate", "double"), ("srv_serror_rate", "double"),
    ("rerror_rate", "double"), ("srv_rerror_rate", "double"),
    ("same_srv_rate", "double"), ("diff_srv_rate", "double"),
    ("srv_diff_host_rate", "double"), ("dst_host_count", "long"),
    ("dst_host_srv_count", "long"), ("dst_host_same_srv_rate", "double"),
    ("dst_host_diff_srv_rate", "double"), ("dst_host_same_src_port_rate", "double"),
    ("dst_host_srv_diff_host_rate", "double"), ("dst_host_serror_rate", "double"),
    ("dst_host_srv_serror_rate", "double"), ("dst_host_rerror_rate", "double"),
    ("dst_host_srv_rerror_rate", "double"),
]

LABEL_COLUMN = "class"
NORMAL_LABEL = "normal"
DIFFICULTY_COLUMN = "difficulty"

# the columns that drive severity, response and the threat log
KEY_FEATURES = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes",
    "count", "srv_count", "serror_rate", "num_failed_logins", "dst_host_count",
]

# columns shown by the different reports
DETAIL_FEATURES = ["src_bytes", "dst_bytes", "count", "srv_count", "serror_rate", "duration"]
COMPARE_FEATURES = ["duration", "src_bytes", "dst_bytes", "count", "srv_count"]
PROFILE_FEATURES = [
    "duration", "src_bytes", "dst_bytes", "count", "srv_count",
    "serror_rate", "srv_serror_rate", "dst_host_count",
]
ANOMALY_FEATURES = ["duration", "src_bytes", "dst_bytes"]

# --- decisions --------------------------------------------------------------

DEFAULT_THRESHOLD = 0.01
SENSITIVITY_THRESHOLDS = [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05]
SWEEP_STEPS = 50                      # 0.01 .. 0.50
HIGH_CONFIDENCE = 0.7
DASHBOARD_DEFAULTS = {
    "accuracy": 0.0, "precision": 0.0, "recall": 1.0, "f1": 0.0,
    "roc_auc": 0.0, "threshold": 0.12, "false_negatives": 0, "false_positives": 0,
}

# --- severity ---------------------------------------------------------------

# level, name, priority, description
SEVERITY_LEVELS = [
    (0, "NORMAL", "None", "Normal traffic, no threat detected"),
    (1, "LOW RISK", "Low", "Suspicious activity detected, monitor"),
    (2, "MEDIUM RISK", "Medium", "Likely intrusion, requires attention"),
    (3, "HIGH RISK", "High", "Confirmed intrusion, immediate action needed"),
]

# feature, (above (exclusive), points), highest first; a value takes the first that fits
SEVERITY_BANDS = [
    ("src_bytes", [(100000, 3), (50000, 2), (10000, 1)]),
    ("count", [(300, 3), (100, 2), (20, 1)]),
    ("num_failed_logins", [(5, 3), (3, 2), (1, 1)]),
    ("serror_rate", [(0.5, 3), (0.3, 2), (0.1, 1)]),
    ("dst_host_count", [(100, 3), (50, 2)]),
    ("srv_count", [(20, 2)]),
    ("duration", [(1000, 1)]),
]

# probability at or above -> points, highest first
PROBABILITY_POINTS = [(0.9, 3), (0.7, 2), (0.5, 1)]

# total score at or above -> level, highest first; anything less is level 1
SCORE_LEVELS = [(8, 3), (4, 2)]

# --- response playbook ------------------------------------------------------

IMMEDIATE_ACTIONS = {
    0: ["Allow this traffic to pass through normally"],
    1: ["Allow the traffic but keep a close watch on it",
        "Turn on detailed packet inspection"],
    2: ["Mark this traffic for immediate security review",
        "Slow down or limit data from this source",
        "Activate intrusion detection systems"],
    3: ["BLOCK this source IP immediately",
        "Add IP to firewall blacklist",
        "Drop all packets from this source",
        "Cut off active connections"],
}

MONITORING_ACTIONS = {
    0: [],
    1: ["Watch connection frequency over next 5 minutes",
        "Look for unusual patterns",
        "Track data volume"],
    2: ["Monitor this source IP in real-time",
        "Check security logs for previous activity",
        "Look up IP reputation online",
        "Review past 24 hours of traffic from this source"],
    3: ["Check if other IPs from same network are attacking",
        "Look for signs of system compromise",
        "Check if IP is part of known botnet",
        "Review all traffic from past 24 hours",
        "Identify targeted systems"],
}

LOGGING_ACTIONS = {
    0: ["Keep basic logs for record-keeping purposes"],
    1: ["Save complete connection details",
        "Store packet headers for analysis"],
    2: ["Capture and save all packets",
        "Add to security database",
        "Create permanent audit log"],
    3: ["Capture everything for forensic analysis",
        "Save evidence in secure location",
        "Create detailed logs for legal proceedings",
        "Write full incident report"],
}

# {pct} stands for the probability as a percentage with one decimal
EXPLANATIONS = {
    0: "This appears to be normal, legitimate network traffic.",
    1: "This traffic looks somewhat suspicious (we are {pct} confident it might be an intrusion).",
    2: "This is likely a real intrusion attempt ({pct} confident). Requires prompt attention.",
    3: "This is a serious attack in progress ({pct} confident). Block immediately!",
}

# the detail report words level 1 a little differently
DETAIL_EXPLANATIONS = {
    1: "This traffic looks somewhat suspicious ({pct} confident it might be an intrusion).",
    2: "This is likely a real intrusion attempt ({pct} confident). Requires prompt attention.",
    3: "This is a serious attack in progress ({pct} confident). Block immediately!",
}

ACTION_SUMMARIES = {
    0: "Normal traffic - no action required.",
    1: "LOW RISK: Monitor activity closely. Review logs and watch for patterns. Confidence: {pct}.",
    2: "MEDIUM RISK: Review immediately and monitor source. Likely intrusion with {pct} confidence. "
       "Check logs for similar activity.",
    3: "HIGH RISK - CRITICAL: Block source IP immediately! Serious attack detected with {pct} confidence. "
       "Initiate incident response.",
}

# what the scored output says for a flow that was not flagged
NORMAL_SUMMARY = "Normal traffic"

# level, list extended, feature, above (exclusive), action appended, summary suffix
CONDITIONAL_ACTIONS = [
    (2, "monitoring", "src_bytes", 10000,
     "High outbound data - possible data theft", " Large data transfer detected."),
    (2, "monitoring", "count", 100,
     "Many connections - possible network scan", " Multiple connections detected."),
    (3, "immediate", "num_failed_logins", 5,
     "Lock user accounts - password guessing attack", " Password attack in progress!"),
    (3, "immediate", "src_bytes", 50000,
     "Large data transfer - investigate data theft", " Possible data exfiltration!"),
    (3, "immediate", "count", 200,
     "Block port scan - probing for weaknesses", " Active port scanning detected!"),
]

LOGGED_MONITORING_ACTIONS = 3
SHOWN_INDICATORS = 3

INDICATOR_TEXTS = {
    "src_bytes_extreme": "Extremely large outbound data - possible major data theft or DDoS",
    "src_bytes_large": "Significant outbound data - might indicate data theft",
    "one_sided": "One-sided traffic pattern - typical of data exfiltration",
    "count_extreme": "Hundreds of connections - automated port scanning or DoS attack",
    "count_large": "Many rapid connections - automated scanning tools detected",
    "syn_errors": "High SYN error rate - telltale sign of SYN flood attack",
    "failed_logins": "{n} failed logins - password guessing attack",
    "many_hosts": "Connecting to many hosts - worm spreading or lateral movement",
}

# --- feature categories: first group holding a token of the name wins -------

CATEGORY_TOKENS = [
    ("Basic Flow Features", ["duration", "protocol_type", "service", "flag"]),
    ("Traffic Volume", ["src_bytes", "dst_bytes", "land"]),
    ("Connection Metrics", ["wrong_fragment", "urgent", "hot", "num_failed_logins"]),
    ("Time-based Features", ["count", "srv_count", "serror_rate", "srv_serror_rate",
                             "rerror_rate", "srv_rerror_rate"]),
    ("Host-based Features", ["dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate",
                             "dst_host_diff_srv_rate", "dst_host_same_src_port_rate",
                             "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
                             "dst_host_srv_serror_rate", "dst_host_rerror_rate",
                             "dst_host_srv_rerror_rate"]),
    ("Content Features", ["num_compromised", "root_shell", "su_attempted", "num_root",
                          "num_file_creations", "num_shells", "num_access_files",
                          "is_guest_login", "is_host_login", "num_outbound_cmds"]),
]
OTHER_CATEGORY = "Other/Encoded"

# --- learning ---------------------------------------------------------------

BOOSTING = {
    "n_estimators": 500, "max_depth": 8, "learning_rate": 0.05, "subsample": 0.8,
    "colsample": 0.8, "scale_pos_weight": 20.0, "seed": 42,
}
TEST_FRACTION = 0.2
SPLIT_SEED = 42
LABEL_MAPPING = {"normal": 0, "intrusion": 1}

# --- frozen additive scorecard: reproducible scores without a fitted model --
# feature, bound, value if x <= bound, value otherwise, share of rows at or below

SCORECARD_BIAS = -2.0
SCORECARD_STUMPS = [
    ("src_bytes", 50000.0, -0.9, 1.6, 0.87),
    ("count", 300.0, -0.5, 1.5, 0.75),
    ("serror_rate", 0.5, -1.2, 1.7, 0.5),
    ("num_failed_logins", 3.0, -0.8, 1.2, 0.5),
    ("dst_host_count", 100.0, -0.7, 0.8, 0.4),
    ("srv_count", 20.0, -0.4, 0.5, 0.35),
    ("duration", 1000.0, -0.3, 0.6, 0.5),
    ("dst_bytes", 2500.0, 0.4, -0.4, 0.5),
    ("flag_S0", 0.5, -0.6, 2.0, 0.8),
    ("flag_REJ", 0.5, -0.3, 1.1, 0.8),
    ("protocol_type_icmp", 0.5, -0.4, 0.9, 0.67),
    ("service_domain_u", 0.5, -0.9, 2.2, 0.8),
]

# --- texts and files --------------------------------------------------------

# first and last code point of each range that counts as an emoji
EMOJI_RANGES = [
    (0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF),
    (0x1F1E0, 0x1F1FF), (0x2702, 0x27B0), (0x24C2, 0x1F251),
]

GENESIS_MESSAGE = "Threat Log Blockchain Initialized"
GENESIS_SYSTEM = "Network Intrusion Detection System"
GENESIS_PREVIOUS_HASH = "0"

LOG_VIEW_DEFAULTS = {"text": "N/A", "type": "Unknown", "status": "logged", "sample_index": -1}
LOG_PAGE_SIZE = 10
DETAIL_LIMIT = 100

PREDICTIONS_PREFIX = "predictions_with_actions_"
LOG_PREFIX = "blockchain_threat_log_"
EXPLANATION_PREFIX = "xai_predictions_"
RUN_STAMP = "yyyyMMdd_HHmmss"
ARTIFACT_KINDS = {".png": "images", ".csv": "data", ".json": "blockchain"}
