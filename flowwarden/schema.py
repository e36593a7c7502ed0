"""Spark schemas built from the fixed column lists."""

from pyspark.sql import types as T

from .fixed_values import DIFFICULTY_COLUMN, FLOW_COLUMNS, LABEL_COLUMN

_TYPES = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}

FLOW_SCHEMA = T.StructType([T.StructField(n, _TYPES[t]) for n, t in FLOW_COLUMNS])
FEATURES = [n for n, _ in FLOW_COLUMNS]
NUMERIC_FEATURES = [n for n, t in FLOW_COLUMNS if t != "string"]
CATEGORICAL_FEATURES = [n for n, t in FLOW_COLUMNS if t == "string"]

# columns a flow file may hold besides the features
OPTIONAL_FIELDS = {
    LABEL_COLUMN: T.StringType(),
    DIFFICULTY_COLUMN: T.LongType(),
    "flow_id": T.LongType(),
    "src_id": T.LongType(),
}

NETWORK_FEATURES_SCHEMA = T.StructType([
    T.StructField("duration", T.DoubleType()),
    T.StructField("protocol_type", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("flag", T.StringType()),
    T.StructField("src_bytes", T.DoubleType()),
    T.StructField("dst_bytes", T.DoubleType()),
    T.StructField("count", T.DoubleType()),
    T.StructField("srv_count", T.DoubleType()),
    T.StructField("serror_rate", T.DoubleType()),
    T.StructField("num_failed_logins", T.DoubleType()),
    T.StructField("dst_host_count", T.DoubleType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
])

LOG_DATA_SCHEMA = T.StructType([
    T.StructField("message", T.StringType()),
    T.StructField("system", T.StringType()),
    T.StructField("sample_index", T.LongType()),
    T.StructField("intrusion_probability", T.DoubleType()),
    T.StructField("severity_level", T.LongType()),
    T.StructField("severity_name", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("action_summary", T.StringType()),
    T.StructField("immediate_actions", T.ArrayType(T.StringType())),
    T.StructField("monitoring_actions", T.ArrayType(T.StringType())),
    T.StructField("network_features", NETWORK_FEATURES_SCHEMA),
    T.StructField("blockchain_timestamp", T.StringType()),
    T.StructField("block_index", T.LongType()),
])

LOG_BLOCK_SCHEMA = T.StructType([
    T.StructField("index", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("data", LOG_DATA_SCHEMA),
    T.StructField("previous_hash", T.StringType()),
    T.StructField("hash", T.StringType()),
])

LOG_DOCUMENT_SCHEMA = T.StructType([
    T.StructField("blockchain_info", T.StructType([
        T.StructField("total_blocks", T.LongType()),
        T.StructField("total_intrusions", T.LongType()),
        T.StructField("export_timestamp", T.StringType()),
        T.StructField("is_valid", T.BooleanType()),
    ])),
    T.StructField("blocks", T.ArrayType(LOG_BLOCK_SCHEMA)),
])
