"""Row types of records, evaluations and decisions."""

from __future__ import annotations

from pyspark.sql import types as T

# Tag stamped on every normalized record; callers may pass their own.
SCHEMA_TAG = "logjury.log.v1"

ATTRIBUTES = T.MapType(T.StringType(), T.StringType(), True)

RECORD = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("attributes", ATTRIBUTES),
    ]
)
RECORDS = T.ArrayType(RECORD)

RECORD_FIELDS = ["schema", "source", "timestamp", "level", "service", "message", "attributes"]

CALLBACK_INTENT = T.StructType(
    [
        T.StructField("target", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
        T.StructField("dedupe_key", T.StringType()),
    ]
)

# One handler action; ``kind`` tells emit_decision and emit_callback_intent apart.
ACTION = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("priority", T.LongType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
        T.StructField("dedupe_key", T.StringType()),
    ]
)

RULE = T.StructType(
    [
        T.StructField("rule_rank", T.IntegerType()),
        T.StructField("condition", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("priority", T.LongType()),
    ]
)

HANDLER = T.StructType(
    [
        T.StructField("handler_rank", T.IntegerType()),
        T.StructField("handler", T.StringType()),
        T.StructField("condition", T.StringType()),
        T.StructField("priority", T.LongType()),
        T.StructField("actions", T.ArrayType(ACTION)),
    ]
)

# Total order of decisions: line, record within the line, rule, handler, action.
ORDER_KEY = ["ord", "rec_idx", "rule_rank", "handler_rank", "action_rank"]
