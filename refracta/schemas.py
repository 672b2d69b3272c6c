"""Table schemas and the contract checks built on them."""

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_TS = T.TimestampNTZType()


def _struct(*cols):
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in cols])


FUNCTIONS = _struct(
    ("id", _S, False),
    ("language", _S, False),
    ("code", _S, False),
    ("code_hash", _S, False),
    ("cyclomatic_complexity", _I, False),
    ("halstead_volume", _D, True),
    ("lines_of_code", _I, False),
    ("domain", _S, True),
    ("source", _S, False),
    ("task_name", _S, True),
    ("test_suite_path", _S, True),
    ("validated", _B, True),
    ("created_at", _TS, True),
)

# What the collectors exchange: one JSON object per line, origin columns optional.
FUNCTION_JSONL = T.StructType(
    [f for f in FUNCTIONS.fields if f.name not in ("test_suite_path", "validated", "created_at")]
    + [T.StructField("url", _S, True), T.StructField("file_path", _S, True)]
)

TRANSFORMATIONS = _struct(
    ("function_id", _S, False),
    ("model", _S, False),
    ("task", _S, False),
    ("strategy", _S, False),
    ("temperature", _D, True),
    ("transformed_code", _S, True),
    ("delta_cc", _D, True),
    ("preservation", _I, True),
    ("diversity", _D, True),
    ("effort", _D, True),
    ("se_score", _D, True),
    ("cost_usd", _D, True),
    ("latency_ms", _I, True),
    ("tokens_input", _I, True),
    ("tokens_output", _I, True),
    ("error_type", _S, True),
    ("timestamp", _TS, True),
)

COST_TRACKING = _struct(
    ("date", T.DateType(), False),
    ("model", _S, False),
    ("total_calls", _L, False),
    ("total_cost_usd", _D, False),
    ("avg_latency_ms", _D, True),
    ("successful_calls", _L, False),
    ("failed_calls", _L, False),
)

# Latency sketches of a roll-up: see ``operators.cost.latency_sketches``.
LATENCY_SKETCHES = _struct(("date", T.DateType(), True), ("model", _S, True), ("latencies", T.BinaryType(), True))

# State of a live monitor: see ``operators.monitor.monitor_parts``.
MONITOR_PARTS = _struct(
    ("is_cell", _B, True),
    ("model", _S, True),
    ("task", _S, True),
    ("strategy", _S, True),
    ("function_id", _S, True),
    ("count", _L, True),
    ("pending", _L, True),
    ("cost_usd", _D, True),
    ("latency_ms", _L, True),
    ("latencies", _L, True),
    ("delta_cc", _D, True),
    ("deltas", _L, True),
)
