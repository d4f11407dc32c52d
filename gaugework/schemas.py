"""Table schemas, as DDL strings that ``spark.read.schema`` accepts."""

READINGS = (
    "id bigint, node_id string, value string, timestamp timestamp, "
    "quality string, created_on timestamp"
)

VARIABLES = (
    "variable_id bigint, variable_name string, pre_save_formula string, "
    "formula_type string, time int, time_interval timestamp, is_deleted boolean"
)

EXECUTIONS = (
    "variable_id bigint, tag_id bigint, result double, result_on timestamp, "
    "processed_on timestamp, window_end timestamp, created_by string, "
    "created_on timestamp, is_deleted boolean"
)

FAILURES = (
    "tag_id bigint, variable_id bigint, error_message string, failed_at timestamp, "
    "retry_count int, is_resolved boolean"
)

STATE = (
    "service_name string, last_processed_id bigint, updated_at timestamp, "
    "as_of timestamp, readings bigint"
)

# The log of batches: the state after each, and how many outcomes it has.
COUNTED = STATE + ", successes bigint, failures bigint"
BATCHES = COUNTED + ", batch_id bigint"

# A line as it is written: the attempt it counts, and how many lines the batch had before.
LINE = COUNTED + ", attempt string, turn int"

LATEST = "node_id string, id bigint, value double"

DEADLINES = "variable_id bigint, time_interval timestamp"
