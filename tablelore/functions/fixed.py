"""Fixed values.

Word lists, thresholds and weights that define the results.  Changing one changes
what the operators report.
"""

# --- column roles: a name containing one of these is a time column / an identifier
ROLE_TIME_WORDS = ("date", "time", "timestamp", "created", "updated", "modified")
ROLE_ID_WORDS = ("_id", "_key", "_pk", "_fk", "_code", "_num")

# --- column categories
SPARSE_CATEGORY_PCT = 90
HIGH_CARDINALITY_SHARE = 0.95
LOW_CARDINALITY_LIMIT = 50

# --- temporal names
TEMPORAL_TYPE_WORDS = ("date", "time", "timestamp")
TEMPORAL_SUFFIXES = ("_at", "_date", "_ts", "_time", "_timestamp")
RECENCY_WORDS = (
    "updated", "modified", "last_seen", "last_sync", "synced", "loaded", "ingested",
)
EVENT_WORDS = RECENCY_WORDS + ("event", "occurred", "happened", "created")
TEMPORAL_TYPE_POINTS = 4
TEMPORAL_SUFFIX_POINTS = 3
EVENT_WORD_POINTS = 2
RECENCY_WORD_POINTS = 1

# --- type families used to judge whether two columns can join
NUMERIC_FAMILY = (
    "integer", "int", "bigint", "smallint", "tinyint", "real", "float", "double",
    "numeric", "decimal", "number",
)
TEXT_FAMILY = ("text", "varchar", "char", "string", "nvarchar", "nchar")
TEXT_TYPE_WORDS = ("CHAR", "TEXT", "STRING", "VARCHAR")

# --- join candidates: confidence when the type families agree / differ
EXACT_NAME_CONFIDENCE = (0.9, 0.5)
CONVENTION_CONFIDENCE = (0.8, 0.4)

# --- measures whose name contains one of these are averaged, the others summed
AVERAGE_WORDS = ("rate", "pct", "percent", "ratio", "avg", "average", "mean")

# --- quality signals
NULL_SIGNAL_PCT = 20
UNIQUE_SIGNAL_PCT = 1

# --- texts of signals and issues
NULL_SIGNAL = "% null"
ALL_NULL_SIGNAL = "0 distinct values (all null)"
UNIQUE_SIGNAL = "% unique"
INVALID_ISSUE = "%s value(s) not in valid_values (%s allowed)"

# --- texts of a freshness verdict
NO_TEMPORAL_COLUMN = "No temporal columns were detected from schema names or types."
NO_TEMPORAL_VALUE = "Detected temporal columns, but none contained non-null values."
UNREADABLE_TIME = "Latest value in '%s' could not be parsed as a date/time."
NEWEST_VALUE = "Newest value in '%s' is %s day(s) old (threshold: %sd)."

# --- derived facts
VALID_VALUES_CEILING = 20
SPARSE_FACT_PCT = 95.0
TEMPORAL_CONFIDENCE = 0.9
SPARSE_CONFIDENCE = 0.9
VALID_VALUES_CONFIDENCE = 0.8

# --- fields of the fact table
MACHINE_TABLE_FIELDS = ("row_count", "table_comment")
# places that a person fills in
DESCRIPTION_PLACE = "<description>"
TABLE_PLACES = {
    "table_description": "<description>", "data_owner": "<data_owner>",
    "update_frequency": "<update_frequency>", "notes": "",
}
HUMAN_TABLE_FIELDS = ("table_description", "data_owner", "update_frequency", "notes")
MACHINE_COLUMN_FIELDS = (
    "type", "nullable", "primary_key", "distinct_count", "null_count", "null_pct",
    "min_val", "max_val", "min_length", "max_length", "sample_values",
)
HUMAN_COLUMN_FIELDS = ("description", "pii", "valid_values")
SCAN_COLUMN_FIELDS = ("description", "valid_values", "pii", "temporal", "likely_sparse")
IDENTITY_TABLE_FIELDS = (
    "table", "connection", "schema_fingerprint", "schema_version", "columns",
)
REDACTED_FIELDS = ("sample_values", "min_val", "max_val", "valid_values")

# --- completeness score
DESCRIPTION_WEIGHT = 0.5
VALID_VALUES_WEIGHT = 0.3
FRESHNESS_WEIGHT = 0.2
FRESH_DAYS = 7.0
STALE_DAYS = 90.0

# --- lexical search: term weight per field, ranking constants, name and phrase bonus
TABLE_DOC_WEIGHTS = {
    "table_name": 6, "table_description": 5, "data_owner": 3, "update_frequency": 2,
    "table_comment": 2, "notes": 3,
}
COLUMN_DOC_WEIGHTS = {
    "column_name": 6, "table_name": 3, "description": 5, "valid_values": 4, "type": 2,
    "pii": 4,
}
NO_DESCRIPTION = "No table description yet."
GENERAL_MATCH = "General metadata match."
TOKEN_PATTERN = "[a-z0-9]+(?:[-_][a-z0-9]+)?"
JOINED_PATTERN = "[a-z0-9]+[-_][a-z0-9]+"
BM25_K1 = 1.5
BM25_B = 0.75
SAME_NAME_BONUS = 8.0
NAME_CONTAINS_BONUS = 3.0
EXCERPT_CONTAINS_BONUS = 2.0
NAME_TERM_BONUS = 0.8
