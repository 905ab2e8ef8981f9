"""Names, patterns, limits and targets that results must agree with."""

from __future__ import annotations

# --- statement flags, in display order -------------------------------------------------
FLAG_ORDER = ["ERR", "GAP", "LIN", "SELF", "COL", "OK"]

# --- characters removed by a Unicode-aware strip ---------------------------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = r"\s\x1c-\x1f\x85\p{Z}"
WHITESPACE_RUN = f"[{WHITESPACE_CLASS}]+"
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"

LINE_JOIN = (
    r"(?<![\t\x1f\p{Zs}])[\t\x1f\p{Zs}]*+[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
    f"[{WHITESPACE_CLASS}]*+"
)

# --- statement classification by leading keywords --------------------------------------
LEADING_TOKEN_LIMIT = 6
DML_KEYWORDS = ["SELECT", "INSERT", "UPDATE", "DELETE", "MERGE"]
CALL_KEYWORDS = ["CALL", "EXEC", "EXECUTE"]
TABLE_KINDS = ["SET", "MULTISET"]
OBJECTS_BY_VERB = {
    "REPLACE": ["PROCEDURE", "FUNCTION", "TABLE", "VIEW", "MACRO"],
    "CREATE": ["TABLE", "VIEW", "DATABASE", "PROCEDURE", "MACRO", "FUNCTION"],
    "ALTER": ["TABLE", "DATABASE", "PROCEDURE", "FUNCTION"],
    "DROP": ["TABLE", "DATABASE", "VIEW", "PROCEDURE", "MACRO", "FUNCTION"],
    "COLLECT": ["STATISTICS"],
    "BEGIN": ["TRANSACTION"],
}
TABLE_KIND_VERBS = ["REPLACE", "CREATE"]

# --- text limits ------------------------------------------------------------------------
COMPONENT_LIMIT = 128
IDENTIFIER_LIMIT = 200
IDENTIFIER_DIGEST = 8
PREVIEW_LIMIT = 240
PROPERTY_LIMIT = 280
JOB_DESCRIPTION_LIMIT = 512

# --- labels -----------------------------------------------------------------------------
NO_ERROR = "<none>"
UNKNOWN_ERROR = "<unknown>"
EMPTY_PREVIEW = "<empty>"
UNAVAILABLE = "UNAVAILABLE"
PLACEHOLDER_NATIVE_TYPE = "UNKNOWN"

# --- names of the metadata records ------------------------------------------------------
DATASET_URN = "urn:li:dataset:(urn:li:dataPlatform:%s,%s,%s)"
SCHEMA_FIELD_URN = "urn:li:schemaField:(%s,%s)"
FLOW_URN = "urn:li:dataFlow:(%s,%s,%s)"
JOB_URN = "urn:li:dataJob:(%s,%s)"
DATASET_URN_PARTS = r"^urn:li:dataset:\(urn:li:dataPlatform:(.*),(.*),(.*)\)$"
DEFAULT_ORCHESTRATOR = "sqlparser"
DEFAULT_JOB_TYPE = "SQL_PARSER"
DEFAULT_PLATFORM = "teradata"
DEFAULT_ENV = "PROD"

# --- confidence bands (lower bound, label), highest first -------------------------------
CONFIDENCE_BANDS = [(0.9, "high"), (0.7, "medium")]
HIGH_CONFIDENCE = 0.9
MIN_CONFIDENCE = 0.7

# --- targets by test category: name, success %, high-confidence % (None = varies) --------
CATEGORY_TARGETS = [
    ("01-basic", 95.0, 90.0),
    ("02-ctes", 90.0, 85.0),
    ("03-subqueries", 85.0, 80.0),
    ("04-advanced-dml", 75.0, 70.0),
    ("05-stored-procs", 50.0, 40.0),
    ("06-cross-db", 85.0, 80.0),
    ("07-edge-cases", None, None),
    ("08-real-world", 80.0, 75.0),
]
RED_FLAG_BASIC_SUCCESS = 50.0
RED_FLAG_COLUMN_LINEAGE = 30.0
RED_FLAG_CONFIDENCE = 0.7

# --- error classes: id, name, pattern, group; the first that matches wins ----------------
ERROR_CLASSES = [
    (1, "Column Lineage Limitation", r"^Can only generate column-level lineage for select-like inner statements", "Expected Limitations"),
    (2, "Teradata USING Clause", r"(?is)^Invalid expression / Unexpected token\. Line \d+, Col: \d+\.\s*USING\b", "Teradata Dialect"),
    (3, "Teradata LOCKING Clause", r"^Expected SELECT statement after LOCKING clause", "Teradata Dialect"),
    (4, "Abbreviated CREATE TABLE", r"(?is)^Invalid expression.*\bCT\s+\w", "Teradata Dialect"),
    (5, "INSERT VALUES Scope Error", r"^Failed to build scope for statement", "System Limits"),
    (6, "Teradata NAMED Keyword", r"(?is)^Expecting \).*\(\s*NAMED\b", "Teradata Dialect"),
    (7, "Teradata REPLACE PROCEDURE", r"^Required keyword: 'definer' missing", "Teradata Dialect"),
    (8, "Unsupported DDL Syntax", r"^Got unsupported syntax for statement", "Unsupported DDL"),
    (9, "Duplicate Alias", r"^Alias already used|failed to map columns to their source tables", "Configuration"),
    (10, "Schema Nesting Level", r"must match the schema's nesting level", "Configuration"),
    (11, "Expression Type Mismatch", r"^\* is not <class", "System Limits"),
    (12, "Syntax Error (Parentheses)", r"^Expecting \)", "Syntax/Invalid SQL"),
    (13, "Invalid Teradata Syntax", r"(?is)^Invalid expression.*SELECT\s+SESSION\b", "Syntax/Invalid SQL"),
    (14, "Invalid MODIFY USER", r"(?is)^Invalid expression.*MODIFY\s+USER\b", "Syntax/Invalid SQL"),
]
UNCLASSIFIED = (0, "Unclassified", "Unclassified")
#: Literal texts, by class, one of which every message of the class holds.
ERROR_ANCHORS = {
    1: ["column-level lineage"], 2: ["USING"], 3: ["LOCKING clause"], 4: ["Invalid expression"],
    5: ["Failed to build scope"], 6: ["NAMED"], 7: ["definer"], 8: ["unsupported syntax"],
    9: ["Alias already used", "failed to map columns to their source tables"], 10: ["nesting level"],
    11: ["is not <class"], 12: ["Expecting )"], 13: ["SESSION"], 14: ["MODIFY"],
}

# --- message prefixes by the layer that raises them --------------------------------------
LINEAGE_LAYER_PATTERN = (
    r"^Can only generate column-level lineage|^Failed to build scope"
    r"|failed to map columns to their source tables|must match the schema's nesting level"
)
PARSER_LAYER_PATTERN = (
    r"^Invalid expression / Unexpected token|^Expecting \)|^Required keyword:|^\* is not <class"
    r"|^Got unsupported syntax|^Expected SELECT statement after LOCKING"
)

# --- statement types that cannot carry column lineage -------------------------------------
NO_COLUMN_LINEAGE_TYPES = [
    "DATABASE", "USE", "DELETE", "LOCKING", "DROP", "DROP_TABLE", "DROP_VIEW", "DROP_DATABASE",
    "DROP_PROCEDURE", "DROP_MACRO", "DROP_FUNCTION", "ALTER_TABLE", "ALTER_DATABASE",
    "ALTER_PROCEDURE", "ALTER_FUNCTION", "CREATE_TABLE", "CREATE_DATABASE", "CREATE_DDL",
]

# --- dialect rewrites: pattern, replacement ------------------------------------------------
REWRITE_USING = (r"(?is)USING\s+[^;]+?\s+(SELECT|INSERT|UPDATE|DELETE|WITH)", "$1")
REWRITE_CT = (r"(?i)\bCT\b", "CREATE TABLE")
REWRITE_LOCKING = (r"(?i)LOCKING\s+TABLE\s+[\w.]+\s+FOR\s+(ACCESS|WRITE|READ)\s+", "")
REWRITE_NAMED = (r"(?i)\(\s*NAMED\s+(\w+)\s*\)", "AS $1")
PLACEHOLDER = r"\{\{[^}]*\}\}|\$\{[^}]*\}|\?|:[A-Za-z_]\w*|@[A-Za-z_]\w*"
