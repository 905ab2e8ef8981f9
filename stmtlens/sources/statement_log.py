"""A statement log derived from the events table: scripts with the parser's answers.

Twelve templates, one per event in turn, cover the classification and lineage rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlens.functions.text import file_stem, type_label
from stmtlens.functions.urns import dataset_urn
from stmtlens.operators.statements import split_statements, with_outcome_columns
from stmtlens.session import spread
from stmtlens.sources.tables import parquet_table

SCRIPT_TEXT = r"""
CASE event_id % 12
 WHEN 0 THEN concat('SELECT a, b FROM db.s.t', user_id, ' WHERE a > ', event_id)
 WHEN 1 THEN concat('-- load ', event_type, '\nINSERT INTO db.s.', event_type, ' (a, b) SELECT a, b FROM db.s.t', user_id)
 WHEN 2 THEN concat('CREATE TABLE db.s.', event_type, '_copy AS (SELECT s.a FROM db.s.t', user_id, ' s INNER JOIN db.s.orders o ON s.a = o.a) WITH DATA')
 WHEN 3 THEN concat('UPDATE db.s.', event_type, ' FROM db.s.t', user_id, ' x SET a = x.a WHERE b = x.b')
 WHEN 4 THEN concat('DELETE FROM db.s.', event_type, ' WHERE a IN (SELECT a FROM db.s.t', user_id, ')')
 WHEN 5 THEN concat('MERGE INTO db.s.', event_type, ' USING db.s.t', user_id, ' ON 1 = 1 WHEN MATCHED THEN UPDATE SET a = 1')
 WHEN 6 THEN concat('WITH c AS (SELECT a FROM db.s.t', user_id, ') INSERT INTO db.s.', event_type, ' SELECT a FROM c')
 WHEN 7 THEN concat('LOCKING TABLE db.s.t', user_id, ' FOR ACCESS SELECT a FROM db.s.t', user_id)
 WHEN 8 THEN concat('USING p (INTEGER) UPDATE db.s.', event_type, ' SET a = 1')
 WHEN 9 THEN concat('CREATE MULTISET TABLE db.s.', event_type, ' (a INTEGER)')
 WHEN 10 THEN concat('DATABASE ', event_type)
 ELSE '/* two\nlines */ SEL 1 # tail\n; END; ; ' END"""

# The parser's type label, error and remote error by template; NULL where there is none.
REPORTED_TYPE = """
CASE event_id % 12 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'QueryType.INSERT'
 WHEN 2 THEN 'create-table as/select' WHEN 3 THEN 'UPDATE' WHEN 4 THEN 'DELETE' WHEN 5 THEN 'MERGE'
 WHEN 6 THEN 'UNKNOWN' WHEN 8 THEN 'UNKNOWN' WHEN 9 THEN 'CREATE_DDL' END"""
PARSER_ERROR = """
CASE event_id % 12
 WHEN 4 THEN 'Can only generate column-level lineage for select-like inner statements, not <class X.Delete>'
 WHEN 7 THEN 'Expected SELECT statement after LOCKING clause. Line 1, Col: 5.'
 WHEN 8 THEN 'Invalid expression / Unexpected token. Line 1, Col: 5.' END"""
RPC_ERROR = "CASE WHEN event_id % 12 = 10 THEN 'HTTPError: 401 Unauthorized' END"

# A message of every class of errors in turn, one of a class of its own, one of none, and no message.
ERROR_TEXT = r"""
CASE script_id % 18
 WHEN 1 THEN concat('Can only generate column-level lineage for select-like inner statements, not <class ', event_type, '>')
 WHEN 2 THEN concat('Invalid expression / Unexpected token. Line 1, Col: ', user_id, '. using p (INTEGER)')
 WHEN 3 THEN 'Expected SELECT statement after LOCKING clause. Line 1, Col: 5.'
 WHEN 4 THEN concat('Invalid expression / Unexpected token. Line 2, Col: ', user_id, '.
 ct ', event_type)
 WHEN 5 THEN concat('Failed to build scope for statement ', user_id)
 WHEN 6 THEN concat('Expecting ). Line 1, Col: 9. SELECT a (NAMED ', event_type, ')')
 WHEN 7 THEN 'Required keyword: ''definer'' missing for <class Procedure>'
 WHEN 8 THEN concat('Got unsupported syntax for statement: ', event_type)
 WHEN 9 THEN 'Alias already used: a'
 WHEN 10 THEN concat('Table ', event_type, ' must match the schema''s nesting level: 3')
 WHEN 11 THEN '* is not <class Column>'
 WHEN 12 THEN concat('Expecting ). Line ', user_id)
 WHEN 13 THEN concat('Invalid expression / Unexpected token. Line 1, Col: ', user_id, '. select session')
 WHEN 14 THEN 'Invalid expression / Unexpected token. Line 1, Col: 1. MODIFY USER u'
 WHEN 15 THEN concat('Script has too many statements: ', user_id)
 WHEN 16 THEN concat('disk of ', event_type, ' is full')
 WHEN 17 THEN concat('failed to map columns to their source tables in ', event_type) END"""

# Test category by template, so that every category of the target table occurs.
CATEGORY = """
CASE event_id % 12 WHEN 0 THEN '01-basic' WHEN 1 THEN '01-basic' WHEN 2 THEN '04-advanced-dml'
 WHEN 3 THEN '04-advanced-dml' WHEN 4 THEN '03-subqueries' WHEN 5 THEN '04-advanced-dml'
 WHEN 6 THEN '02-ctes' WHEN 7 THEN '07-edge-cases' WHEN 8 THEN '05-stored-procs'
 WHEN 9 THEN '01-basic' WHEN 10 THEN '06-cross-db' ELSE '08-real-world' END"""


def scripts(spark: SparkSession, folder: str) -> DataFrame:
    """One script per event, with the parser's answer on the same row."""
    events = spread(
        parquet_table(spark, folder, "events").select(
            "event_id", "ts", "user_id", "event_type", "value"
        )
    )
    return events.selectExpr(
        "event_id AS script_id",
        "event_id % 12 AS template",
        "concat('queries/', event_type, '/u', user_id, '.sql') AS source_path",
        f"concat('suite/', {CATEGORY}, '/s', event_id, '.sql') AS test_path",
        "date_format(ts, 'yyyy-MM-dd') AS run_id",
        "user_id",
        "event_type",
        "value AS timing_ms",
        "CAST(event_id % 11 AS DOUBLE) / 10 AS confidence",
        f"{SCRIPT_TEXT} AS script_text",
        f"{REPORTED_TYPE} AS parser_type_raw",
        f"{PARSER_ERROR} AS parser_error",
        f"{RPC_ERROR} AS rpc_error",
    )


def statements(spark: SparkSession, folder: str) -> DataFrame:
    """The scripts, split; the parser's answer belongs to the first statement of a script."""
    answer = ["confidence", "parser_type_raw", "parser_error", "rpc_error", "timing_ms"]
    return split_statements(scripts(spark, folder)).selectExpr(
        "concat(source_path, '#', script_id, ':', stmt_index) AS identifier",
        "query_text",
        "'file' AS origin",
        "concat(source_path, '#', script_id, ' (statement ', stmt_index, ')') AS context",
        "source_path", "script_id", "stmt_index", "template", "test_path", "run_id", "user_id",
        "event_type",
        *[f"CASE WHEN stmt_index = 1 THEN {c} END AS {c}" for c in answer],
    )


NAMES = {
    "_source": "concat('db.s.t', user_id)",
    "_target": "concat('db.s.', event_type)",
    "_copy": "concat('db.s.', event_type, '_copy')",
}
NO_NAMES = "CAST(array() AS ARRAY<STRING>)"
UPSTREAMS = f"""
CASE WHEN stmt_index > 1 THEN {NO_NAMES} WHEN template IN (0, 1, 4, 5, 6) THEN array(_source)
 WHEN template = 2 THEN array(_source, _orders) WHEN template = 3 THEN array(_target, _source)
 ELSE {NO_NAMES} END"""
DOWNSTREAMS = f"""
CASE WHEN stmt_index > 1 THEN {NO_NAMES} WHEN template IN (1, 3, 4, 5, 6, 9) THEN array(_target)
 WHEN template = 2 THEN array(_copy) ELSE {NO_NAMES} END"""


def _entry(source: str, target: str, column: str) -> str:
    """SQL of one lineage entry: ``target.column`` is a copy of ``source.column``."""
    no_text = "CAST(NULL AS STRING)"
    return (
        f"named_struct('downstream', named_struct('table', {target}, 'column', '{column}',"
        f" 'column_type', {no_text}, 'native_column_type', {no_text}),"
        f" 'upstreams', array(named_struct('table', {source}, 'column', '{column}')),"
        f" 'logic', named_struct('is_direct_copy', true, 'column_logic', '{column}'))"
    )


NOWHERE = "CAST(NULL AS STRING)"
LINEAGE = f"""
CASE WHEN stmt_index > 1 THEN array()
 WHEN template = 0 THEN array({_entry('_source', NOWHERE, 'a')}, {_entry('_source', NOWHERE, 'b')})
 WHEN template = 1 THEN array({_entry('_source', '_target', 'a')}, {_entry('_source', '_target', 'b')})
 WHEN template = 2 THEN array({_entry('_source', '_copy', 'a')})
 WHEN template = 3 THEN array({_entry('_source', '_target', 'a')}, {_entry('_target', '_target', 'a')})
 WHEN template = 6 THEN array({_entry('_source', '_target', 'a')})
 ELSE array() END"""


def with_answers(split: DataFrame) -> DataFrame:
    """Add the lineage lists the parser gives for each template."""
    named = split.withColumns(
        {
            **{name: dataset_urn(F.expr(sql)) for name, sql in NAMES.items()},
            "_orders": dataset_urn(F.lit("db.s.orders")),
        }
    )
    return named.withColumns(
        {
            "upstreams": F.expr(UPSTREAMS),
            "downstreams": F.expr(DOWNSTREAMS),
            "column_lineage": F.expr(LINEAGE),
        }
    ).drop(*NAMES, "_orders")


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of the log. The answers are on the script's own row, so no join is needed."""
    answered = with_answers(statements(spark, folder)).withColumns(
        {
            "parser_statement_type": type_label(F.col("parser_type_raw")),
            "raw_query_type": F.col("parser_type_raw"),
            "query_fingerprint": F.lit(None).cast("string"),
        }
    )
    return with_outcome_columns(answered)


def payload_table(
    spark: SparkSession, folder: str, identifier: Column | None = None
) -> DataFrame:
    """The same answers as a separate table in the payload schema."""
    answered = with_answers(statements(spark, folder))
    if identifier is not None:
        answered = answered.withColumn("identifier", identifier)
    text = F.lit(None).cast("string")
    return answered.select(
        "identifier",
        text.alias("queryType"),
        F.col("parser_type_raw").alias("query_type"),
        text.alias("query_fingerprint"),
        F.col("upstreams").alias("in_tables"),
        F.when(F.size("downstreams") > 0, F.col("downstreams")).alias("out_tables"),
        F.when(F.size("column_lineage") > 0, F.col("column_lineage")).alias("column_lineage"),
        F.struct(
            F.col("confidence").alias("confidence"),
            F.lit(None).cast("boolean").alias("table_error"),
            F.col("parser_error").alias("error"),
            text.alias("generalized_statement"),
        ).alias("debug_info"),
        "timing_ms",
        F.col("rpc_error").alias("error"),
    )


def expected_documents(outcome_rows: DataFrame) -> DataFrame:
    """``query_id, document``: the JSON text of each script's expected results.

    They differ from the answers: some are empty, some name one table more. Scripts of template 10
    have none; those of template 11 are an array of two, as they have two statements.
    """
    nothing = F.array().cast("array<string>")
    kept = F.col("script_id") % 5 != 0
    extra = F.when(
        F.col("script_id") % 7 == 0, F.array(dataset_urn(F.lit("db.s.extra")))
    ).otherwise(nothing)
    one = F.to_json(
        F.struct(
            F.concat(F.when(kept, F.col("upstreams")).otherwise(nothing), extra).alias("in_tables"),
            F.when(kept, F.col("downstreams")).alias("out_tables"),
            F.when(kept, F.col("column_lineage")).alias("column_lineage"),
        )
    )
    both = F.concat(F.lit("["), one, F.lit(","), one, F.lit("]"))
    return outcome_rows.where((F.col("template") != 10) & (F.col("stmt_index") == 1)).select(
        file_stem(F.col("test_path")).alias("query_id"),
        F.when(F.col("template") == 11, both).otherwise(one).alias("document"),
    )


def known_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue knows the source tables of the users with an even number."""
    return (
        parquet_table(spark, folder, "events")
        .where(F.col("user_id") % 2 == 0)
        .select(dataset_urn(F.concat(F.lit("db.s.t"), F.col("user_id").cast("string"))).alias("urn"))
        .distinct()
    )
