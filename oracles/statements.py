"""Oracle SQL of the statement, lineage, metadata, report and analysis queries.

Where a result follows from the script template, the SQL states it per template instead of repeating
the text rule.
"""

from __future__ import annotations

URN = "'urn:li:dataset:(urn:li:dataPlatform:teradata,'"
STRIP = "chr(32) || chr(9) || chr(10) || chr(13)"

SCRIPTS = """
SELECT event_id AS script_id, event_id % 12 AS template, user_id, event_type,
 concat('queries/', event_type, '/u', CAST(user_id AS VARCHAR), '.sql') AS source_path, value AS timing_ms,
 CAST((event_id % 11) AS DOUBLE) / 10 AS confidence, strftime(ts, '%Y-%m-%d') AS run_id,
 ['01-basic','01-basic','04-advanced-dml','04-advanced-dml','03-subqueries','04-advanced-dml','02-ctes','07-edge-cases','05-stored-procs','01-basic','06-cross-db','08-real-world'][event_id % 12 + 1] AS category,
 CASE event_id % 12
  WHEN 0 THEN concat('SELECT a, b FROM db.s.t', CAST(user_id AS VARCHAR), ' WHERE a > ', CAST(event_id AS VARCHAR))
  WHEN 1 THEN concat('-- load ', event_type, chr(10), 'INSERT INTO db.s.', event_type, ' (a, b) SELECT a, b FROM db.s.t', CAST(user_id AS VARCHAR))
  WHEN 2 THEN concat('CREATE TABLE db.s.', event_type, '_copy AS (SELECT s.a FROM db.s.t', CAST(user_id AS VARCHAR), ' s INNER JOIN db.s.orders o ON s.a = o.a) WITH DATA')
  WHEN 3 THEN concat('UPDATE db.s.', event_type, ' FROM db.s.t', CAST(user_id AS VARCHAR), ' x SET a = x.a WHERE b = x.b')
  WHEN 4 THEN concat('DELETE FROM db.s.', event_type, ' WHERE a IN (SELECT a FROM db.s.t', CAST(user_id AS VARCHAR), ')')
  WHEN 5 THEN concat('MERGE INTO db.s.', event_type, ' USING db.s.t', CAST(user_id AS VARCHAR), ' ON 1 = 1 WHEN MATCHED THEN UPDATE SET a = 1')
  WHEN 6 THEN concat('WITH c AS (SELECT a FROM db.s.t', CAST(user_id AS VARCHAR), ') INSERT INTO db.s.', event_type, ' SELECT a FROM c')
  WHEN 7 THEN concat('LOCKING TABLE db.s.t', CAST(user_id AS VARCHAR), ' FOR ACCESS SELECT a FROM db.s.t', CAST(user_id AS VARCHAR))
  WHEN 8 THEN concat('USING p (INTEGER) UPDATE db.s.', event_type, ' SET a = 1')
  WHEN 9 THEN concat('CREATE MULTISET TABLE db.s.', event_type, ' (a INTEGER)')
  WHEN 10 THEN concat('DATABASE ', event_type)
  ELSE concat('/* two', chr(10), 'lines */ SEL 1 # tail', chr(10), '; END; ; ') END AS script_text,
 CASE event_id % 12 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'QueryType.INSERT' WHEN 2 THEN 'create-table as/select' WHEN 3 THEN 'UPDATE' WHEN 4 THEN 'DELETE' WHEN 5 THEN 'MERGE' WHEN 6 THEN 'UNKNOWN' WHEN 8 THEN 'UNKNOWN' WHEN 9 THEN 'CREATE_DDL' ELSE NULL END AS parser_type_raw,
 CASE event_id % 12 WHEN 4 THEN 'Can only generate column-level lineage for select-like inner statements, not <class X.Delete>' WHEN 7 THEN 'Expected SELECT statement after LOCKING clause. Line 1, Col: 5.' WHEN 8 THEN 'Invalid expression / Unexpected token. Line 1, Col: 5.' ELSE NULL END AS parser_error,
 CASE WHEN event_id % 12 = 10 THEN 'HTTPError: 401 Unauthorized' ELSE NULL END AS rpc_error
FROM events"""

SPLIT = f"""
SELECT script_id, template, user_id, event_type, category, run_id, source_path,
 CAST(unnest(range(1, len(parts) + 1)) AS BIGINT) AS stmt_index, unnest(parts) AS query_text,
 confidence AS c0, timing_ms AS t0, parser_type_raw AS p0, parser_error AS e0, rpc_error AS r0
FROM (SELECT *, list_filter(list_transform(string_split(script_text, ';'), lambda s: trim(s, {STRIP})), lambda s: s <> '') AS parts FROM scripts)"""

# k is the template of a first statement, -1 otherwise; T, E, EC and O are dataset URNs.
NAMED = f"""
SELECT script_id, template, user_id, event_type, category, run_id, source_path, stmt_index, query_text,
 concat(source_path, '#', script_id, ':', stmt_index) AS identifier,
 concat(source_path, '#', script_id, ' (statement ', stmt_index, ')') AS context,
 CASE WHEN stmt_index = 1 THEN template ELSE -1 END AS k,
 CASE WHEN stmt_index = 1 THEN c0 END AS confidence, CASE WHEN stmt_index = 1 THEN t0 ELSE 0 END AS timing_ms,
 CASE WHEN stmt_index = 1 THEN p0 END AS parser_type_raw, CASE WHEN stmt_index = 1 THEN e0 END AS parser_error,
 CASE WHEN stmt_index = 1 THEN r0 END AS rpc_error,
 concat({URN}, 'db.s.t', user_id, ',PROD)') AS T, concat({URN}, 'db.s.', event_type, ',PROD)') AS E,
 concat({URN}, 'db.s.', event_type, '_copy,PROD)') AS EC, concat({URN}, 'db.s.orders,PROD)') AS O,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(query_text, '(?s)/\\*.*?\\*/', ' ', 'g'), '--[^\\n]*', ' ', 'g'), '//[^\\n]*', ' ', 'g'), '#[^\\n]*', ' ', 'g'), {STRIP}) AS clean_text
FROM split"""

TYPED = """
SELECT *, CASE k WHEN 0 THEN 'SELECT' WHEN 1 THEN 'INSERT' WHEN 2 THEN 'CREATE_TABLE' WHEN 3 THEN 'UPDATE' WHEN 4 THEN 'DELETE' WHEN 5 THEN 'MERGE'
   WHEN 6 THEN 'SELECT' WHEN 7 THEN 'LOCKING' WHEN 8 THEN 'USING' WHEN 9 THEN 'CREATE_TABLE' WHEN 10 THEN 'DATABASE' WHEN 11 THEN 'SELECT' ELSE 'END' END AS inferred,
 CASE k WHEN 0 THEN 'SELECT' WHEN 1 THEN 'INSERT' WHEN 2 THEN 'CREATE_TABLE_AS_SELECT' WHEN 3 THEN 'UPDATE' WHEN 4 THEN 'DELETE' WHEN 5 THEN 'MERGE'
   WHEN 6 THEN 'UNKNOWN' WHEN 8 THEN 'UNKNOWN' WHEN 9 THEN 'CREATE_DDL' END AS label,
 CASE WHEN k = 0 THEN [T] WHEN k = 1 THEN [T] WHEN k = 2 THEN [T, O] WHEN k = 3 THEN [E, T] WHEN k IN (4, 5, 6) THEN [T] ELSE CAST([] AS VARCHAR[]) END AS ups,
 CASE WHEN k IN (1, 3, 4, 5, 6, 9) THEN [E] WHEN k = 2 THEN [EC] ELSE CAST([] AS VARCHAR[]) END AS downs,
 CASE WHEN k = 1 THEN [T || '.a -> ' || E || '.a', T || '.b -> ' || E || '.b'] WHEN k = 2 THEN [T || '.a -> ' || EC || '.a']
   WHEN k = 3 THEN [T || '.a -> ' || E || '.a', E || '.a -> ' || E || '.a'] WHEN k = 6 THEN [T || '.a -> ' || E || '.a'] ELSE CAST([] AS VARCHAR[]) END AS edges,
 CASE k WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 6 THEN 1 ELSE 0 END AS n_lineage,
 k = 3 AS self_ref, rpc_error IS NULL AND parser_error IS NULL AS ok
FROM named"""

OUTCOMES = """
SELECT *, CASE WHEN label IS NOT NULL AND label <> 'UNKNOWN' THEN label ELSE inferred END AS statement_type,
 CASE WHEN label IS NOT NULL AND label <> 'UNKNOWN' THEN 'parser' ELSE 'fallback' END AS statement_type_source,
 CASE k WHEN 0 THEN ['GAP', 'COL'] WHEN 1 THEN ['LIN', 'COL'] WHEN 2 THEN ['LIN', 'COL'] WHEN 3 THEN ['SELF', 'COL'] WHEN 4 THEN ['ERR', 'LIN']
   WHEN 5 THEN ['LIN'] WHEN 6 THEN ['LIN', 'COL'] WHEN 7 THEN ['ERR'] WHEN 8 THEN ['ERR'] WHEN 9 THEN ['GAP'] WHEN 10 THEN ['ERR'] ELSE ['OK'] END AS flags,
 CASE k WHEN 4 THEN 'Can only generate column-level lineage for select-like inner statements, not'
   WHEN 7 THEN 'Expected SELECT statement after LOCKING clause' WHEN 8 THEN 'Invalid expression / Unexpected token' ELSE '<none>' END AS error_class
FROM typed"""

# Column mentions (dataset, column), NULL for a bare dataset.
MENTIONS = """
SELECT DISTINCT dataset, col FROM (
 SELECT unnest(list_concat(ups, downs)) AS dataset, NULL AS col FROM outcomes
 UNION ALL SELECT T, 'a' FROM outcomes WHERE k IN (0, 1, 2, 3, 6) UNION ALL SELECT T, 'b' FROM outcomes WHERE k IN (0, 1)
 UNION ALL SELECT E, 'a' FROM outcomes WHERE k IN (1, 3, 6) UNION ALL SELECT E, 'b' FROM outcomes WHERE k = 1
 UNION ALL SELECT EC, 'a' FROM outcomes WHERE k = 2)"""

FLOW = "concat('urn:li:dataFlow:(sqlparser,nightly_', event_type, '/u', user_id, '.sql,PROD)')"
RECORDS = f"""
SELECT *, {FLOW} AS flow_urn,
 concat('urn:li:dataJob:(', {FLOW}, ',', source_path, '_', script_id, ':', stmt_index, ')') AS job_urn
FROM outcomes WHERE len(downs) > 0"""

CHECKED = f"""
SELECT *, list_distinct(list_concat(ups, downs)) AS act, list_distinct(edges) AS act_e,
 CASE WHEN template = 10 THEN NULL ELSE list_distinct(list_concat(CASE WHEN script_id % 5 <> 0 THEN list_concat(ups, downs) ELSE [] END,
   CASE WHEN script_id % 7 = 0 THEN [concat({URN}, 'db.s.extra,PROD)')] ELSE [] END)) END AS exp,
 CASE WHEN template = 10 THEN NULL WHEN script_id % 5 <> 0 THEN list_distinct(edges) ELSE CAST([] AS VARCHAR[]) END AS exp_e
FROM outcomes"""

VALIDATED = """
SELECT *,
 CASE WHEN len(act) > 0 THEN CAST(len(list_filter(act, lambda x: list_contains(exp, x))) AS DOUBLE) / len(act) END AS tp0,
 CASE WHEN len(exp) > 0 THEN CAST(len(list_filter(exp, lambda x: list_contains(act, x))) AS DOUBLE) / len(exp) END AS tr0,
 CASE WHEN len(act_e) > 0 THEN CAST(len(list_filter(act_e, lambda x: list_contains(exp_e, x))) AS DOUBLE) / len(act_e) END AS cp0,
 CASE WHEN len(exp_e) > 0 THEN CAST(len(list_filter(exp_e, lambda x: list_contains(act_e, x))) AS DOUBLE) / len(exp_e) END AS cr0,
 list_sort(list_filter(exp, lambda x: NOT list_contains(act, x))) AS tm, list_sort(list_filter(act, lambda x: NOT list_contains(exp, x))) AS tx,
 list_sort(list_filter(exp_e, lambda x: NOT list_contains(act_e, x))) AS cm, list_sort(list_filter(act_e, lambda x: NOT list_contains(exp_e, x))) AS cx
FROM checked"""

JUDGED = """
SELECT * REPLACE (CASE WHEN exp IS NULL THEN NULL ELSE tm END AS tm, CASE WHEN exp IS NULL THEN NULL ELSE tx END AS tx,
  CASE WHEN exp IS NULL THEN NULL ELSE cm END AS cm, CASE WHEN exp IS NULL THEN NULL ELSE cx END AS cx),
 CASE WHEN exp IS NOT NULL THEN tp0 END AS tp, CASE WHEN exp IS NOT NULL THEN tr0 END AS tr,
 CASE WHEN exp IS NOT NULL THEN cp0 END AS cp, CASE WHEN exp IS NOT NULL THEN cr0 END AS cr,
 CASE WHEN exp IS NULL THEN 'no_expectation' WHEN len(tm) + len(tx) + len(cm) + len(cx) = 0 THEN 'match' ELSE 'mismatch' END AS status
FROM validated"""

SHAPE = """
SELECT *, CAST(CASE WHEN k = 6 THEN 1 ELSE 0 END AS BIGINT) AS cte_count, CAST(CASE WHEN k = 6 THEN 1 ELSE 0 END AS BIGINT) AS max_cte_depth,
 CAST(CASE WHEN k IN (2, 4) THEN 1 ELSE 0 END AS BIGINT) AS subquery_count, CAST(CASE WHEN k = 2 THEN 1 ELSE 0 END AS BIGINT) AS join_count,
 CAST(0 AS BIGINT) AS union_count, CAST(0 AS BIGINT) AS window_function_count,
 CAST(CASE WHEN k IN (1, 11) THEN 2 ELSE 1 END AS BIGINT) AS line_count, CAST(length(query_text) AS BIGINT) AS char_count
FROM judged"""

# The file of each statement, its number there, and the CSV record of its script (the header is 1).
PLACED = """
SELECT *, concat('batch=', script_id // 1000, '/part') AS file,
 row_number() OVER (PARTITION BY script_id // 1000 ORDER BY script_id, stmt_index) AS n,
 dense_rank() OVER (PARTITION BY script_id // 1000 ORDER BY script_id) + 1 AS r
FROM outcomes"""

CHAIN = [
    ("scripts", SCRIPTS), ("split", SPLIT), ("named", NAMED), ("typed", TYPED),
    ("outcomes", OUTCOMES), ("mentions", MENTIONS), ("records", RECORDS), ("checked", CHECKED),
    ("validated", VALIDATED), ("judged", JUDGED), ("shape", SHAPE),
    ("placed", PLACED),
]
WITH = "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in CHAIN)


def q(body: str) -> str:
    return f"{WITH}\n{body}"


def joined(values: str) -> str:
    return f"array_to_string({values}, ',')"


def listed(values: str) -> str:
    return f"array_to_string(list_sort({values}), ',')"


def has(flag: str) -> str:
    return f"COUNT(*) FILTER (list_contains(flags, '{flag}'))"


TOTAL_MS = "CAST(SUM(CAST(timing_ms AS DECIMAL(20,6))) AS DOUBLE)"
OVERVIEW = f"""COUNT(*) AS query_count, COUNT(*) FILTER (ok) AS success_count,
 COUNT(parser_error) AS parser_error_count, COUNT(rpc_error) AS rpc_error_count, {has('ERR')} AS error_count,
 {has('LIN')} AS lineage_count, {has('GAP')} AS gap_lineage_count, {has('SELF')} AS self_referential_count,
 {has('COL')} AS column_lineage_count, {TOTAL_MS} AS timing_ms_total"""
PREFIX = "array_to_string(list_transform({}, lambda f: '[' || f || ']'), '')"
FLAG_ORDER = "['ERR', 'GAP', 'LIN', 'SELF', 'COL', 'OK']"
SOURCE_FLAGS = (
    "list_filter(['ERR', 'GAP', 'LIN', 'SELF', 'COL'], lambda f: list_contains(flatten(list(flags)), f))"
)
SOURCE_PREFIX = f"coalesce(nullif({PREFIX.format(SOURCE_FLAGS)}, ''), '[OK]')"
RATES = f"""COUNT(*) AS total_queries, COUNT(*) FILTER (ok) AS success_count,
 round(COUNT(*) FILTER (ok) * CAST(100 AS DOUBLE) / COUNT(*), 6) AS success_rate,
 round(COUNT(*) FILTER (confidence >= 0.9) * CAST(100 AS DOUBLE) / COUNT(*), 6) AS high_confidence_rate,
 round(COUNT(*) FILTER (n_lineage > 0) * CAST(100 AS DOUBLE) / COUNT(*), 6) AS column_lineage_rate,
 round(CAST(SUM(CAST(confidence AS DECIMAL(12,6))) AS DOUBLE) / COUNT(confidence), 6) AS avg_confidence"""


def with_totals(label: str, expression: str) -> str:
    return q(
        f"""SELECT c.statement_type, c.{label}, c.count, t.type_total FROM
        (SELECT statement_type, {expression} AS {label}, COUNT(*) AS count FROM outcomes GROUP BY ALL) c
        JOIN (SELECT statement_type, COUNT(*) AS type_total FROM outcomes GROUP BY statement_type) t USING (statement_type)"""
    )


def cut(text: str, limit: int) -> str:
    return f"CASE WHEN length({text}) <= {limit} THEN {text} ELSE left({text}, {limit - 1}) || '…' END"


def one_line(text: str) -> str:
    """Text without line breaks: the lines joined by one space."""
    return (
        f"array_to_string(list_filter(list_transform(string_split({text}, chr(10)), lambda s: trim(s, {STRIP})), lambda s: s <> ''), ' ')"
    )


def squeezed(text: str) -> str:
    return f"regexp_replace(trim({text}, {STRIP}), '\\s+', ' ', 'g')"


def identifier_of(text: str) -> str:
    cleaned = f"trim(regexp_replace(regexp_replace(trim({text}, {STRIP}), '[^A-Za-z0-9_.:/\\\\-]+', '_', 'g'), '_+', '_', 'g'), '_')"
    return f"(SELECT lower(CASE WHEN length(x) <= 200 THEN x ELSE left(x, 191) || '_' || left(sha1(x), 8) END) FROM (SELECT {cleaned} AS x))"


USING_TEXT = "'USING p (INTEGER), q (CHAR(4))' || chr(10) || query_text"
def report(key: str) -> str:
    none = "CAST(NULL AS BIGINT)"
    return q(
        f"""SELECT {key} AS source_path, 'summary' AS section, {SOURCE_PREFIX} AS label, COUNT(*) AS n, COUNT(*) FILTER (ok) AS ok, round({TOTAL_MS}, 6) AS ms FROM outcomes GROUP BY {key}
        UNION ALL SELECT {key}, 'error', error_class, COUNT(*), {none}, NULL FROM outcomes GROUP BY {key}, error_class
        UNION ALL SELECT {key}, 'type', statement_type, COUNT(*), COUNT(*) FILTER (ok), round(quantile_cont(timing_ms, 0.95), 6) FROM outcomes GROUP BY {key}, statement_type
        UNION ALL SELECT {key}, 'query', identifier, len(flags), CAST(ok AS BIGINT), round(timing_ms, 6) FROM outcomes"""
    )


def dialect(expression: str) -> str:
    return q(f"SELECT identifier, {expression} AS rewritten FROM named")


def fixed(number: str, digits: int) -> str:
    """Text with fixed decimals, ties to even, from the value at six decimals."""
    units = f"CAST(round({number}, 6) AS DECIMAL(26,6)) * {10 ** digits}"
    whole = f"floor({units})"
    rest = f"({units} - {whole})"
    rounded = f"CASE WHEN {rest} > 0.5 OR ({rest} = 0.5 AND {whole} % 2 = 1) THEN {whole} + 1 ELSE {whole} END"
    return f"CAST(CAST(CAST({rounded} AS DECIMAL(26,6)) / {10 ** digits} AS DECIMAL(26,{digits})) AS VARCHAR)"


def band(column: str) -> str:
    return f"CASE WHEN {column} = 0 THEN '0' WHEN {column} = 1 THEN '1' WHEN {column} <= 3 THEN '2-3' ELSE '4+' END"


JOB_PROPERTIES = f"""concat('sqlParserConfidence=', printf('%.6f', confidence), '|sqlParserQueryIdentifier=', identifier,
 '|sqlParserQueryPreview=', {cut(one_line('query_text'), 240)}, '|sqlParserQueryType=', parser_type_raw, '|sqlParserSource=', source_path)"""

FIELD = "'urn:li:schemaField:(' || {} || ',{})'"
FINE = " UNION ALL ".join(
    f"""SELECT identifier, job_urn, {target} AS downstream_dataset, {FIELD.format(target, c)} AS downstream_field,
 {FIELD.format('T', c)} AS upstream_fields, nullif(confidence, 0) AS confidence_score, '{c}' AS transform_operation FROM records WHERE {where}"""
    for target, c, where in [("E", "a", "k IN (1, 3, 6)"), ("E", "b", "k = 1"), ("EC", "a", "k = 2")]
)

NO_COLUMNS = "('DATABASE', 'DELETE', 'LOCKING', 'CREATE_TABLE', 'CREATE_DDL')"

FROM_FILES = """SELECT {ordinal} AS input_ordinal, 'file' AS origin, concat(file, ':', n) AS identifier,
 concat(file, ' (statement ', n, ')') AS context, file AS source_path, CAST(NULL AS BIGINT) AS row_number,
 n AS stmt_index, query_text FROM placed"""
FROM_CSV = """SELECT {ordinal} AS input_ordinal, 'csv' AS origin, concat(file, ':row', r, ':stmt', stmt_index) AS identifier,
 concat(file, ' row ', r, ' column ''sql_text'' (statement ', stmt_index, ')') AS context, file AS source_path,
 r AS row_number, stmt_index, query_text FROM placed"""
FILE_FLOW = "concat('urn:li:dataFlow:(sqlparser,nightly_', replace(file, '=', '_'), ',PROD)')"
FILE_JOB = f"concat('urn:li:dataJob:(', {FILE_FLOW}, ',', replace(file, '=', '_'), ':', n, ')')"

SQL = {
    # sources
    "src_sql_file": q(FROM_FILES.format(ordinal=0)),
    "src_sql_dir": q(FROM_FILES.format(ordinal=0)),
    "src_csv_column": q(FROM_CSV.format(ordinal=0)),
    "src_csv_dir": q(FROM_CSV.format(ordinal=0)),
    "src_csv_headers": q(FROM_CSV.format(ordinal=0)),
    "src_union_inputs": q(
        " UNION ALL ".join(
            [
                FROM_FILES.format(ordinal=0) + " WHERE script_id < 1000",
                FROM_FILES.format(ordinal=1), FROM_CSV.format(ordinal=2), FROM_CSV.format(ordinal=3),
            ]
        )
    ),
    "e2e_outcomes": q(
        f"""SELECT concat(file, ':', n) AS identifier, stmt_index = 1 AS answered, CASE WHEN stmt_index = 1 THEN ok END AS succeeded, statement_type,
        statement_type_source, CASE WHEN stmt_index = 1 THEN timing_ms END AS timing_ms, parser_type_raw AS raw_query_type,
        CASE WHEN stmt_index = 1 THEN {joined('flags')} ELSE '' END AS flags, {listed('ups')} AS upstreams, {listed('downs')} AS downstreams FROM placed"""
    ),
    "e2e_records": q(
        f"""SELECT DISTINCT 2 AS phase, {FILE_FLOW} AS entity_urn, 'dataFlowInfo' AS aspect_name, 'part' AS name, NULL AS query_type, NULL AS inputs, NULL AS outputs
        FROM placed WHERE len(downs) > 0
        UNION ALL SELECT 3, {FILE_JOB}, 'dataJobInfo', concat(file, ':', n), parser_type_raw, NULL, NULL FROM placed WHERE len(downs) > 0
        UNION ALL SELECT 3, {FILE_JOB}, 'dataJobInputOutput', NULL, NULL, {listed('ups')}, {listed('downs')} FROM placed WHERE len(downs) > 0"""
    ),
    "split_statements": q("SELECT script_id, stmt_index, query_text FROM split"),
    "src_lineage_payload": q(
        f"""SELECT identifier, statement_type, statement_type_source, parser_error, rpc_error, {listed('ups')} AS upstreams, {listed('downs')} AS downstreams,
        {joined('flags')} AS flags, confidence, timing_ms FROM outcomes"""
    ),
    "src_malformed_payload": """SELECT CASE event_id % 4 WHEN 0 THEN concat('{ no json ', event_id) WHEN 1 THEN concat('[', event_id, ']')
        WHEN 2 THEN concat('{"query_type": "SELECT", "n": ', event_id, '}') ELSE concat('{"identifier": null, "n": ', event_id, '}') END AS value, CAST(1 AS BIGINT) AS n
        FROM events WHERE event_id % 7 = 0 UNION ALL SELECT 'answered', COUNT(*) FROM events WHERE event_id % 7 <> 0""",
    "src_expected_results": q(
        f"""SELECT script_id, CAST(i AS BIGINT) AS stmt_index, {listed('ups')} AS in_tables, {listed('downs')} AS out_tables, {listed('edges')} AS edges
        FROM outcomes, (VALUES (1), (2)) v(i) WHERE stmt_index = 1 AND (i = 1 OR template = 11)"""
    ),
    # text
    "clean_sql": q("SELECT identifier, clean_text FROM named"),
    "leading_tokens": q(
        "SELECT identifier, array_to_string(list_transform(regexp_extract_all(clean_text, '[A-Za-z_#]+')[1:6], lambda t: upper(t)), ' ') AS tokens FROM named"
    ),
    "infer_statement_type": q("SELECT identifier, inferred AS inferred_type FROM outcomes"),
    "normalize_type_label": q("SELECT identifier, label AS type_label FROM outcomes"),
    "parser_statement_type": q(
        "SELECT identifier, coalesce(label, upper(event_type)) AS parser_statement_type FROM outcomes"
    ),
    "resolve_statement_type": q(
        "SELECT identifier, statement_type, statement_type_source FROM outcomes"
    ),
    "normalize_error_label": q(
        """SELECT identifier, error_class AS parser_label, CASE WHEN rpc_error IS NULL THEN '<none>' ELSE 'HTTPError' END AS rpc_label,
        CASE WHEN parser_error IS NULL THEN '<none>' ELSE '<unknown>' END AS odd_label FROM outcomes"""
    ),
    "status_label": q(
        "SELECT identifier, CASE WHEN k = 10 THEN 'RPC_ERROR' WHEN k IN (4, 7, 8) THEN 'PARSE_ERROR' ELSE 'OK' END AS status FROM outcomes"
    ),
    "sanitize_component": q(
        r"SELECT identifier, left(trim(regexp_replace('_/' || query_text || '/_', '[^\p{L}\p{N}\-_.#]', '_', 'g'), '_'), 128) AS component FROM named"
    ),
    "sanitize_identifier": q(
        f"SELECT identifier, {identifier_of('context')} AS short_id, {identifier_of('repeat(query_text, 6)')} AS long_id FROM named"
    ),
    "relative_source_label": q(
        """SELECT identifier, CASE WHEN event_type = 'click' THEN concat('u', user_id, '.sql') ELSE source_path END AS below,
        concat(event_type, '/u', user_id, '.sql') AS windows FROM named"""
    ),
    "truncate_property": q(
        f"SELECT identifier, {cut(squeezed('query_text'), 280)} AS whole, {cut(squeezed('repeat(query_text || chr(32) || chr(10) || chr(32), 8)'), 280)} AS cut FROM named"
    ),
    "query_preview": q(
        f"SELECT identifier, {cut(one_line('query_text'), 240)} AS preview, {cut(one_line('repeat(query_text || chr(10) || chr(10), 8)'), 240)} AS long_preview FROM named"
    ),
    # lineage
    "column_edges": q("SELECT identifier, unnest(edges) AS edge FROM outcomes"),
    "table_edges": q(
        """SELECT identifier, 'input' AS edge_kind, unnest(ups) AS dataset FROM records
        UNION ALL SELECT identifier, 'output', unnest(downs) FROM records"""
    ),
    "self_reference": q("SELECT identifier, self_ref AS self_referential FROM outcomes"),
    "statement_flags": q(f"SELECT identifier, {joined('flags')} AS flags FROM outcomes"),
    "flag_prefix": q(
        f"""SELECT identifier, {PREFIX.format('flags')} AS prefix, {PREFIX.format('flags')} || '[AA][ZZ]' AS prefix_with_extras FROM outcomes"""
    ),
    "source_flags": q(f"SELECT source_path, {SOURCE_PREFIX} AS flags FROM outcomes GROUP BY source_path"),
    "dataset_columns": q(
        "SELECT dataset, coalesce(string_agg(col, ',' ORDER BY col), '') AS columns FROM mentions GROUP BY dataset"
    ),
    "dataset_scaffolds": q(
        """SELECT dataset, split_part(dataset, ',', 2) AS name, 'teradata' AS platform, 'PROD' AS cluster,
        coalesce(string_agg(col || ':UNKNOWN', ',' ORDER BY col), '') AS fields, 'stmtlens' AS auto_created_by FROM mentions GROUP BY dataset"""
    ),
    "missing_datasets": q(
        f"""SELECT dataset, COUNT(col) AS n_columns FROM mentions
        WHERE dataset NOT IN (SELECT concat({URN}, 'db.s.t', user_id, ',PROD)') FROM events WHERE user_id % 2 = 0) GROUP BY dataset"""
    ),
    "fine_grained_lineage": q(f"SELECT * EXCLUDE (job_urn) FROM ({FINE})"),
    "urn_build_parse": q(
        """SELECT identifier, concat('urn:li:dataset:(urn:li:dataPlatform:teradata,', name, ',DEV)') AS urn, 'teradata' AS platform, name, 'DEV' AS env,
        concat('urn:li:schemaField:(urn:li:dataset:(urn:li:dataPlatform:teradata,', name, ',DEV),a)') AS field_urn
        FROM (SELECT identifier, concat(['maindb.core.t', 'maindb.s.t', 'db.s.t'][script_id % 3 + 1], user_id) AS name FROM named)"""
    ),
    "table_refs": q(
        """SELECT identifier,
        CASE WHEN k = 2 THEN concat('db.s.t', user_id, ',db.s.orders') WHEN k IN (0, 1, 3, 4, 5, 6, 7) THEN concat('db.s.t', user_id) ELSE '' END AS upstreams,
        CASE WHEN k = 2 THEN concat('db.s.', event_type, '_copy') WHEN k IN (1, 3, 4, 5, 6, 8, 9) THEN concat('db.s.', event_type) ELSE '' END AS downstreams FROM named"""
    ),
    # metadata
    "flows": q(
        """SELECT DISTINCT flow_urn, source_path, concat('u', user_id, '.sql') AS name, concat('SQL lineage extracted from ', event_type, '/u', user_id, '.sql') AS description,
        concat('queries/', event_type) AS project, 'PROD' AS env,
        concat('sqlParserFlowId=nightly_', event_type, '/u', user_id, '.sql|sqlParserFlowPrefix=nightly|sqlParserSourcePath=', source_path) AS custom_properties FROM records"""
    ),
    "jobs": q(
        f"""SELECT job_urn, flow_urn, identifier AS name, 'SQL_PARSER' AS type, context AS description, 'PROD' AS env, {JOB_PROPERTIES} AS custom_properties FROM records"""
    ),
    "job_io": q(
        f"""SELECT r.job_urn, {listed('r.ups')} AS inputs, {listed('r.downs')} AS outputs, f.fine_grained FROM records r LEFT JOIN
        (SELECT job_urn, string_agg(upstream_fields || '>' || downstream_field, ',' ORDER BY upstream_fields || '>' || downstream_field) AS fine_grained FROM ({FINE}) GROUP BY job_urn) f
        ON r.job_urn = f.job_urn"""
    ),
    "collect_gate": q(
        """SELECT len(downs) > 0 AS has_job, COUNT(*) AS statements, COUNT(*) FILTER (NOT ok) AS failed FROM outcomes GROUP BY ALL
        UNION ALL SELECT NULL, COUNT(DISTINCT dataset), 0 FROM mentions"""
    ),
    "emission_plan": q(
        f"""SELECT phase, aspect_name, entity_urn, COUNT(*) AS n FROM (
        SELECT 1 AS phase, a AS aspect_name, dataset AS entity_urn FROM (SELECT DISTINCT dataset FROM mentions WHERE dataset NOT IN
          (SELECT concat({URN}, 'db.s.t', user_id, ',PROD)') FROM events WHERE user_id % 2 = 0)), (VALUES ('datasetProperties'), ('schemaMetadata')) v(a)
        UNION ALL SELECT DISTINCT 2, 'dataFlowInfo', flow_urn FROM records
        UNION ALL SELECT 3, a, job_urn FROM records, (VALUES ('dataJobInfo'), ('dataJobInputOutput')) v(a)) GROUP BY ALL"""
    ),
    "emitted_entities": q("SELECT flow_urn AS entity_urn FROM records UNION SELECT job_urn FROM records"),
    # reports
    "run_overview": q(f"SELECT {OVERVIEW} FROM outcomes"),
    "source_overview": q(f"SELECT source_path, {OVERVIEW} FROM outcomes GROUP BY source_path"),
    "error_summary": q("SELECT error_class AS message, COUNT(*) AS count FROM outcomes GROUP BY error_class"),
    "type_metrics": q(
        """SELECT statement_type, COUNT(*) AS total_queries, COUNT(*) FILTER (ok) AS success_count, COUNT(*) FILTER (NOT ok) AS error_count,
        round(CAST(COUNT(*) FILTER (ok) AS DOUBLE) / COUNT(*) * 100, 6) AS success_rate, round(100 - CAST(COUNT(*) FILTER (ok) AS DOUBLE) / COUNT(*) * 100, 6) AS error_rate
        FROM outcomes GROUP BY statement_type"""
    ),
    "timing_summary": q(
        f"""SELECT statement_type, round({TOTAL_MS} / COUNT(*), 6) AS avg_ms, round(median(timing_ms), 6) AS median_ms, round(quantile_cont(timing_ms, 0.95), 6) AS p95_ms,
        round(min(timing_ms), 6) AS min_ms, round(max(timing_ms), 6) AS max_ms FROM outcomes GROUP BY statement_type"""
    ),
    "percentile_linear": q(
        """SELECT 'all' AS run, round(quantile_cont(timing_ms, 0.1), 6) AS p10, round(quantile_cont(timing_ms, 0.5), 6) AS p50,
        round(quantile_cont(timing_ms, 0.9), 6) AS p90, round(quantile_cont(timing_ms, 0.99), 6) AS p99 FROM outcomes"""
    ),
    "flag_counts": q(
        f"""SELECT statement_type, {', '.join(f'{has(f)} AS "{f}"' for f in ['ERR', 'GAP', 'LIN', 'SELF', 'COL', 'OK'])} FROM outcomes GROUP BY statement_type"""
    ),
    "error_class_counts": with_totals("error_class", "error_class"),
    "parser_error_counts": with_totals("parser_error", "coalesce(parser_error, '<none>')"),
    "source_breakdown": q(
        """SELECT statement_type, COUNT(*) FILTER (statement_type_source = 'parser') AS parser, COUNT(*) FILTER (statement_type_source = 'fallback') AS fallback,
        CAST(0 AS BIGINT) AS unresolved FROM outcomes GROUP BY statement_type"""
    ),
    "reported_labels": with_totals("parser_label", "coalesce(label, 'UNAVAILABLE')"),
    "report_header": q(
        f"""SELECT COUNT(*) AS query_count, {TOTAL_MS} AS timing_ms_total, COUNT(*) FILTER (statement_type_source = 'parser') AS via_parser,
        COUNT(*) FILTER (statement_type_source = 'fallback') AS via_fallback, CAST(0 AS BIGINT) AS still_unknown, COUNT(*) FILTER (label = 'UNKNOWN') AS parser_unknown FROM outcomes"""
    ),
    "type_overview_table": q(
        f"""SELECT statement_type, COUNT(*) AS total_queries, COUNT(*) FILTER (ok) AS success_count, COUNT(*) FILTER (NOT ok) AS error_count,
        {fixed('CAST(COUNT(*) FILTER (ok) AS DOUBLE) / COUNT(*) * 100', 1)} || '%' AS success_pct, {fixed(TOTAL_MS + ' / COUNT(*)', 2)} AS avg_ms,
        {fixed('quantile_cont(timing_ms, 0.95)', 2)} AS p95_ms FROM outcomes GROUP BY statement_type"""
    ),
    "multi_scope_report": q(
        f"""SELECT source_path, statement_type, CASE WHEN grouping(source_path) = 0 AND grouping(statement_type) = 0 THEN 'source_type' WHEN grouping(source_path) = 0 THEN 'source'
        WHEN grouping(statement_type) = 0 THEN 'run_type' ELSE 'run' END AS scope, {OVERVIEW} FROM outcomes
        GROUP BY GROUPING SETS ((source_path, statement_type), (source_path), (statement_type), ())"""
    ),
    "query_list": q(
        f"""SELECT source_path, identifier, {joined('flags')} AS flags, ok AS succeeded, timing_ms, {cut(one_line('query_text'), 240)} AS preview, statement_type,
        statement_type_source, label AS parser_statement_type FROM outcomes"""
    ),
    # analyses
    "complexity_metrics": q(
        """SELECT identifier, cte_count, max_cte_depth, subquery_count, join_count, union_count, window_function_count, line_count, char_count FROM shape"""
    ),
    "validate_tables": q(
        f"SELECT identifier, round(tp, 6) AS tables_precision, round(tr, 6) AS tables_recall, {joined('tm')} AS tables_missing, {joined('tx')} AS tables_extra FROM judged"
    ),
    "validate_columns": q(
        f"SELECT identifier, round(cp, 6) AS columns_precision, round(cr, 6) AS columns_recall, {joined('cm')} AS columns_missing, {joined('cx')} AS columns_extra FROM judged"
    ),
    "validation_status": q("SELECT identifier, status AS validation_status FROM judged"),
    "validation_summary": q(
        "SELECT COUNT(*) FILTER (status <> 'no_expectation') AS validated_count, COUNT(*) FILTER (status = 'match') AS match_count, "
        + ", ".join(
            f"round(CAST(SUM(CAST(round({c}, 9) AS DECIMAL(20,9))) AS DOUBLE) / COUNT({c}), 6) AS avg_{n}"
            for c, n in [("tp", "tables_precision"), ("tr", "tables_recall"), ("cp", "columns_precision"), ("cr", "columns_recall")]
        )
        + " FROM judged"
    ),
    "overall_stats": q(f"SELECT {RATES} FROM outcomes"),
    "confidence_buckets": q(
        """SELECT CASE WHEN c >= 0.9 THEN 'high' WHEN c >= 0.7 THEN 'medium' WHEN c > 0 THEN 'low' ELSE 'failed' END AS bucket, COUNT(*) AS count
        FROM (SELECT coalesce(confidence, 0) AS c FROM outcomes) GROUP BY ALL"""
    ),
    "stats_by_category": q(f"SELECT category, {RATES} FROM outcomes GROUP BY category"),
    "stats_by_type": q(f"SELECT statement_type, {RATES} FROM outcomes GROUP BY statement_type"),
    "complexity_impact": q(
        "SELECT measure, band, COUNT(*) AS total_queries, COUNT(*) FILTER (ok) AS success_count, round(COUNT(*) FILTER (ok) * CAST(100 AS DOUBLE) / COUNT(*), 6) AS success_rate FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS measure, {band(c)} AS band, ok FROM shape" for c in ["cte_count", "join_count", "subquery_count"]
        )
        + ") GROUP BY measure, band"
    ),
    "error_analysis": q(
        """SELECT error_class, COUNT(*) AS count, array_to_string(list_sort(list(identifier))[1:3], ',') AS examples
        FROM (SELECT CASE WHEN k = 10 THEN 'HTTPError' ELSE error_class END AS error_class, identifier FROM outcomes WHERE NOT ok) GROUP BY error_class"""
    ),
    "threshold_gate": q(
        f"""SELECT s.category, s.success_rate, s.high_confidence_rate,
        CASE WHEN t.s IS NULL THEN 'no target' WHEN s.success_rate >= t.s THEN 'pass' ELSE 'fail' END AS success_verdict,
        CASE WHEN t.h IS NULL THEN 'no target' WHEN s.high_confidence_rate >= t.h THEN 'pass' ELSE 'fail' END AS confidence_verdict,
        s.category = '01-basic' AND s.success_rate < 50 AS red_flag_basic, s.column_lineage_rate < 30 AS red_flag_columns, s.avg_confidence < 0.7 AS red_flag_confidence
        FROM (SELECT category, {RATES} FROM outcomes GROUP BY category) s LEFT JOIN (VALUES ('01-basic', 95, 90), ('02-ctes', 90, 85), ('03-subqueries', 85, 80),
        ('04-advanced-dml', 75, 70), ('05-stored-procs', 50, 40), ('06-cross-db', 85, 80), ('08-real-world', 80, 75)) t(category, s, h) ON s.category = t.category"""
    ),
    "low_confidence_filter": q("SELECT identifier, confidence FROM outcomes WHERE confidence >= 0.7"),
    "error_category": q(
        """SELECT category_id, category, category_group, count, round(count * CAST(100 AS DOUBLE) / SUM(count) OVER (), 6) AS share_pct FROM (
        SELECT CAST(CASE k WHEN 4 THEN 1 WHEN 8 THEN 2 ELSE 3 END AS BIGINT) AS category_id,
        CASE k WHEN 4 THEN 'Column Lineage Limitation' WHEN 8 THEN 'Teradata USING Clause' ELSE 'Teradata LOCKING Clause' END AS category,
        CASE k WHEN 4 THEN 'Expected Limitations' ELSE 'Teradata Dialect' END AS category_group, COUNT(*) AS count
        FROM outcomes WHERE parser_error IS NOT NULL GROUP BY ALL)"""
    ),
    "error_patterns": q(
        """SELECT c.id AS category_id, c.name AS category, c.grp AS category_group, COUNT(*) AS count,
        round(COUNT(*) * CAST(100 AS DOUBLE) / SUM(COUNT(*)) OVER (), 6) AS share_pct
        FROM scripts s JOIN (VALUES (0, 'Unclassified', 'Unclassified'), (1, 'Column Lineage Limitation', 'Expected Limitations'),
        (2, 'Teradata USING Clause', 'Teradata Dialect'), (3, 'Teradata LOCKING Clause', 'Teradata Dialect'), (4, 'Abbreviated CREATE TABLE', 'Teradata Dialect'),
        (5, 'INSERT VALUES Scope Error', 'System Limits'), (6, 'Teradata NAMED Keyword', 'Teradata Dialect'), (7, 'Teradata REPLACE PROCEDURE', 'Teradata Dialect'),
        (8, 'Unsupported DDL Syntax', 'Unsupported DDL'), (9, 'Duplicate Alias', 'Configuration'), (10, 'Schema Nesting Level', 'Configuration'),
        (11, 'Expression Type Mismatch', 'System Limits'), (12, 'Syntax Error (Parentheses)', 'Syntax/Invalid SQL'), (13, 'Invalid Teradata Syntax', 'Syntax/Invalid SQL'),
        (14, 'Invalid MODIFY USER', 'Syntax/Invalid SQL'), (15, 'Script Limit', 'System Limits')) AS c(id, name, grp)
        ON c.id = CASE s.script_id % 18 WHEN 16 THEN 0 WHEN 17 THEN 9 ELSE s.script_id % 18 END
        WHERE s.script_id % 18 <> 0 GROUP BY ALL"""
    ),
    "error_layer": q(
        "SELECT CASE WHEN k = 10 THEN 'rpc' WHEN k = 4 THEN 'lineage' WHEN k IN (7, 8) THEN 'parser' ELSE 'none' END AS layer, COUNT(*) AS count FROM outcomes GROUP BY ALL"
    ),
    "rewrite_using": dialect(
        rf"regexp_replace({USING_TEXT}, '(?is)USING\s+[^;]+?\s+(SELECT|INSERT|UPDATE|DELETE|WITH)', '\1', 'g')"
    ),
    "rewrite_ct": dialect("'CREATE TABLE db.s.x AS (' || query_text || ')'"),
    "rewrite_locking": dialect(
        "CASE WHEN k = 7 THEN concat('SELECT a FROM db.s.t', user_id) ELSE query_text END"
    ),
    "rewrite_named": dialect("'SEL a AS aa, b AS bb FROM (' || query_text || ')'"),
    "qualify_names": q(
        """SELECT identifier,
        CASE WHEN k = 2 THEN concat('maindb.core.t', user_id, ',maindb.core.orders') WHEN k IN (0, 1, 3, 4, 5, 6, 7) THEN concat('maindb.core.t', user_id) ELSE '' END AS upstream_names,
        CASE WHEN k = 2 THEN concat('maindb.core.', event_type, '_copy') WHEN k IN (1, 3, 4, 5, 6, 8, 9) THEN concat('maindb.core.', event_type) ELSE '' END AS downstream_names FROM named"""
    ),
    "generalize_fingerprint": q(
        r"""SELECT sha256(lower(g)) AS query_fingerprint, COUNT(*) AS count, min(g) AS generalized FROM
        (SELECT trim(regexp_replace(regexp_replace(clean_text, '\b[0-9]+\b', '?', 'g'), '\s+', ' ', 'g')) AS g FROM named) GROUP BY lower(g)"""
    ),
    "extract_proc_statements": q(
        """SELECT script_id, CAST(1 AS BIGINT) AS step, clean_text AS query_text, inferred AS statement_type FROM outcomes
        WHERE stmt_index = 1 AND inferred IN ('SELECT', 'INSERT', 'UPDATE', 'DELETE')
        UNION ALL SELECT script_id, CASE WHEN template = 11 THEN 3 ELSE 2 END, 'UPDATE db.s.y SET a = 1', 'UPDATE' FROM scripts
        UNION ALL SELECT script_id, CASE WHEN template = 11 THEN 5 ELSE 4 END, 'DELETE FROM db.s.y', 'DELETE' FROM scripts"""
    ),
    "statement_filter": q(
        f"SELECT identifier, statement_type FROM outcomes WHERE statement_type NOT IN {NO_COLUMNS}"
    ),
    "template_placeholders": q(
        """SELECT identifier, concat('{{user_', user_id, '}},${v},:p1,@q,?') AS found,
        query_text || ' AND x = NULL AND y = NULL AND z = NULL AND w = NULL AND v = NULL' AS filled FROM named"""
    ),
    "trend_over_runs": q(
        f"""SELECT run_id, statement_type, total_queries, round(s, 6) AS success_rate, round(c, 6) AS avg_confidence,
        round(s - lag(s) OVER w, 6) AS success_change, round(c - lag(c) OVER w, 6) AS confidence_change FROM (
        SELECT run_id, statement_type, COUNT(*) AS total_queries, COUNT(*) FILTER (ok) * CAST(100 AS DOUBLE) / COUNT(*) AS s,
        CASE WHEN COUNT(confidence) > 0 THEN CAST(SUM(CAST(confidence AS DECIMAL(12,6))) AS DOUBLE) / COUNT(confidence) END AS c FROM outcomes GROUP BY ALL)
        WINDOW w AS (PARTITION BY statement_type ORDER BY run_id)"""
    ),
    "ledger_overview": q(
        f"""SELECT statement_type, {OVERVIEW}, round(COUNT(*) FILTER (ok) * CAST(100 AS DOUBLE) / COUNT(*), 6) AS success_rate,
        round({TOTAL_MS} / COUNT(*), 6) AS avg_ms, min(timing_ms) AS min_ms, max(timing_ms) AS max_ms FROM outcomes GROUP BY statement_type"""
    ),
    "percentile_sketch": q(
        """SELECT statement_type, quantile, COUNT(*) AS timed, true AS within_error FROM outcomes,
        (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) AS t(quantile) GROUP BY ALL"""
    ),
    # sinks
    "sink_statement_json": q(
        f"""SELECT o.identifier, s.source_flags, {joined('o.flags')} AS flags, o.query_text AS source_query, {cut(one_line('query_text'), 240)} AS preview,
        o.label AS query_type, o.confidence, o.parser_error, o.rpc_error, {listed('o.ups')} AS in_tables, {listed('o.downs')} AS out_tables
        FROM outcomes o JOIN (SELECT source_path, replace(trim({SOURCE_PREFIX}, '[]'), '][', '-') AS source_flags FROM outcomes GROUP BY source_path) s
        ON o.source_path = s.source_path"""
    ),
    "sink_source_report": report("source_path"),
    "sink_run_report": report("'run'"),
    "sink_results_table": q(
        """SELECT concat('u', user_id) AS query_id, source_path AS query_file, stmt_index AS statement_index, statement_type, 'teradata' AS dialect, ok AS success,
        confidence, timing_ms AS parse_time_ms, CAST(len(ups) AS BIGINT) AS in_tables_count, CAST(len(downs) AS BIGINT) AS out_tables_count,
        CAST(n_lineage AS BIGINT) AS column_lineage_count, coalesce(rpc_error, parser_error) AS error_message, cte_count, max_cte_depth, subquery_count, join_count,
        union_count, window_function_count, line_count, char_count, status AS validation_status, round(tp, 6) AS tables_precision, round(tr, 6) AS tables_recall,
        round(cp, 6) AS columns_precision, round(cr, 6) AS columns_recall, COUNT(*) AS n FROM shape GROUP BY ALL"""
    ),
    "sink_metadata_records": q(
        f"""SELECT sequence, phase, entity_urn, aspect_name, name, description, env, properties, inputs, outputs FROM (
        SELECT *, row_number() OVER (ORDER BY phase, source_path NULLS FIRST, script_id NULLS FIRST, stmt_index NULLS FIRST, entity_urn, aspect_name) - 1 AS sequence FROM (
        SELECT DISTINCT 2 AS phase, flow_urn AS entity_urn, 'dataFlowInfo' AS aspect_name, concat('u', user_id, '.sql') AS name,
          concat('SQL lineage extracted from ', event_type, '/u', user_id, '.sql') AS description, 'PROD' AS env,
          concat('sqlParserFlowId=nightly_', event_type, '/u', user_id, '.sql|sqlParserFlowPrefix=nightly|sqlParserSourcePath=', source_path) AS properties,
          NULL AS inputs, NULL AS outputs, NULL AS source_path, NULL AS script_id, NULL AS stmt_index FROM records
        UNION ALL SELECT 3, job_urn, 'dataJobInfo', identifier, context, 'PROD', {JOB_PROPERTIES}, NULL, NULL, source_path, script_id, stmt_index FROM records
        UNION ALL SELECT 3, job_urn, 'dataJobInputOutput', NULL, NULL, NULL, NULL, {listed('ups')}, {listed('downs')}, source_path, script_id, stmt_index FROM records))
        WHERE (sequence // 500) % 2 = 1"""
    ),
    "sink_ctas": """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS total_amount FROM orders""",
    "sink_insert": """SELECT c_custkey AS customer_id, c_name AS customer_name, concat('c', CAST(c_custkey AS VARCHAR), '@example.com') AS email, 'ACTIVE' AS status
        FROM (SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
  UNION ALL SELECT s_suppkey + 10000000000, s_name, s_nationkey, s_acctbal, 'HOUSEHOLD' FROM supplier) WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, c_name, NULL, NULL FROM customer""",
    "sink_view": """SELECT c.c_custkey AS customer_id, c.c_name AS customer_name, o.o_orderkey AS order_id FROM (SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
  UNION ALL SELECT s_suppkey + 10000000000, s_name, s_nationkey, s_acctbal, 'HOUSEHOLD' FROM supplier) c
        LEFT JOIN orders o ON c.c_custkey = o.o_custkey""",
}
SQL["ledger_trend"] = SQL["trend_over_runs"]
