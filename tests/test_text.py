"""Text rules on hand-made cases."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from stmtlens.functions import rewrite as rw
from stmtlens.functions import text as tx


def evaluate(spark, function, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string")
    return [r["out"] for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def check(spark, function, cases):
    got = evaluate(spark, function, [given for given, _ in cases])
    assert got == [wanted for _, wanted in cases]


def test_strip_takes_all_unicode_whitespace(spark):
    check(spark, tx.strip, [(" \t\n a b \r\x0b", "a b"), ("  x　", "x"), ("\x1cx\x85", "x"), ("", "")])


def test_split_is_naive(spark):
    got = evaluate(
        spark,
        lambda c: F.transform(tx.statement_texts(c), tx.strip),
        ["a; b ;;\n;c", ";", "", "select ';' from t -- x;y", "one", "  ; a"],
    )
    assert got == [["a", "b", "c"], [], [], ["select '", "' from t -- x", "y"], ["one"], ["a"]]


def test_clean_sql(spark):
    check(
        spark,
        tx.clean_sql,
        [
            ("/* a\nb */ SELECT 1 -- tail\nFROM t", "SELECT 1  \nFROM t"),
            ("SELECT 'http://x' FROM t", "SELECT 'http:"),
            ("a # b\nc", "a  \nc"),
            ("-- only", ""),
            ("/* open", "/* open"),
            ("a -- x /* y\nz */ b", "a"),
            ("x /**/ y", "x   y"),
        ],
    )


def test_leading_tokens(spark):
    got = evaluate(
        spark, lambda c: tx.leading_tokens(c),
        ["select t1, b_c from 9x", "a b c d e f g h", "", "123 ()", "ſelect x"],
    )
    assert got == [
        ["SELECT", "T", "B_C", "FROM", "X"], ["A", "B", "C", "D", "E", "F"], [], [], ["ELECT", "X"],
    ]


TYPES = [
    ("", "UNKNOWN"), (")", "UNKNOWN"), ("SEL 1", "SELECT"), ("sel", "SELECT"),
    ("WITH x AS (SELECT 1) INSERT INTO t", "SELECT"), ("WITH x AS (VALUES 1) DELETE", "DELETE"),
    ("WITH a b c d e INSERT", "SELECT"), ("WITH a b c d INSERT", "INSERT"), ("WITH", "SELECT"),
    ("WITH inserted AS (select 1)", "SELECT"),
    ("BT", "BT"), ("ET", "ET"), ("DATABASE d", "DATABASE"), ("USING (a INT) SELECT", "USING"),
    ("CALL p", "CALL"), ("EXEC p", "CALL"), ("EXECUTE IMMEDIATE s", "CALL"),
    ("COLLECT STATISTICS ON t", "COLLECT_STATISTICS"), ("COLLECT STATS t", "COLLECT"),
    ("LOCKING ROW FOR ACCESS SELECT 1", "LOCKING"),
    ("REPLACE MACRO m", "REPLACE_MACRO"), ("REPLACE SET TABLE t", "REPLACE_TABLE"),
    ("REPLACE SET VIEW t", "REPLACE"), ("REPLACE DATABASE d", "REPLACE"),
    ("CREATE MULTISET TABLE t", "CREATE_TABLE"), ("CREATE TABLE t", "CREATE_TABLE"),
    ("CREATE VIEW v", "CREATE_VIEW"), ("CREATE VOLATILE TABLE t", "CREATE"),
    ("CREATE TABLESPACE t", "CREATE"), ("CREATE FUNCTION f", "CREATE_FUNCTION"),
    ("ALTER PROCEDURE p COMPILE", "ALTER_PROCEDURE"), ("ALTER VIEW v", "ALTER"),
    ("DROP MACRO m", "DROP_MACRO"), ("DROP INDEX i", "DROP"), ("drop table t", "DROP_TABLE"),
    ("INSERT INTO t", "INSERT"), ("UPD t", "UPD"), ("MERGE INTO t", "MERGE"), ("GRANT x", "GRANT"),
    ("REVOKE x", "REVOKE"), ("LOGON a", "LOGON"), ("LOGOFF", "LOGOFF"), ("BEGIN", "BEGIN"),
    ("BEGIN TRANSACTION", "BEGIN_TRANSACTION"), ("BEGIN LOADING", "BEGIN"), ("END IF", "END"),
    ("read_loop: LOOP", "READ_LOOP"),
]


def test_statement_types(spark):
    check(spark, lambda c: tx.statement_type_of(tx.leading_words(tx.clean_sql(c))), TYPES)


def test_type_label(spark):
    check(
        spark, tx.type_label,
        [
            (None, None), ("  ", None), ("QueryType.INSERT", "INSERT"), ("a.b.c d", "C_D"),
            ("create-table as/select", "CREATE_TABLE_AS_SELECT"), ("x.", None), ("A \t B", "A_B"),
        ],
    )


def test_resolved_type(spark):
    df = spark.createDataFrame(
        [("INSERT", "SELECT"), (None, "SELECT"), ("UNKNOWN", "END"), ("UNKNOWN", "UNKNOWN")],
        "label string, inferred string",
    )
    kind, source = tx.resolved_type(F.col("label"), F.col("inferred"))
    got = [tuple(r) for r in df.select(kind, source).collect()]
    assert got == [
        ("INSERT", "parser"), ("SELECT", "fallback"), ("END", "fallback"), ("UNKNOWN", "fallback"),
    ]


def test_error_label(spark):
    check(
        spark, tx.error_label,
        [
            (None, "<none>"), ("  ", "<none>"), ("Expecting ). Line 1", "Expecting )"),
            ("a: b. c", "a"), ("Not <class X>", "Not"), (":x", "<unknown>"),
            ("_TableName(table='c')", "_TableName(table='c')"),
        ],
    )


def test_sanitized(spark):
    check(
        spark, tx.sanitized_component,
        [("a/b c.sql", "a_b_c.sql"), ("__", "result"), ("é#1", "é#1"), ("x" * 200, "x" * 128)],
    )
    long = "A" * 150 + " " + "B" * 100
    cleaned = "A" * 150 + "_" + "B" * 100
    digest = hashlib.sha1(cleaned.encode()).hexdigest()[:8]
    check(
        spark, lambda c: tx.sanitized_identifier(c, "none"),
        [
            (" /a//b C.sql#1 ", "/a//b_c.sql_1"), ("__ __", "none"), ("", "none"),
            (long, (cleaned[:191] + "_" + digest).lower()), ("y" * 200, "y" * 200),
        ],
    )


def test_previews(spark):
    check(
        spark, tx.query_preview,
        [
            ("  a  b \n\n   c\t\r\n d ", "a  b c d"), (" \n ", "<empty>"), ("", "<empty>"),
            ("x" * 240, "x" * 240), ("x" * 241, "x" * 239 + "…"), ("a c\x85d", "a c d"),
        ],
    )
    check(
        spark, lambda c: tx.truncated_property(c, 10),
        [("  a \n b  ", "a b"), (" ", ""), ("0123456789", "0123456789"), ("0123456789a", "012345678…")],
    )


def test_relative_label(spark):
    check(
        spark, lambda c: tx.relative_label(c, "/data/sql/"),
        [("/data/sql/a/b.sql", "a/b.sql"), ("/other/c.sql", "/other/c.sql"), ("/data/sqlx/d", "/data/sqlx/d")],
    )


def test_fixed_point(spark):
    df = spark.createDataFrame([(6.25,), (93.75,), (0.0,), (12.345,)], "v double")
    assert [r[0] for r in df.select(tx.fixed_point(F.col("v"), 1)).collect()] == ["6.2", "93.8", "0.0", "12.3"]


@pytest.mark.parametrize(
    ("function", "given", "wanted"),
    [
        (rw.without_using, "USING S(CHAR(4)), R(INTEGER)\nUPDATE t SET a=1", "UPDATE t SET a=1"),
        (rw.expand_ct, "ct db.t, direct", "CREATE TABLE db.t, direct"),
        (rw.without_locking, "LOCKING TABLE a.b FOR access LOCKING TABLE c FOR READ SELECT 1", "SELECT 1"),
        (rw.named_to_alias, "SEL a (NAMED x), b(named y)", "SEL a AS x, bAS y"),
        (rw.generalized, "a = 'it''s' AND b IN (1, 2.5)  AND t1 = 3", "a = ? AND b IN (?, ?) AND t1 = ?"),
        (rw.fill_placeholders, "a={{x}} b=${y} c=? d=:e f=@g", "a=NULL b=NULL c=NULL d=NULL f=NULL"),
    ],
)
def test_rewrites(spark, function, given, wanted):
    check(spark, function, [(given, wanted)])
