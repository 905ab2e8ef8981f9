"""Lineage arrays, row changes, hierarchies and report properties on small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stmtlens import schemas
from stmtlens.functions import lineage as lin
from stmtlens.functions.text import clean_sql
from stmtlens.functions.urns import qualified_name
from stmtlens.operators import analysis, lineage, metadata, reports, tables
from stmtlens.operators.hierarchy import paths_from_roots
from stmtlens.sources import statement_log as log

FOLDER = "/root/testdata/sf0.001"


def entry(table, column, upstreams, logic="x"):
    return {
        "downstream": {"table": table, "column": column},
        "upstreams": [{"table": t, "column": c} for t, c in upstreams],
        "logic": {"column_logic": logic},
    }


def lineage_row(spark, downstreams, entries, confidence=0.5):
    from pyspark.sql import types as T

    schema = T.StructType(
        [
            T.StructField("identifier", T.StringType()),
            T.StructField("upstreams", schemas.STRINGS),
            T.StructField("downstreams", schemas.STRINGS),
            T.StructField("column_lineage", schemas.COLUMN_LINEAGE),
            T.StructField("confidence", T.DoubleType()),
        ]
    )
    return spark.createDataFrame([("q", ["U"], downstreams, entries, confidence)], schema)


def test_column_edges_need_all_four_parts(spark):
    entries = [
        entry("D", "a", [("U", "x"), ("", "y"), ("U", None), ("V", "z")]),
        entry(None, "a", [("U", "x")]),
        entry("D", "", [("U", "x")]),
        {"downstream": None, "upstreams": None, "logic": None},
    ]
    df = lineage_row(spark, ["D"], entries)
    assert df.select(lin.column_edges(F.col("column_lineage"))).first()[0] == ["U.x -> D.a", "V.z -> D.a"]


def test_fine_grained_rules(spark):
    entries = [
        entry(None, "a", [("U", "x"), ("D1", "x")]),
        entry("D2", "b", [("U", "y")], logic=""),
        entry("D1", "c", [("D1", "z")]),
        entry("other", "d", [("U", "x")]),
        entry("D1", None, [("U", "x")]),
    ]
    df = lineage_row(spark, ["D1", "", "D2"], entries, 0.0)
    got = [tuple(r) for r in lineage.fine_grained_rows(df).collect()]
    field = "urn:li:schemaField:({},{})".format
    assert got == [
        ("q", "D1", field("D1", "a"), [field("U", "x")], None, "x"),
        ("q", "D2", field("D2", "a"), [field("U", "x"), field("D1", "x")], None, "x"),
        ("q", "D2", field("D2", "b"), [field("U", "y")], None, None),
    ]


def test_dataset_columns_keep_bare_datasets(spark):
    df = lineage_row(spark, ["D"], [entry("D", "a", [("U", "x"), ("W", None)]), entry("D", "a", [])])
    pairs = lineage.dataset_fields(lineage.dataset_columns(df)).collect()
    assert {r["dataset"]: r["columns"] for r in pairs} == {"U": ["x"], "D": ["a"], "W": []}


def test_table_refs(spark):
    cases = [
        ("SELECT * FROM a.b x JOIN c ON 1=1", ["a.b", "c"], []),
        ("WITH RECURSIVE h AS (SELECT 1 FROM e), k AS (SELECT 2) INSERT INTO t SELECT * FROM h JOIN k", ["e"], ["t"]),
        ("DELETE FROM t WHERE x IN (SELECT x FROM s)", ["s"], ["t"]),
        ("MERGE INTO t USING s ON 1=1 WHEN MATCHED THEN UPDATE SET a = 1", ["s"], ["t"]),
        ("SELECT EXTRACT(YEAR FROM d) FROM TABLE(f(1)) AS r", [], []),
        ("CREATE VIEW v AS SELECT 1 FROM s", ["s"], ["v"]),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "q string")
    refs = df.select(lin.table_refs(clean_sql(F.col("q"))).alias("r")).collect()
    assert [(r["r"]["upstreams"], r["r"]["downstreams"]) for r in refs] == [(u, d) for _, u, d in cases]


def test_qualified_name(spark):
    df = spark.createDataFrame([("t",), ("s.t",), ("d.s.t",)], "n string")
    got = [r[0] for r in df.select(qualified_name(F.col("n"), "D", "S")).collect()]
    assert got == ["D.S.t", "D.s.t", "d.s.t"]
    assert df.select(qualified_name(F.col("n"))).first()[0] == "t"


def test_emission_needs_a_job(spark):
    rows = log.outcomes(spark, FOLDER).where("template IN (0, 7)")
    known = spark.createDataFrame([], "urn string")
    assert metadata.emission_plan(rows, known).count() == 0
    assert lineage.dataset_columns(rows).count() > 0


def test_merge(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "n", "z")], "k int, v string, w string")
    source = spark.createDataFrame([(2, "B"), (3, None), (None, "N")], "k int, v string")
    got = tables.merged(target, source, "k", update=["v"], insert=["k", "v"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "a", "x"), (2, "B", "y"), (None, "n", "z"), (3, None, None), (None, "N", None)], key=str
    )
    with pytest.raises(ValueError, match="not unique"):
        tables.merged(target, source.union(source), "k", ["v"], ["k", "v"])


def test_update_and_delete(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    keys = spark.createDataFrame([(2,), (2,), (None,)], "k int")
    updated = tables.updated_where_matched(target, keys, "k", {"v": F.lit("X")})
    assert sorted(map(tuple, updated.collect()), key=str) == [(1, "a"), (2, "X"), (None, "c")]
    assert sorted(map(tuple, tables.deleted_in(target, keys, "k").collect()), key=str) == [(1, "a"), (None, "c")]


def test_paths_deep_cyclic_and_orphaned(spark):
    chain = [(0, None)] + [(i, i - 1) for i in range(1, 300)]
    star = [(1000 + i, 0) for i in range(50)]
    cycle = [(500, 501), (501, 500), (502, 500)]
    orphans = [(600, 999), (601, 600)]
    nodes = spark.createDataFrame(
        [(i, p, f"n{i}") for i, p in chain + star + cycle + orphans], "id int, parent int, name string"
    )
    got = {r["id"]: r for r in paths_from_roots(nodes, "id", "parent", "name").collect()}
    assert set(got) == {i for i, _ in chain + star}
    assert got[299]["level"] == 300
    assert got[299]["hierarchy_path"] == " > ".join(f"n{i}" for i in range(300))
    assert got[1007]["hierarchy_path"] == "n0 > n1007"


def test_report_properties(spark):
    rows = log.outcomes(spark, FOLDER).cache()
    total = rows.count()
    types = reports.type_metrics(rows).collect()
    assert sum(r["total_queries"] for r in types) == total
    assert all(r["success_rate"] + r["error_rate"] == pytest.approx(100) for r in types)
    has = lambda f: F.array_contains("flags", f)
    assert rows.where(has("GAP") & has("LIN")).count() == 0
    assert rows.where(has("OK") & (F.size("flags") > 1)).count() == 0
    assert reports.run_overview(rows).first()["query_count"] == total
    assert reports.other_flag_counts(rows).count() == 0
    rows.unpersist()


def test_cte_depth_and_counts(spark):
    text = (
        "WITH a AS (WITH b AS (SELECT 1) SELECT * FROM b), c AS (SELECT 2)\n"
        "SELECT x, ROW_NUMBER() OVER (ORDER BY y) FROM a JOIN c ON 1=1\n"
        "UNION ALL SELECT 1, 2 FROM (SELECT 3) d -- JOIN in a comment"
    )
    row = analysis.complexity_metrics(spark.createDataFrame([(text,)], "query_text string")).first()
    assert (row["cte_count"], row["max_cte_depth"], row["subquery_count"]) == (3, 2, 1)
    assert (row["join_count"], row["union_count"], row["window_function_count"], row["line_count"]) == (1, 1, 1, 3)


def test_error_classes(spark):
    messages = [
        ("Invalid expression / Unexpected token. Line 1, Col: 5.\n  USING p (INTEGER) UPDATE t", "x", 2),
        ("Invalid expression / Unexpected token. Line 1, Col: 15.", "CT db.t, FALLBACK (a INT)", 4),
        ("Expecting ). Line 1, Col: 9.", "SELECT a (NAMED b) FROM t", 6),
        ("Expecting ). Line 3, Col: 18.", "UPDATE t SET a = (1", 12),
        ("* is not <class X.Alias>", "SELECT *", 11),
        ("Table a.b must match the schema's nesting level: 3.", "CREATE VIEW", 10),
        ("Invalid expression / Unexpected token. Line 1, Col: 9.", "SELECT SESSION", 13),
        ("something new", "x", 0),
    ]
    df = spark.createDataFrame([(m, q) for m, q, _ in messages], "parser_error string, query_text string")
    got = {r["category_id"]: r for r in analysis.error_categories(df).collect()}
    assert sorted(got) == sorted(c for _, _, c in messages)
    assert got[0]["category"] == "Unclassified"
    assert sum(r["share_pct"] for r in got.values()) == pytest.approx(100)
