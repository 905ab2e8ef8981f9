"""File sources on small files written for each test."""

from __future__ import annotations

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from stmtlens.operators import analysis, metadata, statements
from stmtlens.plans import procedures
from stmtlens.plans.statements import SETTINGS
from stmtlens.sinks import reports
from stmtlens.sources import files
from stmtlens.sources.csv_cells import column_cells
from stmtlens.sources.workload import Workload


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_sql_file(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_bytes(b"-- x; y\r\nSELECT 1;\n\n; SELECT 'a;b' ;")
    got = rows(files.sql_files(spark, [str(path)]), "stmt_index", "query_text", "identifier", "context", "origin")
    texts = ["-- x", "y\nSELECT 1", "SELECT 'a", "b'"]
    assert got == [
        (i, t, f"{path}:{i}", f"{path} (statement {i})", "file") for i, t in enumerate(texts, 1)
    ]


def test_sql_dir_recurses_and_filters(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    (tmp_path / "b.sql").write_text("B1; B2")
    (tmp_path / "sub" / "deep" / "a.sql").write_text("A1")
    (tmp_path / "sub" / "note.txt").write_text("N")
    got = rows(files.sql_dirs(spark, [str(tmp_path)]), "source_path", "stmt_index", "query_text")
    assert [(p.split("/")[-1], i, q) for p, i, q in got] == [
        ("b.sql", 1, "B1"), ("b.sql", 2, "B2"), ("a.sql", 1, "A1"),
    ]


def test_large_files_give_the_same_statements(spark, tmp_path):
    """Cut by the scan over many blocks, numbered as if read whole."""
    for name, n in [("x.sql", 4000), ("y.sql", 30)]:
        body = ";\n".join(f"SELECT {i} -- é\n FROM t{i}" + ("; ;" if i % 7 == 0 else "") for i in range(n))
        (tmp_path / name).write_text(body)
    columns = ["identifier", "query_text", "stmt_index", "context"]
    whole = rows(files.sql_dirs(spark, [str(tmp_path)]), *columns)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        cut = files.sql_dirs(spark, [str(tmp_path)])
        assert rows(cut, *columns) == whole
        assert spark.read.option("lineSep", ";").text(str(tmp_path)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


CSV = 'id,sql_text,note\n1,"SELECT 1;\nSELECT ""a,b""",x\n2,   ,y\n3,,z\n4,SELECT 4,"w\nv"\n5\n6,SELECT 6;,\n'


def test_csv_rows_are_numbered_from_two(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text(CSV)
    got = rows(files.csv_column(spark, f"{path}:sql_text"), "row_number", "stmt_index", "query_text", "identifier", "context")
    assert got == [
        (r, s, q, f"{path}:row{r}:stmt{s}", f"{path} row {r} column 'sql_text' (statement {s})")
        for r, s, q in [(2, 1, "SELECT 1"), (2, 2, 'SELECT "a,b"'), (5, 1, "SELECT 4"), (7, 1, "SELECT 6")]
    ]


def test_csv_dir_with_delimiter(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.csv").write_text("k|q\n1|A\n2|B;C\n")
    (tmp_path / "d" / "b.csv").write_text("k|q\n1|\n2|D\n")
    (tmp_path / "c.txt").write_text("k|q\n1|X\n")
    got = rows(files.csv_dirs(spark, [str(tmp_path)], "q", "|"), "source_path", "row_number", "query_text")
    assert [(p.split("/")[-1], r, q) for p, r, q in got] == [
        ("a.csv", 2, "A"), ("a.csv", 3, "B"), ("a.csv", 3, "C"), ("b.csv", 3, "D"),
    ]


def test_csv_errors(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="available: a, b"):
        files.csv_column(spark, f"{path}:c")
    with pytest.raises(ValueError, match="PATH:COLUMN"):
        files.csv_column(spark, "nothing")


def test_all_inputs_keep_order_and_repeats(spark, tmp_path):
    (tmp_path / "one.sql").write_text("S1")
    (tmp_path / "q.csv").write_text("t\nC1\n")
    sql, csv = str(tmp_path / "one.sql"), str(tmp_path / "q.csv")
    got = files.all_inputs(
        spark, files=[sql, str(tmp_path)], dirs=[str(tmp_path)], csv_specs=[f"{csv}:t"],
        csv_directories=[str(tmp_path)], csv_dir_column="t",
    )
    assert rows(got, "input_ordinal", "query_text") == [
        (0, "S1"), (1, "S1"), (2, "S1"), (3, "C1"), (4, "C1"),
    ]
    near = files.all_inputs(
        spark, files=[sql], csv_specs=[f"{csv}:t"], relative_to=str(tmp_path)
    )
    assert rows(near, "identifier", "source_path") == [
        ("one.sql:1", "one.sql"), ("q.csv:row2:stmt1", "q.csv"),
    ]
    with pytest.raises(ValueError):
        files.all_inputs(spark, csv_directories=["x"])
    with pytest.raises(ValueError):
        files.all_inputs(spark)


def test_payloads_and_outcomes(spark, tmp_path):
    table = "urn:li:dataset:(urn:li:dataPlatform:teradata,db.s.t,PROD)"
    answers = {
        "1.json": {"identifier": "i1", "querytype": "QueryType.INSERT", "in_tables": [table], "out_tables": None},
        "2.json": {"identifier": "i2", "query_type": "UNKNOWN", "debug_info": {"error": "Expecting ). Line 2", "confidence": 0.2}},
        "3.json": {"identifier": "i3", "error": "HTTPError: 401", "in_tables": [table], "query_type": "SELECT"},
    }
    for name, answer in answers.items():
        (tmp_path / name).write_text(json.dumps(answer, indent=2))
    texts = spark.createDataFrame(
        [("i1", "INSERT INTO x SELECT 1"), ("i2", "SEL 1"), ("i3", "DELETE FROM t"), ("i4", "END")],
        "identifier string, query_text string",
    )
    got = statements.outcomes(texts, files.payloads(spark, str(tmp_path)))
    result = {r["identifier"]: r for r in got.collect()}
    assert [(result[i]["statement_type"], result[i]["statement_type_source"], result[i]["flags"]) for i in sorted(result)] == [
        ("INSERT", "parser", ["GAP"]), ("SELECT", "fallback", ["ERR"]),
        ("DELETE", "fallback", ["ERR"]), ("END", "fallback", []),
    ]
    assert result["i3"]["upstreams"] == [] and result["i3"]["parser_statement_type"] is None
    assert result["i4"]["succeeded"] is None and result["i4"]["timing_ms"] is None
    assert result["i1"]["raw_query_type"] == "QueryType.INSERT"


TABLE = "urn:li:dataset:(urn:li:dataPlatform:teradata,db.s.t,PROD)"


def test_files_to_records(spark, tmp_path):
    """Scripts and answers from files up to metadata records; one answer missing, one malformed."""
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "a.sql").write_text("\ufeffINSERT INTO t SELECT 1; MERGE INTO t; SEL 2;")
    lines = [
        json.dumps({"identifier": "a.sql:1", "queryType": "", "query_type": " ", "querytype": "MERGE",
                    "in_tables": [], "out_tables": [TABLE], "debug_info": {"table_error": True}, "timing_ms": 5.0}),
        "{ no json", json.dumps({"query_type": "SELECT"}),
    ]
    (tmp_path / "answers.json").write_text("\n".join(lines))
    answers = str(tmp_path / "answers.json")
    texts = files.sql_dirs(spark, [str(tmp_path / "sql")], relative_to=str(tmp_path / "sql"))
    assert rows(texts, "identifier", "query_text")[0] == ("a.sql:1", "INSERT INTO t SELECT 1")
    assert files.malformed_payloads(spark, answers, multi_line=False).count() == 2
    got = statements.outcomes(texts, files.payloads(spark, answers, multi_line=False)).persist()
    first = {r["identifier"]: r for r in got.collect()}
    assert first["a.sql:1"]["statement_type"] == "MERGE" and first["a.sql:1"]["table_error"] is True
    assert [first[f"a.sql:{i}"]["succeeded"] for i in (1, 2, 3)] == [True, None, None]
    assert got.selectExpr("percentile(timing_ms, 0.5)").first()[0] == 5.0
    records = metadata.metadata_records(got, SETTINGS).collect()
    assert {r["aspect_name"] for r in records} >= {"dataFlowInfo", "dataJobInfo"}
    assert metadata.jobs(got, SETTINGS).count() >= 1


def test_dynamic_table_reads_the_named_table(spark):
    w = Workload(spark, "/root/testdata/sf0.001")
    both = [procedures.dynamic_table(w, name).count() for name in ("customers", "customers_archive")]
    assert both[0] == w.people().count() > both[1] > 0
    with pytest.raises(ValueError):
        procedures.dynamic_table(w, "orders")


def test_expected_results(spark, tmp_path):
    one = {"in_tables": ["a"], "out_tables": []}
    (tmp_path / "01_x.json").write_text(json.dumps(one, indent=1))
    (tmp_path / "02_y.json").write_text(json.dumps([one, {"in_tables": ["b"]}], indent=1))
    got = rows(files.expected_results(spark, str(tmp_path)), "query_id", "stmt_index", "in_tables")
    assert got == [("01_x", 1, ["a"]), ("02_y", 1, ["a"]), ("02_y", 2, ["b"])]


def test_expected_results_meet_statements_by_stem_and_number(spark, tmp_path):
    (tmp_path / "two.json").write_text('[{"in_tables": ["a"]}, {"out_tables": ["b"]}]')
    (tmp_path / "one.json").write_text('{"in_tables": ["c"], "out_tables": ["d"]}')
    said = spark.createDataFrame(
        [
            ("x", "sql/two.sql", 1, ["a"], []), ("y", "sql/two.sql", 2, [], ["z"]),
            ("w", "sql/one.sql", 1, ["c"], ["d"]), ("v", "other", 1, ["c"], []),
        ],
        "identifier string, source_path string, stmt_index long, upstreams array<string>, "
        "downstreams array<string>",
    ).withColumn("column_edges", F.array().cast("array<string>"))
    wanted = analysis.expectations(said, files.expected_results(spark, str(tmp_path)))
    checked = analysis.validated(said, wanted)
    got = {r["identifier"]: (r["validation_status"], r["tables_missing"]) for r in checked.collect()}
    assert got == {
        "x": ("match", []), "y": ("mismatch", ["b"]), "w": ("match", []),
        "v": ("no_expectation", None),
    }


def test_statement_records_hold_the_answer_as_it_came(spark):
    said = {"identifier": "a", "query_type": "SELECT", "joins": [{"on": ["x"]}], "in_tables": ["t"]}
    texts = spark.createDataFrame([(json.dumps(said),)], "value string")
    asked = spark.createDataFrame(
        [("a", "SELECT 1", "f.sql"), ("b", "SELECT 2", "f.sql")],
        "identifier string, query_text string, source_path string",
    )
    found = statements.outcomes(asked, files.payload_from_text(texts))
    records = {r["identifier"]: json.loads(r["record"]) for r in reports.statement_records(found).collect()}
    assert records["a"]["raw_payload"] == said
    assert "raw_payload" not in records["b"] and records["b"]["source_query"] == "SELECT 2"


def _random_csv(rng, order):
    """Records with quotes, delimiters and line breaks in cells, stray quotes, and empty lines."""
    parts = ["a", "b c", ",", '"', "\n", "\r\n", ";", "é", "SELECT 1", "", " "]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
    writer.writerow(order)
    for i in range(rng.randint(50, 400)):
        cell = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        values = {"id": i, "sql_text": cell, 'no,te "x"': rng.choice(["n", 'q"q', "x\ny"])}
        writer.writerow([values[c] for c in order])
        if rng.random() < 0.1:
            out.write(rng.choice(["\n", "9\n", '7,5" pipe,b"c\n']))
    return out.getvalue()


@pytest.mark.parametrize("block", [None, 700])
def test_csv_blocks_equal_a_plain_reader(spark, tmp_path, block):
    """Cut anywhere, with other columns in every file, as the csv module reads them whole."""
    rng, want = random.Random(block), []
    orders = [["id", "sql_text", 'no,te "x"'], ["sql_text", 'no,te "x"', "id"], ['no,te "x"', "sql_text"]]
    for f in range(6):
        text = _random_csv(rng, orders[f % 3])
        (tmp_path / f"{f}.csv").write_bytes((b"\xef\xbb\xbf" if f == 4 else b"") + text.encode())
        records = csv.reader(io.StringIO(text.replace("\r\n", "\n"), newline=""))
        at = next(records).index("sql_text")
        filled = [r for r in records if r]
        want += [(f"{f}.csv", k, r[at] if at < len(r) else None) for k, r in enumerate(filled, 1)]
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        found = column_cells(spark, [str(tmp_path)], "sql_text", recursive=True)
        got = [(r["path"].split("/")[-1], r["number"], r["cell"]) for r in found.collect()]
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tasks > 20 or not block


def test_csv_one_record_over_many_blocks(spark, tmp_path):
    long = "\n".join(f"line {i}, with more" for i in range(3000))
    (tmp_path / "q.csv").write_text(f'k,t\n1,"{long}"\n2,x\n3,"open till the\nend')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        got = {r["number"]: r["cell"] for r in column_cells(spark, [str(tmp_path / "q.csv")], "t").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {1: long, 2: "x", 3: "open till the\nend"}


def test_csv_file_without_the_column_is_named(spark, tmp_path):
    (tmp_path / "good.csv").write_text("q,k\nS1,1\n")
    (tmp_path / "bad.csv").write_text("k,other\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match=r"'q' not found in .*bad\.csv; available: k, other"):
        files.csv_dirs(spark, [str(tmp_path)], "q")
