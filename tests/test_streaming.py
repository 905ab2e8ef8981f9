"""Incremental loading: every statement once, over two runs."""

from __future__ import annotations

from stmtlens.streaming.ingest import append_statements, statement_stream


def test_two_runs_load_each_file_once(spark, tmp_path):
    source, table, marks = tmp_path / "in", tmp_path / "out", tmp_path / "marks"
    source.mkdir()
    (source / "a.sql").write_text("SEL 1; DELETE FROM t")

    def run():
        stream = statement_stream(spark, str(source))
        append_statements(stream, str(table), str(marks)).awaitTermination()
        rows = spark.read.parquet(str(table)).select("identifier", "inferred_type").collect()
        return sorted((r[0].split("/")[-1], r[1]) for r in rows)

    first = [("a.sql:1", "SELECT"), ("a.sql:2", "DELETE")]
    assert run() == first
    (source / "b.sql").write_text("CREATE VIEW v AS SELECT 1")
    assert run() == [*first, ("b.sql:1", "CREATE_VIEW")]
