"""Statement records, reports and metadata records as files.

Lists that grow with the log (the statements of a source) are written as rows next to the summary
record of the source, never nested into it: one source may hold a third of the log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtlens.functions import text as tx
from stmtlens.operators import analysis, reports
from stmtlens.operators.statements import succeeded
from stmtlens.session import written

SOURCE_BUCKETS = 64


def _bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def statement_records(outcomes: DataFrame, buckets: int = SOURCE_BUCKETS) -> DataFrame:
    """One JSON record per statement: flags, parser answer, text and preview.

    The answer is the one that was loaded, with all its keys; outcomes that were not loaded from
    texts have one made from their columns.
    """
    payload = F.struct(
        F.col("parser_statement_type").alias("query_type"),
        F.col("upstreams").alias("in_tables"),
        F.col("downstreams").alias("out_tables"),
        "column_lineage",
        F.struct("confidence", F.col("parser_error").alias("error")).alias("debug_info"),
        F.col("rpc_error").alias("error"),
    )
    raw = F.try_parse_json("raw_payload") if "raw_payload" in outcomes.columns else payload
    record = F.struct(
        "flags",
        raw.alias("raw_payload"),
        F.col("query_text").alias("source_query"),
        tx.query_preview(F.col("query_text")).alias("preview"),
    )
    return outcomes.select(
        _bucket(F.col("source_path"), buckets).alias("source_bucket"),
        "source_path",
        "identifier",
        F.to_json(record).alias("record"),
    )


def write_statement_records(
    outcomes: DataFrame, path: str, buckets: int = SOURCE_BUCKETS
) -> None:
    """A folder for each set of flags that a whole source has, in it one for each hash of sources.

    The flags of a source follow from all its statements, so they are found first and joined. A large
    bucket (one source may hold a third of the log) is split over several files by its size.
    """
    flags = reports.source_flags(outcomes).select(
        "source_path", F.array_join("flags", "-").alias("source_flags")
    )
    (
        statement_records(outcomes, buckets)
        .join(flags, "source_path")
        .hint("rebalance", "source_flags", "source_bucket")
        .write.partitionBy("source_flags", "source_bucket")
        .json(path)
    )


REPORT_INPUTS = [
    "source_path", "identifier", "query_text", "flags", "succeeded", "timing_ms", "parser_error",
    "rpc_error", "statement_type", "statement_type_source", "parser_statement_type",
]


def source_reports(outcomes: DataFrame, keys: Sequence[str] = ("source_path",)) -> dict[str, DataFrame]:
    """The report of each source, as tables keyed by the source.

    ``summary``: one row per source with flags and overview; ``errors``: one row per error class;
    ``types``: one row per statement type; ``queries``: one row per statement. Error classes, types
    and statements of one source are unbounded, so they are rows and not lists in the summary.
    What the tables show is written once, so that the texts are classified once and not for each.
    """
    keys = list(keys)
    columns = [*keys, *(name for name in REPORT_INPUTS if name not in keys)]
    outcomes = written(outcomes.select(*columns), "report_inputs")
    error_class = tx.error_label(F.col("parser_error")).alias("message")
    return {
        "summary": reports.source_summary(outcomes, keys),
        "errors": outcomes.groupBy(*keys, error_class).agg(F.count(F.lit(1)).alias("count")),
        "types": reports.type_report(outcomes, [*keys, "statement_type"]),
        "queries": reports.query_list(outcomes),
    }


def run_report(outcomes: DataFrame, run_name: str) -> dict[str, DataFrame]:
    """The same tables for the whole run, under the run's name."""
    return source_reports(outcomes.withColumn("source_path", F.lit(run_name)))


def write_reports(
    tables: dict[str, DataFrame], path: str, buckets: int = SOURCE_BUCKETS
) -> None:
    """One folder per table; statements by a hash of the source, large buckets split over files."""
    for name, table in tables.items():
        if name == "queries":
            (
                table.withColumn("source_bucket", _bucket(F.col("source_path"), buckets))
                .hint("rebalance", "source_bucket")
                .write.partitionBy("source_bucket")
                .json(f"{path}/{name}")
            )
        else:
            table.write.json(f"{path}/{name}")


RESULT_COLUMNS = [
    "query_id", "query_file", "statement_index", "statement_type", "dialect", "success",
    "confidence", "parse_time_ms", "in_tables_count", "out_tables_count", "column_lineage_count",
    "error_message", "table_error", "cte_count", "max_cte_depth", "subquery_count", "join_count",
    "union_count", "window_function_count", "line_count", "char_count", "validation_status",
    "tables_precision", "tables_recall", "columns_precision", "columns_recall",
]


def results_table(outcomes: DataFrame, expected: DataFrame, dialect: str = "teradata") -> DataFrame:
    """The flat result table: 13 core, 8 complexity and 5 validation columns."""
    checked = analysis.validated(analysis.complexity_metrics(outcomes), expected)
    message = F.coalesce(
        F.nullif(F.col("rpc_error"), F.lit("")), F.nullif(F.col("parser_error"), F.lit(""))
    )
    size = lambda name: F.size(name).cast("bigint")
    return checked.select(
        tx.file_stem(F.col("source_path")).alias("query_id"),
        F.col("source_path").alias("query_file"),
        F.col("stmt_index").alias("statement_index"),
        "statement_type",
        F.lit(dialect).alias("dialect"),
        succeeded(F.col("rpc_error"), F.col("parser_error")).alias("success"),
        "confidence",
        F.col("timing_ms").alias("parse_time_ms"),
        size("upstreams").alias("in_tables_count"),
        size("downstreams").alias("out_tables_count"),
        size("column_lineage").alias("column_lineage_count"),
        message.alias("error_message"),
        (F.col("table_error") if "table_error" in outcomes.columns else F.lit(None).cast("boolean")).alias("table_error"),
        *RESULT_COLUMNS[13:],
    )


def write_results(table: DataFrame, path: str, file_format: str = "csv") -> None:
    writer = table.write
    if file_format == "csv":
        # Quotes are doubled, so that texts with quotes and line breaks read back unchanged.
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.json(path)
