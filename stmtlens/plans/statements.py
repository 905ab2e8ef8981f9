"""Statement, lineage, metadata, report and analysis queries over the statement log."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stmtlens.functions import lineage as lin
from stmtlens.functions import rewrite as rw
from stmtlens.functions import text as tx
from stmtlens.functions import urns
from stmtlens.operators import analysis, ledger, lineage, metadata, patterns, reports, statements
from stmtlens.sinks import reports as report_sinks
from stmtlens.sinks import sending
from stmtlens.sinks import tables as table_sinks
from stmtlens.sources import files
from stmtlens.sources import statement_log as log
from stmtlens.sources.workload import Workload
from stmtlens.session import fresh_path


def _sorted(values: str | Column) -> Column:
    """A list as one sorted text, for comparison."""
    return F.array_join(F.array_sort(values), ",")


def _joined(values: str | Column) -> Column:
    return F.array_join(values, ",")


def _pairs(values: str | Column) -> Column:
    """A string map as sorted ``key=value`` text."""
    entries = F.transform(F.map_entries(values), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.array_join(F.array_sort(entries), "|")


# --- sources ------------------------------------------------------------------------------


SCRIPTS_PER_FILE = 1000


def _batch() -> Column:
    return F.floor(F.col("script_id") / SCRIPTS_PER_FILE)


def _in_files(spark: SparkSession, folder: str) -> DataFrame:
    """Scripts in the order of their numbers, a bounded number for each file to write."""
    return (
        log.scripts(spark, folder)
        .withColumn("batch", _batch())
        .repartition("batch")
        .sortWithinPartitions("batch", "script_id")
    )


def _script_files(spark: SparkSession, folder: str) -> str:
    path = fresh_path(spark, "scripts")
    text = F.concat("script_text", F.lit(";"))
    _in_files(spark, folder).select(text.alias("value"), "batch").write.partitionBy("batch").text(path)
    return path


def _script_csv(spark: SparkSession, folder: str) -> str:
    path = fresh_path(spark, "script_csv")
    table = _in_files(spark, folder).select(
        "script_id", F.col("script_text").alias("sql_text"), "batch"
    )
    writer = table.write.partitionBy("batch").option("header", True)
    writer.option("escape", '"').option("quoteAll", True).csv(path)
    return path


PLACES = ["identifier", "context", "source_path"]


def _named_by_batch(loaded: DataFrame) -> DataFrame:
    """The writer gives files a random name; only their folder is told."""
    return loaded.withColumns(
        {c: F.regexp_replace(c, r"part-[^/: ]*", "part") for c in PLACES}
    )


LOADED = [
    "input_ordinal", "origin", "identifier", "context", "source_path", "row_number", "stmt_index",
    "query_text",
]


def _loaded(rows: DataFrame) -> DataFrame:
    return _named_by_batch(rows).select(*LOADED)


def src_sql_file(spark: SparkSession, folder: str) -> DataFrame:
    path = _script_files(spark, folder)
    return _loaded(files.sql_files(spark, [f"{path}/batch=*/*.txt"], relative_to=path))


def src_sql_dir(spark: SparkSession, folder: str) -> DataFrame:
    path = _script_files(spark, folder)
    return _loaded(files.sql_dirs(spark, [path], "*.txt", relative_to=path))


def src_csv_column(spark: SparkSession, folder: str) -> DataFrame:
    path = _script_csv(spark, folder)
    return _loaded(files.csv_column(spark, f"{path}:sql_text", relative_to=path))


def src_csv_dir(spark: SparkSession, folder: str) -> DataFrame:
    path = _script_csv(spark, folder)
    return _loaded(files.csv_dirs(spark, [path], "sql_text", relative_to=path))


def src_csv_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Files of one folder in which the column stands at different places."""
    path = fresh_path(spark, "script_csv")
    table = _in_files(spark, folder).select("script_id", F.col("script_text").alias("sql_text"), "batch")
    note = F.format_string('he said "%s",\nfrom %s', "script_id", "batch").alias("a note")
    kinds = [["script_id", "sql_text"], [note, "sql_text", "script_id"], ["sql_text", note]]
    for k, columns in enumerate(kinds):
        part = table.where(F.col("batch") % len(kinds) == k).select(*columns, "batch")
        writer = part.write.mode("append").partitionBy("batch").option("header", True)
        writer.option("escape", '"').option("quoteAll", True).csv(path)
    return _loaded(files.csv_dirs(spark, [path], "sql_text", relative_to=path))


def src_union_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """All four kinds of input: the file of the first scripts, a folder, and a column twice."""
    scripts, table = _script_files(spark, folder), _script_csv(spark, folder)
    first = spark.read.text(f"{scripts}/batch=0").inputFiles()
    loaded = files.all_inputs(
        spark, files=first, dirs=[scripts], csv_specs=[f"{table}:sql_text"],
        csv_directories=[table], csv_dir_column="sql_text", pattern="*.txt",
    )
    below = r"^.*?(batch=\d+/)"
    inside = {c: F.regexp_replace(c, below, "$1") for c in PLACES}
    return _loaded(loaded.withColumns(inside))


def _loaded_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Scripts and answers through files. Second statements have no answer, and one is no JSON."""
    scripts, answers = _script_files(spark, folder), fresh_path(spark, "answers")
    in_file = Window.partitionBy(_batch()).orderBy("script_id", "stmt_index")
    number = F.row_number().over(in_file).cast("string")
    identifier = F.concat(F.lit("batch="), _batch().cast("string"), F.lit("/part:"), number)
    said = log.payload_table(spark, folder, identifier).where(F.col("debug_info.confidence").isNotNull())
    said.select(F.to_json(F.struct("*")).alias("value")).write.text(answers)
    spark.range(1).select(F.lit("no answer at all").alias("value")).write.mode("append").text(answers)
    loaded = _named_by_batch(files.sql_dirs(spark, [scripts], "*.txt", relative_to=scripts))
    return statements.outcomes(loaded, files.payloads(spark, answers, multi_line=False))


def e2e_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """From script files and answer files to outcomes."""
    return _loaded_outcomes(spark, folder).select(
        "identifier", "answered", "succeeded", "statement_type", "statement_type_source",
        "timing_ms", "raw_query_type", _joined("flags").alias("flags"),
        _sorted("upstreams").alias("upstreams"), _sorted("downstreams").alias("downstreams"),
    )


def e2e_records(spark: SparkSession, folder: str) -> DataFrame:
    """From script files and answer files to the records of flows and jobs, and what is in them."""
    records = metadata.metadata_records(_loaded_outcomes(spark, folder), SETTINGS)
    said = lambda path: F.get_json_object("aspect_json", f"$.{path}")
    return records.select(
        "phase", "entity_urn", "aspect_name", said("name").alias("name"),
        said("custom_properties.sqlParserQueryType").alias("query_type"),
        _sorted(F.from_json(said("input_datasets"), "array<string>")).alias("inputs"),
        _sorted(F.from_json(said("output_datasets"), "array<string>")).alias("outputs"),
    )


def split_statements(spark: SparkSession, folder: str) -> DataFrame:
    return statements.split_statements(log.scripts(spark, folder)).select(
        "script_id", "stmt_index", "query_text"
    )


def src_lineage_payload(spark: SparkSession, folder: str) -> DataFrame:
    """Answers written as JSON lines, read with the fixed schema and joined to the statements."""
    path = fresh_path(spark, "payload")
    log.payload_table(spark, folder).write.json(path)
    loaded = files.payloads(spark, path, multi_line=False)
    plain = log.statements(spark, folder).select("identifier", "query_text", "source_path")
    joined = statements.outcomes(plain, loaded)
    return joined.select(
        "identifier", "statement_type", "statement_type_source", "parser_error", "rpc_error",
        _sorted("upstreams").alias("upstreams"), _sorted("downstreams").alias("downstreams"),
        _joined("flags").alias("flags"), "confidence", "timing_ms",
    )


def src_malformed_payload(spark: SparkSession, folder: str) -> DataFrame:
    """What among the answer files answers no statement: every seventh text is broken."""
    path = fresh_path(spark, "payload")
    rows = log.scripts(spark, folder).select("script_id")
    number = F.col("script_id").cast("string")
    broken = (
        F.when(F.col("script_id") % 4 == 0, F.concat(F.lit("{ no json "), number))
        .when(F.col("script_id") % 4 == 1, F.concat(F.lit("["), number, F.lit("]")))
        .when(F.col("script_id") % 4 == 2, F.concat(F.lit('{"query_type": "SELECT", "n": '), number, F.lit("}")))
        .otherwise(F.concat(F.lit('{"identifier": null, "n": '), number, F.lit("}")))
    )
    whole = F.concat(F.lit('{"identifier": "'), number, F.lit('", "timing_ms": "much", "in_tables": 3}'))
    rows.select(F.when(F.col("script_id") % 7 == 0, broken).otherwise(whole).alias("value")).write.text(path)
    answered = files.payloads(spark, path, multi_line=False).agg(
        F.lit("answered").alias("value"), F.count(F.lit(1)).alias("n")
    )
    return files.malformed_payloads(spark, path, multi_line=False).select(
        "value", F.lit(1).cast("bigint").alias("n")
    ).unionByName(answered)


def src_expected_results(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON document per script: an object, or an array where a script has two statements."""
    rows = log.outcomes(spark, folder).where(F.col("stmt_index") == 1)
    one = F.to_json(
        F.struct(
            F.col("upstreams").alias("in_tables"), F.col("downstreams").alias("out_tables"),
            "column_lineage",
        )
    )
    document = F.when(
        F.col("template") == 11, F.concat(F.lit("["), one, F.lit(","), one, F.lit("]"))
    ).otherwise(one)
    loaded = files.expected_from_text(rows.select("script_id", document.alias("document")))
    return loaded.select(
        "script_id", "stmt_index", _sorted("in_tables").alias("in_tables"),
        _sorted("out_tables").alias("out_tables"),
        _sorted(lin.column_edges(F.col("column_lineage"))).alias("edges"),
    )


# --- text scalars ---------------------------------------------------------------------------


def _per_statement(spark: SparkSession, folder: str, **columns: Column) -> DataFrame:
    rows = log.statements(spark, folder)
    return rows.select("identifier", *[value.alias(name) for name, value in columns.items()])


def clean_sql(spark, folder):
    return _per_statement(spark, folder, clean_text=tx.clean_sql(F.col("query_text")))


def leading_tokens(spark, folder):
    tokens = tx.leading_tokens(tx.clean_sql(F.col("query_text")))
    return _per_statement(spark, folder, tokens=F.array_join(tokens, " "))


def infer_statement_type(spark, folder):
    rows = statements.with_inferred_type(log.statements(spark, folder))
    return rows.select("identifier", "inferred_type")


def normalize_type_label(spark, folder):
    return _per_statement(spark, folder, type_label=tx.type_label(F.col("parser_type_raw")))


def parser_statement_type(spark, folder):
    blank = F.when(F.col("user_id") % 2 == 0, F.lit("  "))
    label = tx.reported_type(blank, F.col("parser_type_raw"), F.col("event_type"))
    return _per_statement(spark, folder, parser_statement_type=label)


def resolve_statement_type(spark, folder):
    rows = statements.with_inferred_type(log.statements(spark, folder))
    label = tx.type_label(F.col("parser_type_raw"))
    kind, source = tx.resolved_type(label, F.col("inferred_type"))
    return rows.select(
        "identifier", kind.alias("statement_type"), source.alias("statement_type_source")
    )


def normalize_error_label(spark, folder):
    return _per_statement(
        spark, folder,
        parser_label=tx.error_label(F.col("parser_error")),
        rpc_label=tx.error_label(F.col("rpc_error")),
        odd_label=tx.error_label(F.concat(F.lit(" <"), F.col("parser_error"))),
    )


def status_label(spark, folder):
    return _per_statement(
        spark, folder, status=tx.status_label(F.col("rpc_error"), F.col("parser_error"))
    )


def sanitize_component(spark, folder):
    return _per_statement(
        spark, folder,
        component=tx.sanitized_component(F.concat(F.lit("_/"), "query_text", F.lit("/_"))),
    )


def sanitize_identifier(spark, folder):
    return _per_statement(
        spark, folder,
        short_id=tx.sanitized_identifier(F.col("context"), "sql_parser_job"),
        long_id=tx.sanitized_identifier(F.repeat("query_text", 6), "sql_parser_job"),
    )


def relative_source_label(spark, folder):
    return _per_statement(
        spark, folder,
        below=tx.relative_label(F.col("source_path"), "queries/click"),
        windows=tx.relative_label(F.translate("source_path", "/", "\\"), "queries"),
    )


def truncate_property(spark, folder):
    return _per_statement(
        spark, folder,
        whole=tx.truncated_property(F.col("query_text")),
        cut=tx.truncated_property(F.repeat(F.concat("query_text", F.lit(" \n ")), 8)),
    )


def query_preview(spark, folder):
    return _per_statement(
        spark, folder,
        preview=tx.query_preview(F.col("query_text")),
        long_preview=tx.query_preview(F.repeat(F.concat("query_text", F.lit("\n\n")), 8)),
    )


# --- lineage ----------------------------------------------------------------------------------


def column_edges(spark, folder):
    return lineage.column_edge_rows(log.outcomes(spark, folder))


def table_edges(spark, folder):
    return lineage.table_edge_rows(log.outcomes(spark, folder))


def self_reference(spark, folder):
    return log.outcomes(spark, folder).select("identifier", "self_referential")


def statement_flags(spark, folder):
    return log.outcomes(spark, folder).select("identifier", _joined("flags").alias("flags"))


def flag_prefix(spark, folder):
    extra = F.concat(F.array(F.lit("ZZ"), F.lit("AA")), F.reverse("flags"))
    return log.outcomes(spark, folder).select(
        "identifier",
        lin.flag_prefix(F.col("flags")).alias("prefix"),
        lin.flag_prefix(extra).alias("prefix_with_extras"),
    )


def source_flags(spark, folder):
    return reports.source_flags(log.outcomes(spark, folder)).select(
        "source_path", lin.flag_prefix(F.col("flags")).alias("flags")
    )


def dataset_columns(spark, folder):
    pairs = lineage.dataset_columns(log.outcomes(spark, folder))
    return lineage.dataset_fields(pairs).select("dataset", _joined("columns").alias("columns"))


def dataset_scaffolds(spark, folder):
    pairs = lineage.dataset_columns(log.outcomes(spark, folder))
    return lineage.dataset_scaffolds(pairs).select(
        "dataset", "name", "platform", "cluster",
        F.array_join(
            F.transform("fields", lambda f: F.concat_ws(":", f["field_path"], f["native_data_type"])),
            ",",
        ).alias("fields"),
        "auto_created_by",
    )


def missing_datasets(spark, folder):
    pairs = lineage.dataset_columns(log.outcomes(spark, folder))
    known = log.known_datasets(spark, folder)
    return lineage.dataset_fields(lineage.missing_datasets(pairs, known)).select(
        "dataset", F.size("columns").cast("bigint").alias("n_columns")
    )


def fine_grained_lineage(spark, folder):
    return lineage.fine_grained_rows(log.outcomes(spark, folder)).withColumn(
        "upstream_fields", _sorted("upstream_fields")
    )


def urn_build_parse(spark, folder):
    rows = log.statements(spark, folder)
    table = F.concat(F.lit("t"), F.col("user_id").cast("string"))
    name = (
        F.when(F.col("script_id") % 3 == 0, table)
        .when(F.col("script_id") % 3 == 1, F.concat(F.lit("s."), table))
        .otherwise(F.concat(F.lit("db.s."), table))
    )
    full = urns.qualified_name(name, "maindb", "core")
    urn = urns.dataset_urn(full, "teradata", "DEV")
    return rows.select("identifier", urn.alias("urn")).select(
        "identifier", "urn",
        urns.dataset_platform(F.col("urn")).alias("platform"),
        urns.dataset_name(F.col("urn")).alias("name"),
        urns.dataset_env(F.col("urn")).alias("env"),
        urns.schema_field_urn(F.col("urn"), F.lit("a")).alias("field_urn"),
    )


def table_refs(spark, folder):
    refs = lin.table_refs(tx.clean_sql(F.col("query_text")))
    return _per_statement(spark, folder, _refs=refs).select(
        "identifier",
        _joined("_refs.upstreams").alias("upstreams"),
        _joined("_refs.downstreams").alias("downstreams"),
    )


# --- metadata records ----------------------------------------------------------------------


SETTINGS = metadata.RecordSettings(flow_prefix="nightly", base_dir="queries")


def flows(spark, folder):
    return metadata.flows(log.outcomes(spark, folder), SETTINGS).withColumn(
        "custom_properties", _pairs("custom_properties")
    )


def jobs(spark, folder):
    return metadata.jobs(log.outcomes(spark, folder), SETTINGS).withColumn(
        "custom_properties", _pairs("custom_properties")
    )


def job_io(spark, folder):
    fields = F.transform(
        "fine_grained",
        lambda e: F.concat_ws(">", F.array_join(e["upstream_fields"], "+"), e["downstream_field"]),
    )
    return metadata.job_io(log.outcomes(spark, folder), SETTINGS).select(
        "job_urn",
        _sorted("input_datasets").alias("inputs"),
        _sorted("output_datasets").alias("outputs"),
        _sorted(fields).alias("fine_grained"),
    )


def collect_gate(spark, folder):
    """Datasets count for all results, jobs only for writing statements."""
    rows = log.outcomes(spark, folder)
    failed = ~F.col("succeeded")
    writes = F.size("downstreams") > 0
    names = rows.select(F.explode(F.concat("upstreams", "downstreams")).alias("dataset"))
    per_status = rows.groupBy(writes.alias("has_job")).agg(
        F.count(F.lit(1)).alias("statements"), F.count_if(failed).alias("failed")
    )
    seen = names.agg(F.countDistinct("dataset").alias("statements")).select(
        F.lit(None).cast("boolean").alias("has_job"), "statements",
        F.lit(0).cast("bigint").alias("failed"),
    )
    return per_status.unionByName(seen)


def emission_plan(spark, folder):
    plan = metadata.emission_plan(
        log.outcomes(spark, folder), log.known_datasets(spark, folder), SETTINGS
    )
    return plan.groupBy("phase", "aspect_name", "entity_urn").agg(F.count(F.lit(1)).alias("n"))


def emitted_entities(spark, folder):
    records = metadata.metadata_records(log.outcomes(spark, folder), SETTINGS)
    return metadata.emitted_entities(records)


# --- reports ----------------------------------------------------------------------------------


def run_overview(spark, folder):
    return reports.run_overview(log.outcomes(spark, folder))


def source_overview(spark, folder):
    return reports.source_overview(log.outcomes(spark, folder))


def error_summary(spark, folder):
    return reports.error_summary(log.outcomes(spark, folder))


def type_metrics(spark, folder):
    rates = {c: F.round(c, 6) for c in ["success_rate", "error_rate"]}
    return reports.type_metrics(log.outcomes(spark, folder)).withColumns(rates)


def timing_summary(spark, folder):
    rows = reports.timing_summary(log.outcomes(spark, folder))
    return rows.withColumns({c: F.round(c, 6) for c in reports.TIMING_COLUMNS})


def percentile_linear(spark, folder):
    quantiles = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    found = reports.run_percentiles(log.outcomes(spark, folder), quantiles)
    return found.withColumns({c: F.round(c, 6) for c in quantiles})


def flag_counts(spark, folder):
    return reports.flag_counts(log.outcomes(spark, folder))


def error_class_counts(spark, folder):
    return reports.by_type_frequency(
        reports.error_class_counts(log.outcomes(spark, folder)), "error_class"
    )


def parser_error_counts(spark, folder):
    return reports.by_type_frequency(
        reports.parser_error_counts(log.outcomes(spark, folder)), "parser_error"
    )


def source_breakdown(spark, folder):
    return reports.source_breakdown(log.outcomes(spark, folder))


def reported_labels(spark, folder):
    return reports.by_type_frequency(
        reports.reported_labels(log.outcomes(spark, folder)), "parser_label"
    )


def report_header(spark, folder):
    return reports.report_header(log.outcomes(spark, folder))


def type_overview_table(spark, folder):
    return reports.type_overview_table(log.outcomes(spark, folder))


def multi_scope_report(spark, folder):
    return reports.multi_scope_report(log.outcomes(spark, folder))


def query_list(spark, folder):
    return reports.query_list(log.outcomes(spark, folder)).withColumn("flags", _joined("flags"))


# --- documented analyses --------------------------------------------------------------------


def complexity_metrics(spark, folder):
    rows = log.statements(spark, folder).select("identifier", "query_text")
    return analysis.complexity_metrics(rows).drop("query_text")


def _expected(rows: DataFrame) -> DataFrame:
    """Expected results from their JSON documents, by file stem and statement number."""
    loaded = files.expected_from_text(log.expected_documents(rows))
    return analysis.expectations(rows, loaded, path="test_path")


def _validated(spark, folder):
    rows = log.outcomes(spark, folder)
    return analysis.validated(rows, _expected(rows))


def validate_tables(spark, folder):
    return _validated(spark, folder).select(
        "identifier",
        F.round("tables_precision", 6).alias("tables_precision"),
        F.round("tables_recall", 6).alias("tables_recall"),
        _joined("tables_missing").alias("tables_missing"),
        _joined("tables_extra").alias("tables_extra"),
    )


def validate_columns(spark, folder):
    return _validated(spark, folder).select(
        "identifier",
        F.round("columns_precision", 6).alias("columns_precision"),
        F.round("columns_recall", 6).alias("columns_recall"),
        _joined("columns_missing").alias("columns_missing"),
        _joined("columns_extra").alias("columns_extra"),
    )


def validation_status(spark, folder):
    return _validated(spark, folder).select("identifier", "validation_status")


def validation_summary(spark, folder):
    summary = analysis.validation_summary(_validated(spark, folder))
    return summary.withColumns(
        {c: F.round(c, 6) for c in summary.columns if c.startswith("avg_")}
    )


RATES = ["success_rate", "high_confidence_rate", "column_lineage_rate", "avg_confidence"]


def overall_stats(spark, folder):
    rows = analysis.overall_stats(log.outcomes(spark, folder))
    return rows.withColumns({c: F.round(c, 6) for c in RATES})


def confidence_buckets(spark, folder):
    return analysis.confidence_buckets(log.outcomes(spark, folder))


def stats_by_category(spark, folder):
    rows = analysis.stats_by_category(log.outcomes(spark, folder), "test_path")
    return rows.withColumns({c: F.round(c, 6) for c in RATES})


def stats_by_type(spark, folder):
    rows = analysis.stats_by_type(log.outcomes(spark, folder))
    return rows.withColumns({c: F.round(c, 6) for c in RATES})


def complexity_impact(spark, folder):
    rows = analysis.complexity_impact(log.outcomes(spark, folder))
    return rows.withColumn("success_rate", F.round("success_rate", 6))


def error_analysis(spark, folder):
    return analysis.error_analysis(log.outcomes(spark, folder)).withColumn(
        "examples", _joined("examples")
    )


def threshold_gate(spark, folder):
    stats = analysis.stats_by_category(log.outcomes(spark, folder), "test_path")
    rows = analysis.threshold_gate(stats)
    return rows.withColumns({c: F.round(c, 6) for c in ["success_rate", "high_confidence_rate"]})


def low_confidence_filter(spark, folder):
    kept = analysis.confident_only(log.outcomes(spark, folder))
    return kept.select("identifier", "confidence")


def error_category(spark, folder):
    rows = analysis.error_categories(log.outcomes(spark, folder))
    return rows.withColumn("share_pct", F.round("share_pct", 6))


def error_patterns(spark, folder):
    """Every class of errors, by the pattern table with a class of its own added."""
    said = log.scripts(spark, folder).select(F.expr(log.ERROR_TEXT).alias("message"))
    own = (-1, 15, "Script Limit", "System Limits", "too many statements", r"^Script has too many statements: \d+")
    rows = patterns.class_counts(said, patterns.pattern_table(spark, [own]))
    return rows.withColumn("share_pct", F.round("share_pct", 6))


def error_layer(spark, folder):
    return analysis.error_layers(log.outcomes(spark, folder))


def _dialect_text() -> dict[str, Column]:
    """Statement texts that carry each dialect form."""
    text = F.col("query_text")
    return {
        "using": F.concat(F.lit("USING p (INTEGER), q (CHAR(4))\n"), text),
        "ct": F.concat(F.lit("ct db.s.x AS ("), text, F.lit(")")),
        "locking": F.concat(F.lit("Locking Table db.s.x For Access "), text),
        "named": F.concat(F.lit("SEL a (NAMED aa), b ( named bb ) FROM ("), text, F.lit(")")),
    }


def rewrite_using(spark, folder):
    return _per_statement(spark, folder, rewritten=rw.without_using(_dialect_text()["using"]))


def rewrite_ct(spark, folder):
    return _per_statement(spark, folder, rewritten=rw.expand_ct(_dialect_text()["ct"]))


def rewrite_locking(spark, folder):
    return _per_statement(spark, folder, rewritten=rw.without_locking(_dialect_text()["locking"]))


def rewrite_named(spark, folder):
    return _per_statement(spark, folder, rewritten=rw.named_to_alias(_dialect_text()["named"]))


def qualify_names(spark, folder):
    short = F.regexp_replace("query_text", r"\bdb\.s\.", "")
    rows = _per_statement(spark, folder, query_text=short)
    return analysis.qualified_refs(rows, "maindb", "core").select(
        "identifier",
        _joined("upstream_names").alias("upstream_names"),
        _joined("downstream_names").alias("downstream_names"),
    )


def generalize_fingerprint(spark, folder):
    return analysis.query_patterns(log.statements(spark, folder))


def extract_proc_statements(spark, folder):
    body = F.concat(
        F.lit("CREATE PROCEDURE db.s.p()\nBEGIN\n"), "script_text",
        F.lit(";\nIF x > 0 THEN UPDATE db.s.y SET a = 1; ELSEIF x < 0 THEN SET z = 1;"
              " ELSE DELETE FROM db.s.y; END IF;\nEND;"),
    )
    procedures = log.scripts(spark, folder).select("script_id", body.alias("body"))
    return analysis.procedure_statements(procedures)


def statement_filter(spark, folder):
    kept = analysis.may_carry_column_lineage(log.outcomes(spark, folder))
    return kept.select("identifier", "statement_type")


def template_placeholders(spark, folder):
    text = F.concat(
        "query_text", F.lit(" AND x = {{user_"), F.col("user_id").cast("string"),
        F.lit("}} AND y = ${v} AND z = :p1 AND w = @q AND v = ?"),
    )
    return _per_statement(
        spark, folder, found=_joined(rw.placeholders(text)), filled=rw.fill_placeholders(text)
    )


def trend_over_runs(spark, folder):
    rows = analysis.trend_over_runs(log.outcomes(spark, folder))
    rounded = ["success_rate", "avg_confidence", "success_change", "confidence_change"]
    return rows.withColumns({c: F.round(c, 6) for c in rounded})


# --- run ledger ---------------------------------------------------------------------------------


def _recorded(spark, folder) -> DataFrame:
    """A ledger of all runs, written in three parts, the second of them twice."""
    path = fresh_path(spark, "ledger")
    outcomes = log.outcomes(spark, folder)
    part = F.pmod(F.crc32(F.col("run_id").cast("binary")), F.lit(3))
    for k in (0, 1, 2, 1):
        ledger.record(outcomes.where(part == k), path)
    return ledger.read(spark, path)


def ledger_overview(spark, folder):
    """Totals by type over the runs of a ledger, from its rows alone."""
    rows = ledger.overview(_recorded(spark, folder), ["statement_type"])
    return rows.withColumns({c: F.round(c, 6) for c in ("success_rate", "avg_ms", "timing_ms_total")})


def ledger_trend(spark, folder):
    """The trend over runs, from ledger rows."""
    rounded = ["success_rate", "avg_confidence", "success_change", "confidence_change"]
    return ledger.trend(_recorded(spark, folder)).withColumns({c: F.round(c, 6) for c in rounded})


def percentile_sketch(spark, folder):
    """Percentiles by type from merged sketches, held against the ranks of all timings."""
    keys = ["statement_type"]
    found = ledger.percentile_estimates(_recorded(spark, folder), keys, [0.1, 0.5, 0.9, 0.95, 0.99])
    # A rank of a few values is as near as one value.
    near = F.col("rank_error") <= ledger.RANK_ERROR + 1 / F.col("timed")
    checked = ledger.rank_errors(found, log.outcomes(spark, folder), keys)
    return checked.select("statement_type", "quantile", "timed", near.alias("within_error"))


# --- sinks -------------------------------------------------------------------------------------


def sink_statement_json(spark, folder):
    path = fresh_path(spark, "records")
    report_sinks.write_statement_records(log.outcomes(spark, folder), path)
    back = spark.read.schema(
        "source_path string, identifier string, record string, source_flags string, source_bucket int"
    ).json(path)
    payload = (
        "raw_payload struct<query_type: string, in_tables: array<string>, out_tables: array<string>, "
        "debug_info: struct<confidence: double, error: string>, error: string>"
    )
    record = F.from_json("record", f"flags array<string>, source_query string, preview string, {payload}")
    raw = lambda name: F.col(f"_r.raw_payload.{name}")
    return back.select("identifier", "source_flags", record.alias("_r")).select(
        "identifier", "source_flags", _joined("_r.flags").alias("flags"), "_r.source_query", "_r.preview",
        raw("query_type").alias("query_type"), raw("debug_info.confidence").alias("confidence"),
        raw("debug_info.error").alias("parser_error"), raw("error").alias("rpc_error"),
        _sorted(raw("in_tables")).alias("in_tables"), _sorted(raw("out_tables")).alias("out_tables"),
    )


def _written_report(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write the report tables and read them back as (source, section, label, numbers) rows."""
    report_sinks.write_reports(tables, path)

    def back(name: str) -> DataFrame:
        table = tables[name]
        return table.sparkSession.read.schema(table.schema).json(f"{path}/{name}")

    none = F.lit(None).cast("bigint")
    summary = back("summary").select(
        "source_path", F.lit("summary").alias("section"),
        lin.flag_prefix(F.col("flags")).alias("label"), F.col("query_count").alias("n"),
        F.col("success_count").alias("ok"), F.round("timing_ms_total", 6).alias("ms"),
    )
    errors = back("errors").select("source_path", F.lit("error"), "message", "count", none, none)
    types = back("types").select(
        "source_path", F.lit("type"), "statement_type", "total_queries", "success_count",
        F.round("p95_ms", 6),
    )
    listed = back("queries").select(
        "source_path", F.lit("query"), "identifier",
        F.size("flags").cast("bigint"), F.col("succeeded").cast("bigint"), F.round("timing_ms", 6),
    )
    return summary.unionAll(errors).unionAll(types).unionAll(listed)


def sink_source_report(spark, folder):
    tables = report_sinks.source_reports(log.outcomes(spark, folder))
    return _written_report(tables, fresh_path(spark, "source_reports"))


def sink_run_report(spark, folder):
    tables = report_sinks.run_report(log.outcomes(spark, folder), "run")
    return _written_report(tables, fresh_path(spark, "run_report"))


def sink_results_table(spark, folder):
    path = fresh_path(spark, "results")
    rows = log.outcomes(spark, folder)
    table = report_sinks.results_table(rows, _expected(rows))
    report_sinks.write_results(table, path)
    back = (
        spark.read.schema(table.schema)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
    )
    ratios = ["tables_precision", "tables_recall", "columns_precision", "columns_recall"]
    return (
        back.withColumns({c: F.round(c, 6) for c in ratios})
        .groupBy(*[c for c in back.columns if c not in ("table_error",)])
        .agg(F.count(F.lit(1)).alias("n"))
    )


SENT_PART = 500


def sink_metadata_records(spark, folder):
    """Records laid out in sending order; every other part has been sent, the rest is read again."""
    path = fresh_path(spark, "metadata")
    place = ["source_path", "script_id", "stmt_index"]
    inputs = metadata.record_inputs(metadata.with_jobs(log.outcomes(spark, folder)), place)
    records = metadata.metadata_records(inputs, SETTINGS, place)
    sending.lay_out(records, metadata.sending_order(place), path, SENT_PART)
    parts = [r["part"] for r in sending.manifest(spark, path).select("part").collect()]
    sending.mark_sent(spark, path, [p for p in parts if p % 2 == 0])
    schema = "phase INT, entity_urn STRING, aspect_name STRING, aspect_json STRING, sequence BIGINT"
    said = lambda name: F.get_json_object("aspect_json", f"$.{name}")
    datasets = lambda name: _sorted(F.from_json(said(name), "array<string>"))
    return sending.unsent(spark, path, schema).select(
        "sequence", "phase", "entity_urn", "aspect_name", said("name").alias("name"),
        said("description").alias("description"), said("env").alias("env"),
        _pairs(F.from_json(said("custom_properties"), "map<string,string>")).alias("properties"),
        datasets("input_datasets").alias("inputs"), datasets("output_datasets").alias("outputs"),
    )


def _table_name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex}"


def sink_ctas(spark, folder):
    w = Workload(spark, folder)
    source = w.orders().select("order_id", "customer_id", "total_amount")
    return table_sinks.create_table_as(
        source, _table_name("orders_copy"), fresh_path(spark, "ctas")
    )


def sink_insert(spark, folder):
    """Insert by a column list: named columns by position, the others NULL."""
    w = Workload(spark, folder)
    name = _table_name("summary")
    first = w.customers().select("customer_id", "customer_name", "email", "status")
    table_sinks.create_table_as(
        first.where(F.col("status") == "ACTIVE"), name, fresh_path(spark, "insert")
    )
    added = w.employees().select(F.col("employee_id"), F.col("employee_name"))
    return table_sinks.insert_into(added, name, ["customer_id", "customer_name"])


def sink_view(spark, folder):
    w = Workload(spark, folder)
    joined = w.customers().select("customer_id", "customer_name").join(
        w.orders().select("customer_id", "order_id"), "customer_id", "left"
    )
    return table_sinks.create_view(joined, "stmtlens_customer_orders")


QUERIES = {
    function.__name__: function
    for function in [
        src_sql_file, src_sql_dir, src_csv_column, src_csv_dir, src_csv_headers, src_union_inputs,
        e2e_outcomes, e2e_records,
        split_statements, src_lineage_payload, src_malformed_payload, src_expected_results,
        sink_statement_json, sink_source_report, sink_run_report, sink_results_table,
        sink_metadata_records, sink_ctas, sink_insert, sink_view,
        clean_sql, leading_tokens, infer_statement_type, normalize_type_label,
        parser_statement_type, resolve_statement_type, normalize_error_label, status_label,
        sanitize_component, sanitize_identifier, relative_source_label, truncate_property,
        query_preview,
        column_edges, table_edges, self_reference, statement_flags, flag_prefix, source_flags,
        dataset_columns, dataset_scaffolds, missing_datasets, fine_grained_lineage,
        urn_build_parse, table_refs,
        flows, jobs, job_io, collect_gate, emission_plan, emitted_entities,
        run_overview, source_overview, error_summary, type_metrics, timing_summary,
        percentile_linear, flag_counts, error_class_counts, parser_error_counts,
        source_breakdown, reported_labels, report_header, type_overview_table,
        multi_scope_report, query_list,
        complexity_metrics, validate_tables, validate_columns, validation_status,
        validation_summary, overall_stats, confidence_buckets, stats_by_category,
        stats_by_type,
        complexity_impact, error_analysis, threshold_gate, low_confidence_filter,
        error_category, error_patterns, error_layer, rewrite_using, rewrite_ct, rewrite_locking, rewrite_named,
        qualify_names, generalize_fingerprint, extract_proc_statements, statement_filter,
        template_placeholders, trend_over_runs, ledger_overview, ledger_trend, percentile_sketch,
    ]
}
