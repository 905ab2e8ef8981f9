"""Flow, job and dataset records for a metadata catalogue."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtlens import constants as K
from stmtlens.functions import lineage as lin
from stmtlens.functions import text as tx
from stmtlens.functions import urns
from stmtlens.operators import lineage as rows
from stmtlens.session import written


@dataclass(frozen=True)
class RecordSettings:
    orchestrator: str = K.DEFAULT_ORCHESTRATOR
    cluster: str = K.DEFAULT_ENV
    env: str = K.DEFAULT_ENV
    job_type: str = K.DEFAULT_JOB_TYPE
    flow_prefix: str = ""
    base_dir: str = ""


def _present_map(
    always: list[tuple[str, Column]], optional: list[tuple[str, Column]] = ()
) -> Column:
    """A string map; optional entries are left out where they are NULL."""
    entries = F.create_map(*[part for name, value in always for part in (F.lit(name), value)])
    nothing = F.create_map().cast("map<string,string>")
    extra = [
        F.when(value.isNotNull(), F.create_map(F.lit(name), value)).otherwise(nothing)
        for name, value in optional
    ]
    return F.map_concat(entries, *extra) if extra else entries


def with_jobs(outcomes: DataFrame) -> DataFrame:
    """Only statements that write somewhere become jobs; parser errors do not prevent that."""
    return outcomes.where(F.size("downstreams") > 0)


def _with_flow(df: DataFrame, settings: RecordSettings) -> DataFrame:
    """Add ``flow_id`` and ``flow_urn``. Both follow from the path, so jobs need no join to flows.

    Columns are added step by step: a text used twice is computed once.
    """
    label = tx.relative_label(F.col("source_path"), settings.base_dir)
    if settings.flow_prefix:
        label = F.concat(F.lit(f"{settings.flow_prefix}__"), label)
    return (
        df.withColumn("_flow_text", tx.identifier_text(label, "sql_parser_flow"))
        .withColumn("flow_id", tx.bounded_identifier(F.col("_flow_text")))
        .withColumn(
            "flow_urn", urns.flow_urn(F.col("flow_id"), settings.orchestrator, settings.cluster)
        )
        .drop("_flow_text")
    )


def _with_job(df: DataFrame, settings: RecordSettings) -> DataFrame:
    """Add ``flow_urn`` and ``job_urn``."""
    return (
        _with_flow(df, settings)
        .withColumn("_job_text", tx.identifier_text(F.col("identifier"), "sql_parser_job"))
        .withColumn(
            "job_urn", urns.job_urn(F.col("flow_urn"), tx.bounded_identifier(F.col("_job_text")))
        )
        .drop("_job_text")
    )


def flows(outcomes: DataFrame, settings: RecordSettings = RecordSettings()) -> DataFrame:
    """One flow per source path that has at least one job.

    Paths that differ only in replaced characters share a flow; the last path describes it.
    """
    path = F.col("source_path")
    label = tx.relative_label(path, settings.base_dir)
    parent = F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    paths = with_jobs(outcomes).select("source_path").distinct()
    optional = [("sqlParserFlowPrefix", F.lit(settings.flow_prefix))] if settings.flow_prefix else []
    described = _with_flow(paths, settings).select(
        "flow_urn",
        "source_path",
        F.when(name == "", F.col("flow_id")).otherwise(name).alias("name"),
        F.concat(F.lit("SQL lineage extracted from "), label).alias("description"),
        F.when(parent != "", parent)
        .when(path.startswith("/"), "/")
        .otherwise(".")
        .alias("project"),
        F.lit(settings.env).alias("env"),
        _present_map(
            [("sqlParserSourcePath", path), ("sqlParserFlowId", F.col("flow_id")), *optional]
        ).alias("custom_properties"),
    )
    record = F.struct(*[c for c in described.columns if c != "flow_urn"])
    return (
        described.groupBy("flow_urn")
        .agg(F.max_by(record, "source_path").alias("_flow"))
        .select("flow_urn", "_flow.*")
    )


def _job_rows(
    outcomes: DataFrame, settings: RecordSettings, place: Sequence[str] = ()
) -> DataFrame:
    """Everything the two records of a job hold, computed in one pass; ``place`` is carried along."""
    fine = lin.fine_grained(F.col("downstreams"), F.col("column_lineage"), F.col("confidence"))
    confidence = F.when(F.col("confidence").isNotNull(), F.format_string("%.6f", "confidence"))
    return (
        _with_job(with_jobs(outcomes), settings)
        .withColumn("preview", tx.query_preview(F.col("query_text")))
        .withColumn("_description", tx.truncated_property(F.col("context"), K.JOB_DESCRIPTION_LIMIT))
        .withColumn("_fine", fine)
        .select(
            *[F.col(name).alias(f"place_{name}") for name in place],
            "job_urn",
            "flow_urn",
            F.col("identifier").alias("name"),
            F.lit(settings.job_type).alias("type"),
            F.coalesce(F.nullif(F.col("_description"), F.lit("")), "preview").alias("description"),
            F.lit(settings.env).alias("env"),
            _present_map(
                [
                    ("sqlParserQueryIdentifier", F.col("identifier")),
                    ("sqlParserSource", F.col("source_path")),
                    ("sqlParserQueryPreview", F.col("preview")),
                ],
                [
                    ("sqlParserQueryFingerprint", F.nullif(F.col("query_fingerprint"), F.lit(""))),
                    ("sqlParserQueryType", F.nullif(F.col("raw_query_type"), F.lit(""))),
                    ("sqlParserConfidence", confidence),
                ],
            ).alias("custom_properties"),
            F.filter("upstreams", lin.present).alias("input_datasets"),
            F.filter("downstreams", lin.present).alias("output_datasets"),
            F.when(F.size("_fine") > 0, F.col("_fine")).alias("fine_grained"),
        )
    )


JOB_INFO = ["name", "type", "description", "flow_urn", "env", "custom_properties"]
JOB_IO = ["input_datasets", "output_datasets", "fine_grained"]


def jobs(outcomes: DataFrame, settings: RecordSettings = RecordSettings()) -> DataFrame:
    """One job per writing statement."""
    return _job_rows(outcomes, settings).select("job_urn", *JOB_INFO)


def job_io(outcomes: DataFrame, settings: RecordSettings = RecordSettings()) -> DataFrame:
    """Inputs, outputs and field lineage of each job (``fine_grained`` is NULL when empty)."""
    return _job_rows(outcomes, settings).select("job_urn", *JOB_IO)


def _records(
    rows: DataFrame, phase: int, urn: str, aspects: dict[str, list[str]], place: Sequence[str] = ()
) -> DataFrame:
    """One record per row and aspect; all aspects come from the same pass over the rows."""
    carried = [f"place_{name}" for name in place]
    built = [
        F.struct(
            F.lit(name).alias("aspect_name"), F.to_json(F.struct(*columns)).alias("aspect_json")
        )
        for name, columns in aspects.items()
    ]
    return rows.select(
        F.lit(phase).alias("phase"),
        F.col(urn).alias("entity_urn"),
        F.explode(F.array(*built)).alias("_record"),
        *carried,
    ).select("phase", "entity_urn", "_record.*", *carried)


RECORD_INPUTS = [
    "identifier", "source_path", "context", "query_text", "upstreams", "downstreams",
    "column_lineage", "confidence", "query_fingerprint", "raw_query_type",
]


def record_inputs(outcomes: DataFrame, place: Sequence[str] = ()) -> DataFrame:
    """What records are made of, written once, so that the texts are classified once and not by each
    kind of record."""
    columns = [*RECORD_INPUTS, *(name for name in place if name not in RECORD_INPUTS)]
    return written(outcomes.select(*columns), "record_inputs")


def metadata_records(
    outcomes: DataFrame, settings: RecordSettings = RecordSettings(), place: Sequence[str] = ()
) -> DataFrame:
    """Flow records, then job records: what is sent after the scaffolds.

    ``place`` names columns of the outcomes that say where a statement stands; job records have them
    as ``place_…``, flow records NULL.
    """
    flow_info = ["name", "description", "project", "env", "custom_properties"]
    of_flows = _records(flows(outcomes, settings), 2, "flow_urn", {"dataFlowInfo": flow_info})
    of_jobs = _records(
        _job_rows(outcomes, settings, place),
        3,
        "job_urn",
        {"dataJobInfo": JOB_INFO, "dataJobInputOutput": JOB_IO},
        place,
    )
    return of_flows.unionByName(of_jobs, allowMissingColumns=bool(place))


def sending_order(place: Sequence[str]) -> list[str]:
    """Flows before jobs, jobs by the places of their statements."""
    return ["phase", *[f"place_{name}" for name in place], "entity_urn", "aspect_name"]


def emission_plan(
    outcomes: DataFrame, known: DataFrame, settings: RecordSettings = RecordSettings()
) -> DataFrame:
    """All records in sending order: scaffolds of missing datasets, then flows, then jobs.

    Without any job nothing is sent, not even scaffolds.
    """
    outcomes = record_inputs(outcomes)
    scaffolds = rows.dataset_scaffolds(
        rows.missing_datasets(rows.dataset_columns(outcomes), known)
    ).where(with_jobs(outcomes).exists())
    of_datasets = _records(
        scaffolds,
        1,
        "dataset",
        {
            "datasetProperties": ["name", "auto_created_by"],
            "schemaMetadata": ["name", "platform", "cluster", "fields"],
        },
    )
    return of_datasets.unionByName(metadata_records(outcomes, settings))


def emitted_entities(records: DataFrame) -> DataFrame:
    return (
        records.where((F.col("phase") > 1) & lin.present(F.col("entity_urn")))
        .select("entity_urn")
        .distinct()
        .orderBy("entity_urn")
    )
