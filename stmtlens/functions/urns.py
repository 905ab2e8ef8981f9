"""Dataset, field, flow and job URNs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stmtlens import constants as K


def qualified_name(name: Column, default_db: str | None = None, default_schema: str | None = None) -> Column:
    """Complete a one- or two-part table name with the default database and schema."""
    parts = F.size(F.split(name, r"\."))
    qualified = name
    if default_schema:
        with_schema = F.concat(F.lit(f"{default_schema}."), name)
        with_both = F.concat(F.lit(f"{default_db}."), with_schema) if default_db else with_schema
        qualified = F.when(parts == 1, with_both).otherwise(qualified)
    if default_db:
        qualified = F.when(parts == 2, F.concat(F.lit(f"{default_db}."), name)).otherwise(qualified)
    return qualified


def dataset_urn(name: Column, platform: str = K.DEFAULT_PLATFORM, env: str = K.DEFAULT_ENV) -> Column:
    return F.format_string(K.DATASET_URN, F.lit(platform), name, F.lit(env))


def schema_field_urn(dataset: Column, column: Column) -> Column:
    return F.format_string(K.SCHEMA_FIELD_URN, dataset, column)


def flow_urn(flow_id: Column, orchestrator: str, cluster: str) -> Column:
    return F.format_string(K.FLOW_URN, F.lit(orchestrator), flow_id, F.lit(cluster))


def job_urn(flow: Column, job_id: Column) -> Column:
    return F.format_string(K.JOB_URN, flow, job_id)


def dataset_platform(urn: Column) -> Column:
    return F.regexp_extract(urn, K.DATASET_URN_PARTS, 1)


def dataset_name(urn: Column) -> Column:
    """Name part of a dataset URN, or the URN itself where it has none."""
    name = F.regexp_extract(urn, K.DATASET_URN_PARTS, 2)
    return F.when(name == "", urn).otherwise(name)


def dataset_env(urn: Column) -> Column:
    return F.regexp_extract(urn, K.DATASET_URN_PARTS, 3)
