"""Lineage as tables: edges, datasets with their columns, scaffolds of missing datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlens import constants as K
from stmtlens.functions import lineage as lin
from stmtlens.functions import urns


def column_edge_rows(outcomes: DataFrame) -> DataFrame:
    return outcomes.select("identifier", F.explode("column_edges").alias("edge"))


def table_edge_rows(outcomes: DataFrame) -> DataFrame:
    """Input and output edges of each statement with at least one downstream.

    Edges stay per side, as a job record lists them; upstream and downstream are not multiplied.
    """

    def side(column: str, kind: str):
        return F.transform(
            F.filter(F.col(column), lin.present),
            lambda urn: F.struct(F.lit(kind).alias("edge_kind"), urn.alias("dataset")),
        )

    edges = F.concat(side("upstreams", "input"), side("downstreams", "output"))
    return (
        outcomes.where(F.size("downstreams") > 0)
        .select("identifier", F.explode(edges).alias("_edge"))
        .select("identifier", "_edge.*")
    )


def dataset_columns(outcomes: DataFrame) -> DataFrame:
    """Distinct (dataset, column) pairs seen anywhere; a dataset without columns has one NULL row.

    All mentions of a statement are gathered into one array and exploded once, and equal mentions
    are combined before the shuffle, so a dataset named by a third of the log costs little.
    """
    ref = "array<struct<dataset:string,column:string>>"
    bare = F.transform(
        F.concat("upstreams", "downstreams"),
        lambda urn: F.struct(urn.alias("dataset"), F.lit(None).cast("string").alias("column")),
    ).cast(ref)
    targets = F.transform(
        F.col("column_lineage"),
        lambda e: F.struct(
            e["downstream"]["table"].alias("dataset"), e["downstream"]["column"].alias("column")
        ),
    ).cast(ref)
    sources = F.transform(
        F.flatten(
            F.transform(
                F.col("column_lineage"),
                lambda e: F.coalesce(e["upstreams"], F.array().cast("array<struct<table:string,column:string>>")),
            )
        ),
        lambda u: F.struct(u["table"].alias("dataset"), u["column"].alias("column")),
    ).cast(ref)
    mentions = F.array_distinct(F.concat(bare, targets, sources))
    return (
        outcomes.select(F.explode(mentions).alias("_m"))
        .select("_m.dataset", F.nullif(F.col("_m.column"), F.lit("")).alias("column"))
        .where(lin.present(F.col("dataset")))
        .distinct()
    )


def dataset_fields(pairs: DataFrame) -> DataFrame:
    """One row per dataset with its sorted columns (bounded by the width of the dataset)."""
    return pairs.groupBy("dataset").agg(
        F.array_sort(F.collect_list("column")).alias("columns")
    )


def dataset_scaffolds(pairs: DataFrame, created_by: str = "stmtlens") -> DataFrame:
    """Schema and property values of each dataset, inferred from the columns in use."""
    urn = F.col("dataset")
    return dataset_fields(pairs).select(
        urn.alias("dataset"),
        urns.dataset_name(urn).alias("name"),
        urns.dataset_platform(urn).alias("platform"),
        urns.dataset_env(urn).alias("cluster"),
        F.transform(
            "columns",
            lambda c: F.struct(
                c.alias("field_path"),
                F.lit(K.PLACEHOLDER_NATIVE_TYPE).alias("native_data_type"),
                F.lit("string").alias("type"),
            ),
        ).alias("fields"),
        F.lit(created_by).alias("auto_created_by"),
    )


def missing_datasets(datasets: DataFrame, known: DataFrame) -> DataFrame:
    """Datasets absent from the catalogue table ``known(urn)``."""
    return datasets.join(known, datasets["dataset"] == known["urn"], "left_anti")


def fine_grained_rows(outcomes: DataFrame) -> DataFrame:
    """Field-level lineage: one row per (statement, downstream field, entry)."""
    rows = lin.fine_grained(F.col("downstreams"), F.col("column_lineage"), F.col("confidence"))
    return outcomes.select("identifier", F.explode(rows).alias("_row")).select(
        "identifier", "_row.*"
    )
