"""Quality reports over statement outcomes: by run, by source and by statement type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtlens import constants as K
from stmtlens.functions import text as tx
from stmtlens.operators.slices import counted_values, exact_percentiles, percentiles_of

TIMING_QUANTILES = {"median_ms": 0.5, "p95_ms": 0.95}


def _has(flag: str) -> Column:
    return F.array_contains(F.col("flags"), flag)


def exact_ms() -> Column:
    """Sum of the timings as an exact decimal, so that the result does not depend on the order."""
    return F.sum(F.col("timing_ms").cast("decimal(20,6)"))


def total_ms() -> Column:
    return exact_ms().cast("double")


OVERVIEW_COLUMNS = [
    "query_count", "success_count", "parser_error_count", "rpc_error_count", "error_count",
    "lineage_count", "gap_lineage_count", "self_referential_count", "column_lineage_count",
    "timing_ms_total",
]


def overview_measures() -> list[Column]:
    """The measures of OVERVIEW_COLUMNS, in that order."""
    return [
        F.count(F.lit(1)).alias("query_count"),
        F.count_if(F.col("succeeded")).alias("success_count"),
        F.count_if(~tx.is_blank(F.col("parser_error"))).alias("parser_error_count"),
        F.count_if(~tx.is_blank(F.col("rpc_error"))).alias("rpc_error_count"),
        F.count_if(_has("ERR")).alias("error_count"),
        F.count_if(_has("LIN")).alias("lineage_count"),
        F.count_if(_has("GAP")).alias("gap_lineage_count"),
        F.count_if(_has("SELF")).alias("self_referential_count"),
        F.count_if(_has("COL")).alias("column_lineage_count"),
        total_ms().alias("timing_ms_total"),
    ]


def run_overview(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(*overview_measures())


def source_overview(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("source_path").agg(*overview_measures())


def _union_of_flags() -> Column:
    others = [flag for flag in K.FLAG_ORDER if flag != "OK"]
    seen = F.concat_ws(",", *[F.when(F.bool_or(_has(flag)), flag) for flag in others])
    return F.split(F.when(seen == "", "OK").otherwise(seen), ",")


def source_flags(outcomes: DataFrame, keys: Sequence[str] = ("source_path",)) -> DataFrame:
    """Union of the flags per source in display order; OK only when there is no other.

    One boolean per flag is enough, so no flag list is collected.
    """
    return outcomes.groupBy(*keys).agg(_union_of_flags().alias("flags"))


def source_summary(outcomes: DataFrame, keys: Sequence[str] = ("source_path",)) -> DataFrame:
    """Flags and overview of each source in one aggregation."""
    return outcomes.groupBy(*keys).agg(_union_of_flags().alias("flags"), *overview_measures())


def run_percentiles(outcomes: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """Exact percentiles of the timings of the whole run."""
    return exact_percentiles(outcomes.withColumn("run", F.lit("all")), ["run"], "timing_ms", quantiles)


def error_summary(outcomes: DataFrame) -> DataFrame:
    """Error classes by frequency."""
    return (
        outcomes.groupBy(tx.error_label(F.col("parser_error")).alias("message"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.lower("message"))
    )


def _type_measures() -> list[Column]:
    ok = F.count_if(F.col("succeeded"))
    total = F.count(F.lit(1))
    rate = ok / total * 100.0
    return [
        total.alias("total_queries"),
        ok.alias("success_count"),
        (total - ok).alias("error_count"),
        rate.alias("success_rate"),
        (F.lit(100.0) - rate).alias("error_rate"),
    ]


def type_metrics(outcomes: DataFrame, keys: Sequence[str] = ("statement_type",)) -> DataFrame:
    return outcomes.groupBy(*keys).agg(*_type_measures())


TYPE_COLUMNS = ["total_queries", "success_count", "error_count", "success_rate", "error_rate"]
TIMING_COLUMNS = ["avg_ms", "median_ms", "p95_ms", "min_ms", "max_ms"]


def type_report(outcomes: DataFrame, keys: Sequence[str] = ("statement_type",)) -> DataFrame:
    """Counts, rates and timings per group from one pass over the outcomes.

    The pass counts equal timings per group; totals, extremes and exact percentiles all follow from
    that smaller table. The timing of a statement is never NULL.
    """
    keys = list(keys)
    values = counted_values(
        outcomes, keys, "timing_ms", {"_ok": F.count_if(F.col("succeeded"))}
    )
    total, ok = F.sum("_n"), F.sum("_ok")
    rate = ok / total * 100.0
    value = F.col("_value").cast("decimal(20,6)")
    simple = values.table.groupBy(*keys).agg(
        total.alias("total_queries"),
        ok.alias("success_count"),
        (total - ok).alias("error_count"),
        rate.alias("success_rate"),
        (F.lit(100.0) - rate).alias("error_rate"),
        (F.sum(value * F.col("_n").cast("decimal(18,0)")).cast("double") / total).alias("avg_ms"),
        F.min("_value").alias("min_ms"),
        F.max("_value").alias("max_ms"),
    )
    exact = percentiles_of(values, TIMING_QUANTILES)
    exact = exact.withColumnsRenamed({k: f"_p_{k}" for k in keys})
    same = [simple[k].eqNullSafe(exact[f"_p_{k}"]) for k in keys]
    return simple.join(exact, same, "left").select(
        *[simple[k] for k in keys], *TYPE_COLUMNS, *TIMING_COLUMNS
    )


def timing_summary(outcomes: DataFrame, keys: Sequence[str] = ("statement_type",)) -> DataFrame:
    """Average, extremes and exact median and p95 of the timings per group."""
    return type_report(outcomes, keys).select(*keys, *TIMING_COLUMNS)


def flag_counts(outcomes: DataFrame) -> DataFrame:
    """Statement type by flag. The flags are a fixed list, so the pivot needs no discovery pass."""
    return outcomes.groupBy("statement_type").agg(
        *[F.count_if(_has(flag)).alias(flag) for flag in K.FLAG_ORDER]
    )


def other_flag_counts(outcomes: DataFrame) -> DataFrame:
    """Counts of flags outside the fixed list, in long form."""
    return (
        outcomes.select("statement_type", F.explode("flags").alias("flag"))
        .where(~F.col("flag").isin(K.FLAG_ORDER))
        .groupBy("statement_type", "flag")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def error_class_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy(
        "statement_type", tx.error_label(F.col("parser_error")).alias("error_class")
    ).agg(F.count(F.lit(1)).alias("count"))


def parser_error_counts(outcomes: DataFrame) -> DataFrame:
    message = F.when(tx.is_blank(F.col("parser_error")), K.NO_ERROR).otherwise(
        F.col("parser_error")
    )
    return outcomes.groupBy("statement_type", message.alias("parser_error")).agg(
        F.count(F.lit(1)).alias("count")
    )


def by_type_frequency(counts: DataFrame, label: str) -> DataFrame:
    """Report order: types by total, then labels by count; the total rides on a small table."""
    totals = counts.groupBy("statement_type").agg(F.sum("count").alias("type_total"))
    return counts.join(totals, "statement_type").orderBy(
        F.col("type_total").desc(), "statement_type", F.col("count").desc(), label
    )


def source_breakdown(outcomes: DataFrame) -> DataFrame:
    """How the type was found, per statement type."""
    source = F.col("statement_type_source")
    return outcomes.groupBy("statement_type").agg(
        F.count_if(source == "parser").alias("parser"),
        F.count_if(source == "fallback").alias("fallback"),
        F.count_if(F.coalesce(source, F.lit("unknown")) == "unknown").alias("unresolved"),
    )


def reported_labels(outcomes: DataFrame) -> DataFrame:
    label = F.coalesce("parser_statement_type", F.lit(K.UNAVAILABLE))
    return outcomes.groupBy("statement_type", label.alias("parser_label")).agg(
        F.count(F.lit(1)).alias("count")
    )


def report_header(outcomes: DataFrame) -> DataFrame:
    source = F.col("statement_type_source")
    return outcomes.agg(
        F.count(F.lit(1)).alias("query_count"),
        total_ms().alias("timing_ms_total"),
        F.count_if(source == "parser").alias("via_parser"),
        F.count_if(source == "fallback").alias("via_fallback"),
        F.count_if(F.coalesce(source, F.lit("unknown")) == "unknown").alias("still_unknown"),
        F.count_if(F.col("parser_statement_type") == "UNKNOWN").alias("parser_unknown"),
    )


def type_overview_table(outcomes: DataFrame) -> DataFrame:
    """The type table as shown to a reader: by frequency, rates and times as text."""
    return type_report(outcomes).select(
        "statement_type",
        "total_queries",
        "success_count",
        "error_count",
        F.concat(tx.fixed_point(F.col("success_rate"), 1), F.lit("%")).alias("success_pct"),
        tx.fixed_point(F.col("avg_ms"), 2).alias("avg_ms"),
        tx.fixed_point(F.col("p95_ms"), 2).alias("p95_ms"),
    ).orderBy(F.col("total_queries").desc(), "statement_type")


def multi_scope_report(outcomes: DataFrame) -> DataFrame:
    """The overview for every source, every type and the whole run.

    All measures add up, so the statements are aggregated once by (source, type) and the grouping
    sets expand only those few rows.
    """
    counts = [m for m in OVERVIEW_COLUMNS if m != "timing_ms_total"]
    finest = outcomes.groupBy("source_path", "statement_type").agg(
        *overview_measures()[:-1], exact_ms().alias("_ms")
    )
    grouped = finest.groupingSets(
        [
            [F.col("source_path"), F.col("statement_type")],
            [F.col("source_path")],
            [F.col("statement_type")],
            [],
        ],
        "source_path",
        "statement_type",
    ).agg(
        F.grouping_id().alias("_scope"),
        *[F.sum(c).alias(c) for c in counts],
        F.sum("_ms").cast("double").alias("timing_ms_total"),
    )
    scope = (
        F.when(F.col("_scope") == 0, "source_type")
        .when(F.col("_scope") == 1, "source")
        .when(F.col("_scope") == 2, "run_type")
        .otherwise("run")
    )
    return grouped.withColumn("scope", scope).drop("_scope")


def query_list(outcomes: DataFrame) -> DataFrame:
    """One report row per statement."""
    return outcomes.select(
        "source_path",
        "identifier",
        "flags",
        "succeeded",
        "timing_ms",
        tx.query_preview(F.col("query_text")).alias("preview"),
        "statement_type",
        "statement_type_source",
        "parser_statement_type",
    )
