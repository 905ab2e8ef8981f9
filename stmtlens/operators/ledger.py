"""Run ledger: what reports need of each run, kept so that the log is never read again.

A ledger has one row per (run, source, statement type) with counts, exact sums and a quantile sketch
of the timings. All of these merge: totals over any runs, sources and types are sums of rows, and
sketches merge into a sketch of all their values. A run's rows are one partition, which recording the
run again replaces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stmtlens.functions import text as tx

RUN, SOURCE, TYPE = "run_id", "source_path", "statement_type"
#: Size of the sketches. By their published error the rank of an estimate is off by at most this
#: share of the values, in 99 of 100 cases.
SKETCH_SIZE = 400
RANK_ERROR = 0.0068
FLAGS = {
    "error_count": "ERR", "lineage_count": "LIN", "gap_lineage_count": "GAP",
    "self_referential_count": "SELF", "column_lineage_count": "COL",
}
COUNTS = ["query_count", "success_count", "parser_error_count", "rpc_error_count", *FLAGS]
SUMS = {"timing_sum": "decimal(38,6)", "timed": "bigint", "confidence_sum": "decimal(38,6)", "rated": "bigint"}


def entries(outcomes: DataFrame, keys: Sequence[str] = (RUN, SOURCE, TYPE)) -> DataFrame:
    """The ledger rows of some outcomes, in one aggregation."""
    count = lambda condition: F.count_if(condition)
    exact = lambda name: F.sum(F.col(name).cast("decimal(20,6)"))
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("query_count"),
        count(F.col("succeeded")).alias("success_count"),
        count(~tx.is_blank(F.col("parser_error"))).alias("parser_error_count"),
        count(~tx.is_blank(F.col("rpc_error"))).alias("rpc_error_count"),
        *[count(F.array_contains("flags", flag)).alias(name) for name, flag in FLAGS.items()],
        exact("timing_ms").cast(SUMS["timing_sum"]).alias("timing_sum"),
        F.count("timing_ms").alias("timed"),
        F.min("timing_ms").alias("min_ms"),
        F.max("timing_ms").alias("max_ms"),
        exact("confidence").cast(SUMS["confidence_sum"]).alias("confidence_sum"),
        F.count("confidence").alias("rated"),
        F.kll_sketch_agg_double(F.col("timing_ms").cast("double"), F.lit(SKETCH_SIZE)).alias("timings"),
    )


def record(outcomes: DataFrame, path: str) -> None:
    """Write the runs of ``outcomes`` into the ledger at ``path``; runs already there are replaced."""
    rows = entries(outcomes).hint("rebalance", RUN)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(RUN).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("mergeSchema", False).parquet(path)
    return rows.withColumn(RUN, F.col(RUN).cast("string"))


def merged(ledger: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Ledger rows put together by ``keys``, or all of them."""
    sums = [F.sum(name).alias(name) for name in [*COUNTS, *SUMS]]
    return ledger.groupBy(*keys).agg(
        *sums, F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"),
        F.kll_merge_agg_double("timings").alias("timings"),
    )


def _rate(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part).cast("double") / F.col(whole))


def overview(ledger: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts, success rate and timings by ``keys`` over all runs of the ledger."""
    return merged(ledger, keys).select(
        *keys, *COUNTS, (_rate("success_count", "query_count") * 100).alias("success_rate"),
        F.col("timing_sum").cast("double").alias("timing_ms_total"),
        _rate("timing_sum", "timed").alias("avg_ms"), "min_ms", "max_ms",
    )


def percentile_estimates(
    ledger: DataFrame, keys: Sequence[str], quantiles: Sequence[float]
) -> DataFrame:
    """``quantile, estimate, timed`` by ``keys``: a timing whose rank is ``quantile`` of the timed
    statements, up to ``RANK_ERROR``. Groups without any timing have none."""
    each = [
        F.struct(
            F.lit(q).alias("quantile"),
            F.kll_sketch_get_quantile_double("timings", F.lit(q)).alias("estimate"),
        )
        for q in quantiles
    ]
    some = merged(ledger, keys).where("timed > 0")
    return some.select(*keys, "timed", F.explode(F.array(*each)).alias("e")).select(
        *keys, "e.quantile", "e.estimate", "timed"
    )


def trend(ledger: DataFrame) -> DataFrame:
    """Success and confidence per run and type, with the change since the type's previous run."""
    per_run = merged(ledger, [RUN, TYPE]).select(
        RUN, TYPE, F.col("query_count").alias("total_queries"),
        (_rate("success_count", "query_count") * 100).alias("success_rate"),
        _rate("confidence_sum", "rated").alias("avg_confidence"),
    )
    history = Window.partitionBy(TYPE).orderBy(RUN)  # one row per run
    change = lambda name: F.col(name) - F.lag(name).over(history)
    return per_run.select(
        "*", change("success_rate").alias("success_change"),
        change("avg_confidence").alias("confidence_change"),
    )


def rank_errors(estimates: DataFrame, outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``estimates`` with ``rank_error``: how far the rank of each is from the quantile, as a share of
    the timed statements of its group. Equal timings have a range of ranks.

    There is one estimate per group and quantile, so each statement meets a few rows.
    """
    timed = outcomes.where("timing_ms IS NOT NULL").select(*keys, "timing_ms")
    low = F.count_if(F.col("timing_ms") < F.col("estimate"))
    high = F.count_if(F.col("timing_ms") <= F.col("estimate"))
    at = F.col("quantile") * F.col("timed")
    placed = estimates.join(timed, list(keys)).groupBy(*estimates.columns).agg(
        low.alias("_low"), high.alias("_high")
    )
    off = F.greatest(F.col("_low") - at, at - F.col("_high"), F.lit(0.0)) / F.col("timed")
    return placed.select(*estimates.columns, off.alias("rank_error"))
