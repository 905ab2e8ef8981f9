"""Statistics over outcomes: confidence, validation, complexity, error classes, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtlens import constants as K
from stmtlens import schemas
from stmtlens.functions import lineage as lin
from stmtlens.functions import rewrite as rw
from stmtlens.functions import text as tx
from stmtlens.functions import urns


# --- complexity -------------------------------------------------------------------------


def _hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


SUBQUERY = r"(?i)\(\s*SEL(?:ECT)?\b"
CTE_START = r"(?i)(?:\bWITH\s+(?:RECURSIVE\s+)?|,\s*)[A-Za-z_]\w*\s+AS\s*\("
CTE_BODY_SELECT = CTE_START + r"\s*SEL(?:ECT)?\b"
# Parentheses, and WITH heads including their opening parenthesis.
NESTING_TOKEN = r"(?i)(\bWITH\s+(?:RECURSIVE\s+)?[A-Za-z_]\w*\s+AS\s*\(|[()])"


def _max_cte_depth(clean: Column) -> Column:
    """Deepest WITH: parentheses open where it starts, plus one."""
    tokens = F.regexp_extract_all(clean, F.lit(NESTING_TOKEN), F.lit(1))
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("deepest"))
    state = F.aggregate(
        tokens,
        start,
        lambda acc, token: F.struct(
            (acc["open"] + F.when(token == ")", -1).otherwise(1)).alias("open"),
            F.when(F.length(token) > 1, F.greatest(acc["deepest"], acc["open"] + 1))
            .otherwise(acc["deepest"])
            .alias("deepest"),
        ),
    )
    return state["deepest"].cast("bigint")


def complexity_metrics(statements: DataFrame, text: str = "query_text") -> DataFrame:
    """Add size and structure counts of each statement."""
    clean = F.col("_clean")
    has_with = clean.rlike(r"(?i)\bWITH\b")
    none = F.lit(0).cast("bigint")
    ctes = F.when(has_with, _hits(clean, CTE_START)).otherwise(none)
    # A parenthesised SELECT that is the body of a CTE is not a subquery.
    bodies = F.when(has_with, _hits(clean, CTE_BODY_SELECT)).otherwise(none)
    return (
        statements.withColumn("_clean", tx.clean_sql(F.col(text)))
        .withColumn("cte_count", ctes)
        .withColumn(
            "max_cte_depth",
            F.when(has_with, _max_cte_depth(clean)).otherwise(none),
        )
        .withColumn("subquery_count", _hits(clean, SUBQUERY) - bodies)
        .withColumn("join_count", _hits(clean, r"(?i)\bJOIN\b"))
        .withColumn("union_count", _hits(clean, r"(?i)\bUNION\b"))
        .withColumn("window_function_count", _hits(clean, r"(?i)\bOVER\s*\("))
        .withColumn("line_count", F.size(tx.lines_of(F.col(text))).cast("bigint"))
        .withColumn("char_count", F.length(text).cast("bigint"))
        .drop("_clean")
    )


# --- validation against expected lineage --------------------------------------------------


def _ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(F.size(part).cast("double"), F.size(whole))


def _compared(prefix: str, actual: Column, expected: Column) -> dict[str, Column]:
    actual, expected = F.array_distinct(actual), F.array_distinct(expected)
    common = F.array_intersect(actual, expected)
    return {
        f"{prefix}_precision": _ratio(common, actual),
        f"{prefix}_recall": _ratio(common, expected),
        f"{prefix}_missing": F.array_sort(F.array_except(expected, actual)),
        f"{prefix}_extra": F.array_sort(F.array_except(actual, expected)),
    }


def expectations(
    outcomes: DataFrame, expected: DataFrame, path: str = "source_path"
) -> DataFrame:
    """Expected results (``query_id, stmt_index`` and lists) by the identifier of their statement.

    They belong together by the stem of the statement's file and its number in the file.
    """
    places = outcomes.select(
        "identifier", tx.file_stem(F.col(path)).alias("query_id"), "stmt_index"
    )
    no_lineage = F.array().cast(schemas.COLUMN_LINEAGE)
    return places.join(expected, ["query_id", "stmt_index"]).select(
        "identifier",
        F.concat(lin.as_list(F.col("in_tables")), lin.as_list(F.col("out_tables")))
        .alias("expected_tables"),
        lin.column_edges(lin.as_list(F.col("column_lineage"), no_lineage)).alias("expected_edges"),
    )


def validated(outcomes: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare each statement with its expectation (same ``identifier``), if there is one.

    Adds precision, recall, missing and extra for tables and columns, and ``validation_status``.
    """
    wanted = expected.select(
        F.col("identifier").alias("_wanted"), "expected_tables", "expected_edges"
    )
    joined = outcomes.join(wanted, F.col("identifier") == F.col("_wanted"), "left")
    tables = F.concat("upstreams", "downstreams")
    checks = {
        **_compared("tables", tables, F.col("expected_tables")),
        **_compared("columns", F.col("column_edges"), F.col("expected_edges")),
    }
    compared = joined.withColumns(checks)
    differences = sum(
        (F.size(f"{side}_{kind}") for side in ["tables", "columns"] for kind in ["missing", "extra"]),
        F.lit(0),
    )
    return compared.withColumn(
        "validation_status",
        F.when(F.col("_wanted").isNull(), "no_expectation")
        .when(differences == 0, "match")
        .otherwise("mismatch"),
    ).drop("_wanted")


def validation_summary(checked: DataFrame) -> DataFrame:
    """Mean precision and recall over the statements that have them."""

    def mean(name: str) -> Column:
        exact = F.sum(F.round(F.col(name), 9).cast("decimal(20,9)"))
        return F.try_divide(exact.cast("double"), F.count(name)).alias(f"avg_{name}")

    names = ["tables_precision", "tables_recall", "columns_precision", "columns_recall"]
    return checked.agg(
        F.count_if(F.col("validation_status") != "no_expectation").alias("validated_count"),
        F.count_if(F.col("validation_status") == "match").alias("match_count"),
        *[mean(name) for name in names],
    )


# --- rates ---------------------------------------------------------------------------------


def _percent(condition: Column) -> Column:
    return F.count_if(condition) * 100.0 / F.count(F.lit(1))


def rate_measures() -> list[Column]:
    confidence = F.col("confidence")
    return [
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if(F.col("succeeded")).alias("success_count"),
        _percent(F.col("succeeded")).alias("success_rate"),
        _percent(confidence >= K.HIGH_CONFIDENCE).alias("high_confidence_rate"),
        _percent(F.size("column_lineage") > 0).alias("column_lineage_rate"),
        F.try_divide(
            F.sum(confidence.cast("decimal(12,6)")).cast("double"), F.count(confidence)
        ).alias("avg_confidence"),
    ]


def overall_stats(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(*rate_measures())


def confidence_bucket(confidence: Column) -> Column:
    score = F.coalesce(confidence, F.lit(0.0))
    bands = [(score >= low, label) for low, label in K.CONFIDENCE_BANDS]
    chain = F.when(bands[0][0], bands[0][1])
    for condition, label in bands[1:]:
        chain = chain.when(condition, label)
    return chain.when(score > 0, "low").otherwise("failed")


def confidence_buckets(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy(confidence_bucket(F.col("confidence")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("count")
    )


def category_of(path: Column) -> Column:
    """Test category: the numbered folder of the path."""
    return F.nullif(F.regexp_extract(path, r"/(\d\d-[^/]+)/", 1), F.lit(""))


def stats_by_category(outcomes: DataFrame, path: str = "source_path") -> DataFrame:
    return outcomes.groupBy(category_of(F.col(path)).alias("category")).agg(*rate_measures())


def stats_by_type(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("statement_type").agg(*rate_measures())


def _count_band(count: Column) -> Column:
    return F.when(count == 0, "0").when(count == 1, "1").when(count <= 3, "2-3").otherwise("4+")


def complexity_impact(outcomes: DataFrame) -> DataFrame:
    """Success by number of CTEs, joins and subqueries, in one pass over the statements."""
    measured = complexity_metrics(outcomes).select(
        "succeeded",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("measure"), _count_band(F.col(name)).alias("band"))
                    for name in ["cte_count", "join_count", "subquery_count"]
                ]
            )
        ).alias("_m"),
    )
    return measured.groupBy("_m.measure", "_m.band").agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if(F.col("succeeded")).alias("success_count"),
        _percent(F.col("succeeded")).alias("success_rate"),
    )


def category_targets(spark) -> DataFrame:
    """The fixed targets: eight rows."""
    return spark.createDataFrame(
        K.CATEGORY_TARGETS, "category string, success_target double, high_confidence_target double"
    )


def threshold_gate(stats: DataFrame) -> DataFrame:
    """Categories against their targets, with the red flags."""
    targets = category_targets(stats.sparkSession)

    def verdict(rate: str, target: str) -> Column:
        return (
            F.when(F.col(target).isNull(), "no target")
            .when(F.col(rate) >= F.col(target), "pass")
            .otherwise("fail")
        )

    return stats.join(F.broadcast(targets), "category", "left").select(
        "category",
        "success_rate",
        "high_confidence_rate",
        verdict("success_rate", "success_target").alias("success_verdict"),
        verdict("high_confidence_rate", "high_confidence_target").alias("confidence_verdict"),
        (
            F.col("category").startswith("01-")
            & (F.col("success_rate") < K.RED_FLAG_BASIC_SUCCESS)
        ).alias("red_flag_basic"),
        (F.col("column_lineage_rate") < K.RED_FLAG_COLUMN_LINEAGE).alias("red_flag_columns"),
        F.coalesce(F.col("avg_confidence") < K.RED_FLAG_CONFIDENCE, F.lit(True)).alias(
            "red_flag_confidence"
        ),
    )


def confident_only(outcomes: DataFrame, minimum: float = K.MIN_CONFIDENCE) -> DataFrame:
    return outcomes.where(F.col("confidence") >= minimum)


def may_carry_column_lineage(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(~F.col("statement_type").isin(K.NO_COLUMN_LINEAGE_TYPES))


# --- errors -------------------------------------------------------------------------------


def error_detail(message: Column, statement: Column) -> Column:
    """A message that stops after its position gets the statement appended, as full ones have."""
    return F.when(
        message.rlike(r"Col: \d+\.\s*$"), F.concat(message, F.lit(" "), tx.clean_sql(statement))
    ).otherwise(message)


def _error_class(detail: Column, part: int) -> Column:
    chain = None
    for rule in K.ERROR_CLASSES:
        condition, value = detail.rlike(rule[2]), F.lit(rule[part])
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    position = {0: 0, 1: 1, 3: 2}[part]
    return chain.otherwise(F.lit(K.UNCLASSIFIED[position]))


def error_categories(outcomes: DataFrame) -> DataFrame:
    """Error messages by class and group, with their share of all errors."""
    message = F.col("parser_error")
    detail = error_detail(message, F.col("query_text"))
    counted = (
        outcomes.where(~tx.is_blank(message))
        .select(detail.alias("_detail"))
        .groupBy(_error_class(F.col("_detail"), 0).cast("bigint").alias("category_id"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    names = F.create_map(
        *[F.lit(v) for r in [*K.ERROR_CLASSES, (*K.UNCLASSIFIED[:2], "", "")] for v in (r[0], r[1])]
    )
    groups = F.create_map(
        *[F.lit(v) for r in K.ERROR_CLASSES for v in (r[0], r[3])],
        F.lit(K.UNCLASSIFIED[0]),
        F.lit(K.UNCLASSIFIED[2]),
    )
    everything = Window.partitionBy()  # at most one row per class
    key = F.col("category_id").cast("int")
    return counted.select(
        "category_id",
        names[key].alias("category"),
        groups[key].alias("category_group"),
        "count",
        (F.col("count") * 100.0 / F.sum("count").over(everything)).alias("share_pct"),
    )


def error_layer(rpc_error: Column, message: Column) -> Column:
    return (
        F.when(~tx.is_blank(rpc_error), "rpc")
        .when(tx.is_blank(message), "none")
        .when(message.rlike(K.LINEAGE_LAYER_PATTERN), "lineage")
        .when(message.rlike(K.PARSER_LAYER_PATTERN), "parser")
        .otherwise("other")
    )


def error_layers(outcomes: DataFrame) -> DataFrame:
    layer = error_layer(F.col("rpc_error"), F.col("parser_error"))
    return outcomes.groupBy(layer.alias("layer")).agg(F.count(F.lit(1)).alias("count"))


def error_analysis(outcomes: DataFrame, examples: int = 3) -> DataFrame:
    """Error classes with their frequency and the first identifiers of each.

    The rank filter keeps at most ``examples`` rows per class in every task before the shuffle, so
    no class is collected whole.
    """
    failed = outcomes.where(~F.col("succeeded")).select(
        F.when(~tx.is_blank(F.col("rpc_error")), tx.error_label(F.col("rpc_error")))
        .otherwise(tx.error_label(F.col("parser_error")))
        .alias("error_class"),
        "identifier",
    )
    counts = failed.groupBy("error_class").agg(F.count(F.lit(1)).alias("count"))
    by_class = Window.partitionBy("error_class").orderBy("identifier")
    first = (
        failed.withColumn("_rn", F.row_number().over(by_class))
        .where(F.col("_rn") <= examples)
        .groupBy("error_class")
        .agg(F.array_sort(F.collect_list("identifier")).alias("examples"))
    )
    return counts.join(first, "error_class")


# --- names, fingerprints, procedures, runs --------------------------------------------------


def qualified_refs(
    statements: DataFrame, default_db: str, default_schema: str, text: str = "query_text"
) -> DataFrame:
    """Heuristic table references with default database and schema filled in."""
    refs = lin.table_refs(tx.clean_sql(F.col(text)))
    full = lambda names: F.transform(
        names, lambda n: urns.qualified_name(n, default_db, default_schema)
    )
    return (
        statements.withColumn("_refs", refs)
        .withColumn("upstream_names", full(F.col("_refs.upstreams")))
        .withColumn("downstream_names", full(F.col("_refs.downstreams")))
        .drop("_refs")
    )


def query_patterns(statements: DataFrame, text: str = "query_text") -> DataFrame:
    """Statements that differ only in literals and layout, counted by fingerprint.

    Equal generalised texts are counted first, by hash; the digest and the choice of one spelling
    per fingerprint then work on distinct texts only.
    """
    distinct = (
        statements.select(rw.generalized(tx.clean_sql(F.col(text))).alias("_general"))
        .groupBy("_general")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    digest = F.sha2(F.encode(F.lower("_general"), "UTF-8"), 256)
    return distinct.groupBy(digest.alias("query_fingerprint")).agg(
        F.sum("_n").alias("count"), F.min("_general").alias("generalized")
    )


def procedure_statements(procedures: DataFrame, text: str = "body") -> DataFrame:
    """The data statements inside procedure bodies, numbered by their place in the body.

    Steps are cleaned and classified before they become rows: the filter on the type then reads a
    value, while a type computed after it would be computed again for the filter.
    """
    others = [c for c in procedures.columns if c != text]
    steps = F.transform(
        tx.statement_texts(F.col(text)), lambda part: rw.procedure_step(tx.clean_sql(part))
    )
    # statement_texts leaves trailing whitespace, which clean_sql strips.
    kind = lambda step: tx.once(tx.leading_words(tx.clean_sql(step)), tx.statement_type_of)
    typed = F.transform(
        steps, lambda step: F.struct(step.alias("query_text"), kind(step).alias("statement_type"))
    )
    return (
        procedures.select(*others, F.posexplode(typed).alias("_pos", "_step"))
        .where(F.col("_step.statement_type").isin("SELECT", "INSERT", "UPDATE", "DELETE"))
        .select(
            *others,
            (F.col("_pos") + 1).cast("bigint").alias("step"),
            F.col("_step.query_text").alias("query_text"),
            F.col("_step.statement_type").alias("statement_type"),
        )
    )


def trend_over_runs(outcomes: DataFrame) -> DataFrame:
    """Success and confidence per run and type, with the change since the type's previous run."""
    per_run = outcomes.groupBy("run_id", "statement_type").agg(*rate_measures())
    history = Window.partitionBy("statement_type").orderBy("run_id")  # one row per run
    return per_run.select(
        "run_id",
        "statement_type",
        "total_queries",
        "success_rate",
        "avg_confidence",
        (F.col("success_rate") - F.lag("success_rate").over(history)).alias("success_change"),
        (F.col("avg_confidence") - F.lag("avg_confidence").over(history)).alias(
            "confidence_change"
        ),
    )
