"""From scripts to statements, and from statements and parser answers to outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtlens import schemas
from stmtlens.functions import lineage as lin
from stmtlens.functions import text as tx

def split_statements(scripts: DataFrame, text: str = "script_text") -> DataFrame:
    """One row per statement of the ``text`` column, numbered from 1 after blanks are dropped."""
    others = [c for c in scripts.columns if c != text]
    return scripts.select(
        *others, F.posexplode(tx.statement_texts(F.col(text))).alias("_pos", "query_text")
    ).select(
        *others,
        (F.col("_pos") + 1).cast("bigint").alias("stmt_index"),
        tx.strip(F.col("query_text")).alias("query_text"),
    )


def with_inferred_type(statements: DataFrame, text: str = "query_text") -> DataFrame:
    """Add ``inferred_type``."""
    words = tx.leading_words(tx.clean_sql(F.col(text)))
    return statements.withColumn("inferred_type", tx.once(words, tx.statement_type_of))


def flattened_payload(payload: DataFrame) -> DataFrame:
    """Parser answers as flat columns; absent lists become empty ones.

    The type label comes from the first spelling of its key that has a usable value.
    """
    no_lineage = F.array().cast(schemas.COLUMN_LINEAGE)
    spellings = [F.col(name) for name in schemas.TYPE_KEYS if name in payload.columns]
    usable = [F.when(tx.type_label(label).isNotNull(), label) for label in spellings]
    raw = F.col("raw_payload") if "raw_payload" in payload.columns else F.lit(None).cast("string")
    return payload.select(
        "identifier",
        lin.as_list(F.col("in_tables")).alias("upstreams"),
        lin.as_list(F.col("out_tables")).alias("downstreams"),
        lin.as_list(F.col("column_lineage"), no_lineage).alias("column_lineage"),
        F.nullif(F.col("debug_info.error"), F.lit("")).alias("parser_error"),
        F.col("debug_info.confidence").alias("confidence"),
        tx.reported_type(*spellings).alias("parser_statement_type"),
        F.coalesce(*usable).alias("raw_query_type"),
        F.col("debug_info.table_error").alias("table_error"),
        "query_fingerprint",
        "timing_ms",
        F.col("error").alias("rpc_error"),
        raw.alias("raw_payload"),
    )


def outcomes(statements: DataFrame, payload: DataFrame) -> DataFrame:
    """Statements joined with the parser answers on ``identifier`` (unique on both sides).

    The text is classified before the join, so a report that does not show the text does not move
    it.
    """
    answers = flattened_payload(payload).withColumnRenamed("identifier", "_identifier")
    typed = with_inferred_type(statements)
    joined = typed.join(answers, typed["identifier"] == answers["_identifier"], "left")
    joined = joined.withColumn("answered", F.col("_identifier").isNotNull())
    return with_outcome_columns(joined.drop("_identifier"))


def succeeded(rpc_error: Column, parser_error: Column) -> Column:
    return tx.is_blank(rpc_error) & tx.is_blank(parser_error)


def with_outcome_columns(df: DataFrame) -> DataFrame:
    """Derive type, edges and flags of statements that already carry their parser answer.

    A statement whose remote call failed has no lineage: its lists are empty and its type comes from
    the text. A statement that nothing is known about (``answered`` is false) neither succeeded nor
    failed: ``succeeded`` and ``timing_ms`` are NULL and it has no flags.
    """
    if "answered" not in df.columns:
        df = df.withColumn("answered", F.lit(True))
    if "inferred_type" not in df.columns:
        df = with_inferred_type(df)
    answered = tx.is_blank(F.col("rpc_error"))
    no_lineage = F.array().cast(df.schema["column_lineage"].dataType)

    def if_answered(name: str) -> Column:
        return F.when(answered, F.col(name))

    label, inferred = F.col("parser_statement_type"), F.col("inferred_type")
    statement_type, type_source = tx.resolved_type(label, inferred)
    # In steps, so that a value used by the next step is computed once.
    return (
        df.withColumns(
            {
                "upstreams": lin.as_list(if_answered("upstreams")),
                "downstreams": lin.as_list(if_answered("downstreams")),
                "column_lineage": lin.as_list(if_answered("column_lineage"), no_lineage),
                "parser_error": if_answered("parser_error"),
                "parser_statement_type": if_answered("parser_statement_type"),
                "timing_ms": F.when(
                    F.col("answered"), F.coalesce(F.col("timing_ms"), F.lit(0.0))
                ),
            }
        )
        .withColumns(
            {
                "column_edges": lin.column_edges(F.col("column_lineage")),
                "self_referential": lin.is_self_referential(
                    F.col("upstreams"), F.col("downstreams")
                ),
                "succeeded": F.when(
                    F.col("answered"), succeeded(F.col("rpc_error"), F.col("parser_error"))
                ),
            }
        )
        .withColumns(
            {
                "statement_type": statement_type,
                "statement_type_source": type_source,
                "flags": F.when(
                    F.col("answered"),
                    lin.statement_flags(
                        F.col("succeeded"), F.col("upstreams"), F.col("downstreams"),
                        F.col("self_referential"), F.col("column_lineage"),
                    ),
                ).otherwise(F.array().cast("array<string>")),
            }
        )
        .drop("inferred_type")
    )
