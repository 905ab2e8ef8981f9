"""Explicit schemas of statements, parser payloads and expected results."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())

COLUMN_REF = T.StructType(
    [T.StructField("table", T.StringType()), T.StructField("column", T.StringType())]
)

COLUMN_LINEAGE = T.ArrayType(
    T.StructType(
        [
            T.StructField(
                "downstream",
                T.StructType(
                    [
                        T.StructField("table", T.StringType()),
                        T.StructField("column", T.StringType()),
                        T.StructField("column_type", T.StringType()),
                        T.StructField("native_column_type", T.StringType()),
                    ]
                ),
            ),
            T.StructField("upstreams", T.ArrayType(COLUMN_REF)),
            T.StructField(
                "logic",
                T.StructType(
                    [
                        T.StructField("is_direct_copy", T.BooleanType()),
                        T.StructField("column_logic", T.StringType()),
                    ]
                ),
            ),
        ]
    )
)

DEBUG_INFO = T.StructType(
    [
        T.StructField("confidence", T.DoubleType()),
        T.StructField("table_error", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("generalized_statement", T.StringType()),
    ]
)

# The statement type may arrive under several spellings of its key. The third differs from the
# first only in case, which column names cannot, so its column has a name of its own.
TYPE_KEYS = ("queryType", "query_type", "querytype_lower")

# One parser answer.
PAYLOAD = T.StructType(
    [
        T.StructField("identifier", T.StringType()),
        T.StructField("queryType", T.StringType()),
        T.StructField("query_type", T.StringType()),
        T.StructField("query_fingerprint", T.StringType()),
        T.StructField("in_tables", STRINGS),
        T.StructField("out_tables", STRINGS),
        T.StructField("column_lineage", COLUMN_LINEAGE),
        T.StructField("debug_info", DEBUG_INFO),
        T.StructField("timing_ms", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)

EXPECTED = T.StructType(
    [
        T.StructField("in_tables", STRINGS),
        T.StructField("out_tables", STRINGS),
        T.StructField("column_lineage", COLUMN_LINEAGE),
    ]
)
