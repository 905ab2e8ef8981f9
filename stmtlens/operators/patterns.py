"""Classes of messages from a table of patterns.

Patterns are rows: a priority, a class with its group, a regular expression, and an anchor, a literal
text (in any case) that every matching message holds. A message is looked up by its words: it meets
only the patterns whose anchor has one of them as its longest word, then the anchor itself, then the
expression. The first match by priority wins. A class is added by a row; an anchor that is left empty
means that every message has to be tried.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlens import constants as K

SCHEMA = "priority INT, category_id BIGINT, category STRING, category_group STRING, anchor STRING, pattern STRING"


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda w: w != ""))


def pattern_table(spark: SparkSession, more: Iterable[tuple] = ()) -> DataFrame:
    """The known classes of errors, a row per anchor, and ``more`` rows of the same shape."""
    rows = [
        (place, number, name, group, anchor, pattern)
        for place, (number, name, pattern, group) in enumerate(K.ERROR_CLASSES)
        for anchor in K.ERROR_ANCHORS[number]
    ]
    return spark.createDataFrame([*rows, *more], SCHEMA)


def _indexed(patterns: DataFrame) -> DataFrame:
    """Patterns with the word by which they are found; null where there is none."""
    longest = F.array_max(F.transform(_words(F.col("anchor")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    return patterns.withColumn("word", longest["w"])


def classified(messages: DataFrame, patterns: DataFrame, message: str = "message") -> DataFrame:
    """Distinct messages with ``category_id, category, category_group`` of the first pattern that
    matches; the unclassified class if none does. Null messages are left out."""
    texts = messages.select(F.col(message).alias("message")).where("message IS NOT NULL").distinct()
    index = F.broadcast(_indexed(patterns))  # rows of a table kept by hand
    each = texts.select("message", F.explode_outer(_words(F.col("message"))).alias("word"))
    found = each.join(index.where("word IS NOT NULL"), "word").drop("word")
    always = texts.join(index.where("word IS NULL").drop("word"), F.lit(True))
    holds = F.contains(F.lower("message"), F.lower("anchor")) & F.expr("message RLIKE pattern")
    best = F.min(F.struct("priority", "category_id", "category", "category_group")).alias("best")
    matched = found.unionByName(always).where(holds).groupBy("message").agg(best)
    number, name, group = K.UNCLASSIFIED
    return texts.join(matched, "message", "left").select(
        "message",
        F.coalesce("best.category_id", F.lit(number)).cast("bigint").alias("category_id"),
        F.coalesce("best.category", F.lit(name)).alias("category"),
        F.coalesce("best.category_group", F.lit(group)).alias("category_group"),
    )


def class_counts(messages: DataFrame, patterns: DataFrame, message: str = "message") -> DataFrame:
    """Messages by class with their share of all. Equal messages are counted before any is matched."""
    counted = messages.where(F.col(message).isNotNull()).groupBy(F.col(message).alias("message")).agg(
        F.count(F.lit(1)).alias("n")
    )
    joined = counted.join(classified(counted, patterns), "message")
    by_class = joined.groupBy("category_id", "category", "category_group").agg(F.sum("n").alias("count"))
    total = by_class.agg(F.sum("count").alias("total"))
    return by_class.join(F.broadcast(total), F.lit(True)).select(
        "category_id", "category", "category_group", "count",
        (F.col("count") * 100.0 / F.col("total")).alias("share_pct"),
    )
