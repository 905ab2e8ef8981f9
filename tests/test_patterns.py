from __future__ import annotations

import random

from pyspark.sql import functions as F

from stmtlens import constants as K
from stmtlens.operators import analysis, patterns
from stmtlens.sources import statement_log as log


def test_equals_a_chain_of_all_patterns(spark):
    """Over messages of every class, their parts put together at random, and texts of none."""
    said = log.scripts(spark, "/root/testdata/sf0.001").select(F.expr(log.ERROR_TEXT).alias("message"))
    texts = [r[0] for r in said.distinct().collect() if r[0]]
    rng = random.Random(8)
    for _ in range(300):
        a, b = rng.choice(texts), rng.choice(texts)
        texts.append(rng.choice([a + " " + b, a[: rng.randint(1, 40)] + b, a.upper(), b[rng.randint(0, 9) :]]))
    texts += ["", " ", "...", None]
    messages = spark.createDataFrame([(t,) for t in texts], "message string")
    got = {r["message"]: r["category_id"] for r in patterns.classified(messages, patterns.pattern_table(spark)).collect()}
    want = messages.where("message IS NOT NULL").select(
        "message", analysis._error_class(F.col("message"), 0).cast("bigint").alias("c")
    ).distinct()
    assert got == {r["message"]: r["c"] for r in want.collect()}
    assert set(range(15)) <= set(got.values())


def test_a_class_is_added_by_a_row(spark):
    messages = spark.createDataFrame([("Expecting ) here",), ("new fault 7",), ("other",)], "message string")
    more = [(-1, 20, "New", "Own", "New Fault", r"(?i)^new fault \d$"), (99, 21, "Rest", "Own", "", "other|new")]
    found = patterns.classified(messages, patterns.pattern_table(spark, more))
    assert {r["message"]: r["category_id"] for r in found.collect()} == {
        "Expecting ) here": 12, "new fault 7": 20, "other": 21,
    }
    assert len(K.ERROR_ANCHORS) == len(K.ERROR_CLASSES)
