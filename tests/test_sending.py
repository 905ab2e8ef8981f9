"""Sending order, and going on after a stop."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from stmtlens.session import fresh_path
from stmtlens.sinks import sending

SCHEMA = "phase INT, a STRING, n INT, said STRING, sequence BIGINT"


def test_order_and_resuming(spark):
    rng = random.Random(5)
    rows = [(2 + (i > 40), None if i % 7 == 0 else rng.choice("abc"), i, f'"{i}"\n') for i in range(1000)]
    rng.shuffle(rows)
    records = spark.createDataFrame(rows, "phase int, a string, n int, said string").repartition(6)
    path = fresh_path(spark, "sending")
    sending.lay_out(records, ["phase", "a", "n"], path, part_rows=64)
    want = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
    every = sending.unsent(spark, path, SCHEMA).orderBy("sequence").collect()
    assert [tuple(r)[:4] for r in every] == want
    assert [r["sequence"] for r in every] == list(range(1000))
    parts = sending.manifest(spark, path).orderBy("part").collect()
    assert [(r["first"], r["records"]) for r in parts] == [(k, min(64, 1000 - k)) for k in range(0, 1000, 64)]

    sending.mark_sent(spark, path, [0, 3])
    sending.mark_sent(spark, path, [3, 15])
    left = [r["sequence"] for r in sending.unsent(spark, path, SCHEMA).collect()]
    assert sorted(left) == [k for k in range(1000) if k // 64 not in (0, 3, 15)]
    files = spark.read.text(f"{path}/parts").select(F.col("_metadata.file_path")).distinct().count()
    assert files == len(parts)
