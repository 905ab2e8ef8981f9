"""The run ledger: two runs merged are one run over both, and a repeated run changes nothing."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stmtlens.operators import ledger
from stmtlens.session import fresh_path


@pytest.fixture(scope="module")
def outcomes(spark):
    rng = random.Random(2)
    rows = [
        (f"r{i % 4}", rng.choice(["a", "a", "b", "c"]), rng.choice(["SELECT", "INSERT"]), rng.random() < 0.7,
         rng.choice([None, "e"]), None, rng.choice([["ERR"], ["LIN", "COL"], ["OK"]]),
         None if i % 9 == 0 else rng.choice([5.0, rng.lognormvariate(3, 2)]), rng.choice([None, 0.5, 0.25]))
        for i in range(20000)
    ]
    return spark.createDataFrame(
        rows, "run_id string, source_path string, statement_type string, succeeded boolean, parser_error string, "
        "rpc_error string, flags array<string>, timing_ms double, confidence double",
    ).repartition(5).cache()


def values(df):
    return sorted(map(str, df.drop("timings").collect()))


def test_merged_runs_are_one_run(spark, outcomes):
    path = fresh_path(spark, "ledger")
    for runs in (["r0", "r1"], ["r2"], ["r3"], ["r1", "r2"]):
        ledger.record(outcomes.where(F.col("run_id").isin(runs)), path)
    found = ledger.read(spark, path)
    assert values(found) == values(ledger.entries(outcomes).select(found.columns))
    for keys in ([], ["source_path"], ["statement_type", "source_path"]):
        whole = ledger.entries(outcomes, keys)
        assert values(ledger.merged(found, keys)) == values(whole.select(ledger.merged(found, keys).columns))


def test_a_run_that_is_recorded_again_is_replaced(spark, outcomes):
    path = fresh_path(spark, "ledger")
    ledger.record(outcomes, path)
    less = outcomes.where("run_id = 'r1' AND source_path = 'a'")
    ledger.record(less, path)
    found = ledger.read(spark, path)
    want = outcomes.where("run_id <> 'r1'").unionByName(less)
    assert values(found) == values(ledger.entries(want).select(found.columns))


def test_estimates_keep_their_rank_error(spark, outcomes):
    parts = ledger.entries(outcomes)
    keys = ["source_path"]
    found = ledger.percentile_estimates(parts, keys, [0.01, 0.25, 0.5, 0.75, 0.95, 0.99])
    errors = [r["rank_error"] for r in ledger.rank_errors(found, outcomes, keys).collect()]
    assert len(errors) == 18 and max(errors) <= ledger.RANK_ERROR + 1e-3
