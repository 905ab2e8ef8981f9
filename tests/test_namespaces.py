from __future__ import annotations

import uuid

import pytest

from stmtlens.sources.namespaces import Namespaces, name_parts


def test_name_parts():
    assert name_parts("a") == ["a"] and name_parts(" a . b.c ") == ["a", "b", "c"]
    assert name_parts('"a.b".`c``d`."e""f"') == ["a.b", "c`d", 'e"f']
    for wrong in ("", "a..b", "a.b.c.d", "a b", "a.", '"a'):
        with pytest.raises(ValueError):
            name_parts(wrong)


def test_the_same_name_in_two_databases(spark):
    names = Namespaces(spark, f"t_{uuid.uuid4().hex[:8]}", "DB", "One")
    names.create("DB", "One", {"T": "SELECT 1 AS v", "u": "SELECT v + 10 AS v FROM t"})
    names.create("DB", "Two", {"t": "SELECT 2 AS v"})
    names.create("Other", "One", {"t": "SELECT 3 AS v"})
    value = lambda name: names.table(name).first()["v"]
    assert [value(n) for n in ("t", "two.T", "db.two.t", "OTHER.one.t", "u")] == [1, 2, 2, 3, 11]
    default = spark.catalog.currentDatabase()
    with names.using("DB", "Two"):
        assert value("t") == 2 and spark.sql("SELECT v FROM t").first()["v"] == 2
        with names.using("Other", "One"):
            assert value("t") == 3
        assert value("one.u") == 11
    assert value("t") == 1 and spark.catalog.currentDatabase() == default
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        names.table("two.u")
    with pytest.raises(RuntimeError), names.using("DB", "Two"):
        raise RuntimeError
    assert spark.catalog.currentDatabase() == default
