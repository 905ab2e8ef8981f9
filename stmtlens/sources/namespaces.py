"""Table names of one, two or three parts, resolved over the session catalogue."""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from stmtlens.session import fresh_path

_PART = re.compile(r'\s*(?:"((?:[^"]|"")+)"|`((?:[^`]|``)+)`|([^\s."`]+))\s*(\.|$)')


def name_parts(name: str) -> list[str]:
    """Parts of a dotted name; quoted parts may hold dots."""
    parts, at = [], 0
    while at < len(name) or (parts and name[at - 1] == "."):
        found = _PART.match(name, at)
        if not found:
            raise ValueError(f"not a table name: {name!r}")
        double, back, plain, _ = found.groups()
        parts.append(plain or (double.replace('""', '"') if double else back.replace("``", "`")))
        at = found.end()
    if not 1 <= len(parts) <= 3:
        raise ValueError(f"not a table name: {name!r}")
    return parts


class Namespaces:
    """Databases with schemas, each a database of the session catalogue that holds views.

    A name of three parts is ``database.schema.table``; the parts it lacks in front are those set by
    ``using``. Names are not case-sensitive.
    """

    def __init__(self, spark: SparkSession, prefix: str, database: str, schema: str):
        self.spark, self.prefix = spark, prefix
        self.database, self.schema = database, schema

    def catalogue_name(self, database: str, schema: str) -> str:
        parts = (self.prefix, database, schema)
        return "__".join(re.sub(r"\W", "_", part) for part in parts).lower()

    def create(self, database: str, schema: str, views: dict[str, str]) -> None:
        """A schema with its views, given as SQL over paths or other schemas' views."""
        name = self.catalogue_name(database, schema)
        folder = fresh_path(self.spark, "namespace")
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` LOCATION '{folder}'")
        with self.using(database, schema):
            for view, sql in views.items():
                self.spark.sql(f"CREATE OR REPLACE VIEW `{view.lower()}` AS {sql}")

    @contextmanager
    def using(self, database: str, schema: str):
        """Names that lack parts mean these meanwhile, in ``table`` and in SQL of the session."""
        before = self.database, self.schema, self.spark.catalog.currentDatabase()
        self.database, self.schema = database, schema
        self.spark.catalog.setCurrentDatabase(self.catalogue_name(database, schema))
        try:
            yield self
        finally:
            self.database, self.schema = before[:2]
            self.spark.catalog.setCurrentDatabase(before[2])

    def table(self, name: str) -> DataFrame:
        *front, table = name_parts(name)
        database, schema = [self.database, self.schema][: 2 - len(front)] + front
        return self.spark.table(f"`{self.catalogue_name(database, schema)}`.`{table.lower()}`")
