"""Paths from the roots of a parent-child table, for any depth.

A recursive query joins the whole table once per level. Here every row holds a path segment and the
ancestor above it, and each round joins the open rows with all rows on that ancestor, which doubles
the length of the segments: the number of rounds grows with the logarithm of the depth. Rows that
hang on a missing parent or a cycle are never reached from a root; they stop making progress and
are left out, as a recursion from the roots leaves them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlens.session import written


def paths_from_roots(
    nodes: DataFrame, node_id: str, parent_id: str, name: str, separator: str = " > "
) -> DataFrame:
    """Add ``level`` (roots are 1) and ``hierarchy_path`` to every row reachable from a root."""
    state = nodes.select(
        F.col(node_id).alias("_id"),
        F.col(parent_id).alias("_above"),
        F.lit(1).cast("bigint").alias("_level"),
        F.col(name).alias("_path"),
    )
    reached = state.where(F.col("_above").isNull())
    open_rows = state.where(F.col("_above").isNotNull())
    progress = True
    while progress:
        # The upper segment may itself be complete (its ancestor is NULL) or still open.
        upper = reached.unionByName(open_rows).select(
            F.col("_id").alias("_upper_id"),
            F.col("_above").alias("_upper_above"),
            F.col("_level").alias("_upper_level"),
            F.col("_path").alias("_upper_path"),
        )
        joined = written(
            open_rows.join(upper, F.col("_above") == F.col("_upper_id")).select(
                "_id",
                F.col("_upper_above").alias("_above"),
                (F.col("_upper_level") + F.col("_level")).alias("_level"),
                F.concat("_upper_path", F.lit(separator), "_path").alias("_path"),
            ),
            "paths",
        )
        finished = joined.where(F.col("_above").isNull())
        reached = reached.unionByName(finished)
        open_rows = joined.where(F.col("_above").isNotNull())
        counts = joined.agg(
            F.count_if(F.col("_above").isNull()).alias("finished"),
            F.count_if(F.col("_above").isNotNull()).alias("open"),
        ).first()
        progress = counts["open"] > 0 and counts["finished"] > 0
    found = reached.select(
        F.col("_id").alias("_found"),
        F.col("_level").alias("level"),
        F.col("_path").alias("hierarchy_path"),
    )
    return nodes.join(found, F.col(node_id) == F.col("_found")).drop("_found")
