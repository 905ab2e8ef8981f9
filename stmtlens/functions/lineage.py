"""Column functions over the lineage arrays of one statement; no shuffle, no explode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stmtlens import constants as K
from stmtlens.functions.text import is_blank
from stmtlens.functions.urns import schema_field_urn


def present(value: Column) -> Column:
    return ~is_blank(value)


def as_list(values: Column, like: Column | None = None) -> Column:
    """NULL becomes the empty list."""
    return F.coalesce(values, F.array().cast("array<string>") if like is None else like)


def column_edges(lineage: Column) -> Column:
    """``table.column -> table.column`` for every upstream with all four parts."""
    named = F.filter(
        lineage, lambda e: present(e["downstream"]["table"]) & present(e["downstream"]["column"])
    )

    def edges_of(entry: Column) -> Column:
        target = entry["downstream"]
        sources = F.filter(
            entry["upstreams"], lambda u: present(u["table"]) & present(u["column"])
        )
        return F.transform(
            sources,
            lambda u: F.concat(
                u["table"], F.lit("."), u["column"], F.lit(" -> "),
                target["table"], F.lit("."), target["column"],
            ),
        )

    edges = F.flatten(F.filter(F.transform(named, edges_of), lambda x: x.isNotNull()))
    return as_list(edges)


def is_self_referential(upstreams: Column, downstreams: Column) -> Column:
    return F.coalesce(F.arrays_overlap(upstreams, downstreams), F.lit(False))


def statement_flags(
    succeeded: Column, upstreams: Column, downstreams: Column, self_referential: Column,
    column_lineage: Column,
) -> Column:
    """Quality flags of one statement, in display order; ``OK`` only when there is no other."""
    has_up, has_down = F.size(upstreams) > 0, F.size(downstreams) > 0
    rules = [
        ("ERR", ~succeeded),
        ("GAP", has_up != has_down),
        ("LIN", has_up & has_down & ~self_referential),
        ("SELF", self_referential),
        ("COL", F.size(column_lineage) > 0),
    ]
    # Joined text and split, not filtered arrays: both ends stay in generated code.
    text = F.concat_ws(",", *[F.when(condition, flag) for flag, condition in rules])
    return F.split(F.when(text == "", "OK").otherwise(text), ",")


def flag_prefix(flags: Column) -> Column:
    """``[ERR][COL]``: known flags in display order, then any others sorted."""
    known = F.array(*[F.lit(flag) for flag in K.FLAG_ORDER])
    ordered = F.concat(
        F.filter(known, lambda f: F.array_contains(flags, f)),
        F.array_sort(F.array_except(flags, known)),
    )
    return F.array_join(F.transform(ordered, lambda f: F.concat(F.lit("["), f, F.lit("]"))), "")


def fine_grained(downstreams: Column, lineage: Column, confidence: Column) -> Column:
    """Field-level lineage of one job: one struct per (target dataset, lineage entry).

    An entry without a downstream table applies to each downstream dataset. Upstream columns of the
    target itself are dropped, and so is an entry left without upstreams.
    """

    def entry_for(target: Column, entry: Column) -> Column:
        sources = F.filter(
            entry["upstreams"],
            lambda u: present(u["table"]) & present(u["column"]) & (u["table"] != target),
        )
        return F.struct(
            target.alias("downstream_dataset"),
            schema_field_urn(target, entry["downstream"]["column"]).alias("downstream_field"),
            F.transform(sources, lambda u: schema_field_urn(u["table"], u["column"])).alias(
                "upstream_fields"
            ),
            F.when(confidence != 0, confidence).alias("confidence_score"),
            F.nullif(entry["logic"]["column_logic"], F.lit("")).alias("transform_operation"),
        )

    def entries_of(target: Column) -> Column:
        applicable = F.filter(
            lineage,
            lambda e: present(e["downstream"]["column"])
            & (is_blank(e["downstream"]["table"]) | (e["downstream"]["table"] == target)),
        )
        return F.transform(applicable, lambda e: entry_for(target, e))

    targets = F.filter(downstreams, present)
    return F.filter(
        F.flatten(F.transform(targets, entries_of)),
        lambda row: F.coalesce(F.size(row["upstream_fields"]), F.lit(0)) > 0,
    )


_NAME = r"([A-Za-z_][A-Za-z0-9_$#]*(?:\.[A-Za-z_][A-Za-z0-9_$#]*){0,2})"
# Names after these keywords; a name followed by "(" after FROM/JOIN/USING is a function or a
# parameter list, not a table. Fixed patterns, shared with no grammar: this is a heuristic.
READ_NAME = rf"(?i)\b(?:FROM|JOIN|USING)\s+{_NAME}(\s*\(?)"
WRITE_NAME = (
    r"(?i)\b(?:INTO|UPDATE|(?:CREATE|REPLACE)(?:\s+(?:MULTISET|SET|VOLATILE))*\s+(?:TABLE|VIEW))"
    rf"\s+{_NAME}"
)
CTE_NAME = r"(?i)(?:\bWITH\s+(?:RECURSIVE\s+)?|,\s*)([A-Za-z_]\w*)\s+AS\s*\("
DELETE_FROM = r"(?i)\bDELETE\s+FROM\b"
EXTRACT_FROM = r"(?i)\bEXTRACT\s*\(\s*\w+\s+FROM\b"


def _names(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def table_refs(clean: Column) -> Column:
    """Struct (upstreams, downstreams) of table names found by keyword in a cleaned statement.

    A heuristic for bulk triage where no parser answer exists; it makes no claim of grammar
    accuracy. Names of common table expressions are left out.
    """
    text = F.regexp_replace(
        F.regexp_replace(clean, DELETE_FROM, " INTO "), EXTRACT_FROM, " EXTRACT( "
    )
    ctes = F.transform(_names(text, CTE_NAME), F.lower)
    whole = F.regexp_extract_all(text, F.lit(READ_NAME), F.lit(0))
    read = F.transform(
        F.filter(whole, lambda m: ~m.endswith("(")),
        lambda m: F.regexp_extract(m, READ_NAME, 1),
    )
    wrote = F.filter(_names(text, WRITE_NAME), lambda n: F.upper(n) != "SET")
    not_cte = lambda n: ~F.array_contains(ctes, F.lower(n))
    return F.struct(
        F.array_distinct(F.filter(read, not_cte)).alias("upstreams"),
        F.array_distinct(F.filter(wrote, not_cte)).alias("downstreams"),
    )
