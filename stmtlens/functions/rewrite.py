"""Text rewrites that bring dialect statements into a form a parser accepts, and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stmtlens import constants as K
from stmtlens.functions.text import strip


def _replace(text: Column, rule: tuple[str, str]) -> Column:
    return F.regexp_replace(text, rule[0], rule[1])


def without_using(text: Column) -> Column:
    """Drop the parameter declarations in front of the statement proper."""
    return _replace(text, K.REWRITE_USING)


def expand_ct(text: Column) -> Column:
    return _replace(text, K.REWRITE_CT)


def without_locking(text: Column) -> Column:
    return _replace(text, K.REWRITE_LOCKING)


def named_to_alias(text: Column) -> Column:
    return _replace(text, K.REWRITE_NAMED)


def placeholders(text: Column) -> Column:
    """All template variables and parameter markers, in order."""
    return F.regexp_extract_all(text, F.lit(f"({K.PLACEHOLDER})"), F.lit(1))


def fill_placeholders(text: Column, value: str = "NULL") -> Column:
    return F.regexp_replace(text, K.PLACEHOLDER, value)


def generalized(text: Column) -> Column:
    """Literals to ``?`` and whitespace runs to one space."""
    no_strings = F.regexp_replace(text, r"(?:'[^']*')+", "?")
    no_numbers = F.regexp_replace(no_strings, r"\b\d+(?:\.\d+)?\b", "?")
    return strip(F.regexp_replace(no_numbers, r"\s+", " "))


PROCEDURE_HEADER = r"(?is)^(?:CREATE|REPLACE)\s+PROCEDURE\b.*?\bBEGIN\b\s*"
CONTROL_PREFIX = r"(?is)^(?:(?:BEGIN|ELSE|(?:ELSE)?IF\b.*?\bTHEN)\s+)+"


def procedure_step(text: Column) -> Column:
    """One ``;`` part of a procedure body without header and control-flow prefix."""
    return strip(F.regexp_replace(F.regexp_replace(text, PROCEDURE_HEADER, ""), CONTROL_PREFIX, ""))
