"""Column functions over statement text, labels and identifiers (JVM expressions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stmtlens import constants as K


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace (plain ``trim`` only drops U+0020)."""
    return F.btrim(text, F.lit(K.WHITESPACE))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` where ``value`` is computed once, however often ``use`` names it.

    A column of its own is not enough: a filter on the result is pushed below it, with one copy of
    the value for each mention.
    """
    return F.transform(F.array(value), use)[0]


def is_blank(text: Column) -> Column:
    """True for NULL and for the empty string, which count as "absent" alike."""
    return F.coalesce(text, F.lit("")) == ""


def statement_texts(script: Column) -> Column:
    """The statements of a script: the parts between ``;`` that are not blank.

    Each match starts at the first character that is neither ``;`` nor whitespace, so blank parts
    never match; trailing whitespace is left for ``strip``.
    """
    return F.regexp_extract_all(script, F.lit(f"([^;{K.WHITESPACE_CLASS}][^;]*)"), F.lit(1))


def clean_sql(text: Column) -> Column:
    """Replace block comments, then line comments (``--``, ``//``, ``#``), by one space; strip."""
    no_blocks = F.regexp_replace(text, r"(?s)/\*.*?\*/", " ")
    return strip(F.regexp_replace(no_blocks, r"(?:--|//|#)[^\n]*", " "))


def file_stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def leading_words(clean: Column) -> Column:
    """The first keywords of a cleaned statement, upper case, joined by one space.

    The head of the text up to the last wanted keyword is cut first, so a long statement is not
    tokenised in full.
    """
    word, gap = "[A-Za-z_#]++", "[^A-Za-z_#]*+"
    head = F.regexp_extract(clean, f"^(?:{gap}{word}){{0,{K.LEADING_TOKEN_LIMIT}}}", 0)
    return F.upper(F.trim(F.regexp_replace(head, "[^A-Za-z_#]+", " ")))


def leading_tokens(clean: Column) -> Column:
    return F.array_remove(F.split(leading_words(clean), " "), "")


_PAIR_TYPES = "|".join(
    f"{verb} (?:{'|'.join(objects)})" for verb, objects in K.OBJECTS_BY_VERB.items()
)


def statement_type_of(words: Column) -> Column:
    """Statement type from the leading keywords.

    Few branches over patterns rather than one branch per keyword: a long chain makes the generated
    method too big for the JVM to compile.
    """
    first = F.substring_index(words, " ", 1)
    kinds = f"^({'|'.join(K.TABLE_KIND_VERBS)}) (?:{'|'.join(K.TABLE_KINDS)}) TABLE\\b"
    pair = F.regexp_extract(F.regexp_replace(words, kinds, "$1 TABLE"), f"^({_PAIR_TYPES})\\b", 1)
    after_with = f"^WITH(?: \\S+)*? ({'|'.join(K.DML_KEYWORDS)})\\b"
    dml = F.regexp_extract(words, after_with, 1)
    return (
        F.when(first.isin(*K.OBJECTS_BY_VERB), F.when(pair == "", first).otherwise(F.translate(pair, " ", "_")))
        .when(first == "WITH", F.when(dml == "", "SELECT").otherwise(dml))
        .when(first == "SEL", "SELECT")
        .when(first.isin(K.CALL_KEYWORDS), "CALL")
        .when(first == "", "UNKNOWN")
        # Every other keyword (SELECT, GRANT, LOCKING, DATABASE, BT, ET, ...) names its own type.
        .otherwise(first)
    )


def type_label(label: Column) -> Column:
    """Normal form of a reported type: last dotted part, separators to ``_``, upper; blank is NULL."""
    tail = F.substring_index(strip(label), ".", -1)
    joined = F.regexp_replace(F.translate(tail, "/-", "__"), K.WHITESPACE_RUN, "_")
    return F.nullif(F.upper(joined), F.lit(""))


def reported_type(*labels: Column) -> Column:
    """First usable type label among the spellings a payload may carry."""
    return F.coalesce(*[type_label(label) for label in labels])


def resolved_type(label: Column, inferred: Column) -> tuple[Column, Column]:
    """(statement type, its source): the parser's normalised label unless it is unusable."""
    usable = F.coalesce(label, F.lit("UNKNOWN")) != "UNKNOWN"
    return (
        F.when(usable, label).otherwise(inferred),
        F.when(usable, "parser").otherwise("fallback"),
    )


def error_label(message: Column) -> Column:
    """Error class: the message up to the first ``:``, ``.`` or ``<``."""
    text = strip(F.coalesce(message, F.lit("")))
    head = strip(F.regexp_extract(text, r"^([^:.<]*)", 1))
    return (
        F.when(text == "", K.NO_ERROR).when(head == "", K.UNKNOWN_ERROR).otherwise(head)
    )


def status_label(rpc_error: Column, parser_error: Column) -> Column:
    return (
        F.when(~is_blank(rpc_error), "RPC_ERROR")
        .when(~is_blank(parser_error), "PARSE_ERROR")
        .otherwise("OK")
    )


def sanitized_component(label: Column) -> Column:
    """A label fit for a file name: letters, digits and ``-_.#``."""
    kept = F.regexp_replace(label, r"[^\p{L}\p{N}\-_.#]", "_")
    return _or_if_empty(F.substring(F.btrim(kept, F.lit("_")), 1, K.COMPONENT_LIMIT), "result")


def _or_if_empty(text: Column, default: str) -> Column:
    """``default`` for the empty text; one pattern, so ``text`` is evaluated once."""
    return F.regexp_replace(text, r"^\z", default)


def identifier_text(value: Column, fallback: str) -> Column:
    """``value`` in identifier characters, of any length.

    What lies between runs of other characters, joined by one ``_``; none stays at the ends.
    """
    parts = F.regexp_extract_all(value, F.lit(r"[A-Za-z0-9.:/\\-]+"), F.lit(0))
    return _or_if_empty(F.array_join(parts, "_"), fallback)


def bounded_identifier(cleaned: Column) -> Column:
    """Lower case; a text that is too long is cut and ends in a digest of the whole."""
    prefix_length = K.IDENTIFIER_LIMIT - K.IDENTIFIER_DIGEST - 1

    def bounded(text: Column) -> Column:
        shortened = F.concat(
            F.substring(text, 1, prefix_length),
            F.lit("_"),
            F.substring(F.sha1(F.encode(text, "UTF-8")), 1, K.IDENTIFIER_DIGEST),
        )
        return F.lower(F.when(F.length(text) <= K.IDENTIFIER_LIMIT, text).otherwise(shortened))

    return once(cleaned, bounded)


def sanitized_identifier(value: Column, fallback: str) -> Column:
    """A lower-case identifier of bounded length."""
    return bounded_identifier(identifier_text(value, fallback))


def relative_label(path: Column, base_dir: str = "") -> Column:
    """``path`` below ``base_dir`` with ``/`` separators; other paths stay as they are."""
    posix = F.translate(path, "\\", "/")
    if not base_dir:
        return posix
    base = base_dir.replace("\\", "/").rstrip("/") + "/"
    return F.when(
        posix.startswith(base) & (F.length(posix) > len(base)),
        F.substr(posix, F.lit(len(base) + 1)),
    ).otherwise(posix)


def _shortened(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last one ``…`` where something was cut."""
    return F.regexp_replace(text, f"(?s)^(.{{{limit - 1}}}).{{2,}}\\z", "$1…")


def truncated_property(text: Column, limit: int = K.PROPERTY_LIMIT) -> Column:
    return _shortened(F.regexp_replace(strip(text), K.WHITESPACE_RUN, " "), limit)


def query_preview(text: Column, limit: int = K.PREVIEW_LIMIT) -> Column:
    """The non-empty lines of a statement in one line.

    Stripping lines, dropping empty ones and joining by a space is the same as replacing every
    whitespace run that holds a line break.
    """
    condensed = F.regexp_replace(strip(text), K.LINE_JOIN, " ")
    return _shortened(_or_if_empty(condensed, K.EMPTY_PREVIEW), limit)


def lines_of(text: Column) -> Column:
    return F.split(text, K.LINE_BREAK, -1)


def fixed_point(number: Column, digits: int) -> Column:
    """A number as text with ``digits`` decimals, exact ties to the even digit."""
    micro = F.round(number, 6).cast("decimal(26,6)")
    return F.bround(micro, digits).cast(f"decimal(26,{digits})").cast("string")
