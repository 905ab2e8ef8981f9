"""Statements from script files and CSV columns, parser answers and expectations from JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stmtlens import schemas
from stmtlens.functions import text as tx
from stmtlens.operators.statements import split_statements
from stmtlens.sources.csv_cells import column_cells


def local_path(path: Column, relative_to: str = "") -> Column:
    """A scan's file path as written: ``file:///a%20b`` is ``/a b``; other schemes are kept.

    ``relative_to`` is a folder; paths below it are given relative to it.
    """
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return tx.relative_label(F.regexp_replace(decoded, "^file:/+", "/"), relative_to)


def is_directory(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getFileStatus(hadoop_path).isDirectory()


def _unified_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def with_file_identity(statements: DataFrame, input_ordinal: int = 0) -> DataFrame:
    """Identifier, context and origin of statements that came from script files."""
    position = F.col("stmt_index").cast("string")
    return statements.select(
        F.concat("source_path", F.lit(":"), position).alias("identifier"),
        "query_text",
        F.lit("file").alias("origin"),
        F.concat("source_path", F.lit(" (statement "), position, F.lit(")")).alias("context"),
        "source_path",
        "stmt_index",
        F.lit(None).cast("bigint").alias("row_number"),
        F.lit(input_ordinal).alias("input_ordinal"),
    )


def _without_mark(text: Column) -> Column:
    """A text without the byte order mark that a file may start with, and with plain line ends."""
    return F.regexp_replace(_unified_newlines(text), "^\ufeff", "")


def whole_scripts(texts: DataFrame, relative_to: str = "") -> DataFrame:
    """Path and text of files read as one value each (by a stream, which cannot number blocks)."""
    return texts.select(
        local_path(F.col("_metadata.file_path"), relative_to).alias("source_path"),
        _without_mark(F.col("value")).alias("script_text"),
    )


def _cut_scripts(reader, paths: list[str], relative_to: str) -> DataFrame:
    """Records of a script of any size, cut at ``;`` by the scan itself, over many tasks.

    A byte order mark at the start of a file is dropped. Running ids, given after blanks are dropped,
    are consecutive inside a file block; so a statement's number follows from the first id of its
    block and the counts of the blocks before it, one small row per block, and no text moves for it.
    """
    cut = (
        reader.option("lineSep", ";")
        .text(paths)
        .select(
            local_path(F.col("_metadata.file_path"), relative_to).alias("source_path"),
            F.col("_metadata.file_block_start").alias("_block"),
            tx.strip(_without_mark(F.col("value"))).alias("query_text"),
        )
        .where(F.col("query_text") != "")
        .withColumn("_id", F.monotonically_increasing_id())
    )
    blocks_before = (
        Window.partitionBy("_path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = (
        cut.groupBy(F.col("source_path").alias("_path"), F.col("_block").alias("_at"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
        .select(
            "_path", "_at",
            (F.coalesce(F.sum("_n").over(blocks_before), F.lit(0)) - F.col("_first") + 1)
            .alias("_shift"),
        )
    )
    same = (F.col("source_path") == F.col("_path")) & (F.col("_block") == F.col("_at"))
    # One row per file block, so the texts stay where they are.
    return cut.join(F.broadcast(shifts), same).select(
        "source_path", (F.col("_id") + F.col("_shift")).cast("bigint").alias("stmt_index"),
        "query_text",
    )


def _scripts(
    spark: SparkSession, paths: Sequence[str], pattern: str | None, input_ordinal: int,
    relative_to: str,
) -> DataFrame:
    reader = spark.read
    if pattern:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return with_file_identity(_cut_scripts(reader, list(paths), relative_to), input_ordinal)


def sql_dirs(
    spark: SparkSession, paths: Sequence[str], pattern: str = "*.sql", input_ordinal: int = 0,
    relative_to: str = "",
) -> DataFrame:
    """Statements of every matching file below the directories."""
    return _scripts(spark, paths, pattern, input_ordinal, relative_to)


def sql_files(
    spark: SparkSession, paths: Sequence[str], input_ordinal: int = 0,
    relative_to: str = "",
) -> DataFrame:
    """Statements of the named files, whatever their extension."""
    return _scripts(spark, paths, None, input_ordinal, relative_to)


def _csv(
    spark: SparkSession, paths: Sequence[str], column: str, delimiter: str, recursive: bool,
    input_ordinal: int, relative_to: str,
) -> DataFrame:
    found = column_cells(spark, paths, column, delimiter, recursive)
    located = found.select(
        local_path(F.col("path"), relative_to).alias("source_path"),
        (F.col("number") + 1).alias("row_number"), F.col("cell").alias("script_text"),
    ).where(tx.strip(F.coalesce("script_text", F.lit(""))) != "")
    row, position = F.col("row_number").cast("string"), F.col("stmt_index").cast("string")
    return split_statements(located).select(
        F.concat("source_path", F.lit(":row"), row, F.lit(":stmt"), position).alias("identifier"),
        "query_text",
        F.lit("csv").alias("origin"),
        F.concat(
            "source_path", F.lit(" row "), row, F.lit(f" column '{column}' (statement "), position,
            F.lit(")"),
        ).alias("context"),
        "source_path",
        "stmt_index",
        "row_number",
        F.lit(input_ordinal).alias("input_ordinal"),
    )


def csv_column(
    spark: SparkSession, spec: str, delimiter: str = ",", input_ordinal: int = 0,
    relative_to: str = "",
) -> DataFrame:
    """Statements of one CSV column; ``spec`` is ``PATH:COLUMN``, cut at the first colon."""
    path, colon, column = spec.partition(":")
    if not colon:
        raise ValueError("a CSV spec has the form PATH:COLUMN")
    return _csv(spark, [path], column, delimiter, False, input_ordinal, relative_to)


def csv_dirs(
    spark: SparkSession, paths: Sequence[str], column: str, delimiter: str = ",",
    input_ordinal: int = 0, relative_to: str = "",
) -> DataFrame:
    """Statements of the column of that name in every ``*.csv`` below the directories; the files may
    have different headers."""
    return _csv(spark, paths, column, delimiter, True, input_ordinal, relative_to)


def all_inputs(
    spark: SparkSession,
    files: Sequence[str] = (),
    dirs: Sequence[str] = (),
    csv_specs: Sequence[str] = (),
    csv_directories: Sequence[str] = (),
    csv_dir_column: str | None = None,
    delimiter: str = ",",
    relative_to: str = "",
    pattern: str = "*.sql",
) -> DataFrame:
    """All inputs in the order files, directories, CSV specs, CSV directories; nothing is dropped.

    ``input_ordinal`` keeps the order of the inputs; inside one input the order is
    (source_path, row_number, stmt_index). A directory among ``files`` is searched like ``dirs``,
    for files that match ``pattern``.
    Paths below the folder ``relative_to`` are given relative to it.
    """
    if csv_directories and not csv_dir_column:
        raise ValueError("csv_dir_column is required with csv_directories")
    parts: list[DataFrame] = []
    for path in files:
        if is_directory(spark, path):
            parts.append(sql_dirs(spark, [path], pattern, len(parts), relative_to))
        else:
            parts.append(sql_files(spark, [path], len(parts), relative_to))
    for path in dirs:
        parts.append(sql_dirs(spark, [path], pattern, len(parts), relative_to))
    for spec in csv_specs:
        parts.append(csv_column(spark, spec, delimiter, len(parts), relative_to))
    for path in csv_directories:
        parts.append(csv_dirs(spark, [path], csv_dir_column, delimiter, len(parts), relative_to))
    if not parts:
        raise ValueError("no input given")
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part)
    return combined


def _said(value: str, path: str, kind: T.DataType) -> Column:
    """A field of a parsed text; null where it is absent or of another type."""
    return F.try_variant_get(value, path, kind.simpleString())


def _fields(value: str, schema: T.StructType) -> list[Column]:
    """The fields of an object, each by itself, so that one of a wrong type is lost alone."""
    return [_said(value, f"$.{f.name}", f.dataType).alias(f.name) for f in schema]


def payload_from_text(documents: DataFrame, text: str = "value") -> DataFrame:
    """Parser answers from JSON texts, with a fixed schema; ``raw_payload`` is the text as it came.

    Each text is parsed once, to a variant from which all fields and spellings of keys are taken.
    Texts that are no JSON object, or name no statement, are left to ``malformed_from_text``.
    """
    parsed = documents.select(F.try_parse_json(text).alias("_said"), F.col(text).alias("raw_payload"))
    flat = T.StructType([f for f in schemas.PAYLOAD if f.name != "debug_info"])
    debug = [
        _said("_said", f"$.debug_info.{f.name}", f.dataType).alias(f.name) for f in schemas.DEBUG_INFO
    ]
    there = F.try_variant_get("_said", "$.debug_info", "variant").isNotNull()
    return parsed.select(
        *_fields("_said", flat),
        F.when(there, F.struct(*debug)).alias("debug_info"),
        _said("_said", "$.querytype", T.StringType()).alias("querytype_lower"),
        "raw_payload",
    ).where(F.col("identifier").isNotNull())


def malformed_from_text(documents: DataFrame, text: str = "value") -> DataFrame:
    """The texts among parser answers that give no answer to any statement."""
    named = F.try_variant_get(F.try_parse_json(text), "$.identifier", "string")
    return documents.where(named.isNull())


def _answer_texts(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=multi_line)


def payloads(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Parser answers from JSON: one object per file, or one per line."""
    return payload_from_text(_answer_texts(spark, path, multi_line))


def malformed_payloads(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """What ``payloads`` cannot use, with the file it stands in."""
    texts = _answer_texts(spark, path, multi_line).select(
        "value", local_path(F.col("_metadata.file_path")).alias("source_path")
    )
    return malformed_from_text(texts)


def expected_from_text(documents: DataFrame, text: str = "document") -> DataFrame:
    """Expected lineage from JSON texts: an object, or an array with one object per statement.

    Texts that are no JSON have none.
    """
    others = [c for c in documents.columns if c != text]
    parsed = documents.select(*others, F.try_parse_json(text).alias("_said")).where("_said IS NOT NULL")
    several = F.coalesce(F.try_variant_get("_said", "$", "array<variant>"), F.array("_said"))
    return parsed.select(*others, F.posexplode(several).alias("_pos", "_one")).select(
        *others, (F.col("_pos") + 1).cast("bigint").alias("stmt_index"), *_fields("_one", schemas.EXPECTED)
    )


def expected_results(spark: SparkSession, path: str) -> DataFrame:
    """Expected lineage of every ``*.json`` below ``path``, matched by file stem and statement."""
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .text(path, wholetext=True)
        .select(
            F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("query_id"),
            F.col("value").alias("document"),
        )
    )
    return expected_from_text(files)
