"""The registered queries of the text operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from stmtlens.llm import (
    ctw,
    fill_middle,
    fingerprints,
    language,
    line_dedup,
    packing,
    periodic_runs,
    quality,
    secrets,
    sentence_pieces,
    simhash,
    superkmers,
    tensor_minhash,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(documents(spark, sf_dir))
    judged = quality.apply_policy(
        quality.apply_policy(entries, quality.BASE, out="base_kept"), quality.CURRENT
    )
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"), "kept", "fail_bits",
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_neighbours(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = packing.pack(documents(spark, sf_dir), path, end_id=1, length=2048)
    return packing.checked(found)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.dedup(documents(spark, sf_dir)))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_predictions(documents(spark, sf_dir))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.held_out_scores(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(documents(spark, sf_dir)).select(
        "doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(documents(spark, sf_dir)))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.digests(superkmers.drop_repeats(documents(spark, sf_dir), size=13))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentence_pieces.digests(sentence_pieces.encode_decode(documents(spark, sf_dir), path))


def op11_tensor_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor_minhash.components(documents(spark, sf_dir), width=5, percent=85)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_runs(documents(spark, sf_dir))
    return periodic_runs.digests(periodic_runs.collapse_runs(docs, exponent=4, length=6))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(documents(spark, sf_dir), seed=7, rate=100, spm_rate=50)
    return fill_middle.digests(fill_middle.restore(made))


WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

SQL_OP1 = f"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), numbered AS (
  SELECT row_number() OVER () AS r, * FROM split
), wins AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM numbered WHERE len(w) >= 3)
), again AS (
  SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, k) > 1
), covered AS (
  SELECT r, count(DISTINCT i + d) AS n FROM again, (VALUES (0), (1), (2)) AS t(d) GROUP BY r
), measured AS (
  SELECT doc_id, len(w) AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
           - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))))
           AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter_words
  FROM numbered LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, {' + '.join(f"CASE WHEN {r.failed} THEN {r.mask} ELSE 0 END" for r in quality.RULES)}
    AS bits
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       bits & {quality.policy_mask(quality.CURRENT)} = 0 AS kept, bits::BIGINT AS fail_bits
FROM judged
"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL_OP4 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), each AS (
  SELECT r, doc_id, i, lines[i] AS line,
         translate(trim(lines[i], {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs)
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM each WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -r)) >= 3
), judged AS (
  SELECT each.*, repeated.key IS NOT NULL AND keeper IS NOT NULL
                 AND doc_id IS DISTINCT FROM keeper AS gone
  FROM each LEFT JOIN repeated ON each.key = repeated.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""

_WINDOW = " || ' ' || ".join(["w[i]", *[f"w[i + {k}]" for k in range(1, 13)]])

SQL_OP9 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents
), wins AS (
  SELECT r, doc_id, i, {_WINDOW} AS k
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i
        FROM docs WHERE len(w) >= 13 AND doc_id IS NOT NULL)
), repeats AS (
  SELECT r, i FROM wins QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id
), gone AS (
  SELECT DISTINCT r, i + unnest(range(0, 13)) AS i FROM repeats
), words AS (
  SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs
), kept AS (
  SELECT words.r, count(gone.r) AS n_removed,
         string_agg(word, ' ' ORDER BY words.i) FILTER (gone.r IS NULL) AS kept
  FROM words LEFT JOIN gone ON words.r = gone.r AND words.i = gone.i GROUP BY words.r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

SQL_OP11 = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS k
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT r, count(*) AS n FROM shingles GROUP BY r
), common AS (
  SELECT x.r AS a, y.r AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.k = y.k AND x.r <> y.r GROUP BY x.r, y.r
), links AS (
  SELECT a, b FROM common JOIN sizes x ON a = x.r JOIN sizes y ON b = y.r
  WHERE 100 * c >= 85 * (x.n + y.n - c)
), reached AS (
  SELECT r AS a, r AS b FROM docs
  UNION
  SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
), least AS (
  SELECT a AS r, min(doc_id) AS component_id FROM reached JOIN docs ON docs.r = reached.b GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id,
       coalesce(doc_id = component_id, component_id IS NULL) AS kept
FROM docs LEFT JOIN sizes USING (r) JOIN least USING (r)
"""

# CRC-32 a bit at a time: each character of the id meets the register, then eight shifts.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
           string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
         lambda acc, x: xor(xor(acc, x) >> 1, 3988292384::BIGINT * (xor(acc, x) & 1))), 4294967295)"""

# Equal words a period apart, in one stretch: a run of at least four periods has three of them.
SQL_OP12 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w,
         coalesce({_CRC32}, 1) AS h
  FROM documents
), planned AS (
  SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS d FROM docs
), planted AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
           w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // d) END]) ELSE w END AS w
  FROM planned
), words AS (
  SELECT r, n, unnest(range(n)) AS i, unnest(w) AS word FROM planted
), same AS (
  SELECT x.r, x.i, y.i - x.i AS q
  FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM same)
  GROUP BY r, q, g HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length
), told AS (
  SELECT r, count(*) AS n_runs, arg_max(start, (length, -start, -period)) AS start,
         max(length) AS length, arg_max(period, (length, -start, -period)) AS period,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said
  FROM runs GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS said FROM words ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period,
       1000 * length // period AS exponent_milli, sha256(coalesce(told.said, '')) AS runs_sha256,
       sha256(coalesce(kept.said, '')) AS collapsed_sha256
FROM planted LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""

SQL_OP13 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), drawn AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM docs
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), pieces AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p,
         coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(u[b + 1:n], ''), '') AS s
  FROM cut
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
                        ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces
"""

QUERIES = {
    query.__name__: query
    for query in (
        op1_quality_rules, op2_fingerprints, op3_packing, op4_line_dedup, op5_language,
        op6_lm_scores, op7_simhash, op8_secrets, op9_substring_dedup, op10_sentence_pieces,
        op11_tensor_minhash, op12_periodic_runs, op13_fill_middle,
    )
}
SQL = {
    "op1_quality_rules": SQL_OP1, "op4_line_dedup": SQL_OP4, "op9_substring_dedup": SQL_OP9,
    "op11_tensor_minhash": SQL_OP11, "op12_periodic_runs": SQL_OP12, "op13_fill_middle": SQL_OP13,
}
