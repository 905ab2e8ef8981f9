from __future__ import annotations

import re
from collections import Counter

from stmtlens.llm import quality

from .conftest import texts_of


def plain(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, covered = Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered),
    )


def key(row):
    return tuple((x is not None, x) for x in row)


def test_measures_equal_plain_counts(odd_docs, odd_rows):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = [(r["doc_id"], *(r[n] for n in names)) for r in quality.measured(odd_docs).collect()]
    want = [(doc_id, *plain(text)) for doc_id, text in texts_of(odd_rows)]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_policies_and_ablation(odd_docs, no_docs):
    entries = quality.ledger(odd_docs).persist()
    base = quality.apply_policy(entries, quality.BASE).where("kept").count()
    assert base == entries.where("n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words").count()
    current = quality.apply_policy(entries, quality.CURRENT).where("kept").count()
    assert current <= base
    effect = {r["rule"]: r for r in quality.ablation(entries, quality.CURRENT).collect()}
    for rule in quality.RULES:
        left = quality.Policy("x", 1, tuple(n for n in quality.CURRENT.rules if n != rule.name))
        kept = quality.apply_policy(entries, left).where("kept").count()
        assert effect[rule.name]["n_kept_without"] == kept
        assert effect[rule.name]["n_only_this"] == kept - current
        assert effect[rule.name]["n_failed"] == entries.where(rule.failed).count()
    assert quality.ledger(no_docs).count() == 0


def test_accepted_keeps_all_columns(odd_docs, no_docs):
    kept = quality.accepted(odd_docs)
    assert kept.columns == odd_docs.columns
    want = quality.apply_policy(quality.ledger(odd_docs), quality.CURRENT).where("kept")
    assert kept.count() == want.count() > 3
    assert quality.accepted(no_docs).count() == 0


def test_accepted_keeps_texts_of_any_script(spark):
    letters = ("абвгдежз", "αβγδεζηθ", "אבגדהוזח", "कखगघचछजझ", "가나다라마바사아")
    texts = [" ".join(x[i % 8] + x[i // 8] + x[i % 7] for i in range(64)) for x in letters]
    texts += ["١٢٣ ٤٥٦ " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in quality.accepted(docs).collect()} == {0, 1, 2, 3, 4}
