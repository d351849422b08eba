"""Phrase collocations against brute force."""

import itertools
import random
import re
from collections import Counter

import pytest

from serieslake.llm import collocations
from tables import CLASHES, awkward, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def brute(rows, longest=3, least=10, percent=50, top=2000):
    counts, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for size in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    found = {key: f for key, f in counts.items() if len(key[1]) > 1 and f >= least}
    out = []
    for (lang, words), a in found.items():
        covered = any(
            other == lang and len(more) > len(words) and 100 * f >= percent * a and any(more[i : i + len(words)] == words for i in range(len(more)))
            for (other, more), f in found.items()
        )
        if covered:
            continue
        cuts = [(counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min((1000000 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
        out.append((lang, -score, -a, " ".join(words).encode(), left, right))
    result = []
    for lang, group in itertools.groupby(sorted(out), key=lambda r: r[0]):
        for rank, (_, score, a, phrase, left, right) in enumerate(itertools.islice(group, top), 1):
            result.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return result


def table(spark, rows):
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    return docs.selectExpr("*", *[f"'x' AS {c.split()[0]}" for c in CLASHES.split(", ")], "'y' AS word", "'y' AS words", "'y' AS place", "'y' AS chunk")


def texts():
    pick = random.Random(3)
    words = [f"w{k}" for k in range(30)] + ["Über", "ÉTÉ", "中文", "a\x00b", "c\x1cd", "--", "I'm"]
    weights = [1 / (1 + k) for k in range(len(words))]
    rows = []
    for k in range(400):
        run = []
        for word in pick.choices(words, weights, k=pick.randrange(0, 30)):
            run.append(word if pick.random() > 0.05 else word.upper())
            run.append(pick.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " . ", "?!"]))
            if pick.random() < 0.08:
                run.append("new york city " if k % 3 else "New York ")
        rows.append(("".join(run), ["en", "de", None, "und"][k % 4]))
    return rows + [(t, "en") for _, t in awkward()] + [("the same row again", "fr")] * 25 + [(prose(5, 200000, vocabulary=60), "long")]


def test_like_brute_force(spark):
    rows = texts()
    got = collocations.collocations(table(spark, rows))
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string")] + [(c, "bigint") for c in ("a", "l", "r", "n", "score")]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


@pytest.mark.parametrize("longest, least, percent, top", [(2, 3, 50, 7), (5, 12, 80, 40)])
def test_other_lengths_and_thresholds(spark, longest, least, percent, top):
    rows = texts()[:-1]
    got = collocations.collocations(table(spark, rows), longest, least, percent, top)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, longest, least, percent, top))


def test_chunks_change_nothing(spark):
    rows = texts()[:400]
    one, many = (collocations.collocations(table(spark, rows).repartition(n)) for n in (1, 40))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_products_beyond_64_bits(spark):
    a, wide = 3_000_000_000, 4_000_000_000
    row = spark.createDataFrame([(a, wide, a)], "a long, l long, r long")
    score = row.select(collocations._score(row["a"], row["l"], row["r"])).first()[0]
    assert score == 1000000 * a * a // (wide * a)


def test_empty_tables_and_texts(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [(None, None), ("", "en"), (" . ", "en"), ("one two", "en")])).count() == 0
