"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from serieslake.llm import ranked_search
from tables import CLASHES, awkward, documents, prose

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERMS.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc_id, c in held:
            m = 25 + (75 * c.total() * n_docs) // max(n_terms, 1)
            score = sum(
                r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, r in wanted.items() if t in c
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", *[f"'x' AS {c.split()[0]}" for c in CLASHES.split(", ") if not c.startswith("item_id")])


def tables():
    docs = awkward() + [(100 + k, prose(k, 30 + 7 * (k % 9), vocabulary=150)) for k in range(120)]
    docs += [(300 + k, prose(3, 40, vocabulary=150)) for k in range(15)] + [(400, "rare1 rare2 " + prose(8, 300000, vocabulary=150))]
    items = [(k, prose(1000 + k, 12, vocabulary=150)) for k in range(12)] + [(50, None), (51, ""), (52, "nowhere to-be-found"), (None, "two words ONE"), (53, prose(3, 40, vocabulary=150)), (54, "rare1 rare1 中文字")]
    return docs, [*items, (3, "two words two")]


@pytest.mark.parametrize("block", [200_000, 20])
def test_ranks_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    docs, items = tables()
    got = ranked_search.search(documents(spark, docs, extra=True), items_of(spark, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = tables()
    assert ranked_search.search(documents(spark, []), items_of(spark, items)).count() == 0
    assert ranked_search.search(documents(spark, docs[:5]), items_of(spark, [])).count() == 0


@pytest.mark.parametrize("window, short", [(4, 1), (16, 3), (64, 16), (1024, 10**9)])
def test_windows_are_skipped_and_nothing_is_lost(monkeypatch, window, short):
    monkeypatch.setattr(ranked_search, "WINDOW", window)
    monkeypatch.setattr(ranked_search, "SHORT", short)
    pick = random.Random(window)
    words = [f"w{k}" for k in range(40)]
    weights = [1 / (1 + k) for k in range(40)]
    texts = [(k, " ".join(pick.choices(words, weights, k=pick.randrange(1, 60)))) for k in range(600)]
    texts += [(1000 + k, "w39 w38 w37 w36 w35 w34") for k in range(12)]
    builder = ranked_search.Builder({w.encode(): n for n, w in enumerate(words)})
    for doc_id, text in pick.sample(texts, len(texts)):
        builder.add(doc_id, text.encode())
    segment = ranked_search._segment(builder.batch().to_pylist()[0])
    df = Counter(w for _, t in texts for w in set(t.split()))
    searcher = ranked_search.Searcher(segment, builder.n_docs, builder.n_terms)
    for number in range(30):
        wanted = Counter(pick.choices(words, k=8)) if number else Counter(words[30:])
        factors = {words.index(w): r * ranked_search.weight(len(texts), df[w]) for w, r in wanted.items()}
        at, scores = searcher.best(factors, 10)
        want = brute(texts, [(0, " ".join(wanted.elements()))])
        assert sorted(((0, k, int(segment.docs[a]), int(s)) for k, (a, s) in enumerate(zip(at, scores), 1)), key=repr) == want
    assert window >= 64 or searcher.skipped > 0
    assert np.all(np.diff(segment.docs) >= 0)
