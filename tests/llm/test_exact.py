"""Exact dedup and its filters against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from serieslake.llm import binary_fuse, exact_dedup
from tables import awkward, documents, found, prose


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 5000, 60000])
def test_filters_hold_their_keys_and_few_others(n):
    pick = np.random.default_rng(n)
    keys = pick.integers(0, 1 << 63, n, dtype=np.uint64)
    fuse = binary_fuse.build(np.concatenate((keys, keys)))
    assert binary_fuse.holds(fuse, keys).all()
    assert binary_fuse.holds(fuse, pick.integers(0, 1 << 63, 50000, dtype=np.uint64)).mean() < 0.008
    assert n < 1000 or len(fuse.slots) < 1.45 * n


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) of each row."""
    plain = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    order = [(-len(t or ""), i is not None, i or 0) for i, t in rows]
    out = []
    for (doc_id, _), norm, own in zip(rows, plain, order):
        best = min(o for o, p in zip(order, plain) if p == norm)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out.append((doc_id, best[2] if best[1] else None, plain.count(norm), own == best, sha))
    return sorted(out, key=repr)


def copies():
    base = prose(1, 120)
    rows = awkward() + [(20 + k, base.replace(" ", " " * (1 + k % 3))) for k in range(40)]
    return rows + [(80 + k, f"text {k % 7}" + "\n" * (k % 4)) for k in range(30)] + [(200, prose(9, 400000)), (201, prose(9, 400000) + "\t")]


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_copies_like_brute_force(spark, batches):
    rows = copies()
    got = exact_dedup.exact_duplicates(documents(spark, rows, extra=True), batches)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_texts_with_one_digest_are_told_apart_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest", lambda norm: F.lit(7).cast("long"))
    rows = [(k, f"text {k % 5}") for k in range(30)]
    assert sorted(map(tuple, exact_dedup.exact_duplicates(documents(spark, rows)).collect()), key=repr) == brute(rows)


def test_filters_screen_what_joins_the_buckets(spark):
    def groups(numbers):
        rows = documents(spark, [(k, f"text {k}") for k in numbers])
        return exact_dedup.grouped(rows.select("doc_id", "text")).cache()

    snapshot = exact_dedup.take_snapshot(groups(range(500)))
    batch = groups(range(400, 3000))
    assert 100 <= exact_dedup.screened(batch, snapshot).count() < 100 + 60  # one in 256 of the others by chance
    known, new = exact_dedup.matched(batch, [snapshot])
    assert known.count() == 100 and new.count() == 2500
    later = exact_dedup.take_snapshot(new)
    known, new = exact_dedup.matched(groups(range(2990, 3005)), [snapshot, later])
    assert known.count() == 10 and new.count() == 5


def test_one_row_of_each_stays_with_its_columns(spark):
    rows = copies()
    docs = documents(spark, rows, extra=True)
    kept = exact_dedup.deduplicated(docs)
    assert kept.dtypes == docs.dtypes
    got = found(kept)
    plain = {re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows}
    assert sum(map(len, got.values())) == len(plain)
    assert got[22][0]["name"] == "x" and not {1, 2, 6, 7} & set(got)  # the longest original of each


def test_empty_table(spark):
    empty = documents(spark, [])
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.deduplicated(empty).count() == 0
