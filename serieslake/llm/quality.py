"""Quality classifier: logistic regression on hashed word n-grams, trained by
follow-the-regularised-leader updates and scored as sparse dot products.

A text's n-grams are its words (A-Z lowered), pairs of words, and one to three neighbouring
*shapes* of words and marks (all capitals, capitalised, lower, digits, a run of marks, the same
word again). Each counts with its share of the text's n-grams of that sort, so a score is the
dot product of the weights with those shares. Nothing but the text enters a score.

Nulls and empty texts score the bias alone; repeated rows score alike; rows of ``labels`` with a
null doc_id or label, and ids labelled both ways, teach nothing. Without any label
all scores are 0.5. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslake.llm import words
from serieslake.llm.common import begin, labelled_sample, text_of, with_columns_of_text
from serieslake.llm.ftrl import Ftrl

BITS = 18  # weights per sort of n-gram: 2 ** BITS
SORTS = 5
PER_CLASS = 1500  # labelled texts of each class that a model is fitted on, at most
EPOCHS = 4
SCALE = 20.0


def held_out(doc_id: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _ngrams(run: words.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weight index, bounds by text) of every n-gram, one pair for each sort."""
    upper = np.concatenate(([0], np.cumsum((run.data >= 65) & (run.data <= 90))))
    length = run.end - run.start
    capitals = upper[run.end] - upper[run.start]
    first = run.data[run.start]
    shape = np.where(
        run.kind == 2,
        16 + run.data[run.start].astype(np.int64) * 4 + np.minimum(length, 4) - 1,
        np.where((capitals == length) & (length > 1), 1, np.where((first >= 65) & (first <= 90), 2, np.where((first >= 48) & (first <= 57), 3, 4))),
    ).astype(np.uint64)
    h = run.hash
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[np.minimum(run.bounds[:-1], max(len(h) - 1, 0))] = False
    shape[again & (run.kind == 1)] = 5
    out = []
    with np.errstate(over="ignore"):
        pair = words.mixed(h[:-1] * np.uint64(3) + h[1:])
        shape2 = words.mixed(shape[:-1] * np.uint64(4096) + shape[1:])
        shape3 = words.mixed(shape2[:-1] * np.uint64(5) + shape[2:])
        grams = [(1, words.mixed(h + np.uint64(7))), (2, pair), (1, words.mixed(shape)), (2, shape2), (3, shape3)]
    for sort, (n, hashes) in enumerate(grams):
        index = (hashes >> np.uint64(64 - BITS)).astype(np.int64) + (sort << BITS)
        # n-grams start at all but the last n - 1 words of a text
        low = np.minimum(run.bounds[:-1], len(index))
        high = np.maximum(low, run.bounds[1:] - (n - 1))
        out.append((index, np.stack((low, high))))
    return out


def _scores(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    margin = np.full(len(texts), bias)
    for first, run in words.runs(texts):
        found = words.Words(run, words.LETTERS_OR_MARKS)
        if not len(found.hash):
            continue
        for index, (low, high) in _ngrams(found):
            total = np.concatenate(([0.0], np.cumsum(weights[index], dtype=np.float64)))
            margin[first : first + len(run)] += SCALE * (total[high] - total[low]) / np.maximum(high - low, 1)
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))


def _fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follow-the-regularised-leader over the sample, in id order."""
    begin()
    sample = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "label": []}), *frames]).sort_values(["doc_id", "text"])
    rows = []
    for first, run in words.runs(sample["text"].tolist()):
        found = words.Words(run, words.LETTERS_OR_MARKS)
        grams = _ngrams(found) if len(found.hash) else []
        for i in range(len(run)):
            index, count, distinct, held = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [], []
            for all_index, (low, high) in grams:
                own, times = np.unique(all_index[low[i] : high[i]], return_counts=True)
                index.append(own.astype(np.int32))
                count.append(times.astype(np.int32))
                distinct.append(len(own))
                held.append(max(high[i] - low[i], 1))
            # shares are made from counts at each use, so that an n-gram takes 8 bytes here
            rows.append((np.concatenate(index), np.concatenate(count), distinct, held))
    size = (SORTS << BITS) + 1
    model = Ftrl(size)
    labels = sample["label"].to_numpy(dtype=float)
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            index, count, distinct, held = rows[k]
            value = SCALE * count / np.repeat(np.array(held, np.int64), np.array(distinct, np.int64))
            index, value = np.append(index, size - 1), np.append(value, 1.0)
            w = model.at(index)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -30, 30)))
            model.learn(index, w, (p - labels[k]) * value)
    del rows
    w = model.all()
    yield pd.DataFrame({"weights": [w.astype(np.float32).tobytes()]})


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """(weights, bias) from at most ``per_class`` labelled, not held-out texts of each class.

    The ids with the least hash are taken. Only the sample, bounded by ``per_class``, meets in one
    task, and only the weights reach the driver.
    """
    sample = labelled_sample(documents, labels.where(~held_out()), label, (per_class, per_class))
    found = sample.mapInPandas(_fit, "weights binary").first()
    w = np.frombuffer(found[0], np.float32) if found else np.zeros((SORTS << BITS) + 1, np.float32)
    return w[:-1], float(w[-1])


def score(documents: DataFrame, weights: np.ndarray, bias: float, columns: list[str] | None = None, text: str = "text") -> DataFrame:
    """``columns`` of the documents (all by default) with quality_score and quality_label added."""
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast((weights, bias))  # 2 ** BITS * SORTS weights, whatever the corpus

    def scored(texts):
        values = _scores(texts, *model.value)
        return values, (values >= 0.5).astype(np.int32)

    return with_columns_of_text(documents, columns, "quality_score double, quality_label int", scored, text=text)
