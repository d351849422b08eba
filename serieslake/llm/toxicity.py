"""Toxicity: cumulative-link ordinal regression from sparse text features to severity grades.

A text's features are its distinct words (A-Z lowered) and the first four and five bytes of longer words,
hashed. One weight per feature is shared by all grades; P(grade > k) = sigmoid(f - threshold k) with
ascending thresholds, and the expected severity is the sum of those chances. Weights and both thresholds are
learned in the likelihood of the grades. Which texts are called toxic is another matter: they are those from a decision cut on,
the f that tells the sample's toxic from its clean texts best, and the cut leaves the model as it is. Labels tell toxic from
clean only, so training grades toxic texts by how dense the features are that mark toxic texts:
below the median of the toxic sample is grade 1, from it on grade 2. Only marking features get a weight.

Null and empty texts have no features and get the chances of the thresholds alone. Texts of any length are read whole. Rows that
repeat score alike. Without labelled texts of both classes all severities are 0. Extra columns are dropped
unless asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from serieslake.llm import words
from serieslake.llm.common import begin, labelled_sample, with_columns_of_text
from serieslake.llm.ftrl import Ftrl

BITS = 20
PER_CLASS = (3000, 1500)  # labelled clean and toxic texts that a model is fitted on, at most
EPOCHS = 6
LIKELIHOOD = 12.0  # a feature marks toxic texts from this log-likelihood ratio on,
RATIO = 10.0  # if that many times as large a share of toxic texts has it
CLEAN_COST = 2.0  # a clean text called toxic weighs as much as so many toxic ones missed
PREFIXES = (4, 5)
LEAST_GAP = 0.001  # between the thresholds


def _features(run: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and word beginning, with repeats."""
    letters = np.flatnonzero(run.kind == 1)
    start, end = run.start[letters], run.end[letters]
    text = np.searchsorted(run.bounds, letters, side="right") - 1
    hashes, owners = [run.hash[letters]], [text]
    for n in PREFIXES:
        longer = end - start > n
        hashes.append(run.of(start[longer], start[longer] + n) + np.uint64(n))
        owners.append(text[longer])
    feature = (words.mixed(np.concatenate(hashes)) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate(owners), feature


def _distinct(text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique((text.astype(np.int64) << BITS) | feature)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _marks(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """The features that mark toxic texts, by their log-likelihood ratio."""
    held = np.zeros((2, 1 << BITS))
    for row, t in zip(rows, toxic):
        held[t, row] += 1
    texts = np.bincount(toxic, minlength=2).astype(float)[:, None]
    expected = held.sum(axis=0) * texts / texts.sum()
    ratio = np.zeros(1 << BITS)
    for seen, awaited in ((held, expected), (texts - held, texts - expected)):
        ratio += 2 * (seen * np.log(np.maximum(seen, 1e-12) / np.maximum(awaited, 1e-12))).sum(axis=0)
    return (ratio >= LIKELIHOOD) & (held[1] / texts[1] >= RATIO * held[0] / texts[0])


def _grades(marked: list[np.ndarray], counts: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """0 for clean texts; 1 or 2 for toxic ones by the density of marking features."""
    density = np.array([len(m) / max(len(c), 1) for m, c in zip(marked, counts)])
    return np.where(toxic == 0, 0, np.where(density >= np.median(density[toxic == 1]), 2, 1))


def log_likelihood(margins: np.ndarray, grade: np.ndarray, low: float, high: float) -> float:
    below, under = _sigmoid(low - margins), _sigmoid(high - margins)
    return float(np.log(np.maximum(np.choose(grade, (below, under - below, 1 - under)), 1e-12)).sum())


def _thresholds(margins: np.ndarray, grade: np.ndarray, low: float, high: float) -> tuple[float, float]:
    """The thresholds of greatest likelihood at given margins, by Newton steps that are halved until they gain."""
    at, reached = np.array([low, high]), log_likelihood(margins, grade, low, high)
    first, second, third = (grade == g for g in range(3))
    for _ in range(100):
        a, b = _sigmoid(at[0] - margins), _sigmoid(at[1] - margins)
        da, db, p = a * (1 - a), b * (1 - b), np.maximum(b - a, 1e-12)
        slope = np.array([(1 - a)[first].sum() - (da / p)[second].sum(), (db / p)[second].sum() - b[third].sum()])
        cross = (da * db / p**2)[second].sum()
        bend = np.array(
            [
                [-da[first].sum() - (da * (1 - 2 * a) / p + (da / p) ** 2)[second].sum(), cross],
                [cross, (db * (1 - 2 * b) / p - (db / p) ** 2)[second].sum() - db[third].sum()],
            ]
        )
        step = np.linalg.solve(np.eye(2) * 1e-6 - bend, slope)
        while np.abs(step).max() > 1e-7:
            to = np.clip(at + step, -30, 30)
            gained = log_likelihood(margins, grade, *to)
            if to[1] >= to[0] + LEAST_GAP and gained > reached:
                at, reached = to, gained
                break
            step = step / 2
        else:
            break
    return float(at[0]), float(at[1])


def _cut(margins: np.ndarray, toxic: np.ndarray) -> float:
    """The margin that tells the sample's toxic from its clean texts best."""
    order = np.argsort(margins, kind="stable")
    margins, toxic = margins[order], toxic[order]
    missed = np.cumsum(toxic) / max(toxic.sum(), 1)
    called = 1 - np.cumsum(1 - toxic) / max((1 - toxic).sum(), 1)
    cost = missed + CLEAN_COST * called
    cost[:-1][margins[1:] == margins[:-1]] = np.inf  # no cut between equal margins
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float((margins[best[0]] + margins[min(best[-1] + 1, len(margins) - 1)]) / 2)


def _fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    begin()
    sample = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "label": []}), *frames]).sort_values("doc_id")
    toxic = sample["label"].to_numpy(dtype=np.int64)
    if len(np.unique(toxic)) < 2:
        return
    rows, counts = [], []
    for _, run in words.runs(sample["text"].tolist()):
        found = words.Words(run, words.LETTERS_OR_MARKS)
        text, feature = _features(found)
        order = np.argsort(text, kind="stable")
        for own in np.split(feature[order], np.searchsorted(text[order], np.arange(1, len(run)))):
            counts.append(own)
            rows.append(np.unique(own))
    marks = _marks(rows, toxic)
    rows = [row[marks[row]] for row in rows]
    grade = _grades([c[marks[c]] for c in counts], counts, toxic)
    model = Ftrl(1 << BITS, alpha=0.3, l1=0.1, l2=0.1)
    low, gap = 0.0, 0.0  # thresholds low and low + exp(gap)
    order = np.random.default_rng(4)
    for epoch in range(EPOCHS):
        rate = 0.05 / (1 + epoch)
        for k in order.permutation(len(rows)):
            w = model.at(rows[k])
            f = w.sum()
            cuts = np.array([-np.inf, low, low + np.exp(gap), np.inf])
            a, b = (_sigmoid(cuts[grade[k] + 1] - f), _sigmoid(cuts[grade[k]] - f))
            chance = max(a - b, 1e-9)
            # the loss is -log(a - b)
            model.learn(rows[k], w, np.full(len(w), 1.0 - a - b))
            up, down = -a * (1 - a) / chance, b * (1 - b) / chance
            steps = [0.0, 0.0]
            for cut, step in ((grade[k], up), (grade[k] - 1, down)):
                if 0 <= cut < 2:
                    steps[cut] += step
            low -= rate * np.clip(steps[0] + steps[1], -5, 5)
            gap -= rate * np.clip(steps[1] * np.exp(gap), -5, 5)
    weights = model.all()
    margins = np.array([weights[row].sum() for row in rows])
    low, high = _thresholds(margins, grade, low, low + np.exp(gap))
    kept = np.flatnonzero(weights)
    yield pd.DataFrame(
        {
            "features": [kept.astype(np.int32).tobytes()],
            "weights": [weights[kept].tobytes()],
            "low": [low],
            "high": [high],
            "cut": [_cut(margins, toxic)],
        }
    )


class Model:
    """Shared weights, ascending thresholds and the margin from which a text is called toxic."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, low: float, high: float, cut: float):
        self.weights = np.zeros(1 << BITS)
        self.weights[features] = weights
        self.thresholds, self.cut = (low, high), cut

    def margins(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, run in words.runs(texts):
            text, feature = _features(words.Words(run, words.LETTERS_OR_MARKS))
            counts = self.weights[feature] != 0
            text, feature = _distinct(text[counts], feature[counts])
            out[first : first + len(run)] += np.bincount(text, self.weights[feature], minlength=len(run))
        return out


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: tuple[int, int] = PER_CLASS) -> Model | None:
    """The model of at most ``per_class`` labelled clean and toxic texts; the sample meets in one task."""
    sample = labelled_sample(documents, labels, label, per_class)
    found = sample.mapInPandas(_fit, "features binary, weights binary, low double, high double, cut double").first()
    if found is None:
        return None
    return Model(np.frombuffer(found[0], np.int32), np.frombuffer(found[1]), *found[2:])


def grade(documents: DataFrame, model: Model | None, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all by default) with the expected ``severity`` (0 to 2), ``toxic`` (from the decision cut on), and the ``grade``.

    A text that is not called toxic has grade 0, another one the grade 2 if the model holds that likelier than not, else 1.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights, whatever the corpus

    def graded(texts):
        if shared.value is None:
            return np.zeros(len(texts)), np.zeros(len(texts), np.int32), np.zeros(len(texts), bool)
        f = shared.value.margins(texts)
        above = np.stack([_sigmoid(f - t) for t in shared.value.thresholds])
        toxic = f >= shared.value.cut
        return above.sum(axis=0), np.where(toxic, 1 + (above[1] >= 0.5), 0).astype(np.int32), toxic

    return with_columns_of_text(documents, columns, "severity double, grade int, toxic boolean", graded)
