"""Operator 5: document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's features are ten shares and lengths, each put in one of
BINS bins, of the line and of the lines before and after it; a transition weight ties
neighbouring lines.  Labelled documents give all their lines the document's label; the
weights maximise the penalised conditional likelihood (forward-backward, Adam).  A text's
score is the mean of its lines' marginal probabilities of being good, weighted by length.

The fit takes at most ``max_docs`` labelled documents (those of least id hash), whole texts.
Recurrences run for all documents of a chunk at once, ordered by their number of lines.

Defined results: a null, empty or blank text scores the learned share of good documents;
without both labels every text scores that share (0.5 without any); labels that repeat an id
count as their largest; texts of any length are scored whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm import textops as T
from tactus.llm.toxicity import labelled

FEATURES, BINS = 10, 8
#: Upper ends of the bins of each feature; the last bin is open.
EDGES = np.array(
    [
        [4, 12, 30, 60, 120, 250, 600],  # characters
        [0.001, 0.01, 0.03, 0.08, 0.2, 0.5, 0.9],  # share of capitals among letters
        [0.001, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7],  # share of digits
        [0.005, 0.02, 0.04, 0.07, 0.12, 0.25, 0.5],  # share of , . ; : ' ? -
        [0.001, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4],  # share of other signs
        [0.001, 0.03, 0.07, 0.1, 0.15, 0.2, 0.35],  # share of white space
        [2, 3.5, 4.5, 5.5, 6.5, 8, 12],  # characters a token
        [0.001, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7],  # share of tokens like the one before
        [0.001, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8],  # share of tokens seen before in the line
        [0.5, 1.5, 2.5, 3.5, 5.5, 9.5, 19.5],  # equal lines before it in the text
    ]
)
_KIND = np.full(256, 4, np.int64)  # 0 capital, 1 letter, 2 digit, 3 common sign, 4 other, 5 space
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 0, 1, 1, 2
_KIND[[ord(x) for x in ",.;:'?-"]] = 3
_KIND[[9, 11, 12, 13, 32]] = 5


def lines(c: T.Chunk) -> tuple[T.Words, np.ndarray]:
    """The non-empty lines of a chunk and the bins of their features (lines x FEATURES)."""
    w = T.words(c.data, c.offs, T.NOTNEWLINE, lower=False)
    size = np.maximum(w.end - w.start, 1)
    n = len(c.data) - 16
    kind = _KIND[c.data[:n]]
    share = []
    for k in range(6):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        share.append(total[w.end] - total[w.start])
    bounds = np.append(w.start, w.end[-1:]) if len(w.start) else np.zeros(1, np.int64)
    tok = T.words(c.data, bounds, T.NONSPACE, lower=False) if len(w.start) else None
    f = np.zeros((len(w.start), FEATURES))
    if tok is not None:
        # tokens end at the newline at the latest, so line bounds from start to next start are exact
        count = np.maximum(tok.counts(), 1)
        same = np.zeros(len(tok.hash))
        same[1:] = tok.hash[1:] == tok.hash[:-1]
        same[tok.first[:-1][tok.counts() > 0]] = 0
        letters = np.maximum(share[0] + share[1], 1)
        cols = [size, share[0] / letters, share[2] / size, share[3] / size, share[4] / size, share[5] / size, (size - share[5]) / count, T.segment_sum(same, tok.first) / count, T.segment_sum(T.occurrence(tok.hash, tok.first) > 0, tok.first) / count, T.occurrence(w.hash, w.first)]
        f = np.stack(cols, 1)
    return w, np.stack([np.searchsorted(EDGES[j], f[:, j]) for j in range(FEATURES)], 1).astype(np.uint8)


def wide(bins: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Feature numbers of each line with its neighbours: lines x 3 FEATURES, into a weight vector; BINS stands for no neighbour."""
    none = np.full((1, FEATURES), BINS, np.uint8)
    before, after = np.concatenate([none, bins[:-1]]) if len(bins) else bins, np.concatenate([bins[1:], none]) if len(bins) else bins
    before, after = before.copy(), after.copy()
    some = np.diff(first) > 0
    before[first[:-1][some]] = BINS
    after[first[1:][some] - 1] = BINS
    return np.concatenate([bins, before, after], 1) + np.arange(3 * FEATURES) * (BINS + 1)


N_WEIGHTS = 3 * FEATURES * (BINS + 1)


@dataclass
class Model:
    """Weights of good against bad, the bias, the weight of equal neighbours, and the share of good documents."""

    w: np.ndarray
    bias: float
    tie: float
    good: float


def marginals(u: np.ndarray, tie: float, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each line is good, and that it equals the line before it (0 for a first line)."""
    good, equal = np.zeros(len(u)), np.zeros(len(u))
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    at, n = first[:-1][order], n[order]
    if not len(u):
        return good, equal
    p1 = 1 / (1 + np.exp(-np.clip(u, -30, 30)))
    stay = 1 / (1 + np.exp(-tie))
    fwd, own = np.empty(len(u)), np.stack([1 - p1, p1])
    alive = np.searchsorted(-n, -np.arange(n[0]), "left")  # rows with more than t lines
    for t in range(n[0]):
        i = at[: alive[t]] + t
        b = own[1, i]
        if t:
            a = fwd[i - 1]
            into = a * stay + (1 - a) * (1 - stay)
            x = b * into
            fwd[i] = x / np.maximum(x + (1 - b) * (1 - into), 1e-300)
        else:
            fwd[i] = b
    back = np.ones((2, len(u)))
    for t in range(n[0] - 2, -1, -1):
        i = at[: alive[t + 1]] + t
        g, h = back[1, i + 1] * own[1, i + 1], back[0, i + 1] * own[0, i + 1]
        x, y = g * stay + h * (1 - stay), g * (1 - stay) + h * stay
        s = np.maximum(x + y, 1e-300)
        back[1, i], back[0, i] = x / s, y / s
    x, y = fwd * back[1], (1 - fwd) * back[0]
    good[:] = x / np.maximum(x + y, 1e-300)
    later = np.ones(len(u), bool)
    later[at[n > 0]] = False
    i = np.flatnonzero(later)
    g, h = own[1, i] * back[1, i], own[0, i] * back[0, i]
    a = fwd[i - 1]
    same, diff = (a * g + (1 - a) * h) * stay, (a * h + (1 - a) * g) * (1 - stay)
    equal[i] = same / np.maximum(same + diff, 1e-300)
    return good, equal


def train(bins: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = 120, rate: float = 0.1, l2: float = 0.3) -> Model:
    """Fit on documents whose lines all have the document's label; each document weighs as one."""
    good = float(label.mean()) if len(label) else 0.5
    n = np.diff(first)
    if not len(label) or label.min() == label.max() or not len(bins):
        return Model(np.zeros(N_WEIGHTS), float(np.log((good + 1e-3) / (1 - good + 1e-3))), 0.0, good)
    at = wide(bins, first)
    y = np.repeat(label, n).astype(float)
    weight = np.repeat(1 / np.maximum(n, 1), n)
    theta = np.zeros(N_WEIGHTS + 2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.ones(len(y), bool)
    inner[first[:-1][n > 0]] = False
    for step in range(1, steps + 1):
        u = theta[at].sum(1) + theta[-2]
        p, e = marginals(u, theta[-1], first)
        r = (y - p) * weight
        g = np.append(np.bincount(at.ravel(), np.repeat(r, at.shape[1]), N_WEIGHTS), [r.sum(), ((1 - e) * weight)[inner].sum()])
        g -= l2 * theta * np.append(np.ones(N_WEIGHTS), [0, 5])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[-1] = np.clip(theta[-1], 0, 3)
    return Model(theta[:-2], theta[-2], theta[-1], good)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4000) -> Model:
    """Learn from at most ``max_docs`` labelled documents; only their binned features reach the driver."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in T.chunks(batches):
            w, bins = lines(c)
            raw = [bins[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:])]
            yield pa.RecordBatch.from_arrays([c.rows.column(1), pa.array(raw, pa.binary())], names=["label", "bins"])

    rows = labelled(docs, labels, "quality", max_docs).mapInArrow(features, "label int, bins binary").collect()
    rows.sort(key=lambda r: (r.label, r.bins))
    flat = np.frombuffer(b"".join(r.bins for r in rows), np.uint8).reshape(-1, FEATURES)
    first = np.concatenate([[0], np.cumsum([len(r.bins) // FEATURES for r in rows])]).astype(np.int64)
    return train(flat, first, np.array([int(r.label > 0) for r in rows]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_lines, bad_lines (lines more likely bad)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for c in T.chunks(batches):
            w, bins = lines(c)
            p, _ = marginals(m.w[wide(bins, w.first)].sum(1) + m.bias if len(bins) else np.zeros(0), m.tie, w.first)
            size = (w.end - w.start).astype(float)
            total = T.segment_sum(size, w.first)
            s = np.where(total > 0, T.segment_sum(p * size, w.first) / np.maximum(total, 1), m.good)
            yield pa.RecordBatch.from_arrays([c.rows.column(0), pa.array(np.clip(s, 0, 1)), pa.array(w.counts()), pa.array(T.segment_sum(p < 0.5, w.first))], names=["doc_id", "score", "n_lines", "bad_lines"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, score double, n_lines long, bad_lines long")
