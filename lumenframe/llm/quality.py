"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. A line's features, and those of the lines before and after it, score its label; a weight for
each pair of neighbouring labels scores the chain. Forward and backward passes give each line's marginal, and the marginals,
weighted by the lines' lengths, sum up a document.

Labels are known of documents only. Lines of good documents count as good; those of a bad document as bad at first, and
in later rounds only where the field fitted so far finds them more likely bad than good, with its worst line always bad.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import annotated, training_rows
from .logistic import Logistic

_LOWER, _UPPER, _DIGITS = bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789"
_HIGH = bytes(range(128, 256))
_PLAIN = _LOWER + _UPPER + _DIGITS + _HIGH + b" \t\r"
_COMMON_SIGNS = b".,;:'\"-()?"
_RUNS = re.compile(rb"([^\w\s])\1\1")
#: Features of a line by itself.
LINE = 18


def line_features(line: str, seen: set[str], before: str | None) -> list[float]:
    raw = line.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * (LINE - 1) + [1.0]
    words = raw.split()
    k = len(words) or 1
    high = n - len(raw.translate(None, _HIGH))
    upper = n - len(raw.translate(None, _UPPER))
    letters = n - len(raw.translate(None, _LOWER)) + upper + high
    signs = len(raw.translate(None, _PLAIN))
    rare = len(raw.translate(None, _PLAIN + _COMMON_SIGNS))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [
        min(1.0, n / 400),
        min(1.0, k / 60),
        min(1.0, letters / k / 12),
        letters / n,
        upper / (letters + 1),
        (n - len(raw.translate(None, _DIGITS))) / n,
        signs / n,
        min(1.0, rare / k),
        min(1.0, raw.count(b"|") / k),
        min(1.0, len(_RUNS.findall(raw)) / k),
        repeats / k,
        len(set(words)) / k,
        min(1.0, (raw.count(b".") + raw.count(b",")) / k),
        float(line in seen),
        float(line == before),
        float(raw[:1].isupper()),
        float(raw.rstrip()[-1:] in (b".", b"!", b"?")),
        0.0,
    ]


def bends(x: np.ndarray) -> np.ndarray:
    """The values, and where they pass a few levels, so that weights can follow a bend."""
    return np.hstack([x, x > 0.02, x > 0.1, x > 0.3, x > 0.6]).astype(np.float64)


def chain(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text's lines with their neighbours', and the lines' lengths. An empty text is one empty line."""
    lines = text.split("\n")
    seen: set[str] = set()
    rows, before = [], None
    for line in lines:
        rows.append(line_features(line, seen, before))
        seen.add(line)
        before = line
    x = bends(np.array(rows))
    edge = np.zeros((1, x.shape[1]))
    return np.hstack([x, np.vstack([edge, x[:-1]]), np.vstack([x[1:], edge]), np.ones((len(x), 1))]), np.array([len(s) + 1 for s in lines], float)


class LineCRF:
    """Labels 0 (good) and 1 (bad); a line's score is for bad, a good one scores 0."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray) -> None:
        self.weights, self.pairs = weights, pairs

    def marginals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each line's chance of being bad, and the expected count of each pair of neighbouring labels."""
        p, pairs, _ = forward_backward(x @ self.weights, self.pairs)
        return p, pairs


def forward_backward(score: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Passes scaled at each line, in plain floats: chains are short, and two labels need no arrays."""
    n = len(score)
    t00, t01, t10, t11 = np.exp(pairs).ravel().tolist()
    emit = np.exp(np.clip(score, -30, 30)).tolist()
    f0, f1 = [0.0] * n, [0.0] * n
    a0, a1 = 1.0, emit[0]
    s = a0 + a1
    a0, a1 = a0 / s, a1 / s
    f0[0], f1[0] = a0, a1
    for i in range(1, n):
        b0 = a0 * t00 + a1 * t10
        b1 = (a0 * t01 + a1 * t11) * emit[i]
        s = b0 + b1
        a0, a1 = b0 / s, b1 / s
        f0[i], f1[i] = a0, a1
    p = [0.0] * n
    p[-1] = a1
    c0 = c1 = 1.0
    e00 = e01 = e10 = e11 = 0.0
    for i in range(n - 2, -1, -1):
        g1 = emit[i + 1] * c1
        q00, q01, q10, q11 = f0[i] * t00 * c0, f0[i] * t01 * g1, f1[i] * t10 * c0, f1[i] * t11 * g1
        z = q00 + q01 + q10 + q11
        e00, e01, e10, e11 = e00 + q00 / z, e01 + q01 / z, e10 + q10 / z, e11 + q11 / z
        p[i] = (q10 + q11) / z
        d0, d1 = t00 * c0 + t01 * g1, t10 * c0 + t11 * g1
        s = d0 + d1
        c0, c1 = d0 / s, d1 / s
    return np.array(p), np.array([[e00, e01], [e10, e11]]), 0.0


def fit_crf(chains: list[np.ndarray], labels: list[np.ndarray], rounds: int = 60, rate: float = 0.15, ridge: float = 1e-4, start: LineCRF | None = None) -> LineCRF:
    """Steps of Adam on the conditional likelihood of the label chains."""
    width = chains[0].shape[1]
    w = np.concatenate([start.weights, start.pairs.ravel()]) if start else np.zeros(width + 4)
    x, y = np.vstack(chains), np.concatenate(labels)
    ends = np.cumsum([len(c) for c in chains])
    seen = np.zeros((2, 2))
    for own in labels:
        np.add.at(seen, (own[:-1], own[1:]), 1)
    gold, total = np.concatenate([x.T @ y, seen.ravel()]), len(y)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        scores = x @ w[:width]
        p, pairs = np.zeros(total), np.zeros((2, 2))
        begin = 0
        for end in ends:
            p[begin:end], e, _ = forward_backward(scores[begin:end], w[width:].reshape(2, 2))
            pairs += e
            begin = end
        g = (gold - np.concatenate([x.T @ p, pairs.ravel()])) / total - ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return LineCRF(w[:width], w[width:].reshape(2, 2))


def summary(p: np.ndarray, sizes: np.ndarray) -> list[float]:
    """Length-weighted means of the lines' marginals, of their log odds, and of whether they are clearly bad."""
    share = sizes / sizes.sum()
    odds = np.log((p + 1e-4) / (1 - p + 1e-4))
    return [float(share @ p), float(share @ odds), float(share @ (p > 0.5))]


#: Numbers that sum up a document.
SUMMARY = 3


@dataclass
class Model:
    crf: LineCRF
    logistic: Logistic

    def of(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The texts' chances of label 1, and the marginals of their lines."""
        if not texts:
            return np.zeros(0), []
        made = [chain(t) for t in texts]
        marginals = [self.crf.marginals(x)[0] for x, _ in made]
        return self.logistic.of(np.array([summary(p, s) for p, (_, s) in zip(marginals, made)])), marginals


def fit(rows: list[tuple[str, int]], passes: int = 3) -> Model:
    """``rows``: (text, quality). Without rows the field is flat and the score 0.5."""
    made = [chain(t) for t, _ in rows]
    chains = [x for x, _ in made]
    good = [y == 1 for _, y in rows]
    labels = [np.full(len(x), 0 if g else 1) for x, g in zip(chains, good)]
    crf = LineCRF(np.zeros(3 * 5 * LINE + 1), np.zeros((2, 2)))
    for i in range(passes if rows else 0):
        crf = fit_crf(chains, labels, start=crf if i else None)
        for j, (x, g) in enumerate(zip(chains, good)):
            if not g:
                p = crf.marginals(x)[0]
                labels[j] = (p >= min(0.5, p.max())).astype(int)
    numbers = np.array([summary(crf.marginals(x)[0], s) for x, s in made]).reshape(len(rows), SUMMARY)
    return Model(crf, Logistic.fit(numbers, np.array(good, float)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 800) -> Model:
    """Fit on at most ``per_class`` labelled rows a class, by the smallest hash of doc_id, held-out rows left out."""
    return fit(training_rows(docs, labels, "quality", per_class))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` with score (0 to 1, higher for better texts) and lines array<double> (each line's chance of
    being bad) of every whole text.

    A null or empty text is one empty line; repeated rows stay; columns score and lines of ``docs`` are replaced; an empty table
    gives an empty one; the time of a text is linear in its length. A map over Arrow
    batches: nothing is shuffled; the model is a few hundred weights.
    """

    def start():
        def work(texts: list[str]) -> list[pa.Array]:
            scores, lines = model.of(texts)
            return [pa.array(scores, pa.float64()), pa.array([p.tolist() for p in lines], pa.list_(pa.float64()))]

        return work

    return annotated(docs, "text", start, {"score": "double", "lines": "array<double>"})
