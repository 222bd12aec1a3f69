"""Quality classifier: gated attention over the passages of a document (multiple-instance learning).

Every passage of 64 words is encoded by what its characters and words look like, a tanh layer embeds it, a gated attention
layer weighs the passages, and the weighted embedding is scored. All weights are learned together, in numpy, from document
labels alone. Scoring runs over whole texts in Arrow batches; the broadcast model has a few thousand numbers.

Defined results: a null or empty text is one passage without words and gets a score like any other; repeated rows get equal
scores; an empty table gives an empty result; other columns are ignored, whatever their names. Without labels of both
classes the score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import Chars, mix, slices
from .common import class_counts, labelled_sample

PASSAGE_WORDS = 64
_KINDS = 8
N_STATS = 12
N_FEATURES = N_STATS + _KINDS * _KINDS
_TABLE: np.ndarray | None = None


def _kinds(cp: np.ndarray) -> np.ndarray:
    """0 other, 1 lower-case letter, 2 upper-case letter, 3 digit, 4 space, 5 line break, 6 mark of a sentence, 7 symbol."""
    global _TABLE
    if _TABLE is None:
        t = np.zeros(0x10000, np.uint8)
        for i in range(0x10000):
            c = chr(i)
            t[i] = 5 if i in (10, 11, 12, 13) else 4 if c.isspace() else 3 if c.isdigit() else 2 if c.isupper() else 1 if c.isalpha() else 6 if c in ".,;:!?'\"()-¿¡«»…" else 7 if c.isprintable() else 0
        _TABLE = t
    return np.where(cp < 0x10000, _TABLE[np.minimum(cp, 0xFFFF)], 1)


def passage_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, and the number of passages of each text (one at least)."""
    c = Chars(texts)
    n_docs, n_words = len(texts), len(c.start)
    per_doc = np.maximum(1, -(-c.n_words // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(per_doc)])
    total = int(first[-1])
    out = np.zeros((total, N_FEATURES))
    if not n_words:
        return out, per_doc
    word_at = np.concatenate([[0], np.cumsum(c.n_words)])
    nth = np.arange(n_words) - word_at[c.doc]
    passage = first[c.doc] + nth // PASSAGE_WORDS
    count = np.bincount(passage, minlength=total)
    # characters belong to the passage of the last word that began at or before them
    kinds = _kinds(c.cp)
    lo, hi = c.start[0], c.end[-1]
    owner = np.repeat(passage, np.diff(np.append(c.start, hi)))
    k = kinds[lo:hi].astype(np.int64)
    of_kind = np.bincount(owner * _KINDS + k, minlength=total * _KINDS).reshape(total, _KINDS)
    pairs = np.bincount(owner[1:] * 64 + k[:-1] * 8 + k[1:], minlength=total * 64).reshape(total, 64)
    n_chars = np.maximum(of_kind.sum(1), 1)
    words = np.maximum(count, 1)
    h = c.word_hashes()
    length = c.end - c.start
    # distinct words of each passage
    order = np.lexsort((h, passage))
    new = np.ones(n_words, bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order][new], minlength=total)
    again = np.zeros(n_words, bool)
    again[1:] = (h[1:] == h[:-1]) & (c.doc[1:] == c.doc[:-1])
    # windows of three words that the document has had before
    seen = np.zeros(n_words, bool)
    if n_words > 2:
        with np.errstate(over="ignore"):
            tri = mix((h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:] + c.doc[2:].astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
        _, at = np.unique(tri, return_index=True)
        seen[2:] = True
        seen[at + 2] = False
        seen[2:] &= c.doc[2:] == c.doc[:-2]
    share = lambda mask: np.bincount(passage[mask], minlength=total) / words
    letters = np.maximum(of_kind[:, 1] + of_kind[:, 2], 1)
    mean = np.bincount(passage, length, total) / words
    stats = [np.log1p(count) / 4, mean / 10, np.sqrt(np.maximum(np.bincount(passage, length.astype(float) ** 2, total) / words - mean**2, 0)) / 10, of_kind[:, 2] / letters, of_kind[:, 3] / n_chars, of_kind[:, 6] / words, of_kind[:, 7] / words, distinct / words, share(again), share(seen), share((kinds[c.end - 1] == 7) | (kinds[c.end - 1] == 0)), of_kind[:, 5] / words]
    out[:, :N_STATS] = np.stack(stats, 1)
    out[:, N_STATS:] = np.sqrt(pairs / n_chars[:, None])
    return out, per_doc


@dataclass
class QualityModel:
    """Weights of the encoder, the gated attention and the scorer; ``prior`` alone counts where weights is None."""

    prior: float
    weights: dict[str, np.ndarray] | None = None

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        for lo, hi in slices(texts):
            x, n = passage_features(texts[lo:hi])
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(_forward(self.weights, x, n)["logit"], -40, 40)))
        return out


def _forward(w: dict[str, np.ndarray], x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Gated attention: a_k = softmax_k(v . (tanh(V h_k) * sigmoid(U h_k))), logit = c . sum_k a_k h_k + b."""
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    bag = np.repeat(np.arange(len(n)), n)
    x = np.clip((x - w["mean"]) / w["scale"], -6, 6)
    h = np.tanh(x @ w["W"] + w["d"])
    gate, value = 1 / (1 + np.exp(-(h @ w["U"]))), np.tanh(h @ w["V"])
    e = (gate * value) @ w["v"]
    a = np.exp(e - np.maximum.reduceat(e, at)[bag])
    a /= np.add.reduceat(a, at)[bag]
    z = np.add.reduceat(a[:, None] * h, at, axis=0)
    return {"x": x, "h": h, "gate": gate, "value": value, "a": a, "z": z, "bag": bag, "at": at, "logit": z @ w["c"] + w["b"][0]}


def train(texts: list[str], labels: np.ndarray, prior: float, hidden: int = 16, epochs: int = 25, seed: int = 7) -> QualityModel:
    """Adam on the log loss of the bags. ``prior`` is the share of label 1, restored after training on balanced classes."""
    labels = np.asarray(labels, float)
    if not len(texts) or labels.min() == labels.max():
        return QualityModel(prior)
    parts = [passage_features(texts[lo:hi]) for lo, hi in slices(texts)]
    x, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    at = np.concatenate([[0], np.cumsum(n)])
    rng = np.random.default_rng(seed)
    w = {"mean": x.mean(0), "scale": x.std(0) + 1e-3}
    for name, shape in (("W", (x.shape[1], hidden)), ("U", (hidden, 8)), ("V", (hidden, 8)), ("v", (8,)), ("c", (hidden,))):
        w[name] = rng.normal(0, shape[0] ** -0.5, shape)
    w |= {"d": np.zeros(hidden), "b": np.zeros(1)}
    learn = ("W", "d", "U", "V", "v", "c", "b")
    m, s, step = {k: np.zeros_like(w[k]) for k in learn}, {k: np.zeros_like(w[k]) for k in learn}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(n))
        for lo in range(0, len(n), 64):
            ids = order[lo : lo + 64]
            rows = np.concatenate([np.arange(at[i], at[i + 1]) for i in ids])
            f = _forward(w, x[rows], n[ids])
            err = (1 / (1 + np.exp(-f["logit"])) - labels[ids]) / len(ids)
            dz = err[:, None] * w["c"]
            da = (dz[f["bag"]] * f["h"]).sum(1)
            de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["at"])[f["bag"]])
            dgv = de[:, None] * w["v"]
            dgate, dvalue = dgv * f["value"] * f["gate"] * (1 - f["gate"]), dgv * f["gate"] * (1 - f["value"] ** 2)
            dh = f["a"][:, None] * dz[f["bag"]] + dgate @ w["U"].T + dvalue @ w["V"].T
            dx = dh * (1 - f["h"] ** 2)
            grad = {"W": f["x"].T @ dx + 1e-4 * w["W"], "d": dx.sum(0), "U": f["h"].T @ dgate, "V": f["h"].T @ dvalue, "v": (f["gate"] * f["value"]).T @ de, "c": f["z"].T @ err + 1e-4 * w["c"], "b": err.sum(keepdims=True)}
            step += 1
            for k in learn:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                s[k] = 0.999 * s[k] + 0.001 * grad[k] ** 2
                w[k] = w[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    share = labels.mean()
    w["b"] = w["b"] + np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) - np.log(share / (1 - share))
    return QualityModel(prior, w)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500) -> QualityModel:
    """Learn from ``docs`` (doc_id, text; only rows that may be learned from) and ``labels`` (doc_id, label).

    per_class: at most so many whole documents of each class are fetched for training (the stated bound of the sample); the
    share of the classes is counted over all of them.
    """
    n0, n1 = class_counts(docs, labels, label)
    prior = n1 / (n0 + n1) if n0 + n1 else 0.5
    if not n0 or not n1:
        return QualityModel(prior)
    rows = labelled_sample(docs, labels, label, per_class).toPandas()
    return train(rows["text"].tolist(), rows["label"].to_numpy(), prior)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``docs`` with a column quality_score (double, 0 to 1): the model's probability of label 1 for the whole text.

    A column of that name in ``docs`` is replaced.
    """

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(model.score(s.fillna("").tolist()))

    return docs.withColumn("quality_score", scored(F.col(text)))
