"""Toxicity: bags of subword embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its character 3- to 5-grams (with its borders) and of itself, all hashed into one
table; 4 words are averaged and go through a linear softmax; the windows of a document meet in a log-sum-exp, so that a few
toxic words count in a long text. Embeddings and softmax are trained jointly, in numpy. Since both are linear up to the
window, scoring needs one number per n-gram: the broadcast model is 1 MB whatever the input.

Defined results: a null or empty text has one window without words and gets the model's base score; repeated rows get equal
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

from .chars import Chars, fold, mix, slices
from .common import class_counts, labelled_sample, tended

WINDOW_WORDS = 4
BUCKET_BITS = 18
#: Characters scored at once: each takes some 200 bytes of arrays on the way.
SCORED_CHARS = 1 << 17
NGRAMS = (3, 4, 5)


def _grams(c: Chars) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of every word, words counted from 0, and each word's hash."""
    cp = fold(c.cp)
    cp = np.where(c.ws, 32, cp).astype(np.uint64)
    h = c.word_hashes(cp)
    word_of = np.full(len(cp), -1, np.int64)
    span = c.end - c.start
    inside = np.repeat(c.start - np.concatenate([[0], np.cumsum(span)[:-1]]).astype(np.int64), span) + np.arange(int(span.sum()))
    word_of[inside] = np.repeat(np.arange(len(c.start)), span)
    words, buckets = [np.arange(len(h))], [h >> np.uint64(64 - BUCKET_BITS)]
    at = inside - 1  # an n-gram begins at a word's border or within it
    for n in NGRAMS:
        # the second to the last but one character lie in the same word
        i = at[at + n <= len(cp)]
        ok = word_of[i + n - 2] == word_of[i + 1]
        i = i[ok]
        g = cp[i]
        with np.errstate(over="ignore"):
            for k in range(1, n):
                g = g * np.uint64(0x100000001B3) + cp[i + k]
        words.append(word_of[i + 1])
        buckets.append(mix(g + np.uint64(n)) >> np.uint64(64 - BUCKET_BITS))
    return np.concatenate(words), np.concatenate(buckets).astype(np.int64), h


def _windows(c: Chars) -> tuple[np.ndarray, np.ndarray]:
    """The window of each word, and the number of windows of each text (one at least)."""
    per_doc = np.maximum(1, -(-c.n_words // WINDOW_WORDS))
    first = np.concatenate([[0], np.cumsum(per_doc)])
    nth = np.arange(len(c.start)) - np.concatenate([[0], np.cumsum(c.n_words)])[c.doc]
    return first[c.doc] + nth // WINDOW_WORDS, per_doc


@dataclass
class ToxicityModel:
    """gram: each bucket's part of the log-odds; prior alone counts where gram is None."""

    prior: float
    gram: np.ndarray | None = None
    bias: float = 0.0

    def score(self, texts: list[str]) -> np.ndarray:
        if self.gram is None:
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        for lo, hi in slices(texts, SCORED_CHARS):
            c = Chars(texts[lo:hi])
            window, per_doc = _windows(c)
            margin = np.zeros(int(per_doc.sum()))
            if len(c.start):
                word, bucket, _ = _grams(c)
                n = len(c.start)
                value = np.bincount(word, self.gram[bucket], n) / np.bincount(word, minlength=n)
                margin = np.bincount(window, value, len(margin)) / np.maximum(np.bincount(window, minlength=len(margin)), 1)
            out[lo:hi] = _pool(margin + self.bias, per_doc)[0]
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _pool(margin: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-sum-exp of each document's windows, and each window's share in it."""
    at = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    top = np.maximum.reduceat(margin, at)
    e = np.exp(margin - top[doc])
    total = np.add.reduceat(e, at)
    return top + np.log(total), e / total[doc]


def train(texts: list[str], labels: np.ndarray, prior: float, dims: int = 8, updates: int = 600, seed: int = 7, init: float = 0.02, rate: float = 0.3) -> ToxicityModel:
    """Adagrad on the log loss of the documents, over embeddings and softmax at once; ``updates`` of 32 documents at least."""
    labels = np.asarray(labels, float)
    if not len(texts) or labels.min() == labels.max():
        return ToxicityModel(prior)
    # each distinct word's n-grams once; each document as the numbers of its words
    ids: dict[int, int] = {}
    grams: list[np.ndarray] = []
    seqs: list[np.ndarray] = []
    for lo, hi in slices(texts, 1 << 18):
        c = Chars(texts[lo:hi])
        if not len(c.start):
            seqs += [np.zeros(0, np.int64)] * (hi - lo)
            continue
        word, bucket, h = _grams(c)
        order = np.argsort(word, kind="stable")
        bucket = bucket[order]
        ends = np.cumsum(np.bincount(word, minlength=len(h)))
        own, first, back = np.unique(h, return_index=True, return_inverse=True)
        number = np.empty(len(own), np.int64)
        for j, (key, f) in enumerate(zip(own.tolist(), first.tolist())):
            if (known := ids.get(key)) is None:
                known = ids[key] = len(grams)
                grams.append(bucket[(ends[f - 1] if f else 0) : ends[f]].astype(np.int32))
            number[j] = known
        seqs += np.split(number[back], np.cumsum(c.n_words)[:-1])
    size = np.array([len(g) for g in grams])
    flat, at = np.concatenate(grams), np.concatenate([[0], np.cumsum(size)])
    rng = np.random.default_rng(seed)
    table = rng.normal(0, init, (1 << BUCKET_BITS, dims)).astype(np.float32)
    u, b = rng.normal(0, 1.0, dims), np.full(1, -3.0)
    seen, seen_u, seen_b = np.full((1 << BUCKET_BITS, dims), 1e-6, np.float32), np.full(dims, 1e-6), np.full(1, 1e-6)
    for epoch in range(-(-updates // -(-len(texts) // 32))):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), 32):
            docs = order[lo : lo + 32]
            words = np.concatenate([seqs[i] for i in docs])
            n_words = np.array([len(seqs[i]) for i in docs])
            per_doc = np.maximum(1, -(-n_words // WINDOW_WORDS))
            first = np.concatenate([[0], np.cumsum(per_doc)])
            doc = np.repeat(np.arange(len(docs)), n_words)
            nth = np.arange(len(words)) - np.concatenate([[0], np.cumsum(n_words)])[doc]
            window = first[doc] + nth // WINDOW_WORDS
            n_windows = int(first[-1])
            in_window = np.maximum(np.bincount(window, minlength=n_windows), 1)
            kinds, back = np.unique(words, return_inverse=True)
            if not len(kinds):
                continue
            spans = size[kinds]
            where = np.repeat(at[kinds] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(int(spans.sum()))
            bucket, owner = flat[where], np.repeat(np.arange(len(kinds)), spans)
            word_vec = np.stack([np.bincount(owner, table[bucket, d], len(kinds)) for d in range(dims)], 1) / spans[:, None]
            window_vec = np.stack([np.bincount(window, word_vec[back, d], n_windows) for d in range(dims)], 1) / in_window[:, None]
            logit, share = _pool(window_vec @ u + b[0], per_doc)
            err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[docs]) / len(docs)
            dm = np.repeat(err, per_doc) * share
            du, db = window_vec.T @ dm, dm.sum()
            # the gradient of a word's mean, spread over its n-grams
            pull = np.bincount(back, (dm / in_window)[window], len(kinds)) / spans
            touched, which = np.unique(bucket, return_inverse=True)
            g = np.bincount(which, pull[owner], len(touched))[:, None] * u
            seen[touched] += g**2
            table[touched] -= (rate * g / np.sqrt(seen[touched])).astype(np.float32)
            seen_u += du**2
            seen_b += db**2
            u = u - 0.1 * du / np.sqrt(seen_u)
            b = b - 0.1 * db / np.sqrt(seen_b)
    share = labels.mean()
    bias = float(b[0] + np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) - np.log(share / (1 - share)))
    return ToxicityModel(prior, (table @ u).astype(np.float32), bias)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 1500) -> ToxicityModel:
    """Learn from ``docs`` (doc_id, text; only rows that may be learned from) and ``labels`` (doc_id, label).

    per_class: at most so many whole documents of each class are fetched for training (the stated bound of the sample); the
    share of the classes is counted over all of them.
    """
    n0, n1 = class_counts(docs, labels, label)
    prior = n1 / (n0 + n1) if n0 + n1 else 0.5
    if not n0 or not n1:
        return ToxicityModel(prior)
    rows = labelled_sample(docs, labels, label, per_class).toPandas()
    return train(rows["text"].tolist(), rows["label"].to_numpy(), prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with a column toxic_score (double, 0 to 1): the model's probability of label 1 for the whole text.

    A column of that name in ``docs`` is replaced.
    """

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in tended(batches, "toxicity"):
            out = pd.Series(model.score(s.fillna("").tolist()))
            del s
            yield out

    return docs.withColumn("toxic_score", scored(F.col(text)))
