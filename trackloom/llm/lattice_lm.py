"""Language-model scores from a subword lattice.

A word's probability is the sum over all its segmentations into pieces of an existing vocabulary, by a forward recursion in
log space; pieces begin at a word mark, so a document's lattice falls apart at white space, and its marginal probability is
the product of its words' and of the end of the text. The vocabulary and its order come from a file and are never trained; the
pieces' probabilities start from their ranks there and are fitted to the training words by expectation maximisation over all
segmentations. A word that was learned has one arc more, over its whole length, worth its count. Since the same word comes
again and again, each distinct word's lattice is summed once.

Counting: every task folds its words into (word, count) before the shuffle. Scoring: the ``HEAD_WORDS`` most frequent words
(short ones: a size bound) are broadcast and resolved where the text is; only the rest is joined by shuffle, so no frequent
word makes a hot key.

Defined results: a null or empty text is one end token; repeated rows are scored each for itself; a null id is never learned
from; without training text every count is 0 and the pieces keep their first probabilities; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Words that are broadcast at most, and their greatest length in bytes.
HEAD_WORDS, HEAD_BYTES = 50_000, 48
#: Words folded before a task passes on its counts.
FOLD_WORDS = 300_000
MARK = "▁"
LN10 = math.log(10)


def load_pieces(path: str) -> list[str]:
    """Pieces in the order of the vocabulary file; unusable ones (control, several marks) as empty strings."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return [p if not (sp.is_control(i) or sp.is_unknown(i) or MARK in p[1:]) else "" for i, p in enumerate(pieces)]


class Lattice:
    """Sums over the segmentations of many words at once. prob: natural log of each piece's probability."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if p.startswith("<0x") and len(p) == 6}
        spelled_out = set(self.byte.values())
        #: Finds every piece at every place of many words in one pass; the value holds the piece and its length.
        self.finder = ahocorasick.Automaton()
        for i, p in enumerate(pieces):
            if p and i not in spelled_out:
                self.finder.add_word(p, i << 8 | len(p))
        self.finder.make_automaton()
        self.single = np.array(sorted(ord(p) for i, p in enumerate(pieces) if len(p) == 1 and i not in spelled_out), np.uint32)
        #: Characters that are no piece go as their bytes: numbered from ``size`` on.
        self.spelt: dict[str, int] = {}

    def _arcs(self, words: list[str]) -> np.ndarray:
        """(word, from, to, piece) of every piece over every stretch of every marked word, by word."""
        text = "".join([f"{MARK}{w}\n" for w in words])
        begin = np.concatenate([[0], np.cumsum([len(w) + 2 for w in words])])
        hits = np.fromiter(chain.from_iterable(self.finder.iter(text)), np.int64).reshape(-1, 2)
        end, piece, length = hits[:, 0] + 1, hits[:, 1] >> 8, hits[:, 1] & 255
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        odd = np.flatnonzero(~np.isin(cp, self.single) & (cp != 10))
        if len(odd):
            spelt = [self.size + self.spelt.setdefault(text[i], len(self.spelt)) for i in odd.tolist()]
            end, piece, length = np.concatenate([end, odd + 1]), np.concatenate([piece, spelt]), np.concatenate([length, np.ones(len(odd), np.int64)])
        word = np.searchsorted(begin, end, "right") - 1
        order = np.argsort(word, kind="stable")
        word, end, length = word[order], end[order] - begin[word[order]], length[order]
        return np.stack([word, end - length, end, piece[order]])

    def _weights(self, prob: np.ndarray) -> np.ndarray:
        return np.concatenate([prob[: self.size], [sum(prob[self.byte[b]] for b in c.encode("utf-8", "surrogatepass")) for c in self.spelt]])

    @staticmethod
    def _sums(score: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owners (in order) and the log of the sum of exponentials of each one's scores."""
        at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        top = np.maximum.reduceat(score, at)
        rest = np.exp(score - np.repeat(top, np.diff(np.append(at, len(score)))))
        return owner[at], top + np.log(np.add.reduceat(rest, at))

    def _forward(self, arcs: np.ndarray, lw: np.ndarray, n: int, longest: int) -> np.ndarray:
        """alpha[word, position]: log-space forward recursion, one position of all words at a time."""
        alpha = np.full((n, longest + 1), -np.inf)
        alpha[:, 0] = 0
        order = np.argsort(arcs[2], kind="stable")
        cuts = np.searchsorted(arcs[2][order], np.arange(1, longest + 2))
        for j in range(1, longest + 1):
            o = order[cuts[j - 1] : cuts[j]]
            if len(o):
                w, total = self._sums(alpha[arcs[0][o], arcs[1][o]] + lw[o], arcs[0][o])
                alpha[w, j] = total
        return alpha

    def _batches(self, words: list[str]) -> Iterator[np.ndarray]:
        """Numbers of words of like length: about 65,536 positions at a time."""
        order = np.argsort([len(w) for w in words], kind="stable")
        lo = 0
        while lo < len(order):
            hi = min(len(order), lo + max(1, 65536 // (len(words[order[lo]]) + 8)))
            while hi > lo + 1 and len(words[order[hi - 1]]) > 2 * len(words[order[lo]]) + 8:
                hi = lo + (hi - lo) // 2
            yield order[lo:hi]
            lo = hi

    def forward(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability."""
        out = np.empty(len(words))
        for ids in self._batches(words):
            part = [words[i] for i in ids]
            arcs, length = self._arcs(part), np.array([len(w) + 1 for w in part])
            lw = self._weights(prob)[arcs[3]]
            out[ids] = self._forward(arcs, lw, len(part), int(length.max()))[np.arange(len(part)), length]
        return out

    def expect(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """Expected number of each piece over all segmentations of the words, each taken once."""
        out = np.zeros(self.size)
        for ids in self._batches(words):
            part = [words[i] for i in ids]
            arcs, length = self._arcs(part), np.array([len(w) + 1 for w in part])
            lw, longest, n = self._weights(prob)[arcs[3]], int(length.max()), len(part)
            alpha = self._forward(arcs, lw, n, longest)
            beta = np.full((n, longest + 1), -np.inf)
            beta[np.arange(n), length] = 0
            order = np.argsort(arcs[1], kind="stable")
            cuts = np.searchsorted(arcs[1][order], np.arange(longest + 2))
            for i in range(longest - 1, -1, -1):
                o = order[cuts[i] : cuts[i + 1]]
                if len(o):
                    w, total = self._sums(beta[arcs[0][o], arcs[2][o]] + lw[o], arcs[0][o])
                    beta[w, i] = total
            gain = np.exp(alpha[arcs[0], arcs[1]] + lw + beta[arcs[0], arcs[2]] - alpha[np.arange(n), length][arcs[0]])
            every = np.bincount(arcs[3], gain, self.size + len(self.spelt))
            out += every[: self.size]
            for c, k in self.spelt.items():
                for b in c.encode("utf-8", "surrogatepass"):
                    out[self.byte[b]] += every[self.size + k]
        return out


def first_probabilities(pieces: list[str]) -> np.ndarray:
    """Natural logs of probabilities by rank in the vocabulary: 1 / (rank + 10), and little for bytes."""
    n = len(pieces)
    weight = np.array([1e-30 if not p else 0.02 / n if p.startswith("<0x") else 1.0 / (i + 10) for i, p in enumerate(pieces)])
    return np.log(weight / weight.sum())


def _tokens(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z. For bytes, lower() and split() know just the letters and the white space meant here."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def count_words(docs: DataFrame, text: str = "text", learn: str = "learn") -> DataFrame:
    """(word binary, n, n_learn): every distinct word of ``docs``, how often it comes, and how often where ``learn`` is true.

    The end of a text is the empty word.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, learned = Counter(), Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"word": list(every), "n": list(every.values()), "n_learn": [learned[w] for w in every]})
            every.clear(), learned.clear()
            return out

        for b in batches:
            for t, ok in zip(b["t"], b["l"]):
                words = _tokens(t)
                words.append(b"")
                every.update(words)
                if ok:
                    learned.update(words)
                if len(every) > FOLD_WORDS:
                    yield flush()
        if every:
            yield flush()

    folded = docs.select(F.col(text).alias("t"), F.coalesce(F.col(learn), F.lit(False)).alias("l")).mapInPandas(fold, "word binary, n long, n_learn long")
    return folded.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_learn").alias("n_learn"))


def _text(word: bytes) -> str:
    return bytes(word).decode("utf-8", "surrogatepass")


def fit_pieces(words: DataFrame, path: str, rounds: int = 1) -> np.ndarray:
    """Natural logs of the pieces' probabilities after ``rounds`` of expectation maximisation over the words with n_learn > 0.

    Each distinct word counts once: the lattice stands for words as such, and how often each comes is the part of its own arc.
    Tasks sum the expected pieces of their words; what comes to the driver is one row per piece.
    """
    pieces = load_pieces(path)
    first = np.exp(first_probabilities(pieces))
    prob = np.log(first)
    for _ in range(rounds):
        now = prob

        def expected(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            lattice, out = Lattice(load_pieces(path)), np.zeros(len(now))
            for b in batches:
                out += lattice.expect([_text(w) for w in b["word"]], now)
            hit = np.flatnonzero(out)
            yield pd.DataFrame({"piece": hit, "n": out[hit]})

        rows = words.where("n_learn > 0 and length(word) > 0").select("word").mapInPandas(expected, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        count = np.zeros(len(now))
        count[rows["piece"].to_numpy(np.int64)] = rows["n"].to_numpy()
        # a little of the first weights keeps pieces alive that the training words lack
        count += first * max(1.0, 1e-4 * count.sum())
        prob = np.log(count / count.sum())
    return prob


def word_scores(words: DataFrame, path: str, prob: np.ndarray, n_all: int, n_kinds: int) -> DataFrame:
    """words with lattice: log10 of the word's probability, the sum over all paths through its lattice.

    Beside its segmentations a word has one arc of its own, worth its count: n_learn / (N + V), and the segmentations share
    the V / (N + V) that this leaves (N: learned tokens, V: distinct ones). The end of a text has its own arc and 1 / (N + V).
    """
    total = max(n_all + n_kinds, 1)

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        lattice = Lattice(load_pieces(path))
        for word, n in batches:
            texts = [_text(w) for w in word]
            cut = np.log(max(n_kinds, 1) / total) + lattice.forward(texts, prob)
            own = np.log(np.maximum(n.to_numpy(float), 1e-300) / total)
            ends = np.array([not t for t in texts], bool)
            out = np.where(ends, np.log((n.to_numpy(float) + 1) / (total + 1)), np.logaddexp(cut, own))
            yield pd.Series(out / LN10)

    return words.withColumn("lattice", scored("word", "n_learn"))


def lattice_scores(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", learn: str = "learn", rounds: int = 1) -> DataFrame:
    """One row per document: key, learn, n_tokens, n_known, train_tokens, base_score, score.

    score: log10 of the text's marginal probability. base_score: the sum over the words and the end of
    log10((c + 1) / (N + V + 1)) with the counts of the rows where ``learn`` is true.
    """
    counted = materialize(count_words(docs, text, learn), "words")
    total = counted.agg(F.sum("n_learn").alias("n"), F.count_if(F.col("n_learn") > 0).alias("v")).first()
    n_all, n_kinds = total.n or 0, total.v
    scored = materialize(word_scores(counted, path, fit_pieces(counted, path, rounds), n_all, n_kinds), "scores")
    base = math.log10(n_all + n_kinds + 1)
    head = scored.where(F.length("word") <= HEAD_BYTES).orderBy(F.desc("n"), "word").limit(HEAD_WORDS).select("word", "n_learn", "lattice").toPandas()
    words_of, counts, lattice = [bytes(w) for w in head["word"]], head["n_learn"].to_numpy(np.int64), head["lattice"].to_numpy(float)
    shared = docs.sparkSession.sparkContext.broadcast((words_of, counts, lattice))
    kind = dict(docs.dtypes)[key]

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_of, counts, lattice = shared.value
        number = {w: i for i, w in enumerate(words_of)}
        logs = np.log10(counts + 1.0)
        known = (counts > 0).astype(np.int64)
        for b in batches:
            rows = []
            for t in b["t"]:
                words = _tokens(t)
                words.append(b"")
                seen = Counter(words)
                at, times, rest, rest_n = [], [], [], []
                for w, n in seen.items():
                    i = number.get(w)
                    if i is None:
                        rest.append(w)
                        rest_n.append(n)
                    else:
                        at.append(i)
                        times.append(n)
                at, times = np.array(at, np.int64), np.array(times, np.int64)
                rows.append((len(words), int(times @ known[at]), float(times @ logs[at]), float(times @ lattice[at]), rest, rest_n))
            out = pd.DataFrame(rows, columns=["n_tokens", "known", "logs", "lat", "rest", "rest_n"])
            out.insert(0, "l", b["l"].to_numpy())
            out.insert(0, "h", b["h"].to_numpy())
            out.insert(0, "k", b["k"].to_numpy())
            yield out

    # rows with the same id and text have the same scores: they are summed as one and told apart again by their number
    source = docs.select(F.col(key).cast("string").alias("k"), F.xxhash64(text).alias("h"), F.coalesce(F.col(learn), F.lit(False)).alias("l"), F.col(text).alias("t"))
    parts = materialize(source.mapInPandas(near, "k string, h long, l boolean, n_tokens long, known long, logs double, lat double, rest array<binary>, rest_n array<long>"), "parts")
    rare = parts.select("k", "h", "l", F.explode(F.arrays_zip("rest", "rest_n")).alias("r")).select("k", "h", "l", F.col("r.rest").alias("word"), F.col("r.rest_n").alias("m"))
    met = rare.join(scored.select("word", "n_learn", "lattice"), "word")
    m = F.col("m")
    from_rare = met.select("k", "h", "l", F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("n_learn") > 0, m).otherwise(0).alias("known"), (m * F.log10(F.col("n_learn") + 1.0)).alias("logs"), (m * F.col("lattice")).alias("lat"), F.lit(0).cast("long").alias("copies"))
    from_head = parts.select("k", "h", "l", "n_tokens", "known", "logs", "lat", F.lit(1).cast("long").alias("copies"))
    each = from_rare.unionByName(from_head).groupBy("k", "h", "l").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "known", "logs", "lat", "copies")])
    c = F.col("copies")
    per = each.select(F.col("k").cast(kind).alias(key), F.col("l").alias("learn"), (F.col("n_tokens") / c).cast("long").alias("n_tokens"), (F.col("known") / c).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("logs") / c - F.col("n_tokens") / c * base).alias("base_score"), (F.col("lat") / c).alias("score"), F.explode(F.sequence(F.lit(1), c.cast("int"))).alias("_copy"))
    return per.drop("_copy")
