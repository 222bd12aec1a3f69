"""Periodic runs of words, found on a grammar of each text.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least ``MIN_EXPONENT`` periods
and ``MIN_LENGTH`` words that neither neighbouring word extends.

Re-Pair turns a text's word ids into a grammar: in every round the most frequent pairs of neighbouring symbols become new symbols,
where occurrences of two pairs overlap those of the more frequent pair, until no pair occurs twice. What is left is paired up by
halves. Each symbol stands for two parts that meet at one boundary. A run lies across the boundary of the smallest symbol around
it, so the runs across each symbol's boundary are computed once, at the symbol's first occurrence, and translated to all places
where the symbol was derived; intervals within others of the same period are then merged away.

Across a boundary, a run has two whole periods on one side at least. So the three words about the boundary come again one period
away: these distances are the candidates. How far the period reaches is found by bisection over prefix hashes, and what is accepted
is compared word by word; where hashes deceived, the symbol's candidates are all compared so.

Defined results: a null or empty text has no words and no run, and its collapsed text is empty; a text of any length is one row of
one task, with a few arrays of its words; repeated rows come out alike, each for itself; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .chars import mix, powers, slices

#: A run has so many words and periods at least. Candidates rely on two whole periods beside a boundary: not below 6 and 4.
MIN_LENGTH, MIN_EXPONENT = 6, 4


def _twice(key: np.ndarray) -> np.ndarray:
    """Where the keys are that may occur twice: once-only keys go by a count of buckets, without sorting."""
    bits = max(10, len(key).bit_length() + 2)
    bucket = (mix(key.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    return np.flatnonzero(np.bincount(bucket, minlength=1 << bits)[bucket] > 1)


class Grammar:
    """The symbols made from the words ``ids`` of several texts (``doc``: the text of each, ascending); no symbol crosses texts.

    lo, mid, hi: first occurrence of each symbol and where its two parts meet. rule, at: all occurrences, by symbol.
    """

    def __init__(self, ids: np.ndarray, doc: np.ndarray):
        n = len(ids)
        # each text has a grammar of its own: equal words of different texts are different symbols
        sym = pd.factorize((doc << 32) | ids)[0].astype(np.int64)
        end = np.arange(1, n + 1)
        # the sequence is linked, as rounds change only parts of it; place n stands for none
        last = np.concatenate([doc[1:] != doc[:-1], [True]]) if n else np.zeros(0, bool)
        after = np.append(np.where(last, n, end), n)
        before = np.full(n + 1, n)
        before[end[~last]] = np.flatnonzero(~last)
        self._lo, self._mid, self._hi, self._rule, self._at, self._n = [], [], [], [], [], 0
        names = int(sym.max()) + 1 if n else 0
        best, gone = np.full(n + 1, n + 1), np.zeros(n + 1, bool)
        # a pair that occurs once never comes again: a round looks at the others and at the neighbours of new symbols
        live = np.flatnonzero(~last)
        while len(live):
            at, rule, live = self._frequent(sym, after, before, live, best)
            if not len(at):
                break
            mid = after[at]
            self._add(at, mid, end[mid], rule)
            sym[at], end[at] = names + rule, end[mid]
            names += int(rule.max()) + 1
            gone[mid] = True
            after[at] = after[mid]
            before[after[mid]] = at
            before[n] = n
            live = np.unique(np.concatenate([live, at, before[at]]))
            live = live[(live < n) & ~gone[live] & (after[live] < n)]
        start = np.flatnonzero(~gone[:n])
        end, doc = end[start], doc[start]
        while len(start) > 1:
            place = np.arange(len(doc)) - np.searchsorted(doc, doc)
            at = np.flatnonzero((place[:-1] % 2 == 0) & (doc[1:] == doc[:-1]))
            if not len(at):
                break
            self._add(start[at], start[at + 1], end[at + 1], np.arange(len(at)))
            end[at] = end[at + 1]
            keep = np.ones(len(start), bool)
            keep[at + 1] = False
            start, end, doc = start[keep], end[keep], doc[keep]
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.lo, self.mid, self.hi, self.rule, self.at = cat(self._lo), cat(self._mid), cat(self._hi), cat(self._rule), cat(self._at)

    def _add(self, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, rule: np.ndarray) -> None:
        _, first = np.unique(rule, return_index=True)
        for to, x in ((self._lo, lo[first]), (self._mid, mid[first]), (self._hi, hi[first])):
            to.append(x)
        order = np.argsort(rule, kind="stable")
        self._rule.append(rule[order] + self._n)
        self._at.append(lo[order])
        self._n += len(first)

    @staticmethod
    def _frequent(sym: np.ndarray, after: np.ndarray, before: np.ndarray, live: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a round replaces pairs, the number of each one's pair among them, and the places whose pairs occur twice or more."""
        none = np.zeros(0, np.int64)
        key = (sym[live] << 32) | sym[after[live]]
        some = _twice(key)
        if not len(some):
            return none, none, none
        live, key = live[some], key[some]
        _, pair = np.unique(key, return_inverse=True)
        # in a a a the first two are a pair and the last two are not
        place = np.arange(len(live))
        fresh = np.concatenate([[True], (pair[1:] != pair[:-1]) | (after[live[:-1]] != live[1:])])
        apart = (place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0
        times = np.bincount(pair[apart], minlength=int(pair.max()) + 1)
        rank = np.empty(len(times), np.int64)
        rank[np.argsort(-times, kind="stable")] = np.arange(len(times))
        apart &= times[pair] > 1
        at, of = live[apart], pair[apart]
        best[at] = rank[of]
        won = (rank[of] < best[before[at]]) & (rank[of] < best[after[at]])
        best[at] = len(best)
        at, of = at[won], of[won]
        often = np.bincount(of, minlength=len(times)) > 1
        at, of = at[often[of]], of[often[of]]
        return at, np.unique(of, return_inverse=True)[1].astype(np.int64), live[times[pair] > 1]


def _candidates(ids: np.ndarray, doc: np.ndarray, g: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, a place i with words i and i + q alike, q) for the distances q at which the words about a boundary come again."""
    n = len(ids)
    none = (np.zeros(0, np.int64),) * 3
    if n < MIN_LENGTH:
        return none
    with np.errstate(over="ignore"):
        h = mix(ids.astype(np.uint64) + np.uint64(1))
        tri = mix(h[:-2] + mix(h[1:-1] * np.uint64(3) + mix(h[2:] * np.uint64(5) + doc[2:].astype(np.uint64)))).view(np.int64)
    some = np.flatnonzero(doc[2:] == doc[:-2])
    some = some[_twice(tri[some])]
    if not len(some):
        return none
    order = some[np.argsort(tri[some], kind="stable")]
    group = np.cumsum(np.concatenate([[0], tri[order][1:] != tri[order][:-1]]))
    group_of = np.full(n, -1)
    group_of[order] = group
    spots = group * n + order
    out = []
    for left in (True, False):
        t = g.mid - 2 if left else g.mid - 1
        most = np.minimum((g.mid - g.lo if left else g.hi - g.mid) // 2, (g.hi - g.lo) // MIN_EXPONENT)
        fits = (t > g.lo) & (t + 2 < g.hi) if left else t + 2 < g.hi
        node = np.flatnonzero(fits & (most > 0))
        node = node[group_of[t[node]] >= 0]
        t, most = t[node], most[node]
        base = group_of[t] * n + t
        from_ = np.searchsorted(spots, base - np.minimum(most, t) if left else base + 1, "left")
        to = np.searchsorted(spots, base - 1 if left else base + np.minimum(most, n - 1 - t), "right")
        each = np.maximum(to - from_, 0)
        nth = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        other = spots[np.repeat(from_, each) + nth] % n
        q = np.abs(other - np.repeat(t, each))
        node = np.repeat(node, each)
        out.append((node, g.mid[node] - q if left else g.mid[node] - 1, q))
    return tuple(np.concatenate(x) for x in zip(*out))


def _reach(ids: np.ndarray, i: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the stretch with period q about words i and i + q, within lo and hi, by prefix hashes."""
    power = powers(len(ids) + 1)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64) + np.uint64(7)) * power[:-1], dtype=np.uint64)])

        def alike(at: np.ndarray, size: np.ndarray, q: np.ndarray) -> np.ndarray:
            return (prefix[at + size] - prefix[at]) * power[q] == prefix[at + q + size] - prefix[at + q]

        ahead, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        room_ahead, room_back = hi - q - i, i - lo
        step = 1 << max(0, int(max(room_ahead.max(initial=0), room_back.max(initial=0))).bit_length() - 1)
        while step:
            c = np.flatnonzero(ahead + step <= room_ahead)
            ahead[c[alike(i[c] + ahead[c], np.full(len(c), step), q[c])]] += step
            c = np.flatnonzero(back + step <= room_back)
            back[c[alike(i[c] - back[c] - step, np.full(len(c), step), q[c])]] += step
            step //= 2
    return i - back, i + ahead + q


def _reach_by_words(ids: np.ndarray, i: int, q: int, lo: int, hi: int) -> tuple[int, int]:
    differs = np.flatnonzero(ids[i : hi - q] != ids[i + q : hi])
    ahead = int(differs[0]) if len(differs) else max(0, hi - q - i)
    differs = np.flatnonzero((ids[lo:i] != ids[lo + q : i + q])[::-1])
    return i - (int(differs[0]) if len(differs) else i - lo), i + ahead + q


def _smallest(node: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which stretches lie in no other one of the same symbol with a smaller period: only these have q as smallest period."""
    left, won = np.lexsort((q, node)), []
    while len(left):
        first = np.concatenate([[True], node[left][1:] != node[left][:-1]])
        own = left[np.maximum.accumulate(np.where(first, np.arange(len(left)), 0))]
        won.append(left[first])
        left = left[~first & ~((lo[own] <= lo[left]) & (hi[own] >= hi[left]))]
    return np.concatenate(won) if won else left


def _long_enough(lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (hi - lo >= MIN_LENGTH) & (hi - lo >= MIN_EXPONENT * q)


def find_runs(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, period) of every run in the words ``ids`` of several texts, by first word, then period."""
    g = Grammar(ids, doc)
    node, i, q = _candidates(ids, doc, g)
    lo, hi = _reach(ids, i, q, g.lo[node], g.hi[node])
    taken = np.flatnonzero(_long_enough(lo, hi, q))
    taken = taken[_smallest(node[taken], lo[taken], hi[taken], q[taken])]
    deceived = {int(node[k]) for k in taken if not np.array_equal(ids[lo[k] : hi[k] - q[k]], ids[lo[k] + q[k] : hi[k]])}
    if deceived:
        for k in np.flatnonzero(np.isin(node, list(deceived))):
            lo[k], hi[k] = _reach_by_words(ids, int(i[k]), int(q[k]), int(g.lo[node[k]]), int(g.hi[node[k]]))
        taken = np.flatnonzero(_long_enough(lo, hi, q))
        taken = taken[_smallest(node[taken], lo[taken], hi[taken], q[taken])]
    # to every place where the symbol was derived
    from_, to = np.searchsorted(g.rule, node[taken], "left"), np.searchsorted(g.rule, node[taken], "right")
    each = to - from_
    places = g.at[np.repeat(from_, each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)]
    shift = places - np.repeat(g.lo[node[taken]], each)
    lo, hi, q = np.repeat(lo[taken], each) + shift, np.repeat(hi[taken], each) + shift, np.repeat(q[taken], each)
    order = np.lexsort((-hi, lo, q))
    lo, hi, q = lo[order], hi[order], q[order]
    # ends so far, of this period: periods are told apart by a step beyond any end
    step = q * (len(ids) + 1)
    before = np.concatenate([[-1], np.maximum.accumulate(hi + step)[:-1]]) if len(hi) else hi
    keep = hi + step > before
    lo, hi, q = lo[keep], hi[keep], q[keep]
    order = np.lexsort((q, lo))
    return lo[order], hi[order], q[order]


def _judge(texts: list[str]) -> list[tuple]:
    """(n_words, starts, lengths, periods, collapsed) of each text."""
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # bytes split at the six ASCII separators only
    n = np.fromiter(map(len, words), np.int64, len(words))
    at = np.concatenate([[0], np.cumsum(n)])
    ids = pd.factorize(np.array([w for ws in words for w in ws], object))[0].astype(np.int64)
    lo, hi, q = find_runs(ids, np.repeat(np.arange(len(words)), n))
    cut = np.searchsorted(lo, at)
    out = []
    for k, ws in enumerate(words):
        a, z = cut[k], cut[k + 1]
        if z > a:
            change = np.zeros(len(ws) + 1, np.int64)
            np.add.at(change, lo[a:z] + q[a:z] - at[k], 1)
            np.add.at(change, hi[a:z] - at[k], -1)
            ws = [w for w, inside in zip(ws, np.cumsum(change[:-1]).tolist()) if not inside]
        out.append((int(n[k]), lo[a:z] - at[k], (hi - lo)[a:z], q[a:z], b" ".join(ws).decode("utf-8", "surrogatepass")))
    return out


def word_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, starts, lengths, periods, collapsed) of each document: all its runs, and its words without a run's repeats."""
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        kinds = [pa.int64(), longs, longs, longs, pa.string()]
        for b in batches:
            texts = [t or "" for t in b.column("_text").to_pylist()]
            for a, z in slices(texts):
                parts = zip(*_judge(texts[a:z]))
                yield pa.RecordBatch.from_arrays([b.column("_key").slice(a, z - a), *[pa.array(list(x), k) for x, k in zip(parts, kinds)]], names=names)

    names = [key, "n_words", "starts", "lengths", "periods", "collapsed"]
    kinds = [rows.schema["_key"].dataType, LongType(), *[ArrayType(LongType())] * 3, StringType()]
    return rows.mapInArrow(judge, StructType([StructField(n, k) for n, k in zip(names, kinds)]))


def collapse_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, n_words, n_runs, runs (start, length, period of each), worst (the run with the greatest
    length/period; of equal ones the first, then the shortest period; null without runs) and collapsed, the text without repeats."""
    runs = F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length"), F.col("periods").alias("period"))
    rows = word_runs(docs, text, key).select(F.col(f"`{key}`"), "n_words", runs.alias("runs"), "collapsed")
    # a/b > c/d as a*d > c*b: exact; runs come by start, then period, so the first of the greatest stays
    greater = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    worst = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(greater(r, best), r).otherwise(best))
    return rows.select(F.col(f"`{key}`"), "n_words", F.size("runs").cast("long").alias("n_runs"), "runs", worst.alias("worst"), "collapsed")
