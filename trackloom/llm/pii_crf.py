"""Personal data: patterns, and a linear-chain conditional random field over word shapes for what they miss.

The patterns find e-mail addresses, IPv4 addresses, card numbers (Luhn) and international phone numbers. The field labels each
word with a kind or none: from the shape of the word, of its neighbours and from cue words, with weights learned in numpy from
the small labelled table below (sentences written out by rule, their fillers drawn from a fixed seed). It adds addresses that
are spelt out ("jane at mail dot example dot com"), phone numbers without a plus, numbers of cards and addresses with other
separators. Viterbi runs over all lines of a batch at once. Neighbours of one kind have one label: a run of words that holds
several entities is split into them. Added spans are clipped to what lies outside pattern spans, which always stay.

Defined results: a null or empty text has no spans; repeated rows are searched each for itself; an empty table gives an empty
result; other columns are ignored or passed through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import Chars, slices
from .common import tended

KINDS = ("email", "ip", "card", "phone")
NONE = 0
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: Words around which personal data stands; each is a feature of its own.
CUES = ("at", "dot", "email", "mail", "e-mail", "phone", "tel", "call", "fax", "mobile", "card", "visa", "ip", "host", "address", "contact", "com", "org", "net", "edu")
_TRIM = "()[]{}<>\"'.,;:!?¿¡«»…"
_OPENING = _TRIM.replace("(", "")
#: Within a run of words of one kind: what entities are made of, the sign that each address has once, and where a list goes on.
_PIECE = re.compile(r"[^\s,;/|]+")
_AT = re.compile(r"@|(?<![^\W_])at(?![^\W_])", re.I)
_BREAK = re.compile(r"[,;/|]|\+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches, by start and then kind."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split("."))]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m.group())) <= 19 and _luhn(d)]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out)


# ---- features: each word has one of a few thousand shapes, a number made of small fields

_SHAPE_FIELDS = (("length", 6), ("digits", 8), ("letters", 3), ("ats", 2), ("dots", 4), ("dashes", 3), ("plus", 2), ("paren", 2), ("colon", 2), ("other", 2), ("cue", len(CUES) + 1))
N_FEATURES = sum(n for _, n in _SHAPE_FIELDS)


_CLASSES = 10
_CLASS: np.ndarray | None = None
_DIGIT_BUCKET = np.array([0, 1, 2, 3, 3, 3, 4, 4, 4, 4, 5, 5, 6, 6, 7, 7, 7, 7, 7, 7, 7, 6])


def _classes() -> np.ndarray:
    """0 other, 1 digit, 2 letter, 3 @, 4 full stop, 5 dash, 6 plus, 7 parenthesis, 8 colon, 9 mark of a sentence."""
    global _CLASS
    if _CLASS is None:
        t = np.zeros(0x10000, np.uint8)
        t[0xC0:] = 2
        for chars, k in (("0123456789", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 2), ("@", 3), (".", 4), ("-", 5), ("+", 6), ("()[]", 7), (":", 8), (",!?;'\"", 9)):
            t[[ord(x) for x in chars]] = k
        _CLASS = t
    return _CLASS


def _keys(words: list[str]) -> np.ndarray:
    return np.array([sum(min(ord(x), 255) << 8 * i for i, x in enumerate(w)) for w in words], np.uint64)


_CUE_FORMS = tuple((i + 1, form) for i, cue in enumerate(CUES) for form in (cue, cue + ":", cue + ".", cue + ",", "(" + cue + ")", "[" + cue + "]") if len(form) <= 8)


def word_shapes(c: Chars) -> np.ndarray:
    """One row per word: the value of each shape field."""
    n = len(c.start)
    if not n:
        return np.zeros((0, len(_SHAPE_FIELDS)), np.int64)
    span = c.end - c.start
    lo, hi = c.start[0], c.end[-1]
    word = np.repeat(np.arange(n), np.diff(np.append(c.start, hi)))
    kind = _classes()[np.minimum(c.cp[lo:hi], 0xFFFF)]
    count = np.bincount(word * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES)
    first, last = kind[c.start - lo], kind[c.end - 1 - lo]
    inner = lambda k: count[:, k] - (last == k) - ((first == k) & (span > 1))  # noqa: E731  not at either end
    digits, letters = count[:, 1], count[:, 2]
    # what stands between words counts as other
    other = count[:, 0] - (np.diff(np.append(c.start, hi)) - span)
    cue = np.zeros(n, np.int64)
    short = np.flatnonzero(span <= 8)
    key = np.zeros(len(short), np.uint64)
    for i in range(8):
        x = np.minimum(c.cp[np.minimum(c.start[short] + i, len(c.cp) - 1)], 255)
        x = np.where((x >= 65) & (x <= 90), x + 32, x).astype(np.uint64)
        key |= np.where(span[short] > i, x, 0).astype(np.uint64) << np.uint64(8 * i)
    known = _keys([w for _, w in _CUE_FORMS])
    order = np.argsort(known)
    at = np.minimum(np.searchsorted(known[order], key), len(known) - 1)
    cue[short] = np.where(known[order][at] == key, np.array([i for i, _ in _CUE_FORMS])[order][at], 0)
    rows = [np.minimum(span, 20) // 4, _DIGIT_BUCKET[np.minimum(digits, 21)], np.where(letters == 0, 0, np.where(letters == span, 2, 1)), np.minimum(count[:, 3], 1), np.clip(inner(4), 0, 3), np.clip(inner(5), 0, 2), np.minimum(count[:, 6], 1), np.minimum(count[:, 7], 1), np.clip(inner(8), 0, 1), np.minimum(other, 1), cue]
    return np.stack(rows, 1)


_OFFSETS = np.concatenate([[0], np.cumsum([n for _, n in _SHAPE_FIELDS])[:-1]]).astype(np.int64)
_REACH = (-2, -1, 0, 1, 2)


@dataclass
class CrfModel:
    """emit[k]: weights (feature, label) of the shape of the word k places off; step[i, j]: from label i to j; start: of the first."""

    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def emissions(self, shapes: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Score of each label for each word; neighbours count within a line only."""
        n = len(shapes)
        kinds, back = np.unique(shapes @ np.cumprod([1] + [k for _, k in _SHAPE_FIELDS])[:-1], return_inverse=True)
        first = np.zeros(len(kinds), np.int64)
        first[back[::-1]] = np.arange(n)[::-1]
        features = shapes[first] + _OFFSETS
        out = np.zeros((n, self.step.shape[0]))
        for k, off in enumerate(_REACH):
            own = self.emit[k][features].sum(1)[back]
            lo, hi = max(0, -off), n - max(0, off)
            if hi > lo:
                out[lo:hi] += np.where((line[lo:hi] == line[lo + off : hi + off])[:, None], own[lo + off : hi + off], 0)
        return out

    def labels(self, texts: list[str]) -> tuple[Chars, np.ndarray]:
        """The words of the texts and the best label of each, by Viterbi over each line."""
        c = Chars(texts)
        line = _lines(c)
        e = self.emissions(word_shapes(c), line)
        out = np.zeros(len(e), np.int64)
        if len(e):
            # A labelled run gains at most g for each of its words and ``ends`` for its two ends over no label at all. Where the
            # best such run through a word gains nothing, the best sequence has no label there; the rest is decoded.
            inner, none = self.step[1:, 1:].max(), self.step[NONE, NONE]
            g = inner - none - (e[:, NONE] - e[:, 1:].max(1))
            ends = none - inner + max(self.step[NONE, 1:].max() - none, (self.start[1:] - self.start[NONE]).max()) + max(self.step[1:, NONE].max() - none, 0.0)
            fence = 1e6 * (line - line[0])  # no run passes the end of a line
            total = np.cumsum(g)
            before = total - g - fence
            left = total - fence - np.minimum.accumulate(before)
            right = np.maximum.accumulate((total - fence)[::-1])[::-1] - before
            sure = left + right - g + ends < -1e-6
            e[sure, 1:] = -1e9
            near = ~sure
            near[1:] |= ~sure[:-1]
            near[:-1] |= ~sure[1:]
            at = np.flatnonzero(near)
            if len(at):
                run = np.cumsum(np.concatenate([[0], (at[1:] != at[:-1] + 1) | (line[at[1:]] != line[at[:-1]])]))
                out[at] = viterbi(e[at], run, self.step, self.start)
        return c, out


def _lines(c: Chars) -> np.ndarray:
    """A number for each word that grows by one at least where a new line begins."""
    return np.cumsum(c.cp == 10)[c.start] if len(c.start) else np.zeros(0, np.int64)


def _steps(line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of every line, the longest line first."""
    at = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    length = np.diff(np.append(at, len(line)))
    order = np.argsort(-length, kind="stable")
    at, length = at[order], length[order]
    return at, length, np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")


def viterbi(e: np.ndarray, line: np.ndarray, step: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best label sequence of each line: the k-th words of all lines that have one go together."""
    at, length, alive = _steps(line)
    best, back = e.copy(), np.zeros(e.shape, np.int8)
    for t in range(len(alive)):
        i = at[: alive[t]] + t
        if t == 0:
            best[i] += start
            before = best[i]
        else:
            before = before[: alive[t]]
            now = e[i]
            for k in range(e.shape[1]):
                score = before + step[:, k]
                j = score.argmax(1)
                back[i, k] = j
                now[:, k] += np.take_along_axis(score, j[:, None], 1)[:, 0]
            best[i] = before = now
    out = np.zeros(len(e), np.int64)
    for t in range(len(alive) - 1, -1, -1):
        i = at[: alive[t]] + t
        ends = length[: alive[t]] == t + 1
        nxt = np.minimum(i + 1, len(e) - 1)
        out[i] = np.where(ends, best[i].argmax(1), back[nxt, out[nxt]])
    return out


# ---- training

_NAMES = ("jane", "tom", "li", "marie", "anton", "k.weber", "info", "sales", "joe_b", "ruiz88")
_HOSTS = ("mail", "example", "post", "web", "uni", "shop", "mail3", "corp")
_ENDS = ("com", "org", "net", "de", "fr", "es", "edu")
_FILL = ("the", "of", "thonan", "ser", "que", "und", "eneau", "a", "leto", "that", "is", "was", "here", "reach", "or", "me", "write", "ist", "est", "los", "at", "Then", "Rande", "mail", "call", "dot", "card", "12", "3", "1998,", "7.5", "2,400", "x", "on", "host", "(see", "below)", "404189497460", "1/2", "10:30", "phone", "20%", "v2.1", "ab12cd34", "329b0e611c9ac4df", "§5", "3-4", "2021-04-03", "contact", "than.", "At", "Hean", "at", "it.", "oreaes.", "onth,", "dot", "lyor,")


def labelled_table(rows: int = 1500, seed: int = 5) -> list[list[tuple[str, int]]]:
    """The small labelled table: sentences as (word, label) lists, label 0 for none and 1 to 4 for KINDS."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def email() -> list[str]:
        name, host, end = pick(_NAMES), [pick(_HOSTS) for _ in range(int(rng.integers(1, 3)))], pick(_ENDS)
        at, dot = pick((("at", "dot"), ("(at)", "(dot)"), ("[at]", "[dot]"), ("AT", "DOT"), ("@", ".")))
        if at == "@":
            return pick(([f"{name}@{'.'.join(host)}.{end}"], [name, "@", f"{'.'.join(host)}.{end}"]))
        words = [name, at]
        for h in host:
            words += [h, dot]
        return [*words, end]

    def ip() -> list[str]:
        a = [str(x) for x in rng.integers(0, 256, 4)]
        return pick(([".".join(a)], [".".join(a) + ":" + num(4)], ["[" + ".".join(a) + "]"]))

    def card() -> list[str]:
        d = "4" + num(15)
        four = [d[i : i + 4] for i in range(0, 16, 4)]
        return pick((four, ["-".join(four)], [".".join(four)], [d[:4], d[4:10], d[10:15]]))

    def phone() -> list[str]:
        a, b, c = num(3), num(3), num(4)
        return pick(([f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], ["+1", f"({a})", f"{b}-{c}"], [f"{a}.{b}.{c}"], ["+" + num(2), num(3), num(4), num(3)], ["00" + num(2), num(3), num(6)]))

    makers = (email, ip, card, phone)
    table = []
    for i in range(rows):
        fill = lambda lo, hi: [(pick(_FILL), 0) for _ in range(int(rng.integers(lo, hi)))]
        row = fill(1, 9)
        if i % 3:
            k = int(rng.integers(4))
            words = makers[k]()
            if rng.random() < 0.2:
                words[-1] += pick((".", ","))
            row += [(w, k + 1) for w in words] + fill(1, 9)
        table.append(row)
    # lists: two to five entities with nothing between them but a mark, most of one kind; the rows above do not depend on them
    for _ in range(rows // 5):
        row, k = fill(0, 7), int(rng.integers(4))
        mark = pick(("", "", ",", ",", ";", " /", " or"))
        for j in range(int(rng.integers(2, 6))):
            if j and mark:
                row = [*row, (mark.strip(), 0)] if mark[0] == " " else [*row[:-1], (row[-1][0] + mark, row[-1][1])]
            if j and rng.random() < 0.2:
                k = int(rng.integers(4))
            row += [(w, k + 1) for w in makers[k]()]
        table.append(row + fill(0, 7))
    return table


def train(table: list[list[tuple[str, int]]] | None = None, epochs: int = 150, rate: float = 0.1, penalty: float = 1e-5) -> CrfModel:
    """Adam on the conditional log likelihood of all lines at once: forward and backward sums over their words."""
    table = table or labelled_table()
    c = Chars([" ".join(w for w, _ in row) for row in table])
    y = np.array([k for row in table for _, k in row])
    line, n_labels = _lines(c), len(KINDS) + 1
    features = word_shapes(c) + _OFFSETS
    at, length, alive = _steps(line)
    m = CrfModel(np.zeros((len(_REACH), N_FEATURES, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    params = [m.emit, m.step, m.start]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    n = len(y)
    onehot = np.eye(n_labels)[y]
    dense = np.zeros((n, N_FEATURES))
    np.put_along_axis(dense, features, 1, 1)
    for epoch in range(1, epochs + 1):
        e = m.emissions(features - _OFFSETS, line)
        alpha, beta = e.copy(), np.zeros_like(e)
        lse = lambda x, axis: x.max(axis) + np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis))
        for t in range(len(alive)):
            i = at[: alive[t]] + t
            alpha[i] += m.start if t == 0 else lse(alpha[i - 1][:, :, None] + m.step, 1)
        for t in range(len(alive) - 2, -1, -1):
            i = at[: alive[t + 1]] + t
            beta[i] = lse(m.step + (e[i + 1] + beta[i + 1])[:, None, :], 2)
        p = alpha + beta
        p = np.exp(p - lse(p, 1)[:, None])
        same = np.flatnonzero(line[1:] == line[:-1])
        pair = alpha[same][:, :, None] + m.step + (e[same + 1] + beta[same + 1])[:, None, :]
        pair = np.exp(pair - lse(pair.reshape(len(same), -1), 1)[:, None, None])
        d = onehot - p
        g_emit = np.zeros_like(m.emit)
        for k, off in enumerate(_REACH):
            lo, hi = max(0, -off), n - max(0, off)
            ok = np.flatnonzero(line[lo:hi] == line[lo + off : hi + off]) + lo
            g_emit[k] = dense[ok + off].T @ d[ok]
        g_step = -pair.sum(0)
        np.add.at(g_step, (y[same], y[same + 1]), 1)
        grads = [g / n - penalty * q for g, q in zip((g_emit, g_step, d[at].sum(0)), params)]
        for q, g, a, b in zip(params, grads, first, second):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g**2
            q += rate * (a / (1 - 0.9**epoch)) / (np.sqrt(b / (1 - 0.99**epoch)) + 1e-8)
    return m


# ---- spans


def _plausible(kind: int, text: str) -> bool:
    """What a span of the kind must hold, whatever its words look like: the field sees shapes, not how many digits there are in all."""
    n = len(_digits(text))
    if kind == 0:
        return "@" in text or bool(re.search(r"\bat\b.*\bdot\b", text, re.I | re.S))
    if kind == 1:
        return 4 <= n <= 17 and text.count(".") >= 3
    if kind == 2:
        return 14 <= n <= 19 and _luhn(_digits(text))
    return 10 <= n <= 15 and len(re.findall("[^0-9]+", text.strip("+"))) >= 1


def _trimmed(text: str, kind: int, s: int, e: int) -> tuple[int, int]:
    while s < e and (text[s] in (_OPENING if kind == 3 else _TRIM) or text[s].isspace()):
        s += 1
    while e > s and (text[e - 1] in _TRIM or text[e - 1].isspace()):
        e -= 1
    return s, e


def _single(kind: int, text: str) -> bool:
    """Whether a plausible text is one entity: more than one at sign, or more dots than one address has, are several."""
    return len(_AT.findall(text)) == 1 if kind == 0 else kind != 1 or text.count(".") == 3


def _email_cuts(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """One part for each at sign: it begins at the word that holds the sign, or at the name before it if the sign stands alone."""
    begins = []
    for k, (s, e) in enumerate(words):
        m = _AT.search(text[s:e])
        if m:
            begins.append(max(k - (m.start() == 0 or not text[s : s + m.start()].strip(_TRIM)), begins[-1] + 1 if begins else 0))
    return [(words[b][0], words[nxt - 1][1]) for b, nxt in zip(begins, [*begins[1:], len(words)]) if nxt > b]


def _number_cuts(kind: int, text: str, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts that leave the fewest words with digits out, then cross the fewest list marks and pluses, then are the fewest.

    A part has at most 19 digits and so at most 19 words: linear in the length of the run.
    """
    words = [(s, e, len(_digits(text[s:e]))) for s, e in words if _DIGIT.search(text[s:e])]
    best: list[tuple[tuple[int, int, int], int, tuple[int, int] | None]] = [((0, 0, 0), 0, None)]
    for j in range(1, len(words) + 1):
        left_out, crossed, parts = best[j - 1][0]
        now = ((left_out + 1, crossed, parts), j - 1, None)
        digits = 0
        for i in range(j - 1, -1, -1):
            digits += words[i][2]
            if digits > 19:
                break
            s, e = _trimmed(text, kind, words[i][0], words[j - 1][1])
            if s < e and _plausible(kind, text[s:e]) and _single(kind, text[s:e]):
                left_out, crossed, parts = best[i][0]
                cost = (left_out, crossed + len(_BREAK.findall(text, s + 1, e)), parts + 1)
                if cost < now[0]:
                    now = (cost, i, (s, e))
        best.append(now)
    out, j = [], len(words)
    while j:
        _, i, part = best[j]
        out += [part] if part else []
        j = i
    return out[::-1]


def _entities(kind: int, text: str, s: int, e: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The entities of a run of words of one kind: what lies outside the pattern spans, each piece split where it holds several.

    One word with several numbers in it has more digits than any phone has, so the field takes it for a card: it may be phones.
    """
    out, at = [], s
    for p, _, q in [*sorted(b for b in base if b[0] < e and b[2] > s), (e, 0, e)]:
        a, b = _trimmed(text, kind, at, max(at, p))
        at = max(at, q)
        if a >= b:
            continue
        if _plausible(kind, text[a:b]) and _single(kind, text[a:b]):
            out.append((a, kind, b))
            continue
        words = [(a + m.start(), a + m.end()) for m in _PIECE.finditer(text[a:b])]
        one_word = not re.search(r"\s", text[a:b])
        for k in (kind, 3) if kind == 2 and one_word else (kind,):
            parts = [_trimmed(text, k, *x) for x in (_email_cuts(text, words) if k == 0 else _number_cuts(k, text, words))]
            parts = [(p, k, q) for p, q in parts if p < q and _plausible(k, text[p:q])]
            if parts:
                break
        # what is plausible as a whole stays one span if no part is
        out += parts or ([(a, kind, b)] if _plausible(kind, text[a:b]) else [])
    return out


def find_spans(texts: list[str], model: CrfModel) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Pattern spans and all spans of each text, as (start, kind number, end) by start and then kind."""
    out = []
    for lo, hi in slices(texts, 1 << 20):
        part = texts[lo:hi]
        base = [pattern_spans(t) for t in part]
        every = [list(b) for b in base]
        c, y = model.labels(part)
        hit = np.flatnonzero(y)
        if len(hit):
            line = _lines(c)[hit]
            new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (y[hit[1:]] != y[hit[:-1]]) | (line[1:] != line[:-1])])
            begin = np.flatnonzero(new)
            for a, b in zip(begin, np.append(begin[1:], len(hit))):
                doc = int(c.doc[hit[a]])
                s, e = int(c.start[hit[a]] - c.doc_at[doc]), int(c.end[hit[b - 1]] - c.doc_at[doc])
                kind = int(y[hit[a]]) - 1
                every[doc] += _entities(kind, part[doc], s, e, base[doc])
        out += [(b, sorted(x)) for b, x in zip(base, every)]
    return out


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def pii_spans(text: Column, model: CrfModel) -> Column:
    """struct<base array<struct<kind, start, end>> as text, spans likewise, n_email, n_ip, n_card, n_phone> of a text.

    base and spans are kind:start:end in code points, by start and then kind, comma-joined; the counts are those of the patterns.
    """

    @F.pandas_udf("struct<base string, spans string, n_email long, n_ip long, n_card long, n_phone long>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in tended(batches, "pii_crf"):
            rows = []
            for base, every in find_spans(s.fillna("").tolist(), model):
                n = [0, 0, 0, 0]
                for _, k, _ in base:
                    n[k] += 1
                rows.append((_written(base), _written(every), *n))
            yield pd.DataFrame(rows, columns=["base", "spans", "n_email", "n_ip", "n_card", "n_phone"])

    return found(text)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (merged where they overlap) replaced by its first kind in brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = e
        else:
            at = max(at, e)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, model: CrfModel, text: str = "text") -> DataFrame:
    """``docs`` with all personal data in ``text`` replaced by its kind; a null text stays null."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in tended(batches, "pii_crf"):
            texts = s.fillna("").tolist()
            out = pd.Series([redact(t, every) if every else t for t, (_, every) in zip(texts, find_spans(texts, model))], dtype=object)
            del s, texts
            yield out
            del out

    return docs.withColumn(text, F.when(F.col(text).isNotNull(), clean(F.col(text))))
