"""Spelling variants: words that differ by one inserted, deleted or replaced letter, and the form that each one stands for.

All words lie in a trie whose nodes and edges are tables. States (word, position, node, edits) walk down it level by level: each
level joins the frontier with the edges below its nodes; a state may take one edit on its way, and one that has read its whole word
with one edit at the end of another word has found a neighbour.

Edges without a fork are one: a label may be several letters, so there are as many levels as forks on a path. A word and its
neighbour share at least the first or the last half of the shorter one. There are a trie of the words and one of the reversed
words, and states start at the last fork within the first half of their word, where few words are left. A node knows which
letters come next, one and three of them, as sets of bits, so a state that has its edit goes on only where its next letters may be.

Words above ``LONG`` letters, where a row for each prefix would be wasteful, meet by hashes that leave out one of ``BLOCKS`` blocks of
letters each. All neighbours found are compared as words once more, so hashes cannot make one up.

Defined results: a null word, and one of less than ``LEAST`` letters, is no word here; repeated words add up; an empty table gives an
empty result; other columns are ignored, whatever their names. Of forms with equal counts the least in code point order is taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Letters of the shortest word: half of them is where the tries begin.
LEAST = 6
TOP = LEAST // 2
#: Letters from which words meet by blocks, and number of blocks.
LONG, BLOCKS = 64, 16


def _bit(letter: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(letter) % 64)


def _bit3(text: Column, at: Column) -> Column:
    """A bit for the next three letters, or the fewer that are left of a word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(_letters(text, at, F.lit(3))).bitwiseAND(F.lit(63)).cast("int"))


def _letters(text: Column, at: Column, n: Column) -> Column:
    """n letters after the first ``at``."""
    return F.substring(text, at + 1, n)


def _paths(words: DataFrame) -> DataFrame:
    """One row per word and direction: way, t (the word, or reversed), n, size, forks: its prefixes (d, node, next, next3, ends) at which the trie forks.

    next: the letters that follow, as bits; next3: the same of the next three together, hashed; ends: whether a word ends there. Prefixes of TOP letters that several words have count as forks.
    """
    ways = F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("word").alias("t")), F.struct(F.lit(1).alias("way"), F.reverse("word").alias("t"))))
    both = words.select(ways.alias("w"), "n", F.char_length("word").alias("size")).select("w.way", "w.t", "n", "size")
    rows = both.withColumn("d", F.explode(F.sequence(F.lit(TOP), F.col("size"))))
    letter = _letters(F.col("t"), F.col("d"), F.lit(1))
    rows = rows.withColumn("node", F.xxhash64("way", F.substring(F.col("t"), F.lit(1), F.col("d"))))
    code = F.ascii(letter)
    nodes = rows.groupBy("node").agg(F.min(code).alias("lo"), F.max(code).alias("hi"), F.bit_or(F.when(code > 0, _bit(letter)).otherwise(F.lit(0).cast("long"))).alias("next"), F.bit_or(_bit3(F.col("t"), F.col("d"))).alias("next3"), F.min("d").alias("least"), F.count("*").alias("words"))
    forks = nodes.where(f"lo <> hi or (least = {TOP} and words > 1)").select("node", "next", "next3", (F.col("lo") == 0).alias("ends"))
    own = rows.join(forks, "node").groupBy("way", "t", "n", "size").agg(F.collect_list(F.struct("d", "node", "next", "next3", "ends")).alias("forks"))
    return own.withColumn("forks", F.array_sort("forks"))


def _edges(paths: DataFrame) -> DataFrame:
    """(node, label, child, next, next3, near, near_n) below each fork; near: the word that ends at the child, in its trie's direction, and its count."""
    last = F.element_at("forks", -1)
    leaf = F.struct(F.col("size").alias("d"), F.xxhash64("way", "t").alias("node"), F.lit(0).cast("long").alias("next"), F.lit(0).cast("long").alias("next3"), F.lit(True).alias("ends"))
    stops = F.when(last["d"] < F.col("size"), F.concat("forks", F.array(leaf))).otherwise(F.col("forks"))
    step = paths.select("t", "n", "size", stops.alias("stops")).select("t", "n", "size", "stops", F.posexplode("stops").alias("k", "b")).where("k > 0")
    step = step.withColumn("a", F.element_at("stops", F.col("k")))
    label = _letters(F.col("t"), F.col("a.d"), F.col("b.d") - F.col("a.d"))
    near = F.when(F.col("b.ends"), F.substring(F.col("t"), F.lit(1), F.col("b.d")))
    rows = step.select(F.col("a.node").alias("node"), label.alias("label"), F.col("b.node").alias("child"), F.col("b.next").alias("next"), F.col("b.next3").alias("next3"), near.alias("near"), F.when(F.col("b.d") == F.col("size"), F.col("n")).alias("near_n"))
    return rows.groupBy("node", "label", "child", "next", "next3", "near").agg(F.max("near_n").alias("near_n"))


def _level(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """The states after one more edge: way, t, size, pos, node, edits; near and near_n where a word's end was reached with one edit."""
    met = frontier.join(edges, "node")
    m = F.char_length("label")

    def after(more: int) -> Column:
        n = m + more
        read = _letters(F.col("t"), F.col("pos"), n)
        within = F.col("pos") + n <= F.col("size")
        cost = F.when(F.col("edits") == 1, F.when(read == F.col("label"), 0) if more == 0 else F.lit(None).cast("int")).otherwise(F.levenshtein(F.col("label"), read, 1))
        return F.struct((F.col("pos") + n).alias("to"), F.when(within & (cost >= 0), cost + F.col("edits")).alias("cost"))

    moved = met.select("way", "t", "size", "edits", F.col("child").alias("node"), "next", "next3", "near", "near_n", F.inline(F.array(after(0), after(1), after(-1))))
    hit = (F.col("cost") == 1) & (F.col("to") == F.col("size")) & F.col("near").isNotNull()
    may = (F.col("next").bitwiseAND(_bit(_letters(F.col("t"), F.col("to"), F.lit(1)))) != 0) & (F.col("next3").bitwiseAND(_bit3(F.col("t"), F.col("to"))) != 0)
    goes_on = F.when(F.col("cost") == 0, F.col("next") != 0).otherwise((F.col("to") < F.col("size")) & may)
    return moved.where(F.col("cost").isNotNull() & (F.col("cost") <= 1) & (hit | goes_on)).select("way", "t", "size", F.col("to").alias("pos"), "node", F.col("cost").alias("edits"), F.when(hit, F.col("near")).alias("near"), F.when(hit, F.col("near_n")).alias("near_n"))


def _by_blocks(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of words of LONG letters or more: all but one block of letters agrees, counted in the shorter word's length."""
    keys = []
    for shorter in (0, 1):
        m = F.col("size") - shorter
        for k in range(BLOCKS):
            a, z = F.floor(m * k / BLOCKS).cast("int"), F.floor(m * (k + 1) / BLOCKS).cast("int")
            keys.append(F.xxhash64(m, F.lit(k), F.substring(F.col("word"), F.lit(1), a), F.substring(F.col("word"), F.col("size") - (m - z) + 1, m - z)))
    rows = words.withColumn("size", F.char_length("word")).where(F.col("size") >= LONG).select("word", "n", F.explode(F.array_distinct(F.array(*keys))).alias("k"))
    other = rows.select("k", F.col("word").alias("near"), F.col("n").alias("near_n"))
    return rows.join(other, "k").where("word <> near").select("word", "near", "near_n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for all words of ``words`` (word, n) that differ by one letter, each pair both ways; materialised."""
    short = words.where(F.char_length("word").between(LEAST, LONG))
    paths = materialize(_paths(short), "paths")
    edges = materialize(_edges(paths), "edges")
    # the first half decides where to start: up to there the word and its neighbour agree, in one of the two tries
    start = F.element_at(F.filter("forks", lambda f: f["d"] <= F.floor(F.col("size") / 2)), -1)
    frontier = paths.select("way", "t", "size", start.alias("f")).select("way", "t", "size", F.col("f.d").alias("pos"), F.col("f.node").alias("node"), F.lit(0).alias("edits"))
    levels = []
    while True:
        levels.append(materialize(_level(frontier, edges), "level"))
        if len(levels) == 1:
            discard(paths)  # the states have left it
        frontier = levels[-1].where("near is null").drop("near", "near_n")
        if frontier.isEmpty():
            break
    forth = lambda c: F.when(F.col("way") == 1, F.reverse(c)).otherwise(F.col(c))
    found = _by_blocks(words)
    for level in levels:
        found = found.unionByName(level.where("near is not null").select(forth("t").alias("word"), forth("near").alias("near"), "near_n"))
    out = materialize(found.distinct().where(F.levenshtein(F.col("word"), F.col("near"), 1) == 1), "near")
    for spent in (edges, *levels):
        discard(spent)
    return out


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """One row per word of ``words`` (word, n): word, n, n_near, form, form_n and root.

    form: of its neighbours the most frequent one, if that is ``ratio`` times as frequent at least; root: where forms lead in the end.
    """
    if ratio < 2:
        raise ValueError("a form is at least twice as frequent as its word, or forms could lead in circles")
    words = materialize(words.where(F.char_length("word") >= LEAST).groupBy("word").agg(F.sum("n").alias("n")), "words")
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    judged = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("b.m") >= ratio * F.col("n"), -F.col("b.m")))
    judged = materialize(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("b.near")).alias("form"), "form_n"), "judged")
    discard(near)
    # counts grow by the ratio with each form, so chains are short
    most = judged.agg(F.max(F.col("form_n") / F.lit(1.0)), F.min("n")).first()
    forms = judged.where("form is not null").select("word", "form")
    roots = forms.select("word", F.col("form").alias("root"))
    if most[0]:
        for _ in range(max(0, math.ceil(math.log(most[0] / most[1], ratio)))):
            on = forms.select(F.col("word").alias("root"), F.col("form").alias("_on"))
            roots = roots.join(on, "root", "left").select("word", F.coalesce("_on", "root").alias("root"))
    return judged.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
