"""Quality rules: statistics of each text, and the frequency of its lines across the documents of its host.

Lines are normalised (A-Z lower-cased, white space squeezed, digits to 0) and hashed; for each host and line the distinct
documents that have it are counted, copies of a page each for itself. Lines in at least ``min_docs`` documents are removed, however
large the host, and a document that keeps less than ``min_left`` of its words is rejected.

Defined results: a null or empty text has no words and fails the base rule; a null host is a host of its own; rows with equal key
and text are one document, judged alike and counted once; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import Chars, mix, slices
from .common import WORD, lower_ascii

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 20
MIN_LEFT = 0.75


def text_statistics(text: Column) -> Column:
    """struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words> of a text; zeros for null."""

    @F.pandas_udf("struct<n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long>")
    def statistics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            texts = s.fillna("").tolist()
            parts = [_statistics(texts[lo:hi]) for lo, hi in slices(texts)]
            yield pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, 5), np.int64), columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    return statistics(text)


def _statistics(texts: list[str]) -> np.ndarray:
    c = Chars(texts)
    n, docs = len(c.start), len(texts)
    out = np.zeros((docs, 5), np.int64)
    out[:, 0] = c.n_words
    out[:, 1] = np.bincount(c.doc, c.end - c.start, docs)
    symbol = np.flatnonzero(np.isin(c.cp, [ord(x) for x in SYMBOLS]))
    out[:, 2] = np.bincount(np.searchsorted(c.doc_at, symbol, "right") - 1, minlength=docs)
    for i, t in enumerate(texts):
        if "\n" in t:
            lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\f\r")]
            out[i, 3] = len(lines) - len(set(lines))
    if n > 2:
        h = c.word_hashes()
        at = np.flatnonzero(c.doc[2:] == c.doc[:-2])
        with np.errstate(over="ignore"):
            w = mix(mix(h[at] * np.uint64(3) + np.uint64(1)) + mix(h[at + 1] * np.uint64(5) + np.uint64(2)) * np.uint64(7) + h[at + 2] * np.uint64(11) + mix(c.doc[at].astype(np.uint64)))
        _, back, times = np.unique(w, return_inverse=True, return_counts=True)
        twice = at[times[back] > 1]
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[twice + k] = True
        out[:, 4] = np.bincount(c.doc[hit], minlength=docs)
    return out


def normal_line(line: Column) -> Column:
    squeezed = F.regexp_replace(lower_ascii(line), r"[\x20\x09-\x0D]+", " ")
    return F.trim(F.regexp_replace(squeezed, "[0-9]", "0"))


def text_lines(docs: DataFrame, text: str, host: str, key: str) -> DataFrame:
    """(_host, _line, _doc, _words): the normalised lines of each document, by hashes, with all words they hold in its rows."""
    doc = F.xxhash64(F.col(key), F.xxhash64(text)).alias("_doc")
    raw = docs.select(F.col(host).alias("_host"), doc, F.explode(F.split(F.col(text), "\n", -1)).alias("_line"))
    words = F.regexp_count("_line", F.lit(WORD)).cast("long")
    rows = raw.select("_host", "_doc", F.xxhash64(normal_line(F.col("_line"))).alias("_line"), words.alias("_words")).where("_words > 0")
    return rows.groupBy("_host", "_line", "_doc").agg(F.sum("_words").alias("_words"))


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", min_docs: int = MIN_DOCS) -> DataFrame:
    """(host, _line): hashes of the lines that at least ``min_docs`` documents of the host have."""
    return _frequent(text_lines(docs, text, host, key), min_docs).select(F.col("_host").alias(host), "_line")


def _frequent(lines: DataFrame, min_docs: int) -> DataFrame:
    return lines.groupBy("_host", "_line").agg(F.count("*").alias("_docs")).where(F.col("_docs") >= min_docs)


def line_rules(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per document: key, n_words, the other statistics, words_removed, depleted (the verdict of the line rule)."""
    doc = F.xxhash64(F.col(key), F.xxhash64(text)).alias("_doc")
    base = docs.select(F.col(key).alias("_id"), F.col(host).alias("_host"), doc, text_statistics(F.col(text)).alias("_s"))
    lines = text_lines(docs, text, host, key)
    frequent = _frequent(lines, min_docs)
    same = lambda a, b, c: F.col(f"{a}._host").eqNullSafe(F.col(f"{b}._host")) & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    hits = lines.alias("l").join(frequent.alias("f"), same("l", "f", "_line"), "left_semi")
    # rows of one document, if it has several, have added up
    rows = docs.select(F.col(host).alias("_host"), doc).groupBy("_host", "_doc").agg(F.count("*").alias("_rows"))
    removed = hits.groupBy("_host", "_doc").agg(F.sum("_words").alias("_words"))
    removed = removed.alias("r").join(rows.alias("n"), same("r", "n", "_doc")).select("r._host", "r._doc", (F.col("_words") / F.col("_rows")).cast("long").alias("_removed"))
    joined = base.alias("b").join(removed.alias("r"), same("b", "r", "_doc"), "left")
    gone = F.coalesce("_removed", F.lit(0)).cast("long")
    return joined.select(F.col("_id").alias(key), *[F.col(f"_s.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], gone.alias("words_removed"), (F.col("_s.n_words") - gone < min_left * F.col("_s.n_words")).alias("depleted"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def quality_rules(docs: DataFrame, **options) -> DataFrame:
    """line_rules with base_failed and kept: false if the base rule fails, else whether the document is not depleted."""
    out = line_rules(docs, **options)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.col("depleted"))


def strip_frequent_lines(docs: DataFrame, frequent: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """(key, host, text) without the lines in ``frequent`` (frequent_lines of the same host column): the texts that remain after the line rule."""
    lines = docs.select(F.col(key).alias("_id"), F.col(host).alias("_host"), F.xxhash64(text).alias("_key"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("_at", "_raw"))
    lines = lines.withColumn("_line", F.xxhash64(normal_line(F.col("_raw"))))
    known = frequent.select(F.col(host).alias("_host"), "_line", F.lit(True).alias("_gone"))
    marked = lines.alias("l").join(known.alias("f"), F.col("l._host").eqNullSafe(F.col("f._host")) & (F.col("l._line") == F.col("f._line")), "left").select("_id", "l._host", "_key", "_at", "_raw", "_gone")
    # a document of frequent lines alone keeps its row
    rows = F.sort_array(F.collect_set(F.when(F.col("_gone").isNull(), F.struct("_at", "_raw"))))
    whole = marked.groupBy("_id", "_host", "_key").agg(F.array_join(F.transform(rows, lambda r: r["_raw"]), "\n").alias("_text"))
    return whole.select(F.col("_id").alias(key), F.col("_host").alias(host), F.col("_text").alias(text))
