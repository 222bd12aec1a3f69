"""SimHash near-duplicates: which documents' 64-bit fingerprints differ in a few bits only, and their classes.

A fingerprint bit is 1 if it is set in over half the XXH64 hashes of the text's word shingles. Distinct fingerprints are compared
exactly, in tiles: numpy takes the exclusive-or of all pairs of two tiles and counts the bits. A tile holds fingerprints with the same
population count in each quarter of their bits. Two fingerprints differ at least by the sum of what their quarters' counts differ,
so tile pairs beyond the radius are skipped; for each population the few within it are listed, so tiles meet by equality.

Copies of a text have one fingerprint and are compared once. A population with many fingerprints is cut into tiles of about
``TILE`` rows by a hash, and every tile pair is a row of its own. Of the links within a tile pair only a spanning forest goes on.

Defined results: a null text or one without words has fingerprint zero, which links like any other; fewer words than a shingle are
one shingle; a null key never names a component that has other keys; repeated rows come out each for itself; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .jaccard_join import connected

SEED = 42
#: Fingerprints to a tile, and parts of the bits whose population is counted.
TILE, PARTS = 512, 4
_BITS = 64 // PARTS
#: Shingles whose bits are laid out at once.
_BLOCK = 1 << 16


def _fingerprint(text: str | None, words: int) -> int:
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six ASCII separators only
    if not ws:
        return 0
    joined, size = b" ".join(ws), np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    end = np.cumsum(size) - 1
    n = max(1, len(ws) - words + 1)
    first, last = (end - size + 1)[:n].tolist(), end[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:z], SEED) for a, z in zip(first, last)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        bits = np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def simhash(text: Column, words: int = 3) -> Column:
    """The fingerprint of a text as a signed long."""

    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([_fingerprint(t, words) for t in s], dtype="int64")

    return fingerprint(text)


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """The differences of two tiles' populations that are within the radius; of each and its opposite the greater one."""
    near = [d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius]
    return [d for d in near if d >= tuple(-x for x in d)]


def _forest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the links x[k] - y[k] form a spanning forest, where x and y number the same nodes."""
    label = np.arange(int(max(x.max(), y.max())) + 1)
    kept = []
    while len(open_ := np.flatnonzero(label[x] != label[y])):
        # one link of each component goes through the union, so its loop is no longer than there are nodes
        chosen = open_[np.unique(label[x[open_]], return_index=True)[1]]
        up = label.tolist()
        for k, a, b in zip(chosen.tolist(), label[x[chosen]].tolist(), label[y[chosen]].tolist()):
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            if a != b:
                up[b] = a
                kept.append(k)
        label = np.array(up)
        while not np.array_equal(label, label[label]):
            label = label[label]
    return np.array(kept, np.int64)


def _tile_links(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the fingerprints of two tiles (or of one with itself)."""
    # unsigned: of a negative number the bits of its absolute value would count
    i, j = np.nonzero(np.bitwise_count(x.view(np.uint64)[:, None] ^ y.view(np.uint64)[None, :]) <= radius)
    apart = x[i] != y[j]
    i, j = i[apart], j[apart]
    if len(i) > 1:
        _, node = np.unique(np.concatenate([x[i], y[j]]), return_inverse=True)
        kept = _forest(node[: len(i)], node[len(i) :])
        i, j = i[kept], j[kept]
    return x[i], y[j]


def simhash_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links between the distinct fingerprints in column ``fingerprint``, enough of them to connect all that are within the radius."""
    population = [F.bit_count(F.shiftrightunsigned("fingerprint", _BITS * k).bitwiseAND(F.lit((1 << _BITS) - 1))) for k in range(PARTS)]
    number = lambda parts: sum(p.cast("int") * (_BITS + 1) ** k for k, p in enumerate(parts))
    rows = prints.select("fingerprint", *[p.cast("int").alias(f"p{k}") for k, p in enumerate(population)])
    rows = rows.withColumn("key", number([F.col(f"p{k}") for k in range(PARTS)]))
    # (_BITS + 1) ** PARTS populations at most, 83,521: a bound that does not depend on the input
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    dealt = rows.join(F.broadcast(sizes), "key").withColumn("tile", F.pmod(F.xxhash64("fingerprint", F.lit(SEED)), F.col("tiles")))
    tiles = dealt.groupBy("key", "tile").agg(F.collect_list("fingerprint").alias("rows"), *[F.any_value(f"p{k}").alias(f"p{k}") for k in range(PARTS)])
    tiles = materialize(tiles, "tiles")
    near = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{k}") for k, v in enumerate(d)]) for d in _offsets(radius)]))
    one = tiles.select("key", "tile", "rows", near.alias("d"), *[f"p{k}" for k in range(PARTS)])
    there = [F.col(f"p{k}") + F.col(f"d.d{k}") for k in range(PARTS)]
    for p in there:
        one = one.where(p.between(0, _BITS))
    one = one.select(F.col("key").alias("key1"), F.col("tile").alias("tile1"), F.col("rows").alias("x"), number(there).alias("key"))
    met = one.join(F.broadcast(sizes), "key")
    met = met.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).where("key <> key1 or tile >= tile1")
    met = met.join(tiles.select("key", "tile", F.col("rows").alias("y")), ["key", "tile"]).select("x", "y")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_tile_links(np.asarray(x, np.int64), np.asarray(y, np.int64), radius) for x, y in zip(batch["x"], batch["y"])]
            yield pd.DataFrame({"a": np.concatenate([a for a, _ in found]), "b": np.concatenate([b for _, b in found])} if found else {"a": [], "b": []}).astype("int64")

    links = materialize(met.mapInPandas(compare, "a long, b long"), "links")
    discard(tiles)
    return links


def simhash_join(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: key, fingerprint (signed long) and component_id, the least key that it reaches by links (its own included)."""
    prints = materialize(docs.select(F.col(f"`{key}`").alias("_key"), simhash(F.col(f"`{text}`"), words).alias("fingerprint")), "fingerprints")
    least = prints.groupBy("fingerprint").agg(F.min("_key").alias("least"))
    links = simhash_links(least.select("fingerprint"), radius)
    labels = connected(links)
    discard(links)
    each = least.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    classes = each.groupBy("label").agg(F.min("least").alias("component_id"))
    named = each.select("fingerprint", "label").join(classes, "label").select("fingerprint", "component_id")
    # copies of one text may be a third of all rows: both sides keep their natural order, so that Spark can split the join
    return prints.join(named, "fingerprint", "left").select(F.col("_key").alias(key), "fingerprint", "component_id")
