"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions alone.

A text is cut without loss into paragraphs: lines, and of a long line runs of eight words. A paragraph's digest is 12 hex
digits of its md5, a section is 16 paragraphs in a row and its digest 16 digits of the md5 of theirs, and the root is the md5
of the sections' digests. Equal roots mean equal texts; where roots differ, differing sections and then paragraphs locate the
edit.

Defined results: a null or empty text has no paragraph and the root of the empty tree; likeness of two such texts is 1;
repeated rows have equal fingerprints; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARAGRAPH_WORDS = 8
SECTION_PARAGRAPHS = 16
#: Up to eight words with the white space after them, to the end of the line, or one white-space character.
PARAGRAPH = rf"(?:[^\x20\x09-\x0D]++[\x20\x09\x0B-\x0D]*+){{1,{PARAGRAPH_WORDS}}}+\n?|[\x20\x09-\x0D]"
BLOCK_ROWS = 64
COARSE_BLOCKS = 100


def paragraphs(text: Column) -> Column:
    """Digests of the paragraphs of a text, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0)), lambda p: F.substring(F.md5(p), 1, 12))


def sections(leaves: Column) -> Column:
    """Digests of the sections over paragraph digests."""
    n = F.ceil(F.size(leaves) / F.lit(SECTION_PARAGRAPHS)).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(leaves, i * SECTION_PARAGRAPHS + 1, F.lit(SECTION_PARAGRAPHS)), "")), 1, 16))


def root(section_digests: Column) -> Column:
    return F.md5(F.array_join(section_digests, ""))


def fingerprint(leaves: Column) -> Column:
    """The tree as text: root / section digests / paragraph digests."""
    s = sections(leaves)
    return F.concat_ws("/", root(s), F.array_join(s, ""), F.array_join(leaves, ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of the distinct paragraphs of two trees that both have (Dice), from their leaves; 1 for two empty trees."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), (F.size(a) + F.size(b)).cast("double")), F.lit(1.0))


def add_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column tree: struct<root, sections, paragraphs>."""
    leaves = paragraphs(F.col(text))
    out = docs.drop("tree").withColumn("_leaves", leaves).withColumn("_sections", sections(F.col("_leaves")))
    return out.withColumn("tree", F.struct(root(F.col("_sections")).alias("root"), F.col("_sections").alias("sections"), F.col("_leaves").alias("paragraphs"))).drop("_leaves", "_sections")


def changed_sections(a: Column, b: Column) -> Column:
    """Numbers of the sections in which two trees differ; none if the roots are equal."""
    n = F.greatest(F.size(a["sections"]), F.size(b["sections"]))
    numbers = F.when((a["root"] != b["root"]) & (n > 0), F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(numbers, lambda i: ~F.get(a["sections"], i).eqNullSafe(F.get(b["sections"], i)))


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Numbers of the differing paragraphs, looked for in the differing sections only."""
    inside = F.flatten(F.transform(changed_sections(a, b), lambda s: F.sequence(s * SECTION_PARAGRAPHS, s * SECTION_PARAGRAPHS + SECTION_PARAGRAPHS - 1)))
    return F.filter(inside, lambda i: ~F.get(a["paragraphs"], i).eqNullSafe(F.get(b["paragraphs"], i)))


def with_next(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``docs`` (of which ``key`` and ``columns`` stay) with next_<column>: the row that follows in descending order of ``key``.

    Null keys come last, equal keys are ordered by the columns, and the first row follows the last. Rows are dealt to blocks
    that keep the order, by approximate percentiles of the key and even steps between them, so no task holds more than a
    block; the first row of each block goes also to the block before it.
    """
    rows = docs.select(key, *columns)
    stats = rows.agg(F.count("*").alias("n"), F.percentile_approx(key, [i / COARSE_BLOCKS for i in range(COARSE_BLOCKS + 1)], 10_000).alias("cuts")).first()
    cuts = sorted(set(stats.cuts or []))
    fine = max(1, stats.n // (BLOCK_ROWS * COARSE_BLOCKS))
    # blocks are numbered downwards from the largest keys, so that block 0 comes first
    coarse = F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<bigint>"), lambda c: c <= F.col(key)))
    if cuts:
        bounds = F.array(*[F.lit(float(c)) for c in [cuts[0], *cuts, cuts[-1] + 1]])
        lo, hi = F.get(bounds, coarse), F.get(bounds, coarse + 1)
        step = F.coalesce(F.try_divide((F.col(key).cast("double") - lo) * fine, hi - lo), F.lit(0.0))
        step = F.greatest(F.lit(0), F.least(F.floor(step), F.lit(fine - 1)))
    else:
        step = F.lit(0)
    rank = coarse.cast("long") * fine + step
    block = F.when(F.col(key).isNull(), F.lit(1 << 40)).otherwise(F.lit(len(cuts) * fine + fine) - rank)
    rows = rows.withColumn("_block", block.cast("long"))
    order = [F.col(key).desc_nulls_last(), *[F.col(c) for c in columns]]
    whole = F.struct(key, *columns)
    # one row per block: min_by over a key that orders like the window
    first_of = rows.groupBy("_block").agg(F.min_by(whole, F.struct(F.col(key).isNull().alias("a"), (-F.col(key)).alias("b"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])).alias("_row"))
    # where each first row goes follows from block numbers alone: within a run of blocks from the number before it, and from run to
    # run, of which there are few more than COARSE_BLOCKS, from the last number of the run before; the first goes to the last of all
    numbers = rows.select("_block").distinct().withColumn("_run", F.floor(F.col("_block") / fine))
    runs = numbers.groupBy("_run").agg(F.max("_block").alias("_last"))
    over_runs = Window.partitionBy(F.lit(0))
    runs = runs.select("_run", F.coalesce(F.lag("_last").over(over_runs.orderBy("_run")), F.max("_last").over(over_runs)).alias("_before"))
    to = numbers.join(runs, "_run").select("_block", F.coalesce(F.lag("_block").over(Window.partitionBy("_run").orderBy("_block")), "_before").alias("_to"))
    guards = first_of.join(to, "_block").select(F.col(f"_row.{key}").alias(key), *[F.col(f"_row.{c}").alias(c) for c in columns], F.col("_to").alias("_block"), F.lit(True).alias("_guard"))
    together = rows.withColumn("_guard", F.lit(False)).unionByName(guards)
    w = Window.partitionBy("_block").orderBy("_guard", *order)
    nxt = F.lead(whole).over(w)
    out = together.withColumn("_next", nxt).where(~F.col("_guard"))
    return out.select(key, *columns, F.col(f"_next.{key}").alias(f"next_{key}"), *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])
