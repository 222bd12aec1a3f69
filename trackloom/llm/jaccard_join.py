"""N-gram Jaccard join: which documents share at least so many per cent of their word shingles, and their classes.

Rare-first prefix filtering. A document's set is its distinct shingles. In any order that all documents share, two sets with a
Jaccard similarity of t have a shingle in common among the first n - ceil(t n) + 1 of each; in rare-first order these prefixes
hold what few documents have. Prefixes are joined on their shingles; pairs must then pass the length filter, the positional
filter at their first common shingle and the suffix filter (how many shingles each has in parts of the hash range), all from
what the postings carry, and are verified once over their whole sets.

Texts never cross the network. Tasks cut their rows into chunks and send each chunk's (shingle, document) pairs in packed
blocks by hash range; a range counts in how many documents each of its shingles is and answers each chunk with those that more
than one document has. All other shingles cannot link anything and go no further. Documents are named by chunk and place, so
``docs`` must come in the same order when a task is run again, as a scan does.

Groups of near copies are not expanded into all their pairs. Rounds link the members of each prefix bucket to one pivot, linked
documents become one component, and pairs within a component need no check. Once the pairs that are still open are no more
than a few for each posting, they are all checked. Buckets that stay large after the pivot rounds hold unlike texts around one
passage: since similar sets that first meet there also share a second shingle of a prefix that is longer by one, the bucket's
postings are dealt anew by both shingles, then by three. Where that makes more pairs than it saves (documents that share a whole
passage share all its shingles), they are checked undealt. In large buckets only sets of the same or the next band of sizes
meet. No link between different components is lost.

Frequencies and sets go by 48 bits of each shingle's hash: two sets of n shingles share one by mere chance with a probability
of n * n / 2**48.

Defined results: a text without words, or null, has an empty set, no links and itself as component; fewer words than a shingle
are one shingle; equal word sequences are one class; a null key never names a component that has other keys; repeated rows come
out each for itself; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import Chars, fold_ascii, mix, slices
from .common import discard, materialize, tended

#: Characters of a chunk (one text at least), and bytes of text to a hash range.
CHUNK_CHARS, RANGE_BYTES = 1 << 22, 1 << 23
HASH_BITS = 48
#: Parts of the hash range that the suffix filter compares.
PARTS = 16
#: The open pairs are checked in full once they are at most so many times the postings; before that, pivots go first.
OPEN_FACTOR = 3
MAX_PIVOT_ROUNDS = 2
#: Larger buckets that pivots leave open are dealt by further shingles, at most so many.
SPLIT_ABOVE, FURTHER_SHINGLES = 64, 2
#: The columns of a posting beside its shingle.
MEMBER = ("digest", "label", "n", "shared", "parts", "idx")
LEFT = ("gram", *MEMBER, "last", "size")


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of all texts, by document and hash."""
    docs, hashes = [], []
    for lo, hi in slices(texts):
        c = Chars(texts[lo:hi])
        h = c.word_hashes(fold_ascii(c.cp))
        n = len(h)
        if not n:
            continue
        first = np.concatenate([[0], np.cumsum(c.n_words)])[:-1]
        short = (c.n_words > 0) & (c.n_words < words)
        at = np.flatnonzero(c.doc[words - 1 :] == c.doc[: n - words + 1]) if n >= words else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            s = np.zeros(len(at), np.uint64)
            for k in range(words):
                s = mix(s * np.uint64(0x2545F4914F6CDD1D) + h[at + k])
            few = np.zeros(int(short.sum()), np.uint64)
            for k in range(words - 1):
                has = c.n_words[short] > k
                few = np.where(has, mix(few * np.uint64(0x9FB21C651E98DF25) + h[np.minimum(first[short] + k, n - 1)]), few)
        doc = np.concatenate([c.doc[at], np.flatnonzero(short)])
        every = np.concatenate([s, few])
        order = np.lexsort((every, doc))
        doc, every = doc[order], every[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (every[1:] != every[:-1])
        docs.append(doc[new] + lo)
        hashes.append(every[new])
    return (np.concatenate(docs), np.concatenate(hashes)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _packed(sorted_: np.ndarray) -> bytes:
    """Steps between ascending numbers, as byte planes: high ones are mostly zero and compress away in the shuffle."""
    return np.diff(sorted_, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _ranges(values: np.ndarray, n: int) -> np.ndarray:
    """The hash range of each value, ascending with it."""
    return ((values >> np.uint64(HASH_BITS - 24)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(b" ".join(text.encode("utf-8", "surrogatepass").lower().split()), digest_size=16).digest()


def _runs(sorted_: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of each run of equal numbers."""
    cuts = np.flatnonzero(np.diff(sorted_, prepend=-1))
    return zip(cuts.tolist(), np.append(cuts[1:], len(sorted_)).tolist())


def prefix_length(n: int, percent: int) -> int:
    """Of n shingles, how many come before any rest could be all that is shared."""
    return n - -(-percent * n // 100) + 1


_BLOCK = "r long, c string, bits int, v binary, k array<string>, digest array<binary>, n array<long>"


def _prefixes(docs: DataFrame, n_ranges: int, words: int, percent: int) -> DataFrame:
    """One row per document of ``docs`` (k, t): k, digest of its word sequence, n, shared (shingles that others have).

    The first document of each digest in its chunk that can have links also has posts (its prefix shingles that others have and
    FURTHER_SHINGLES more, in order), own (how many of them are the prefix), grams (all its shared shingles) and parts (how
    many of these lie in each part of the hash range).
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, nth = TaskContext.get().partitionId(), 0
        for b in tended(batches, "jaccard_join"):
            keys, every = b["k"].tolist(), b["t"].fillna("").tolist()
            for lo, hi in slices(every, CHUNK_CHARS):
                texts, name, nth = every[lo:hi], f"{task}.{nth}", nth + 1
                doc, h = shingle_sets(texts, words)
                bits = max(1, (len(texts) - 1).bit_length())
                n = np.bincount(doc, minlength=len(texts))
                # equal word sequences of a chunk have equal shingles: each tells of its own, so they count as several documents
                both = np.sort((h >> np.uint64(64 - HASH_BITS) << np.uint64(bits)) | doc.astype(np.uint64))
                at = _ranges(both >> np.uint64(bits), n_ranges)
                rows = [(int(at[a]), name, bits, _packed(both[a:z]), None, None, None) for a, z in _runs(at)]
                # who the documents are goes by the same way, dealt over the ranges
                rows.append(((task * 7919 + nth) % n_ranges, name, bits, None, keys[lo:hi], [_digest(t) for t in texts], n))
                yield pd.DataFrame(rows, columns=["r", "c", "bits", "v", "k", "digest", "n"])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        about = group["v"].isna()
        blocks = group[~about]
        out = group[about].assign(df=None)
        if len(blocks):
            both = [_unpacked(v) for v in blocks["v"]]
            value = np.concatenate([x >> np.uint64(b) for x, b in zip(both, blocks["bits"])])
            order = np.argsort(value, kind="stable")
            new = np.flatnonzero(np.concatenate([[True], np.diff(value[order]) > 0]))
            df = np.empty(len(value), np.int64)
            df[order] = np.repeat(np.diff(np.append(new, len(value))), np.diff(np.append(new, len(value))))
            rows, at = [], 0
            for x, (c, bits) in zip(both, zip(blocks["c"], blocks["bits"])):
                times, at = df[at : at + len(x)], at + len(x)
                if len(hit := np.flatnonzero(times > 1)):
                    rows.append((0, c, bits, _packed(x[hit]), None, None, None, times[hit].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()))
            if rows:
                known = pd.DataFrame(rows, columns=[*group.columns, "df"], dtype=object)
                out = pd.concat([out.astype(object), known]) if len(out) else known
        return out.drop(columns="r")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        about = group[group["v"].isna()].iloc[0]
        known = group[group["v"].notna()]
        bits = np.uint64(group["bits"].iloc[0])
        both = np.concatenate([_unpacked(v) for v in known["v"]]) if len(known) else np.zeros(0, np.uint64)
        df = np.concatenate([np.ascontiguousarray(np.frombuffer(t, np.uint8).reshape(4, -1).T).view("<u4").ravel() for t in known["df"]]).astype(np.int64) if len(known) else np.zeros(0, np.int64)
        doc, value = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), (both >> bits).astype(np.int64)
        order = np.lexsort((value, df, doc))
        doc, value, df = doc[order], value[order], df[order]
        upto = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(about["k"])))])
        seen, rows = set(), []
        for i, (k, digest, n) in enumerate(zip(about["k"], about["digest"], about["n"])):
            shared, n, digest = int(upto[i + 1] - upto[i]), int(n), bytes(digest)
            posts = grams = parts = None
            own = prefix_length(n, percent) - (n - shared)
            if n and own > 0 and digest not in seen:
                seen.add(digest)
                grams = value[upto[i] : upto[i + 1]]
                posts, grams = grams[: own + FURTHER_SHINGLES], np.sort(grams)
                parts = np.bincount(_ranges(grams.view(np.uint64), PARTS), minlength=PARTS)
            rows.append((k, digest, n, shared, max(0, own), parts, posts, grams))
        return pd.DataFrame(rows, columns=["k", "digest", "n", "shared", "own", "parts", "posts", "grams"])

    answered = docs.mapInPandas(cut, _BLOCK).groupBy("r").applyInPandas(answer, _BLOCK.replace("r long, ", "") + ", df binary")
    return answered.groupBy("c").applyInPandas(meet, "k string, digest binary, n long, shared long, own long, parts array<int>, posts array<long>, grams array<long>")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` that are similar enough, by their whole sets; ``sets`` stays where it is."""
    a = sets.select(F.col("digest").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    b = sets.select(F.col("digest").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))

    @F.pandas_udf("long")
    def common(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in tended(batches, "jaccard_join"):
            yield pd.Series([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(xs, ys)], dtype="int64")

    met = pairs.join(a, "a").join(b, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), common("ga", "gb").alias("both"))
    return met.where(F.col("both") * (100 + percent) >= F.col("n") * percent).select("a", "b")


def connected(links: DataFrame) -> DataFrame:
    """(node, label): for each node of the links (a, b), the least node that it reaches. Label spreading with jumps."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("label").alias("far"))
        step = materialize(step.join(jump, "now", "left").select("node", "label", F.least("now", F.coalesce("far", "now")).alias("now")), "labels")
        changed = step.where(F.col("label") != F.col("now")).limit(1).count()
        discard(labels)
        labels = step.select("node", F.col("now").alias("label"))
        labels.scratch = step.scratch
        if not changed:
            discard(both)
            return labels


def _merged(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """(node, label) after ``labels`` have taken in the links ``found``: only the components that these links join go through rounds."""
    if labels is None:
        return connected(found)
    new = found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))).distinct()
    own = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"_{end}"))
    between = found.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    far = connected(between)
    every = labels.select("node", "label").union(new.join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
    out = every.join(far.select(F.col("node").alias("label"), F.col("label").alias("_far")), "label", "left")
    out = materialize(out.select("node", F.coalesce("_far", "label").alias("label")), "labels")
    discard(far)
    return out


def _pairs(one: DataFrame, other: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b, of postings that meet in a bucket, in different components: length, positional and suffix filter.

    Were this the first shingle that two sets share, all they share would come from it on, and shingles that no other document
    has cannot be among it. A pair that can be similar passes at its first one.
    """
    at = ["gram"]
    if one is other:
        # sets of similar sizes lie in the same or in neighbouring bands, the smaller one looks in both: this splits large buckets
        width = math.log(100 / percent) * 1.01 + 0.001
        large, band = F.col("size") > SPLIT_ABOVE, F.floor(F.log("n") / width)
        at.append("band")
        other = one.withColumn("band", F.when(large, band).otherwise(F.lit(0)))
        one = one.withColumn("band", F.explode(F.when(large, F.array(band, band + 1)).otherwise(F.array(F.lit(0).cast("long")))))
    x = one.select(*at, *[F.col(c).alias(f"{c}1") for c in MEMBER])
    y = other.select(*at, *[F.col(c).alias(f"{c}2") for c in MEMBER])
    met = x.join(y, at).where("label1 <> label2")
    if len(at) > 1:
        met = met.where("n1 < n2 or (n1 = n2 and digest1 < digest2)")
    met = met.where(f"100 * least(n1, n2) >= {percent} * greatest(n1, n2)")
    met = met.where(f"{100 + percent} * least(shared1 - idx1, shared2 - idx2) >= {percent} * (n1 + n2)")
    most = F.aggregate(F.zip_with("parts1", "parts2", lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda a, v: a + v)
    met = met.where((100 + percent) * most >= percent * (F.col("n1") + F.col("n2")))
    swap = F.col("digest1") > F.col("digest2")
    met = met.select(F.when(swap, F.col("digest2")).otherwise(F.col("digest1")).alias("a"), F.when(swap, F.col("digest1")).otherwise(F.col("digest2")).alias("b"))
    return met.distinct()


def _split(large: DataFrame, posts: DataFrame, level: int) -> DataFrame:
    """The postings of ``large`` dealt anew: by their shingles so far and one more that comes later in the document.

    The ``level``-th further shingle lies within the first own + level postings. At the last of level + 1 common shingles, level
    of them have come before it, so its place counts less by so many.
    """
    later = posts.where(F.col("idx") < F.col("own") + level).select("digest", F.col("gram").alias("_more"), F.col("idx").alias("_at"))
    met = large.join(later, "digest").where(F.col("_at") > F.col("last"))
    return met.select(F.xxhash64("gram", "_more").alias("gram"), *MEMBER[:-1], (F.col("_at") - level).alias("idx"), F.col("_at").alias("last"))


def _classes(rows: DataFrame, percent: int) -> DataFrame | None:
    """(node, label) of the digests with links, from the postings and sets of ``rows``; None if there are none."""
    spark = rows.sparkSession
    candidates = rows.where(F.size("posts") > 0)
    n_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    one = [F.any_value(c).alias(c) for c in ("n", "own", "shared", "parts", "posts", "grams")]
    # held on disk by digest: every verification joins pairs to it without moving it; what a lost executor held is made again
    sets = candidates.repartition(n_parts, "digest").groupBy("digest").agg(*one).persist(StorageLevel.DISK_ONLY)
    # idx counts among the shingles that others have: in rare-first order those that none has come before them
    posts = sets.select("digest", "n", "own", "shared", "parts", F.posexplode("posts").alias("idx", "gram"))
    # a shingle that copies of one text alone share meets nothing
    common = posts.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram")
    posts = materialize(posts.join(common, "gram"), "posts")
    now = posts.where(F.col("idx") < F.col("own")).select("gram", "digest", F.col("digest").alias("label"), "n", "shared", "parts", "idx", F.col("idx").alias("last"))
    n_posts = now.count()
    seen = labels = left = large = None
    round_ = level = 0
    before_deal = 0
    while n_posts:
        # first the text that the others come from: the one with the least share of shingles that no other document has
        central = (1 - F.col("shared") / F.col("n") if not (round_ or level) else F.lit(0.0)).alias("c")
        cells = now.groupBy("gram", "label").agg(F.count("*").alias("m"), F.min(F.struct(central, F.xxhash64("digest", F.lit(round_)).alias("h"), *MEMBER)).alias("pivot"))
        buckets = cells.groupBy("gram").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.min("pivot").alias("pivot")).where("m * m > mm")
        buckets = materialize(buckets, "buckets")
        to_check = (F.col("m") * F.col("m") - F.col("mm")) / 2
        open_, in_large = buckets.agg(F.sum(to_check), F.sum(F.when(F.col("m") > SPLIT_ABOVE, to_check))).first()
        if not open_:
            discard(buckets)
            break
        # documents that share a whole passage share every further shingle of it: where dealing would make more pairs, it is left out
        undone = large is not None and round_ == 0 and open_ >= before_deal
        # a bucket of one component stays one: only open ones go on
        before, left = left, materialize(large if undone else now.drop("size").join(buckets.select("gram", F.col("m").alias("size")), "gram").select(*LEFT), "open")
        discard(before)
        last = undone or open_ <= OPEN_FACTOR * n_posts or (level == FURTHER_SHINGLES and round_ >= MAX_PIVOT_ROUNDS)
        deal = not last and round_ >= MAX_PIVOT_ROUNDS
        # small buckets in full before the large ones are dealt anew
        small = left.where(F.col("size") <= SPLIT_ABOVE) if deal else left
        pairs = _pairs(small, small, percent) if last or deal else _pairs(left, buckets.select("gram", *[F.col(f"pivot.{c}").alias(c) for c in MEMBER]), percent)
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        discard(buckets)
        seen = pairs if seen is None else seen.unionByName(pairs)
        found = materialize(_verify(pairs, sets, percent), "found")
        linked = not found.isEmpty()
        if linked:
            before, labels = labels, _merged(labels, found)
            discard(before)
        if last:
            break
        if not (linked or deal):
            # pivots that linked nothing leave unlike texts: further ones would not either
            round_ = MAX_PIVOT_ROUNDS - 1
        now = left.where(F.col("size") > SPLIT_ABOVE) if deal else left
        if labels is not None:
            now = now.drop("label").join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
        round_ += 1
        if deal:
            round_, level = 0, level + 1
            large, before_deal = now.select(*LEFT), in_large
            now = _split(large, posts, level)
    sets.unpersist()
    discard(posts)
    discard(left)
    return labels


def _members(docs: DataFrame, text: str, key: str, name: Column, words: int, percent: int) -> DataFrame:
    """(k, digest, n_shingles) of each row of ``docs``: its ``name``, a string, and its class, the same for all that links reach."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rows = materialize(_prefixes(docs.select(name.alias("k"), F.col(text).alias("t")), max(1, size // RANGE_BYTES), words, percent), "prefixes")
    labels = _classes(rows, percent)
    each = rows.select("k", "digest", F.col("n").alias("n_shingles"))
    if labels is not None:
        each = each.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("digest", F.coalesce("label", "digest")).drop("label")
    return each


def jaccard_join(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: key, n_shingles and component_id, the least key that it reaches by links (its own included)."""
    each = _members(docs, text, key, F.col(key).cast("string"), words, percent).withColumn("k", F.col("k").cast(dict(docs.dtypes)[key]))
    least = each.where("n_shingles > 0").groupBy("digest").agg(F.min("k").alias("least"))
    # copies of one text may be a third of all rows: both sides keep their natural order, so that Spark can split the join
    out = each.join(least, "digest", "left")
    return out.select(F.col("k").alias(key), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("k")).alias("component_id"))


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each class: the one with the least key, null after all others; of equal keys the least text hash.

    Texts without words are in no class and stay. Of rows with equal key and text one stays.
    """
    # keys may be null or repeated: a row is named by its text's hash and its key
    name = F.concat(F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.coalesce(F.concat(F.lit(":"), F.col(key).cast("string")), F.lit("")))
    each = _members(docs, text, key, name, words, percent)
    own = F.when(F.length("k") > 16, F.substring("k", 18, 1 << 30)).cast(dict(docs.dtypes)[key])
    first = each.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct(own.isNull().alias("null"), own.alias("key"), "k")).alias("first")).select("first.k")
    keep = first.unionByName(each.where("n_shingles = 0").select("k")).withColumnRenamed("k", "_keep").distinct()
    return docs.withColumn("_keep", name).join(keep, "_keep", "left_semi").dropDuplicates(["_keep"]).select(*[F.col(f"`{c}`") for c in docs.columns])
