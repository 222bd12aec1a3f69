"""Best-fit packing of documents into sequences of at most ``max_tokens`` tokens.

Bulk-synchronous best fit. Pieces go in bands of lengths, the longest first, each half as long as the one before. In each band
rounds are repeated until all its pieces are placed:

1. Pieces and the gaps that sequences still have are range-sorted by size together, a gap before a piece of its size.
2. Every range is swept downwards: a piece takes its successor, the smallest gap that holds it; what it leaves of the gap is a
   gap again, in its place in the order.
3. Pieces whose range has no gap for them compete for the gaps of the ranges above: their ranks (running tokens) deal them to the
   gaps that are left there, the nearest range first, and what these cannot hold by volume to new sequences. Each such share is
   swept in the same way.
4. The gaps are updated, and pieces that found none go into the next round.

All tables have one row for each piece of the band or each open sequence, and no text. There are as many ranges as the rows need
at ``RANGE_ROWS`` to a range, whatever the session's number of partitions: more ranges part pieces from the gaps that hold them and
cost rounds. What reaches the driver is one row for each range and round. New sequences are opened only for tokens that no gap above could hold, or after ``FULL_ROUNDS`` rounds.

Defined results: a null or empty text is the end token alone; repeated rows are packed each for itself; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remembered, tended

MAX_TOKENS = 4096
END_ID = 1
#: Words in each of the two generations whose ids a Python worker remembers: some 100 MB each.
CACHE_WORDS = 400_000
#: Words that are encoded in one call.
JOINED_WORDS = 128
#: Rounds of a band that leave gaps open to its pieces before new sequences are opened for all that remain.
FULL_ROUNDS = 3
LAST_BAND = 6
#: Pieces that are swept together into new sequences.
SHARE_PIECES = 250_000
#: Pieces and gaps of a range. So few rows are read by one task as they lie; more are range-sorted.
RANGE_ROWS = 1 << 16
#: Marks at a word's end that are tokens of their own, whatever they follow.
_TAIL = ",.;:!?)"
_STATE = remembered("packing")


#: Words that show whether a tokenizer treats lower-case Latin words as its model alone does.
_PROBE = ["a", "the", "don", "tt", "\u00e9t\u00e9", "\u00fcber", "stra\u00dfe", "\u00ff", "\u00b5", "zzzzqx", "abcdefghijklmnopqrstuvwxyz"]


def _start(tokenizer_path: str) -> None:
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer, plain = Tokenizer.from_file(tokenizer_path), Tokenizer.from_file(tokenizer_path)
    vocabulary = tokenizer.get_vocab()
    closes = np.zeros(max(vocabulary.values()) + 1, bool)
    closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    # lower-case Latin letters need no normalisation and no pattern: only the parting at spaces and the byte letters are left
    plain.normalizer = normalizers.Sequence([])
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
    same = all(tokenizer.encode(w, add_special_tokens=False).ids == plain.encode(w, add_special_tokens=False).ids for w in [*_PROBE, " ".join(_PROBE)])
    _STATE.update(path=tokenizer_path, tokenizer=tokenizer, plain=plain if same else tokenizer, closes=closes, ids={}, old={})


def _encode_each(words: list[str]) -> None:
    for at in range(0, len(words), 8192):
        part = words[at : at + 8192]
        for w, e in zip(part, _STATE["tokenizer"].encode_batch_fast(part, add_special_tokens=False)):
            _STATE["ids"][w] = np.array(e.ids, "<u4").tobytes()


def _encode_letters(words: list[str], tokenizer: str) -> None:
    """Words of letters alone are one token run each, so many go in one call and are cut apart where a run closes."""
    groups = [words[at : at + JOINED_WORDS] for at in range(0, len(words), JOINED_WORDS)]
    for part, e in zip(groups, _STATE[tokenizer].encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
        ids = np.array(e.ids, "<u4")
        ends = np.flatnonzero(_STATE["closes"][ids]) + 1
        if len(ends) != len(part):  # a letter that is none for the tokenizer
            _encode_each(part)
            continue
        raw, lo = ids.tobytes(), 0
        for w, hi in zip(part, (4 * ends).tolist()):
            _STATE["ids"][w] = raw[lo:hi]
            lo = hi


def _learn(words: set[str]) -> None:
    """Ids of new words. Case and closing marks make most of the forms of a word: it is encoded once, its marks once."""
    ids, latin, letters, other, made = _STATE["ids"], set(), set(), [], []
    for w in words:
        core = w.rstrip(_TAIL)
        if core.isalpha():
            if core.isascii() or max(core) <= "\u00ff":
                low = core.lower()
                latin.add(low)
            else:
                low = core
                letters.add(low)
            if low != w:
                made.append((w, low, w[len(core) :]))
        else:
            other.append(w)
    other += [tail for tail in {m[2] for m in made} if tail not in ids]
    _encode_letters([w for w in latin if w not in ids], "plain")
    _encode_letters([w for w in letters if w not in ids], "tokenizer")
    _encode_each(other)
    empty = b""
    for w, low, tail in made:
        ids[w] = ids[low] + (ids[tail] if tail else empty)


def _encode(texts: list[str], tokenizer_path: str) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each text. White space always parts words here, so each word is looked up once.

    This holds for tokenizers that split at white space and close each run of letters, marks or single digit with </w>.
    """
    if _STATE.get("path") != tokenizer_path:
        _start(tokenizer_path)
    for lo in range(0, len(texts), 256):
        split = [t.replace("\n", " ").split(" ") for t in texts[lo : lo + 256]]
        if len(_STATE["ids"]) > CACHE_WORDS:
            # words that come again are taken over from the old generation, the others go with the next change
            _STATE.update(ids={}, old=_STATE["ids"])
        ids, old = _STATE["ids"], _STATE["old"]
        new = set()
        for w in set().union(*split) - ids.keys():
            if (known := old.get(w)) is None:
                new.add(w)
            else:
                ids[w] = known
        _learn(new)
        for words in split:
            yield b"".join(map(ids.__getitem__, words))


def token_pieces(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: key, piece, start, length, ids_crc32 and, where asked for, ids (array<int>)."""
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in tended(batches, "packing"):
            rows, collects = [], gc.isenabled()
            gc.disable()  # nothing here makes cycles; the collector would walk the lists of words again and again
            try:
                for k, raw in zip(b["k"], _encode(b["t"].fillna("").tolist(), tokenizer_path)):
                    raw += end
                    for n, at in enumerate(range(0, len(raw), 4 * max_tokens)):
                        part = raw[at : at + 4 * max_tokens]
                        row = (k, n, at // 4, len(part) // 4, zlib.crc32(part))
                        rows.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if keep_ids else row)
            finally:
                if collects:
                    gc.enable()
            out = pd.DataFrame(rows, columns=[key, "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])
            out = out.astype({key: b["k"].dtype}) if len(out) else out
            del b, rows
            yield out
            del out

    # a null key would turn a batch of whole numbers into floats, so it travels as text
    out = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInPandas(pieces, schema.replace(f"`{key}` {kind}", f"`{key}` string", 1))
    return out.withColumn(key, F.col(key).cast(kind))


_SWEPT = "home long, part long, kind int, id long, size long, sequence_id long, offset long"
PLACED, PIECE, GAP = 0, 1, 2


def _sweep(rows: DataFrame, capacity: int) -> DataFrame:
    """Best fit within each home of each partition of ``rows`` (home, kind, id, size, sequence_id).

    Rows must lie by home, then size downwards, gaps before pieces. Gives the placed pieces with sequence_id and offset, the pieces
    that no gap of their home holds (offset: the tokens of such pieces before it in its home), and the gaps as they are then; part is
    the partition's number.
    """

    def swept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, home, missed = TaskContext.get().partitionId(), None, 0
        open_: list[tuple[int, int]] = []  # gaps not smaller than where the sweep is: (size, sequence), the smallest last
        later: list[tuple[int, int]] = []  # smaller ones that pieces have left: a heap of (-size, sequence)

        def close() -> list[tuple]:
            out = [(home, part, GAP, -1, size, seq, capacity - size) for size, seq in [*open_, *((-x, seq) for x, seq in later)] if size]
            open_.clear(), later.clear()
            return out

        for b in batches:
            out = []
            for h, kind, id_, size, seq in zip(*(b[c].tolist() for c in ("home", "kind", "id", "size", "sequence_id"))):
                if h != home:
                    out += close()
                    home, missed = h, 0
                while later and -later[0][0] >= size:
                    rest, other = heapq.heappop(later)
                    open_.append((-rest, other))
                if kind == GAP:
                    open_.append((size, seq))
                elif open_:
                    gap, seq = open_.pop()
                    out.append((home, part, PLACED, id_, size, seq, capacity - gap))
                    rest = gap - size
                    if rest >= size:
                        open_.append((rest, seq))
                    else:
                        heapq.heappush(later, (-rest, seq))
                else:
                    out.append((home, part, PIECE, id_, size, -1, missed))
                    missed += size
            yield pd.DataFrame(out, columns=_COLUMNS)
        yield pd.DataFrame(close(), columns=_COLUMNS)

    return rows.select("home", "kind", "id", "size", "sequence_id").mapInPandas(swept, _SWEPT)


_COLUMNS = [c.split()[0] for c in _SWEPT.split(", ")]


def _shares(ranges: list, first_new: int, everything_new: bool, capacity: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]], int]:
    """Where the ranges' unplaced pieces go: (range, from, to, home) by running tokens, and new sequences (home, first, number).

    ``ranges``: rows (part, pieces, tokens, longest, volume) from the largest sizes down; volume is what the range's gaps hold. The
    gaps nearest above come first. Homes of new sequences are negative. Also the next sequence's number.
    """
    above: list[list[int]] = []  # [range, tokens its gaps still hold], the nearest last
    shares, new, home = [], [], -1
    for r in ranges:
        at, end = 0, r["tokens"] or 0
        while at < end and above and not everything_new:
            take = min(end - at, above[-1][1])
            shares.append((r["part"], at, at + take, above[-1][0]))
            at += take
            above[-1][1] -= take
            if not above[-1][1]:
                above.pop()
        while at < end:
            # each sequence holds so many of them, however long they are
            step = max(r["longest"], min(end - at, r["longest"] * SHARE_PIECES))
            pieces = min(r["pieces"], step // r["shortest"] + 1)
            n = -(-pieces // (capacity // r["longest"]))
            shares.append((r["part"], at, at + step, home))
            new.append((home, first_new, n))
            first_new, home, at = first_new + n, home - 1, at + step
        if r["volume"]:
            above.append([r["part"], r["volume"]])
    return shares, new, first_new


def _place_band(todo: DataFrame, n_todo: int, gaps: DataFrame | None, n_gaps: int, first_new: int, capacity: int) -> tuple[list[DataFrame], DataFrame, int, int]:
    """Rounds until every piece of ``todo`` (id, size) is placed: the placed ones, the gaps then and their number, the next sequence's number."""
    spark, placed, round_ = todo.sparkSession, [], 0
    row = lambda df, kind: df.select(F.lit(0).cast("long").alias("home"), F.lit(kind).alias("kind"), *(["id", "size", F.lit(-1).cast("long").alias("sequence_id")] if kind == PIECE else [F.lit(-1).cast("long").alias("id"), "size", "sequence_id"]))
    while True:
        both = row(todo, PIECE) if gaps is None else row(todo, PIECE).unionByName(row(gaps, GAP))
        # equal sizes are dealt to several ranges where they are many
        order = [F.col("size").desc(), F.col("kind").desc(), F.xxhash64("id", "sequence_id")]
        n = -(-(n_todo + n_gaps) // RANGE_ROWS)
        sorted_ = (both.repartitionByRange(n, *order) if n > 1 else both.coalesce(1)).sortWithinPartitions(*order)
        swept = materialize(_sweep(sorted_, capacity), "swept")
        placed.append(swept.where(F.col("kind") == PLACED))
        is_piece, size = F.col("kind") == PIECE, F.col("size")
        left, open_ = F.when(is_piece, size), F.when(~is_piece, size)
        found = swept.where(F.col("kind") != PLACED).groupBy("part").agg(F.count(left).alias("pieces"), F.sum(left).alias("tokens"), F.max(left).alias("longest"), F.min(left).alias("shortest"), F.coalesce(F.sum(open_), F.lit(0)).alias("volume"), F.count(open_).alias("gaps"))
        ranges = sorted(found.collect(), key=lambda r: r["part"])
        round_ += 1
        free = swept.where(F.col("kind") == GAP)
        if not any(r["pieces"] for r in ranges):
            return placed, free.select("size", "sequence_id"), sum(r["gaps"] for r in ranges), first_new
        shares, new, first_new = _shares(ranges, first_new, round_ > FULL_ROUNDS, capacity)
        # a few rows for each range
        share = F.broadcast(spark.createDataFrame(shares, "of long, lo long, hi long, to long"))
        dealt = swept.where(is_piece).join(share, (F.col("part") == F.col("of")) & (F.col("offset") >= F.col("lo")) & (F.col("offset") < F.col("hi")))
        rows = dealt.select(F.col("to").alias("home"), "kind", "id", "size", "sequence_id")
        homes = sorted({s[3] for s in shares if s[3] >= 0})
        used = free.where(F.col("part").isin(homes)) if homes else free.limit(0)
        rows = rows.unionByName(used.select(F.col("part").alias("home"), "kind", "id", "size", "sequence_id"))
        n_rows = sum(r["pieces"] + r["gaps"] * (r["part"] in homes) for r in ranges) + sum(n for _, _, n in new)
        if new:
            opened = spark.createDataFrame(new, "home long, first long, n long").select("home", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("sequence_id"))
            rows = rows.unionByName(opened.select("home", F.lit(GAP).alias("kind"), F.lit(-1).cast("long").alias("id"), F.lit(capacity).cast("long").alias("size"), "sequence_id"))
        by_home = rows.repartition(len(homes) + len(new), "home") if n_rows > RANGE_ROWS else rows.coalesce(1)
        carried = materialize(_sweep(by_home.sortWithinPartitions("home", F.col("size").desc(), F.col("kind").desc(), "id", "sequence_id"), capacity), "carried")
        placed.append(carried.where(F.col("kind") == PLACED))
        gaps = carried.where(F.col("kind") == GAP).select("size", "sequence_id")
        untouched = free.where(~F.col("part").isin(homes)) if homes else free
        gaps = gaps.unionByName(untouched.select("size", "sequence_id"))
        todo = carried.where(is_piece).select("id", "size")
        over = carried.agg(F.count_if(is_piece).alias("pieces"), F.count_if(F.col("kind") == GAP).alias("gaps")).first()
        n_todo, n_gaps = over["pieces"], over["gaps"] + sum(r["gaps"] for r in ranges if r["part"] not in homes)
        if not n_todo:
            return placed, gaps, n_gaps, first_new


def pack(pieces: DataFrame, key: str = "doc_id", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``pieces`` (key, piece, length, ...) with sequence_id and offset, by the rounds above."""
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    # written once with a number for each row: whatever ties, a task that runs again finds the same rows
    pieces = materialize(pieces.select(*[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias("_id")), "pieces")
    sizes = pieces.select(F.col("_id").alias("id"), F.col("length").cast("long").alias("size"))
    # band k holds lengths up to max_tokens / 2**k, the last one all shorter ones
    band = F.least(F.floor(F.log2(max_tokens / F.col("size"))), F.lit(LAST_BAND)).cast("int")
    bands = sorted((r["b"], r["n"]) for r in sizes.groupBy(band.alias("b")).agg(F.count("*").alias("n")).collect())
    placed, gaps, n_gaps, first_new = [], None, 0, 0
    for b, n in bands:
        now, gaps, n_gaps, first_new = _place_band(sizes.where(band == b), n, gaps, n_gaps, first_new, max_tokens)
        placed += now
    if not placed:
        return pieces.drop("_id").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    at = placed[0]
    for more in placed[1:]:
        at = at.unionByName(more)
    at = at.select(F.col("id").alias("_id"), "sequence_id", "offset")
    return pieces.join(at, "_id").select(*[F.col(f"`{c}`") for c in kept], "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and offset, and its ids where asked for."""
    return pack(token_pieces(docs, tokenizer_path, text, key, max_tokens, end_id, keep_ids), key, max_tokens)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (sequence_id, ids), from pieces with ids: at most max_tokens ids to a group."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(rows, lambda r: r["ids"])).alias("ids"))
