"""Sequences, sessions and windows of them. Every window is partitioned by agent (or agent and session), never global.

Tables are sparse: a missing row is a gap, so "the row before" is checked by t, not by position alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.stats import hash_draw
from trackloom.sources.scratch import stored


def start_flags(df: DataFrame, agent: str = "agent", t: str = "t", id: str | None = None, frame: str | None = None) -> DataFrame:
    """isstart: the first row of an agent, or its id has changed, or its frame is not the one after the last."""
    w = Window.partitionBy(agent).orderBy(t)
    flag = F.col(frame or t) != F.lag(frame or t).over(w) + 1
    if id:
        flag = flag | ~F.col(id).eqNullSafe(F.lag(id).over(w))
    return df.withColumn("isstart", F.coalesce(flag, F.lit(True)))


def islands(df: DataFrame, valid: Column, keys: list[str], t: str, broken: Column | None = None) -> DataFrame:
    """The valid rows with a number per run (unique within keys): a run ends at an invalid row, a gap or where ``broken``."""
    w = Window.partitionBy(*keys).orderBy(t)
    kept = df.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    new = ~F.coalesce(F.lag("_valid").over(w), F.lit(False)) | (F.col(t) != F.lag(t).over(w) + 1)
    if broken is not None:
        new = new | F.coalesce(broken, F.lit(False))
    marked = kept.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
    return marked.withColumn("island", F.sum("_new").over(w)).where("_valid").drop("_valid", "_new")


def sessions(df: DataFrame, valid: Column, agent: str = "agent", t: str = "t", start: str = "isstart") -> DataFrame:
    """(agent, start, duration) of the maximal runs of valid rows."""
    runs = islands(df, valid, [agent], t, F.col(start))
    return runs.groupBy(agent, "island").agg(F.min(t).alias("start"), F.count("*").alias("duration")).drop("island")


def session_rows(df: DataFrame, valid: Column, agent: str = "agent", t: str = "t", start: str = "isstart") -> DataFrame:
    """The valid rows with the start of their session."""
    runs = islands(df, valid, [agent], t, F.col(start))
    return runs.withColumn("session", F.min(t).over(Window.partitionBy(agent, "island"))).drop("island")


def chunks(sessions_: DataFrame, length: int, offset: int = 0) -> DataFrame:
    """(agent, start, chunk_start): windows of ``length`` side by side in each session, the tail left out."""
    last = F.col("start") + F.col("duration") - length
    fits = sessions_.where(F.col("start") + offset <= last)
    return fits.withColumn("chunk_start", F.explode(F.sequence(F.col("start") + offset, F.col("start") + F.col("duration") - length, F.lit(length).cast("long"))))


def chunk_examples(rows: DataFrame, features: list[str], length: int, offset: int = 0, mask: str | None = None, agent: str = "agent", t: str = "t") -> DataFrame:
    """One row per chunk with its rows in order: (agent, session, chunk_start, rows array<struct<pos, ...>>).

    ``rows`` come from session_rows. A chunk's number follows from t and the session's start, so no join is needed. With a mask,
    chunks stay of which any row is true.
    """
    n = F.floor((F.col(t) - F.col("session") - offset) / length)
    placed = rows.where(F.col(t) >= F.col("session") + offset).withColumn("chunk_start", F.col("session") + offset + n * length)
    pos = (F.col(t) - F.col("chunk_start")).cast("int").alias("pos")
    out = placed.groupBy(agent, "session", "chunk_start").agg(F.sort_array(F.collect_list(F.struct(pos, *features))).alias("rows"), F.bool_or(mask).alias("_any") if mask else F.lit(True).alias("_any"))
    return out.where((F.size("rows") == length) & F.coalesce("_any", F.lit(False))).drop("_any")


def sliding_windows(sessions_: DataFrame, length: int, stride: int = 1) -> DataFrame:
    """(agent, start, window_start, window): all windows of ``length`` in each session at a stride."""
    fits = sessions_.where(F.col("duration") >= length)
    numbers = F.sequence(F.lit(0).cast("long"), F.col("duration") - length, F.lit(stride).cast("long"))
    return fits.select("*", F.posexplode(numbers).alias("window", "_at")).withColumn("window_start", F.col("start") + F.col("_at")).drop("_at")


def stitch(windows: DataFrame, keys: list[str], window: str, start: str, values: str, keep: int | None = None) -> DataFrame:
    """Overlapping windows of values as one series again: (keys, t, value); of several windows the last one holds.

    ``keep`` uses the last so many values of each window only.
    """
    arr, first = F.col(values), F.lit(0)
    if keep is not None:
        first = F.greatest(F.size(arr) - keep, F.lit(0))
        arr = F.slice(arr, first + 1, F.least(F.lit(keep), F.size(arr)))
    flat = windows.select(*keys, window, (F.col(start) + first).alias("_s"), F.posexplode(arr).alias("_p", "_v"))
    return flat.withColumn("t", F.col("_s") + F.col("_p")).groupBy(*keys, "t").agg(F.max_by("_v", window).alias("value"))


def interval_all(x: Column, length: int, keys: list[str], t: str) -> Column:
    """True where this row and the next length-1 rows exist without gap and are all true.

    Sums from running totals: a long frame costs no more than a short one.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    run = F.sum(F.coalesce(x, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = run - F.coalesce(x, F.lit(False)).cast("int")
    last = F.lead(run, length - 1).over(w)
    return F.coalesce((last - before == length) & (F.lead(t, length - 1).over(w) == F.col(t) + length - 1), F.lit(False))


def run_ends(df: DataFrame, flag: Column, keys: list[str], t: str) -> DataFrame:
    """(keys, first, end): half-open runs of true rows."""
    return islands(df, flag, keys, t).groupBy(*keys, "island").agg(F.min(t).alias("first"), (F.max(t) + 1).alias("end")).drop("island")


def spaced_chunks(df: DataFrame, valid: Column, length: int, npad: int, agent: str = "agent", t: str = "t", start: str = "isstart", first_offset: Column | None = None) -> DataFrame:
    """(agent, t0): starts of chunks of length + npad valid rows without a start inside, ``length`` apart within a run.

    A chunk never holds a break, so the next admissible start after a run is the first row of the next one: no scan in order is
    needed. ``first_offset`` (per agent) shifts the agent's first run, as a seeded draw.
    """
    total = length + npad
    w = Window.partitionBy(agent).orderBy(t)
    # breaks after the first row of a chunk, up to its last
    broken = F.sum(F.col(start).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    can = interval_all(valid, total, [agent], t) & (F.lead(broken, total - 1).over(w) == broken)
    runs = run_ends(df.withColumn("_can", can), F.col("_can"), [agent], t)
    shift = F.lit(0) if first_offset is None else F.when(F.row_number().over(Window.partitionBy(agent).orderBy("first")) == 1, first_offset).otherwise(0)
    runs = runs.withColumn("_first", F.col("first") + shift).where(F.col("_first") < F.col("end"))
    return runs.select(agent, F.explode(F.sequence(F.col("_first"), F.col("end") - 1, F.lit(length).cast("long"))).alias("t0"))


def segments_by_id(df: DataFrame, id: str = "id", t: str = "t", least: int = 1) -> DataFrame:
    """(id, t0, n): one segment per individual, from its first to its last row."""
    return df.where(F.col(id).isNotNull()).groupBy(id).agg(F.min(t).alias("t0"), (F.max(t) - F.min(t) + 1).alias("n")).where(F.col("n") >= least)


def intervals_by_id(df: DataFrame, valid: Column, agent: str = "agent", id: str = "id", t: str = "t") -> DataFrame:
    """(agent, id, first, end): runs of one individual, reaching one row back where that row has the same id."""
    w = Window.partitionBy(agent).orderBy(t)
    back = df.withColumn("_back", F.coalesce(F.lag(id).over(w).eqNullSafe(F.col(id)) & (F.lag(t).over(w) == F.col(t) - 1), F.lit(False)))
    runs = islands(back, valid, [agent, id], t)
    out = runs.groupBy(agent, id, "island").agg(F.min_by("_back", t).alias("_b"), F.min(t).alias("first"), (F.max(t) + 1).alias("end"))
    return out.select(agent, id, (F.col("first") - F.col("_b").cast("int")).alias("first"), "end")


def complete_runs(df: DataFrame, x: str, keys: list[str], t: str, least: int = 2) -> DataFrame:
    """(keys, first, n): runs of one feature without a missing value, of at least ``least`` rows."""
    return islands(df, F.col(x).isNotNull(), keys, t).groupBy(*keys, "island").agg(F.min(t).alias("first"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")


def subsample_sequences(lengths: DataFrame, key: str, n: str, target: int, seed: int = 0) -> DataFrame:
    """Whole sequences in a seeded order until they hold ``target`` rows: the key and length of those chosen.

    The order is a hash of the key. The running sum is over one row per sequence, in hash buckets first, so that the window that
    sees all sequences has one row per bucket only.
    """
    h = lengths.withColumn("_h", hash_draw([key], seed, "order")).withColumn("_b", F.floor(F.col("_h") * 4096))
    per = h.groupBy("_b").agg(F.sum(n).alias("_n"))
    before = per.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("_b").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, -1)
    run = h.join(F.broadcast(before.select("_b", "_before")), "_b").withColumn("_run", F.col("_before") + F.coalesce(F.sum(n).over(w), F.lit(0)))
    return run.where(F.col("_run") < target).select(key, n)


def running_offsets(df: DataFrame, order: list[str], weight: str | None = None, name: str = "offset") -> DataFrame:
    """The rows with the sum of ``weight`` (or the number) of all rows before them in a total order, without a window over all of them.

    Rows are range-partitioned and stored, so that ranges stay as they are; each range is summed in a window of its own, and only one
    number to a range goes through a single task.
    """
    one = F.col(weight) if weight else F.lit(1)
    ranged = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_range").agg(F.sum(one).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row to a range: as many as there are shuffle partitions
    placed = ranged.join(F.broadcast(sums), "_range").withColumn(name, F.col("_before") + F.coalesce(F.sum(one).over(w), F.lit(0)))
    return placed.drop("_range", "_before")


def startable(df: DataFrame, valid: Column, length: int, ahead: int, keys: list[str], t: str, start: str) -> DataFrame:
    """(keys, t0): the first frame of each key from which ``length`` rows are valid and ``ahead`` rows have no break."""
    w = Window.partitionBy(*keys).orderBy(t)
    ok = interval_all(valid, length, keys, t) & interval_all(~F.col(start) | (F.row_number().over(w) == 1), ahead, keys, t)
    return df.withColumn("_ok", ok).where("_ok").groupBy(*keys).agg(F.min(t).alias("t0"))


def split_by_position(df: DataFrame, keys: list[str], order: list[str], share: float = 0.9) -> DataFrame:
    """part: train for the first ``share`` of each key's rows, validation for the rest."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(*order))
    return df.withColumn("part", F.when(rank <= F.floor(F.count("*").over(w) * share), "train").otherwise("validation"))
