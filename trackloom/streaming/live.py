"""Tracks as streams: sessions, steps, running statistics and transition counts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_sessions(tracks: DataFrame, agent: str = "agent", ts: str = "ts", gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """(agent, begin, end, n): sessions of arriving rows; rows later than the watermark are dropped."""
    w = F.session_window(ts, gap)
    return tracks.withWatermark(ts, late).groupBy(agent, w.alias("w")).agg(F.count("*").alias("n")).select(agent, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def live_steps(tracks: DataFrame, agent: str = "agent", t: str = "t", x: str = "x") -> DataFrame:
    """(agent, t, step): the change since the row before, which is the state of each agent.

    Rows of a micro-batch are put in order of t; a row at or before the last one seen gives no step.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(t)
        last = state.get if state.exists else None
        out = []
        for at, value in zip(rows[t].tolist(), rows[x].tolist()):
            if last is None or at > last[0]:
                out.append((key[0], at, value - last[1] if last is not None and at == last[0] + 1 and value == value and last[1] is not None else None))
                last = (at, value if value == value else None)
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=[agent, t, "step"]).astype({"step": "float64"})

    kind = dict(tracks.dtypes)
    return tracks.select(agent, t, x).groupBy(agent).applyInPandasWithState(step, f"{agent} {kind[agent]}, {t} {kind[t]}, step double", f"{t} {kind[t]}, {x} double", "append", GroupStateTimeout.NoTimeout)


class _Waiting:
    """Rows of one agent that wait until the watermark has passed them, so that they are taken in order whatever batch they came in."""

    def __init__(self, state: GroupState, columns: list[str]):
        self.state, self.columns = state, columns
        # last: the last row taken; rest: whatever a caller keeps as JSON
        self.pending, self.last, self.rest = [], None, None
        if state.exists:
            kept = json.loads(state.get[0])
            self.pending, self.last, self.rest = [tuple(r) for r in kept["pending"]], tuple(kept["last"]) if kept["last"] else None, kept["rest"]

    def arrive(self, parts: Iterator[pd.DataFrame], t: str, ts: str) -> Iterator[tuple]:
        """Rows that are due, as (t, milliseconds, values), each t once; the first row of a t that has come counts."""
        for rows in parts if not self.state.hasTimedOut else ():
            millis = rows[ts].astype("datetime64[ms]").astype("int64")
            values = [rows[c].tolist() for c in self.columns]
            self.pending += [(int(a), int(b), *v) for a, b, *v in zip(rows[t].tolist(), millis.tolist(), *values)]
        now = self.state.getCurrentWatermarkMs()
        self.pending.sort(key=lambda r: r[:2])
        due = [r for r in self.pending if r[1] <= now]
        # a row waits for earlier ones that are not due, so that t stays in order
        first = min((r[0] for r in self.pending if r[1] > now), default=None)
        due = [r for r in due if first is None or r[0] < first]
        self.pending = self.pending[len(due) :]
        for r in due:
            if self.last is None or r[0] > self.last[0]:
                before, self.last = self.last, r
                yield before, r

    def keep(self, forget_ms: int) -> None:
        """Wake up when the next row is due; without any, forget the agent after a silence of ``forget_ms``."""
        now = self.state.getCurrentWatermarkMs()
        if not self.pending and self.last is not None and self.last[1] + forget_ms <= now:
            self.state.remove()
            return
        self.state.update((json.dumps({"pending": self.pending, "last": self.last, "rest": self.rest}),))
        wake = min(r[1] for r in self.pending) if self.pending else (self.last[1] if self.last else now) + forget_ms
        self.state.setTimeoutTimestamp(max(wake, now) + 1)


def _millis(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def live_flags(tracks: DataFrame, agent: str = "agent", t: str = "t", ts: str = "ts", gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """(agent, t, ts, isstart, session): start flags of arriving rows and the t that their session began at.

    A row starts a session if it is an agent's first, does not follow on t, or comes over ``gap`` after the row before. Rows are given
    out once the watermark has passed them, in order; later ones Spark drops and counts (numRowsDroppedByWatermark). An agent's state
    goes when it has been silent for ``gap`` after its last row: whatever comes then is a start in any case.
    """
    gap_ms = _millis(gap)

    def flags(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = _Waiting(state, [])
        out = []
        for before, row in waiting.arrive(parts, t, ts):
            start = before is None or row[0] != before[0] + 1 or row[1] - before[1] > gap_ms
            waiting.rest = row[0] if start else waiting.rest
            out.append((key[0], row[0], pd.Timestamp(row[1], unit="ms"), start, waiting.rest))
        waiting.keep(gap_ms)
        yield pd.DataFrame(out, columns=[agent, t, ts, "isstart", "session"]).astype({t: "int64", ts: "datetime64[ns]", "isstart": "bool", "session": "int64"})

    kind = dict(tracks.dtypes)
    schema = f"{agent} {kind[agent]}, {t} long, {ts} timestamp, isstart boolean, session long"
    return tracks.select(agent, t, ts).withWatermark(ts, late).groupBy(agent).applyInPandasWithState(flags, schema, "kept string", "append", GroupStateTimeout.EventTimeTimeout)


def tumbling_transitions(tracks: DataFrame, width: str, agent: str = "agent", t: str = "t", ts: str = "ts", bin_: str = "bin", late: str = "1 day", forget: str = "7 days") -> DataFrame:
    """(agent, window, from_bin, to_bin, n): transition counts of each agent in tumbling windows of event time, once a window is over.

    A transition belongs to the window of its second row; the first may lie in the window before, as the state hands the last bin
    over the border. Sums over agents are those of transitions() within each window.
    """
    wide, forget_ms = _millis(width), _millis(forget)

    def count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = _Waiting(state, [bin_])
        open_ = {tuple(k): n for k, n in waiting.rest or []}
        for before, row in waiting.arrive(parts, t, ts):
            if before is not None and row[0] == before[0] + 1 and before[2] == before[2] and row[2] == row[2]:
                k = (row[1] // wide * wide, int(before[2]), int(row[2]))
                open_[k] = open_.get(k, 0) + 1
        # rows come in order of t; what still waits may lie in an earlier window than the watermark
        over = min([state.getCurrentWatermarkMs(), *(r[1] for r in waiting.pending)])
        out = [(key[0], pd.Timestamp(w, unit="ms"), a, b, n) for (w, a, b), n in sorted(open_.items()) if w + wide <= over]
        waiting.rest = [[list(k), n] for k, n in open_.items() if k[0] + wide > over]
        waiting.keep(max(wide, forget_ms))
        yield pd.DataFrame(out, columns=[agent, "window", "from_bin", "to_bin", "n"]).astype({"window": "datetime64[ns]", "from_bin": "int64", "to_bin": "int64", "n": "int64"})

    kind = dict(tracks.dtypes)
    schema = f"{agent} {kind[agent]}, window timestamp, from_bin long, to_bin long, n long"
    return tracks.select(agent, t, ts, F.col(bin_).cast("double").alias(bin_)).withWatermark(ts, late).groupBy(agent).applyInPandasWithState(count, schema, "kept string", "append", GroupStateTimeout.EventTimeTimeout)


def live_moments(tracks: DataFrame, x: str, by: list[str] = ()) -> DataFrame:
    """Running (n, mean, sd) by group, for update or complete mode."""
    return tracks.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))


def live_transitions(tracks: DataFrame, agent: str = "agent", t: str = "t", bin_: str = "bin") -> DataFrame:
    """(from_bin, to_bin) of arriving rows, the last bin of each agent as its state; counted by whoever reads it."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(t)
        last = state.get if state.exists else None
        out = []
        for at, b in zip(rows[t].tolist(), rows[bin_].tolist()):
            if last is not None and at == last[0] + 1:
                out.append((key[0], int(last[1]), int(b)))
            if last is None or at > last[0]:
                last = (at, int(b))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=[agent, "from_bin", "to_bin"])

    kind = dict(tracks.dtypes)
    return tracks.select(agent, t, bin_).groupBy(agent).applyInPandasWithState(step, f"{agent} {kind[agent]}, from_bin int, to_bin int", f"{t} {kind[t]}, {bin_} int", "append", GroupStateTimeout.NoTimeout)
