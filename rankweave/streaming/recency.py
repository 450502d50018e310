"""Recency-weighted support kept up over a stream of values.

Support obeys a recursion: each new value multiplies every pattern's support by e^-k and adds 1 for the
patterns that end at it. State holds a series' last max_len - 1 values and, for each pattern seen, its
support and the position it holds for: at most the sum of 2! to max_len! patterns a series, 32 of them for
lengths up to 4, whatever the length of the stream.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

OUT = "series_id string, pos long, pattern string, support double"
STATE = "pos long, seq long, buf array<double>, patterns array<string>, supports array<double>, places array<long>"
WAITING = ", taken long, times array<long>, seqs array<long>, waiting array<double>"


def _shape(win: list[float]) -> str | None:
    if len(set(win)) < len(win):
        return None
    order = sorted(win)
    return "(" + ",".join(str(order.index(v) + 1) for v in win) + ")"


@dataclass
class Series:
    """What is kept of a series: its newest position and seq, last values, and (support, position) by pattern."""

    pos: int = -1
    seq: int | None = None
    buf: list[float] = field(default_factory=list)
    known: dict[str, tuple[float, int]] = field(default_factory=dict)

    @classmethod
    def of(cls, pos, seq, buf, names, sums, places) -> Series:
        return cls(pos, seq, list(buf), {n: (s, p) for n, s, p in zip(names, sums, places, strict=True)})

    def kept(self) -> tuple:
        return self.pos, self.seq, self.buf, list(self.known), [s for s, _ in self.known.values()], [p for _, p in self.known.values()]

    def take(self, values: list[float], k: float, min_len: int, max_len: int) -> pd.DataFrame:
        """The supports, at the newest of some values in order, of the patterns that ended in them."""
        touched = set()
        for value in values:
            self.pos += 1
            self.buf = [*self.buf, float(value) + 0.0][-max_len:]
            for m in range(min_len, len(self.buf) + 1):
                if (name := _shape(self.buf[-m:])) is not None:
                    s, p = self.known.get(name, (0.0, self.pos))
                    self.known[name] = (s * math.exp(-k * (self.pos - p)) + 1.0, self.pos)
                    touched.add(name)
        out = sorted(touched)
        return pd.DataFrame({"pos": self.pos, "pattern": out, "support": [self.known[n][0] * math.exp(-k * (self.pos - self.known[n][1])) for n in out]})


def stream_supports(values: DataFrame, k: float, min_len: int = 2, max_len: int = 4) -> DataFrame:
    """Of a stream (series_id, seq, value): for each batch and series the supports, at its newest value, of the patterns that ended in it.

    Values are taken by ``seq``, a whole number, inside a batch; batches must come in order, and a value that
    comes after one with the same ``seq`` or a later one ends the stream with an error. -0.0 counts as 0.0.
    """
    if not k > 0:
        raise ValueError("the forgetting factor must be above 0")

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = Series.of(*state.get) if state.exists else Series()
        rows = pd.concat(list(frames)).sort_values("seq")
        order = ([] if own.seq is None else [own.seq]) + rows.seq.tolist()
        if any(a >= b for a, b in zip(order, order[1:], strict=False)):
            raise ValueError(f"values of series {key[0]} came out of order")
        out = own.take(rows.value.tolist(), k, min_len, max_len)
        own.seq = int(order[-1])
        state.update(own.kept())
        yield out.assign(series_id=key[0])[["series_id", "pos", "pattern", "support"]]

    return values.groupBy("series_id").applyInPandasWithState(step, OUT, STATE, "update", "NoTimeout")


def stream_supports_in_time(values: DataFrame, k: float, time: str = "ts", min_len: int = 2, max_len: int = 4) -> DataFrame:
    """As stream_supports, of a stream (series_id, a time with a watermark, seq, value) that may come out of order.

    A value waits in the state until the watermark passes its time; then values are taken by time, and by ``seq``
    where times are equal. A timer takes what waits when no value comes. The watermark's delay bounds the values that
    wait; one that comes when a later one has been taken, which only one behind the watermark can, is dropped.
    """
    if not k > 0:
        raise ValueError("the forgetting factor must be above 0")

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fields = state.get if state.exists else None
        own = Series.of(*fields[:6]) if fields else Series()
        waiting = list(zip(*fields[7:], strict=True)) if fields else []
        last = (fields[6], own.seq) if fields and own.seq is not None else None
        for rows in () if state.hasTimedOut else frames:
            waiting += zip(rows[time].astype("datetime64[us]").astype("int64").tolist(), rows.seq.tolist(), rows.value.tolist(), strict=True)
        passed = state.getCurrentWatermarkMs() * 1000
        waiting = sorted(x for x in waiting if last is None or x[:2] > last)
        ready = [x for x in waiting if x[0] <= passed]
        waiting = waiting[len(ready) :]
        out = own.take([v for _, _, v in ready], k, min_len, max_len)
        taken = last[0] if last else None
        if ready:
            taken, own.seq = ready[-1][0], ready[-1][1]
        times, seqs, rest = (list(x) for x in zip(*waiting, strict=True)) if waiting else ([], [], [])
        state.update((*own.kept(), taken, times, seqs, rest))
        if waiting:
            state.setTimeoutTimestamp(max(times[0] // 1000, passed // 1000) + 1)
        yield out.assign(series_id=key[0])[["series_id", "pos", "pattern", "support"]]

    return values.groupBy("series_id").applyInPandasWithState(step, OUT, STATE + WAITING, "update", "EventTimeTimeout")
