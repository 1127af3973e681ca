"""Stateful operators over keyed streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor


class RunningTotals(StatefulProcessor):
    """Rows and sum of `value` per user over all batches; emits the totals after each batch."""

    def init(self, handle) -> None:
        self.totals = handle.getValueState("totals", "n long, total double")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        n, total = self.totals.get() or (0, 0.0)
        for frame in rows:
            n, total = n + len(frame), total + float(frame["value"].sum())
        self.totals.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    def close(self) -> None:
        return None


class RowTotals(RunningTotals):
    """The same, a row at a time."""

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        n, total = self.totals.get() or (0, 0.0)
        for row in rows:
            n, total = n + 1, total + float(row["value"] or 0.0)
        self.totals.update((n, total))
        yield Row(user_id=key[0], n=n, total=total)


class TotalsByBucket(StatefulProcessor):
    """RunningTotals of all users of a bucket. Input: columns `user` (text, never null) and `value`; output: user, n, total of the users with rows.

    A group has a cost of its own (a call, a frame in and one out), which with very many small groups is nearly all of the
    cost; here a bucket pays it, and a user only a read and a write of the state.
    """

    def init(self, handle) -> None:
        self.totals = handle.getMapState("totals", "user string", "n long, total double")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        added = pd.concat([frame.groupby("user")["value"].agg(["size", "sum"]) for frame in rows]).groupby(level=0).sum()
        out = []
        for user, more, sum_ in zip(added.index, added["size"].tolist(), added["sum"].tolist()):
            n, total = self.totals.getValue((user,)) or (0, 0.0)
            out.append((user, n + more, total + sum_))
            self.totals.updateValue((user,), out[-1][1:])
        yield pd.DataFrame(out, columns=["user", "n", "total"])

    def close(self) -> None:
        return None


def merge_sessions(sessions: list[tuple], gap: int) -> list[tuple]:
    """Sessions (first, last, rows) in order, those less than `gap` apart as one."""
    merged: list[tuple] = []
    for first, last, n in sorted(sessions):
        if merged and first < merged[-1][1] + gap:
            a, b, m = merged[-1]
            merged[-1] = (a, max(b, last), m + n)
        else:
            merged.append((first, last, n))
    return merged


class InactivitySessions(StatefulProcessor):
    """Sessions of a key: runs of instants with less than `gap` between neighbours; each comes out once the watermark has passed its end.

    Open sessions are a list, since rows of a batch come in any order and a late one may join two. One event-time timer
    stands at the earliest end; when it fires, all sessions that the watermark has passed end, and the next end gets a timer.
    Input: a column `at` in microseconds. Output: user_id, start and n.
    """

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long")

    def _keep(self, sessions: list[tuple]) -> None:
        if sessions:
            self.open.put(sessions)
            self.handle.registerTimer(self._end(min(last for _, last, _ in sessions)))
        else:
            self.open.clear()

    def _end(self, last: int) -> int:
        """Milliseconds, rounded up."""
        return -(-(last + self.gap) // 1000)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        known = list(self.open.get()) if self.open.exists() else []
        for frame in rows:
            known += [(t, t, 1) for t in frame["at"].tolist()]
        self._keep(merge_sessions(known, self.gap))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        sessions = list(self.open.get()) if self.open.exists() else []
        ended = [s for s in sessions if self._end(s[1]) <= now]
        if ended:  # else an earlier timer has ended them, or they have grown since
            yield pd.DataFrame({"user_id": [key[0]] * len(ended), "start": [s[0] for s in ended], "n": [s[2] for s in ended]}).astype({"user_id": "int64", "start": "int64", "n": "int64"})
        if len(ended) < len(sessions):
            self._keep([s for s in sessions if self._end(s[1]) > now])
        elif ended:
            self.open.clear()

    def close(self) -> None:
        return None


class SessionsByBucket(InactivitySessions):
    """InactivitySessions of all users of a bucket, for the reason that TotalsByBucket gives. Input: user (text, never null) and `at`; output: user, start and n.

    One timer stands at the earliest end of the bucket.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "user string", "firsts array<long>, lasts array<long>, ns array<long>")

    def _put(self, user: str, sessions: list[tuple]) -> int:
        """The user's open sessions, at least one; gives the earliest end."""
        self.open.updateValue((user,), tuple(map(list, zip(*sessions))))
        return self._end(min(last for _, last, _ in sessions))

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        added: dict[str, list[tuple]] = {}
        for frame in rows:
            for user, at in zip(frame["user"].tolist(), frame["at"].tolist()):
                added.setdefault(user, []).append((at, at, 1))
        ends = []
        for user, new in added.items():
            held = self.open.getValue((user,))
            ends.append(self._put(user, merge_sessions([*zip(*held), *new] if held else new, self.gap)))
        if ends:
            self.handle.registerTimer(min(ends))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        out, ends = [], []
        for (user,), held in list(self.open.iterator()):
            sessions = list(zip(*held))
            ended = [s for s in sessions if self._end(s[1]) <= now]
            out += [(user, first, n) for first, _, n in ended]
            left = [s for s in sessions if self._end(s[1]) > now]
            if ended and left:
                ends.append(self._put(user, left))
            elif left:
                ends.append(self._end(min(last for _, last, _ in left)))
            else:
                self.open.removeKey((user,))
        if ends:
            self.handle.registerTimer(min(ends))
        if out:
            yield pd.DataFrame(out, columns=["user", "start", "n"])


class CountsByType(StatefulProcessor):
    """Rows of each user by event type over all batches, on top of an initial state; a type without rows for `ttl_ms` is forgotten.

    A lifetime needs the time mode ProcessingTime, in which Spark plans batches without data for ever: a trigger that
    takes what is available ends only with spark.sql.streaming.noDataMicroBatches.enabled off. Output after each batch:
    user_id, event_type, n of all types that the state holds.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl = ttl_ms

    def init(self, handle) -> None:
        self.counts = handle.getMapState("counts", "event_type string", "n long", self.ttl)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for kind, n in zip(initialState["event_type"], initialState["n"]):
            self.counts.updateValue((kind,), (int(n),))

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for kind, n in frame["event_type"].value_counts().items():
                before = self.counts.getValue((kind,))
                self.counts.updateValue((kind,), ((before[0] if before else 0) + int(n),))
        held = [(k[0], v[0]) for k, v in self.counts.iterator()]
        yield pd.DataFrame({"user_id": [key[0]] * len(held), "event_type": [k for k, _ in held], "n": [n for _, n in held]})

    def close(self) -> None:
        return None


class CountsByBucket(StatefulProcessor):
    """CountsByType of all users of a bucket, without lifetimes, for the reason that TotalsByBucket gives.

    Input: user (text, never null) and event_type, the initial state has n too. Output after each batch: user, event_type, n of
    all types that the state holds for the users with rows.
    """

    def init(self, handle) -> None:
        self.counts = handle.getMapState("counts", "user string", "types array<string>, ns array<long>")

    def _add(self, counted: pd.Series) -> dict[str, dict]:
        """Add counts by (user, event_type) to the state; gives all counts of their users."""
        by_user: dict[str, dict] = {}
        for (user, kind), n in zip(counted.index, counted.tolist()):
            kind = None if kind != kind else kind  # a null type is a type of its own
            counts = by_user.setdefault(user, {})
            counts[kind] = counts.get(kind, 0) + int(n)
        for user, counts in by_user.items():
            types, ns = self.counts.getValue((user,)) or ((), ())
            for kind, n in zip(types, ns):
                counts[kind] = counts.get(kind, 0) + n
            self.counts.updateValue((user,), (list(counts), list(counts.values())))
        return by_user

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._add(initialState.groupby(["user", "event_type"], dropna=False)["n"].sum())

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        held = self._add(pd.concat([frame.groupby(["user", "event_type"], dropna=False).size() for frame in rows]))
        yield pd.DataFrame([(user, kind, n) for user, counts in held.items() for kind, n in counts.items()], columns=["user", "event_type", "n"])

    def close(self) -> None:
        return None


def count_batches(key, frames, state):
    """For applyInPandasWithState: rows of each event type over all batches."""
    n = state.get[0] if state.exists else 0
    n += sum(len(f) for f in frames)
    state.update((n,))
    yield pd.DataFrame({"event_type": [key[0]], "n": [n]})
