"""Keyed state that ends by itself: processors for transformWithState, with timers on the watermark.

Times come and go as microseconds (`at`), so the session's time zone has no part in them. Health and gate fold a batch's rows of a key in order of
(at, seq); what a timer does without input, the fold does as well when a later row shows that the time had passed, so results do not
depend on how rows fall into batches. For health, Spark drops rows behind the watermark before the fold; who must not lose them routes them first
(`LateRouter`). The gate drops none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers need, and the setting that names it.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_CONF = "spark.sql.streaming.stateStore.providerClass"

#: Health: one "state" row for each batch and source with rows, one "alarm" row for each failure that lasts too long.
HEALTH = "source_id bigint, kind string, by_timer boolean, runs bigint, consecutive_failures bigint, first_at bigint, success_at bigint, alarm_at bigint"


def unpacked(frames: Iterator[pd.DataFrame], names: tuple[str, ...]) -> list[np.ndarray]:
    """Columns of a key's packs (rows of lists), in order of (at, seq)."""
    packs = pd.concat(list(frames))
    join = lambda name: np.concatenate([np.asarray(x) for x in packs[name]])
    order = np.lexsort((join("seq"), join("at")))
    return [join(name)[order] for name in names]


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """The rows under the schema's names; whole numbers may be null."""
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    kinds = {"bigint": "Int64", "boolean": "boolean", "string": object}
    return pd.DataFrame({name: pd.Series(list(c), dtype=kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


#: Groups that sources are dealt into: a call of the processor, with its trips to the state store, serves a group and not a source.
GROUPS = 256
_HELD = ("source_id", "runs", "failures", "first", "success", "alarmed", "hours")


class SourceHealth(StatefulProcessor):
    """Consecutive failures of a source, and an alarm where they last longer than twice its interval.

    Input: a group's rows of source_id, at, seq, failed, hours (the source's interval; null for none). The alarm of a row of failures stands at the first
    failure plus twice the interval, once; a success at or before that time calls it off. A source without an interval has no alarm: its gap is
    `consecutive_failures` of three or more. State: six values for each source of the group, and the group's one timer, at the first alarm that is due.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = ("bigint", "bigint", "bigint", "bigint", "bigint", "boolean", "double")
        self.state = handle.getValueState("health", ", ".join([*[f"{n} array<{k}>" for n, k in zip(_HELD, kinds, strict=True)], "timer bigint"]))

    @staticmethod
    def _due(first: int | None, alarmed: bool, hours: float | None) -> int | None:
        return None if first is None or alarmed or hours is None else first + int(2 * hours * 3_600_000_000)

    def _load(self) -> tuple[dict[int, list], int | None]:
        if not self.state.exists():
            return {}, None
        *columns, timer = self.state.get()
        return {row[0]: list(row[1:]) for row in zip(*columns, strict=True)}, timer

    def _store(self, held: dict[int, list], timer: int | None) -> None:
        due = min((d for _, _, first, _, alarmed, hours in held.values() if (d := self._due(first, alarmed, hours)) is not None), default=None)
        wanted = None if due is None else due // 1000
        if timer is not None and timer != wanted:
            self.handle.deleteTimer(timer)
        if wanted is not None and timer != wanted:
            self.handle.registerTimer(wanted)
        self.state.update((*[list(c) for c in zip(*[(k, *v) for k, v in held.items()], strict=True)], wanted))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, timer = self._load()
        batch = pd.concat(list(rows)).sort_values(["source_id", "at", "seq"], ignore_index=True)
        out: list[tuple] = []
        given = [None if h != h else h for h in batch["hours"].astype(float).tolist()]
        now, seen = None, 0
        runs = failures = 0
        first = success = hours = due = None
        alarmed = False

        def close() -> None:
            held[now] = [runs, failures, first, success, alarmed, hours]
            out.append((now, "state", False, runs, failures, first, success, None))

        sources, last = batch["source_id"].tolist(), {}
        for source, h in zip(sources, given, strict=True):  # the interval that a batch gives last holds for all of it
            if h is not None:
                last[source] = h
        for source, ts, failed in zip(sources, batch["at"].tolist(), batch["failed"].tolist(), strict=True):
            if source != now:
                if seen:
                    close()
                now, (runs, failures, first, success, alarmed, hours) = source, held.get(source, (0, 0, None, None, False, None))
                hours = last.get(source, hours)
                due = self._due(first, alarmed, hours)
            seen += 1
            runs += 1
            if failed:
                if failures == 0:
                    first, alarmed = ts, False
                    due = self._due(first, alarmed, hours)
                failures += 1
            # the first row past the due time, a failure or a success, shows that the alarm was due
            if due is not None and ts > due:
                out.append((source, "alarm", False, runs, failures, first, success, due))
                alarmed, due = True, None
            if not failed:
                failures, first, alarmed, success, due = 0, None, False, ts, None
        if seen:
            close()
        self._store(held, timer)
        yield _frame(out, HEALTH)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, timer = self._load()
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        for source, h in held.items():
            runs, failures, first, success, alarmed, hours = h
            due = self._due(first, alarmed, hours)
            if due is not None and due // 1000 < mark:
                h[4] = True
                out.append((source, "alarm", True, runs, failures, first, success, due))
        self._store(held, None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer)
        if out:
            yield _frame(out, HEALTH)


#: Gate: one row for each candidate that is promoted; opened_by is the candidate that brought the last evidence needed.
PROMOTED = "fingerprint string, candidate_id bigint, opened_by bigint, owners bigint, confidence string"


class EvidenceGate(StatefulProcessor):
    """Candidates of a fingerprint wait until their evidence suffices: an authoritative source in scope, or two trusted owners.

    Input: fingerprint, and lists (a batch's rows come in packs) of at, seq, candidate_id, owner, known (it has an owner), strength (HIGH, TRUSTED or
    neither). When the gate opens, the candidate that opened it and all that wait are promoted, once; later ones pass unseen. A fingerprint without a row for `span` is forgotten, its waiting candidates with it, and starts
    anew: a timer on the watermark clears the state, and a row that comes later than that does the same. No row is dropped: a late one counts for the
    life that stands, or, if it is from more than `span` before that life's last row, for a life of its own that is over. State: the waiting
    candidates of the span (a list that is appended to, not rewritten) and four values.
    """

    TRUSTED, HIGH = 1, 2

    def __init__(self, span_ms: int) -> None:
        self.span_ms = span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("gate", "opened boolean, owner bigint, last bigint")
        self.waiting = handle.getListState("waiting", "candidate_id bigint, owner bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        opened, owner, last = self.state.get() if self.state.exists() else (False, None, None)
        at, candidate, who, known, strength = unpacked(rows, ("at", "candidate_id", "owner", "known", "strength"))
        out, span = [], self.span_ms * 1000
        if last is not None:
            self.handle.deleteTimer(last // 1000 + self.span_ms)
        # rows before `over` are of lives that ended before the one that stands
        over = 0 if last is None else int(np.searchsorted(at, last - span))
        named = lambda rows: [(int(c), int(w) if k else None) for c, w, k in zip(candidate[rows], who[rows], known[rows], strict=True)]
        edges = sorted({0, over, *(np.flatnonzero(np.diff(at) > span) + 1).tolist(), len(at)})
        for a, b in zip(edges, edges[1:], strict=False):
            goes_on = a == over and last is not None and at[a] - last <= span
            if a >= over and last is not None and not goes_on:
                self.waiting.clear()
            is_open, first = (opened, owner) if goes_on else (False, None)
            if not is_open:
                trusted = strength[a:b] == self.TRUSTED
                if first is None and trusted.any():
                    first = int(who[a + trusted.argmax()])
                opens = strength[a:b] == self.HIGH
                opens |= trusted & (who[a:b] != first) if first is not None else False
                if opens.any():
                    at_open = a + int(opens.argmax())
                    # the stored list is read only if the gate opens
                    held = [tuple(w) for w in self.waiting.get()] if goes_on and self.waiting.exists() else []
                    group = held + named(slice(a, at_open + 1))
                    owners = len({w for _, w in group} - {None})
                    confidence = "high" if strength[at_open] == self.HIGH else "medium"
                    out += [(key[0], c, int(candidate[at_open]), owners, confidence) for c, _ in group]
                    is_open, first = True, None
                    if goes_on:
                        self.waiting.clear()
                elif b == len(at) and a >= over:
                    self.waiting.appendList(named(slice(a, b)))
            if a >= over:
                opened, owner, last = is_open, first, max(int(at[b - 1]), last or 0) if goes_on else int(at[b - 1])
        self.state.update((opened, owner, last))
        self.handle.registerTimer(last // 1000 + self.span_ms)
        if out:
            yield _frame(out, PROMOTED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        self.waiting.clear()
        return iter(())


#: Packs that the router lets out at once.
PACKS = 64


class LateRouter(StatefulProcessor):
    """Marks the rows that stand behind the watermark as their batch begins, so that they can be kept; holds no state.

    Input: source_id, and lists (packs) of seq and at, in a column that carries no watermark, so that Spark drops nothing before. A row that is not late has windows
    that all end after the watermark, so no later operator drops it either: every row is in one branch. Spark lets no row out whose event
    time has passed, so a late row's `ts` is lifted just above the watermark; its own time is `at`.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for frame in rows:
            for i in range(0, len(frame), PACKS):
                at, seq = (np.concatenate([np.asarray(x) for x in frame[c].iloc[i : i + PACKS]]) for c in ("at", "seq"))
                ts = pd.to_datetime(np.maximum(at, mark + 1000), unit="us", utc=True)
                yield pd.DataFrame({"source_id": key[0], "seq": seq, "ts": ts, "at": at, "late": at <= mark})
