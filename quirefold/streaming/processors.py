"""Stateful processors of the live operators (T1-T4): value and list state, event-time timers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _in_order(rows: Iterable[Row], *by: str) -> list[Row]:
    """One micro-batch's rows of one key; what a trigger reads bounds them."""
    return sorted(rows, key=lambda r: tuple((r[c] is None, r[c]) for c in by))


class _Timed(StatefulProcessor):
    """With at most one timer a key.

    Each call on state or timers is a message between Python and the JVM, and a key of few rows
    costs little else. So a key's timer is kept in its state, not asked for.
    """

    def _move_timer(self, old: int | None, at_ms: float, now_ms: int) -> int:
        """The key's timer, set instead of ``old``."""
        at_ms = max(int(at_ms), now_ms + 1)
        if old != at_ms:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at_ms)
        return at_ms

    def _set_timer(self, at_ms: int, now_ms: int) -> None:
        at_ms = max(int(at_ms), now_ms + 1)
        for old in list(self.handle.listTimers()):
            if old == at_ms:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at_ms)

    def close(self) -> None:
        pass


class TaskRuns(_Timed):
    """T1. One run a task and its last lines; a finished run goes ``expiry_s`` after its end.

    What stays of an expired run is a mark that drops its late events (T5), for ``mark_s`` more.
    """

    def __init__(self, keep: int, expiry_s: int, mark_s: int) -> None:
        self.keep, self.expiry_s, self.mark_s = keep, expiry_s, mark_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "started timestamp, updated timestamp, done long, total long, status string, timer long")
        self.lines = handle.getListState("lines", "line string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.run.get()
        run, timer = (list(held[:5]), held[5]) if held else (None, None)
        lines = [x[0] for x in self.lines.get()] if run and run[4] != "expired" else []
        had, met = bool(lines), False
        for r in _in_order(rows, "seq"):
            if run is None or r["kind"] == "start":
                run, lines = [r["ts"], r["ts"], None, None, "running"], []
            elif run[4] != "running":
                continue
            met = True
            run[1] = r["ts"]
            run[2] = run[2] if r["done"] is None else r["done"]
            run[3] = run[3] if r["total"] is None else r["total"]
            if r["kind"] in ("finish", "error"):
                run[4] = "finished" if r["kind"] == "finish" else "failed"
            if r["line"] is not None:
                lines.append(r["line"])
                if r["kind"] != "finish":  # a closing line may be one more
                    del lines[: -self.keep]
        if not met:
            return
        if lines:
            self.lines.put([(x,) for x in lines])
        elif had:
            self.lines.clear()
        if run[4] != "running":
            timer = self._move_timer(timer, run[1].timestamp() * 1000 + self.expiry_s * 1000, timerValues.getCurrentWatermarkInMs())
        elif timer is not None:
            self.handle.deleteTimer(timer)
            timer = None
        self.run.update((*run, timer))
        yield Row(
            task=key[0], started=run[0], updated=run[1], done=run[2], total=run[3],
            lines=len(lines), last_line=lines[-1] if lines else None, status=run[4],
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        run = self.run.get()
        if run is not None and run[4] in ("finished", "failed"):
            timer = timerValues.getCurrentWatermarkInMs() + self.mark_s * 1000
            self.run.update((run[0], run[1], None, None, "expired", timer))
            self.lines.clear()
            self.handle.registerTimer(timer)
        elif run is not None and run[4] == "expired":
            self.run.clear()
        return iter(())


class Transfers(_Timed):
    """T2. The newest attempt of a file: what it began with, what it moved, its total and final size."""

    def __init__(self, expiry_s: int) -> None:
        self.expiry_s = expiry_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "attempt long, base long, moved long, total long, size long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        attempt, base, moved, total, size, timer = self.at.get() or (-1, 0, 0, None, None, None)
        last = 0.0
        for r in _in_order(rows, "seq"):
            last = max(last, r["ts"].timestamp())
            if size is not None or r["attempt"] < attempt:
                continue
            if r["attempt"] > attempt:
                attempt, base, moved, total = r["attempt"], 0, 0, None
            base = max(base, r["start"] or 0)
            total = total if r["total"] is None else max(r["total"], total or 0)
            if r["kind"] == "advance":
                moved += r["amount"] or 0
            elif r["kind"] == "finish":
                size = r["amount"]
        timer = self._move_timer(timer, (last + self.expiry_s) * 1000, timerValues.getCurrentWatermarkInMs())
        self.at.update((attempt, base, moved, total, size, timer))
        phase = "finalizing" if size is not None else "downloading" if moved > 0 else "preparing"
        count, top = (base + moved, total) if size is None else (size, size)
        yield Row(job=key[0], file=key[1], count=count, total=top, phase=phase)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.at.clear()
        return iter(())


class Throttle(_Timed):
    """T3. The time last published, in seconds; a key that is idle longer than the gap needs none."""

    def __init__(self, key: str, at: str, forced: str, gap: float) -> None:
        self.key, self.at, self.forced, self.gap = key, at, forced, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at double, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, timer = self.last.get() or (None, None)
        for r in _in_order(rows, self.at):
            s = r[self.at].timestamp()
            if r[self.forced] or last is None or s - last >= self.gap:
                last = s
                yield Row(**{self.key: key[0], self.at: r[self.at]})
        if last is not None:
            timer = self._move_timer(timer, (last + self.gap) * 1000, timerValues.getCurrentWatermarkInMs())
            self.last.update((last, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())


class Admission(_Timed):
    """T4. The admitted batches of the last span; a client idle that long is forgotten."""

    def __init__(self, client: str, limit: int, span: float, most: int) -> None:
        self.client, self.limit, self.span, self.most = client, limit, span, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.admitted = handle.getListState("held", "at double, n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [tuple(x) for x in self.admitted.get()]
        for r in _in_order(rows, "ts", "batch"):
            good = False
            if r["events"] is not None:
                now = r["ts"].timestamp()
                held = [(t, n) for t, n in held if now - t < self.span]
                good = r["events"] <= self.most and sum(n for _, n in held) + r["events"] <= self.limit
                if good:
                    held.append((now, r["events"]))
            yield Row(**{self.client: key[0], "batch": r["batch"], "admitted": good})
        if held:
            self.admitted.put(held)
            self._set_timer((held[-1][0] + self.span) * 1000, timerValues.getCurrentWatermarkInMs())
        else:
            self.admitted.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.admitted.clear()
        return iter(())
