"""Press-and-release coordination of recordings (G1): a state machine by key, for ordered batches and for streams.

Inputs are edges (kind press or release), cancel, finished and denied events
with a time in milliseconds. A session is idle, recording or processing. A
release is deferred for a grace time, in which a press of the same binding takes
it back; a hold that is long enough then stops the recording, a shorter one
locks it until the next press. While processing, one press can be remembered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxloom.operators.segments import SIZE, packed, settled
from voxloom.session import on_workers

# Fixed values, in milliseconds.
DEBOUNCE_MS, GRACE_MS, HOLD_MS = 30, 50, 300
IDLE, RECORDING, PROCESSING = "idle", "recording", "processing"
EVENTS = "key string, seq long, t_ms long, kind string, binding string, mode string, hold_ms long, external boolean"
EFFECTS = "key string, t_ms long, effect string, binding string"


@dataclass
class Press:
    """A key that is down, or a session that outlives it (locked)."""

    binding: str
    since: int
    locked: bool


@dataclass
class Release:
    binding: str
    at: int
    needed: int


class Coordinator:
    def __init__(self, state: str | None = None) -> None:
        s = json.loads(state) if state else {}
        self.stage: str = s.get("stage", IDLE)
        self.press: Press | None = Press(**s["press"]) if s.get("press") else None  # of the recording, or remembered while processing
        self.release: Release | None = Release(**s["release"]) if s.get("release") else None
        self.last: int | None = s.get("last")
        self.active: str | None = s.get("active")  # the binding that records
        self.effects: list[tuple[int, str, str]] = []

    def dumped(self) -> str:
        return json.dumps({"stage": self.stage, "press": self.press and asdict(self.press), "release": self.release and asdict(self.release), "last": self.last, "active": self.active})

    @property
    def deadline(self) -> int | None:
        return self.release.at + GRACE_MS if self.release else None

    def advance(self, now: int) -> None:
        """Lets time pass: a deferred release whose grace is over takes effect."""
        if self.release is None or now < self.deadline:
            return
        done, self.release = self.release, None
        if self.stage == RECORDING and self.active == done.binding:
            self._let_go(done, self.press, done.at + GRACE_MS)
        elif self.stage == PROCESSING and self.press and self.press.binding == done.binding:
            if done.at - self.press.since < done.needed:
                self.press.locked = True
            else:
                self.press = None

    def _let_go(self, done: Release, press: Press | None, now: int) -> None:
        if press is not None and done.at - press.since < done.needed:
            press.locked = True
        else:
            self._stop(done.binding, now)

    def _start(self, press: Press, now: int) -> None:
        self.stage, self.active, self.press = RECORDING, press.binding, press
        self.effects.append((now, "start", press.binding))

    def _stop(self, binding: str, now: int) -> None:
        self.stage, self.active, self.press = PROCESSING, None, None
        self.effects.append((now, "stop", binding))

    def feed(self, now: int, kind: str, binding: str = "", mode: str = "hold_or_toggle", hold_ms: int = HOLD_MS, external: bool = False) -> None:
        self.advance(now)
        if kind == "cancel":
            self.release = None
            if self.stage == RECORDING:
                self.stage, self.active = IDLE, None
            self.press = None
        elif kind == "finished":
            waiting = self.press if self.stage == PROCESSING else None
            self.stage, self.active, self.press = IDLE, None, None
            if waiting:
                self._start(waiting, now)
        elif kind == "denied":
            if self.stage == RECORDING and self.active == binding:
                self.stage, self.active, self.press = IDLE, None, None
        elif kind in ("press", "release"):
            self._edge(now, kind == "press", binding, mode, hold_ms if mode == "hold_or_toggle" else 0, external)

    def _edge(self, now: int, down: bool, binding: str, mode: str, needed: int, external: bool) -> None:
        holds = mode != "toggle" and not (self.press and self.press.locked)
        held = self.active if self.stage == RECORDING else self.press.binding if self.press else None
        if holds and down and self.release and self.release.binding == binding:
            self.release = None
            return
        if holds and not down and held == binding and self.release is None:
            self.release = Release(binding, now, needed)
            return
        if down and not external:
            if self.last is not None and now - self.last < DEBOUNCE_MS:
                return
            self.last = now
        if self.stage == PROCESSING:
            if not down or self.press and self.press.binding != binding:
                return
            if self.press is None:
                self.press = Press(binding, now, mode == "toggle")
            elif mode == "toggle" or self.press.locked:
                self.press = None
        elif self.stage == IDLE:
            if down:
                self._start(Press(binding, now, mode == "toggle"), now)
        elif self.active == binding:
            if down and (mode == "toggle" or self.press is not None and self.press.locked):
                self._stop(binding, now)
            elif not down and holds:
                self._let_go(Release(binding, now, needed), self.press, now)


class _Event(NamedTuple):
    t_ms: int
    kind: str
    binding: str | None
    mode: str | None
    hold_ms: int | None
    external: bool | None


def _feed(machine: Coordinator, r) -> None:
    value = lambda x, other: other if x is None or x != x else x
    machine.feed(int(r.t_ms), r.kind, value(r.binding, ""), value(r.mode, "hold_or_toggle"), int(value(r.hold_ms, HOLD_MS)), bool(value(r.external, False)))


def _effects(key: str, machine: Coordinator) -> list[tuple]:
    """The effects since the last call."""
    made, machine.effects = [(key, *e) for e in machine.effects], []
    return made


def coordinated(events: DataFrame, until_ms: int | None = None, size: int = SIZE) -> DataFrame:
    """The effects (start, stop) of each key's events; time runs on to until_ms, or until all grace is over.

    A key's events are run by segments, wherever they lie; see settled.
    """
    columns = ["key", "t_ms", "effect", "binding"]
    fields = _Event._fields

    def fed(entry: str, row) -> Coordinator:
        machine = Coordinator(entry or None)
        for values in zip(*(getattr(row, c) for c in fields), strict=True):
            _feed(machine, _Event(*values))
        return machine

    def after(entry: str, row) -> str:
        return fed(entry, row).dumped()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                machine = fed(row.entry, row)
                if row.final:
                    machine.advance(until_ms if until_ms is not None else 1 << 62)
                out += _effects(row.key, machine)
            yield pd.DataFrame(out, columns=columns)

    on_workers(events.sparkSession)
    segments = packed(edges_of(events).withColumnRenamed("seq", "place"), "key", ["t_ms", "place"], size)
    entries = settled(segments, "key", after, "")
    last = Window.partitionBy("key").orderBy(F.desc("part"), F.desc("seq"))
    entries = entries.withColumn("final", F.row_number().over(last) == 1)
    return segments.join(entries, ["key", "part", "seq"]).mapInPandas(run, EFFECTS)


def coordinated_stream(events: DataFrame) -> DataFrame:
    """The same for a stream: a key's state is kept between batches, and a deferred release ends by a timer of processing time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Coordinator(state.get[0] if state.exists else None)
        if state.hasTimedOut:
            if machine.deadline is not None:
                machine.advance(machine.deadline)
        else:
            for rows in batches:
                for r in rows.sort_values(["t_ms", "seq"], kind="stable").itertuples(index=False):
                    _feed(machine, r)
        state.update((machine.dumped(),))
        if machine.deadline is not None:
            state.setTimeoutDuration(GRACE_MS)
        yield pd.DataFrame([(key[0], *e) for e in machine.effects], columns=["key", "t_ms", "effect", "binding"])

    return events.groupBy("key").applyInPandasWithState(run, EFFECTS, "machine string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def edges_of(events: DataFrame) -> DataFrame:
    """EVENTS from rows with some of its columns."""
    missing = {c.split()[0]: c.split()[1] for c in EVENTS.split(", ")}
    return events.select(*[(F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c) for c, t in missing.items()])
