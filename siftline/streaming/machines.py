"""State machines over keyed events, each with a batch form and a Structured Streaming form.

A machine is a class whose ``state`` is a tuple of plain values and whose ``step(row)`` returns one output tuple.
The batch form sorts each key's events by time and arrival; the streaming form keeps the state between
micro-batches and sorts inside of each.  A machine that ignores late events ignores them in both forms.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from siftline.streaming.chains import passes


class RateLimiter:
    """ST1: accepts an event if fewer than ``per_minute`` and ``per_day`` were accepted in the 60 s and 86 400 s before.

    An accepted event counts until just before its age reaches the limit; rejected events do not count.
    """

    STATE = "accepted array<double>"
    OUT = "accepted boolean, in_minute long, in_day long"

    def __init__(self, per_minute: int, per_day: int, state: tuple | None = None):
        self.limits = (per_minute, per_day)
        self.day = deque(state[0] if state else ())

    def step(self, now: float) -> tuple:
        while self.day and now - self.day[0] >= 86_400:
            self.day.popleft()
        recent = 0
        for t in reversed(self.day):
            if now - t >= 60:
                break
            recent += 1
        ok = recent < self.limits[0] and len(self.day) < self.limits[1]
        if ok:
            self.day.append(now)
        return ok, recent + ok, len(self.day)

    @property
    def state(self) -> tuple:
        return (list(self.day),)


class PlaceChange:
    """ST2: says when a traveller has arrived in another place.

    Each event is judged as the first line of ``VERDICTS`` that holds for it, and what a verdict does to the state is
    a row of ``EFFECTS``.  A place that is not the present one is under trial from its first event in a row on; the
    trial ends with an event ``confirm_ms`` or more after the first one, and the traveller has moved.  The move is told
    (``entered``) unless the place is an old one, not the destination (a blank one is none) or comes within
    ``cooldown_ms`` of the last move told.
    """

    STATE = "place string, candidate string, since bigint, seen int, visited array<string>, told bigint, newest bigint"
    OUT = "status string, entered boolean, place string"

    #: A verdict and the facts that must hold for it.
    VERDICTS = (
        ("late", {"behind"}),
        ("first", {"nowhere"}),
        ("same", {"here"}),
        ("candidate", {"untried"}),
        ("candidate", {"early"}),
        ("revisited", {"old"}),
        ("passing", {"elsewhere"}),
        ("cooling", {"soon"}),
        ("entered", set()),
    )
    #: What verdicts do: keep the clock, drop the trial, put the place on trial, move there, note the time of telling.
    EFFECTS = {"late": (), "same": ("clock", "drop"), "candidate": ("clock", "try"), "entered": ("clock", "drop", "move", "tell")}
    MOVED = ("clock", "drop", "move")

    def __init__(self, confirm_ms: int = 60_000, cooldown_ms: int = 600_000, destination: str | None = None, state: tuple | None = None):
        self.confirm, self.cooldown, self.goal = confirm_ms, cooldown_ms, (destination or "").strip()
        self.held = dict(zip((x.split()[0] for x in self.STATE.split(", ")), state or (None, None, None, 0, [], None, None)))

    def facts(self, place: str, ms: int) -> set[str]:
        h, trial = self.held, self.held["candidate"] == place and self.held["seen"] > 0
        shown = {
            "behind": h["newest"] is not None and ms < h["newest"],
            "nowhere": h["place"] is None,
            "here": place == h["place"],
            "untried": not trial,
            "early": trial and ms - h["since"] < self.confirm,
            "old": place in h["visited"],
            "elsewhere": self.goal and place != self.goal,
            "soon": h["told"] is not None and ms - h["told"] < self.cooldown,
        }
        return {name for name, holds in shown.items() if holds}

    def step(self, place: str, ms: int) -> tuple:
        ms, h = int(ms), self.held
        facts = self.facts(place, ms)
        verdict = next(name for name, needed in self.VERDICTS if needed <= facts)
        changes = {
            "clock": {"newest": ms},
            "drop": {"candidate": None, "seen": 0},
            "try": {"candidate": place, "since": ms, "seen": 1} if "untried" in facts else {"seen": h["seen"] + 1},
            "move": {"place": place, "visited": sorted({*h["visited"], place})},
            "tell": {"told": ms},
        }
        for effect in self.EFFECTS.get(verdict, self.MOVED):
            h |= changes[effect]
        return verdict, verdict == "entered", h["place"]

    @property
    def state(self) -> tuple:
        return tuple(self.held.values())


class Throttle:
    """ST3: passes an event if the last one passed is at least ``gap`` seconds older."""

    STATE = "last double"
    OUT = "passed boolean"

    def __init__(self, gap: float = 120, state: tuple | None = None):
        self.gap, self.last = gap, state[0] if state else None

    def step(self, now: float) -> tuple:
        ok = self.last is None or now - self.last >= self.gap
        if ok:
            self.last = now
        return (ok,)

    @property
    def state(self) -> tuple:
        return (self.last,)


def _run(machine, frame: pd.DataFrame, columns: list[str], order: list[str]) -> pd.DataFrame:
    frame = frame.sort_values(order, kind="stable").reset_index(drop=True)
    names = [x.split()[0] for x in machine.OUT.split(", ")]
    rows = [machine.step(*values) for values in zip(*(frame[c] for c in columns))]
    return pd.concat([frame, pd.DataFrame(rows, columns=names)], axis=1)


def _schema(df: DataFrame, machine) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", " + machine.OUT


def replay(df: DataFrame, key: str, make, columns: list[str], order: list[str]) -> DataFrame:
    """The batch form: every event of ``df`` with the machine's output; one key's events are one group.

    ``make(state=None)`` builds the machine, ``columns`` are what a step takes, ``order`` the time and then what
    tells equal times apart.
    """
    out = _schema(df, make())
    names = [x.split()[0] for x in make().OUT.split(", ")]

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        return _run(make(), frame, columns, order)[[*frame.columns, *names]]

    return df.groupBy(key).applyInPandas(group, out)


def stream(df: DataFrame, key: str, make, columns: list[str], order: list[str], idle_ms: int | None = None) -> DataFrame:
    """The streaming form: appends every event with the machine's output; the state lives in the state store.

    With ``idle_ms`` a key that has had no event for so long (by the clock) is forgotten; else its state stays.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    out, names = _schema(df, make()), [x.split()[0] for x in make().OUT.split(", ")]

    def group(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        machine = make(state=state.get if state.exists else None)
        frame = pd.concat(list(frames))
        result = _run(machine, frame, columns, order)[[*frame.columns, *names]]
        state.update(machine.state)
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield result

    waits = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(group, out, make().STATE, "append", waits)


def rate_limited(df: DataFrame, *, key: str = "key", ts: str = "ts_seconds", seq: str | None = None, per_minute: int, per_day: int, streaming: bool = False, idle_ms: int | None = None) -> DataFrame:
    """ST1 over ``df``."""

    def make(state=None):
        return RateLimiter(per_minute, per_day, state)

    return stream(df, key, make, [ts], [ts] + ([seq] if seq else []), idle_ms) if streaming else replay(df, key, make, [ts], [ts] + ([seq] if seq else []))


def place_changes(df: DataFrame, *, key: str = "session", place: str = "city_code", ts: str = "ts_ms", order: list[str] | None = None, confirm_ms: int = 60_000, cooldown_ms: int = 600_000, destination: str | None = None, streaming: bool = False, idle_ms: int | None = None) -> DataFrame:
    """ST2 over ``df``; ``order`` is the order of arrival (by time if not given, so that nothing is late)."""

    def make(state=None):
        return PlaceChange(confirm_ms, cooldown_ms, destination, state)

    return stream(df, key, make, [place, ts], order or [ts], idle_ms) if streaming else replay(df, key, make, [place, ts], order or [ts])


def throttled(df: DataFrame, *, key: str = "key", ts: str = "ts_seconds", seq: str | None = None, gap: float = 120, streaming: bool = False, idle_ms: int | None = None) -> DataFrame:
    """ST3 over ``df``; the batch form spreads a key over many tasks (:func:`chains.passes`)."""

    def make(state=None):
        return Throttle(gap, state)

    if streaming:
        return stream(df, key, make, [ts], [ts] + ([seq] if seq else []), idle_ms)
    return passes(df, key=key, ts=ts, order=[seq] if seq else [], gap=gap)
