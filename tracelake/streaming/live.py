"""The live detectors over a stream of steps, with what each session must remember as keyed state.

A session's state is of bounded size whatever its length: the last calls, outputs and targets, as many as the widest window
looks back (calls and targets as digests), and counters for what has no window (error streaks, trailing read-only calls, blanks,
equal feedback). So batches of any size give the hits of one batch over all steps. Where the steps have an event time, a session
is forgotten once the watermark is `keep_ms` past its last step: it would begin anew. Time of day plays no part, so a
replay gives the same hits.

Steps of a session come in the order of seq. A step that is not after the last one seen (a repeat) is ignored. Null values are
what they are in the batch form: a null count is no sample, a null output counts nothing, null `mutating` is no
mutation, null `blank` ends no run of blanks.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tracelake.operators import detectors

_STATE = "seq bigint, steps bigint, calls array<string>, mutated array<boolean>, outputs array<bigint>, targets array<string>, idle bigint, blanks bigint, feedback string, repeats bigint, errors bigint, streak bigint"
#: How long a session may be silent before it is forgotten.
KEEP_MS = 7 * 24 * 3600 * 1000
#: How far behind the newest step of any session a step may come; later ones are dropped.
DELAY = "1 day"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Session:
    """What a session must remember, and the rules over it. The order of the rules is that of the batch form."""

    def __init__(self, limits: dict[str, int], terminate_on_novelty: bool, state: tuple | None = None):
        self.x, self.terminate = limits, terminate_on_novelty
        s = list(state or (None, 0, [], [], [], [], 0, 0, None, 0, None, 0))
        self.seq, self.steps, self.calls, self.mutated, self.outputs, self.targets, self.idle, self.blanks, self.feedback, self.repeats, self.errors, self.streak = [list(v) if isinstance(v, (list, tuple)) else v for v in s]

    def state(self) -> tuple:
        return (self.seq, self.steps, self.calls, self.mutated, self.outputs, self.targets, self.idle, self.blanks, self.feedback, self.repeats, self.errors, self.streak)

    def step(self, seq: int, call: str, target: str | None, mutating: bool | None, output: int | None, errors: int | None, blank: bool | None, feedback: str | None) -> str | None:
        """Takes a step in and names the first detector that fires at it."""
        x = self.x
        self.seq, self.steps = seq, self.steps + 1
        for held, v, most in ((self.calls, call, max(x["identical"], x["window"])), (self.mutated, bool(mutating), max(x["identical"], x["window"])), (self.outputs, output, x["flood_window"]), (self.targets, target, x["novelty_window"])):
            held.append(v)
            del held[: max(0, len(held) - most)]
        self.idle = 0 if mutating else self.idle + 1
        self.blanks = 0 if blank is False else self.blanks + 1
        self.repeats = self.repeats + 1 if self.steps > 1 and feedback == self.feedback else 1
        self.feedback = feedback
        if errors is not None:
            fell = self.errors is not None and errors < self.errors
            self.streak = 0 if errors == 0 else 1 if fell else self.streak + 1
            self.errors = errors
        return self._fires(output, errors, feedback)

    def _fires(self, output: int | None, errors: int | None, feedback: str | None) -> str | None:
        x, full = self.x, lambda k: self.steps >= k
        distinct = lambda held, k: len({v for v in held[-k:] if v is not None})
        if full(x["identical"]) and distinct(self.calls, x["identical"]) == 1 and any(self.mutated[-x["identical"] :]):
            return "identical"
        if errors is not None and self.streak >= x["persistence"]:
            return "persistence"
        if output is not None and output > x["output"]:
            return "runaway"
        if x["window"] and full(x["window"]) and any(self.mutated[-x["window"] :]) and 2 <= distinct(self.calls, x["window"]) <= x["most"]:
            return "oscillation"
        if x["flood_window"] and full(x["flood_window"]) and sum(o or 0 for o in self.outputs[-x["flood_window"] :]) > x["flood_limit"]:
            return "flood"
        if self.terminate and x["novelty_window"] and full(x["novelty_window"]) and self.idle >= x["novelty_window"] and distinct(self.targets, x["novelty_window"]) <= x["novelty_floor"]:
            return "novelty"
        if x["stall"] and self.idle >= x["stall"]:
            return "stall"
        if self.blanks >= x["empty"]:
            return "empty"
        return "feedback" if feedback is not None and self.repeats >= x["feedback"] else None


_FLAGS = {"true": True, "false": False, "": None}


def _packed(*columns) -> Column:
    """A step in one string: a row's way into Python costs by its columns. None of the values has a comma; null is empty."""
    return F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def _unpacked(step: str) -> tuple:
    """seq, at and what Session.step() takes after seq."""
    seq, at, call, target, mutating, output, errors, blank, feedback = step.split(",")
    number = lambda v: int(v) if v else None
    return number(seq), number(at), call or None, target or None, _FLAGS[mutating], number(output), number(errors), _FLAGS[blank], feedback or None


class _Processor(StatefulProcessor):
    def __init__(self, limits: dict[str, int], terminate_on_novelty: bool, keep_ms: int, timed: bool):
        self.limits, self.terminate, self.keep_ms, self.timed = limits, terminate_on_novelty, keep_ms, timed

    def init(self, handle) -> None:
        self.handle, self.held = handle, handle.getValueState("session", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        session, newest = Session(self.limits, self.terminate, self.held.get()), None
        for seq, at, *values in sorted((_unpacked(r["step"]) for r in rows), key=lambda s: s[0]):
            if session.seq is not None and seq <= session.seq:
                continue
            if self.timed and at is not None:
                newest = max(at, newest or at)
            hit = session.step(seq, *values)
            if hit is not None:
                yield Row(session=key[0], seq=seq, detector=hit)
        self.held.update(session.state())
        if newest is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(newest + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter([])


def detected(steps: DataFrame, *, terminate_on_novelty: bool = False, time: str | None = None, keep_ms: int = KEEP_MS, delay: str = DELAY, **limits: int) -> DataFrame:
    """session, seq, detector of every step of a stream at which a live detector fires; limits as in detectors.DEFAULTS. time
    names the column of the event time (a timestamp), by which silent sessions are forgotten; without one none is. The query
    that runs it needs the state store of state_store()."""
    x = detectors.DEFAULTS | limits
    if unknown := limits.keys() - detectors.DEFAULTS.keys():
        raise ValueError(f"no such limit: {sorted(unknown)}")
    digest = lambda c: F.md5(c.cast("binary"))
    if time is not None:
        steps = steps.withWatermark(time, delay)
    own = [] if time is None else [F.col(time).alias("time")]
    whole, flag = (lambda c: F.col(c).cast("bigint")), (lambda c: F.col(c).cast("boolean"))
    at = F.lit(None) if time is None else F.unix_millis(time)
    step = _packed(whole("seq"), at, digest(detectors.call_key()), digest(detectors.read_target()), flag("mutating"), whole("output_bytes"), whole("errors"), flag("blank"), digest(F.col("feedback")))
    narrow = steps.select(*own, "session", step.alias("step"))
    kind = steps.schema["session"].dataType.simpleString()
    return narrow.groupBy("session").transformWithState(_Processor(x, terminate_on_novelty, keep_ms, time is not None), f"session {kind}, seq bigint, detector string", "append", "none" if time is None else "eventTime")


@contextlib.contextmanager
def state_store(spark):
    """Queries started inside keep keyed state in the store that it needs; what the session had is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(name, None)
    spark.conf.set(name, _PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if had is None else spark.conf.set(name, had)


def live_detectors(steps: DataFrame, checkpoint: str, out: str, **limits):
    """Starts a query that appends (session, seq, detector) of the stream's hits to the table at out, each once, across restarts
    from the checkpoint."""
    with state_store(steps.sparkSession):
        return detected(steps, **limits).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
