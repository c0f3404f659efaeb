"""Ordered folds over unbounded input: each key's rows are folded in the order of event time, whatever order they come in."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator
from decimal import Decimal
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
EPOCH, MICROSECOND = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc), dt.timedelta(microseconds=1)
CHUNK = 1000  # rows of a key in one value of its state, and in one row that comes out
Step = Callable[[dict, dict], list[tuple]]


def chunks(lines: list[str]) -> list[tuple[str]]:
    """Lines in strings of up to CHUNK of them: state and rows cost a round trip and a conversion each."""
    return [("\n".join(lines[i : i + CHUNK]),) for i in range(0, len(lines), CHUNK)]


class OrderedFold(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then folds them by (time, tie) and gives out what the step
    makes of each, as lines of JSON arrays. Rows that come when the watermark is past them are dropped by Spark (late
    rows). A key without a row for idle_days is forgotten; its next row starts afresh."""

    def __init__(self, step: Step, start: dict, names: list[str], idle_days: int) -> None:
        self.step, self.start, self.names, self.idle = step, json.dumps(start), names, idle_days * DAY_MS
        self.time = len(names) - 1  # rows are keys, time, row; names are keys and what is made

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")  # each up to CHUNK rows, a line each
        self.state = handle.getValueState("state", "state string, last long")

    def wake(self, at_us: int) -> None:
        self.handle.registerTimer(at_us // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, new = None, []
        for r in rows:
            first = r[self.time] if first is None else min(first, r[self.time])
            new.append(r[self.time + 1])
        self.waiting.appendList(chunks(new))
        self.wake((first - EPOCH) // MICROSECOND)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        due, rest, soonest = [], [], None
        for (text,) in self.waiting.get():
            lines = text.split("\n")
            for line, row in zip(lines, json.loads(f"[{','.join(lines)}]")):
                if row["_at"] // 1000 < now:
                    due.append((row["_at"], row.pop("_tie"), line, row))
                else:
                    rest.append(line)
                    soonest = row["_at"] if soonest is None else min(soonest, row["_at"])
        due.sort(key=itemgetter(0, 1, 2))
        text, last = self.state.get() or (self.start, None)
        if not due:
            if last is not None and not rest and now - last // 1000 > self.idle:
                self.state.clear()
            return iter(())
        state, out = json.loads(text), []
        for at, _, _, row in due:
            if last is not None and (at - last) // 1000 > self.idle:
                state = json.loads(self.start)
            out += self.step(state, row)
            last = at
        self.state.update((json.dumps(state), last))
        if rest:
            self.waiting.put(chunks(rest))
            self.wake(soonest)
        else:
            self.waiting.clear()
        self.handle.registerTimer(last // 1000 + self.idle + 1)
        return iter([Row(**dict(zip(self.names, (*key, x)))) for (x,) in chunks([json.dumps(made) for made in out])])

    def close(self) -> None:
        pass


def ordered_fold(events: DataFrame, keys: list[str], at: str, tie: str, columns: list[str], step: Step, start: dict, made: str, late: str, idle_days: int) -> DataFrame:
    """What `step` makes of each key's rows of a stream, in order of (at, tie): step(state, row) changes the state (a dict that
    JSON can hold) and returns rows of `made`. A null time, or a null key, is no row. Needs the RocksDB state store."""
    if not events.isStreaming:
        raise ValueError("ordered_fold takes a stream; the batch folds are in operators")
    timed = events.withColumn("_time", F.col(at).cast("timestamp")).where(F.col("_time").isNotNull()).where(" and ".join(f"{k} is not null" for k in keys))
    row = F.to_json(F.struct(F.unix_micros("_time").alias("_at"), F.col(tie).cast("long").alias("_tie"), *columns), {"ignoreNullFields": "false"})
    rows = timed.withWatermark("_time", late).select(*keys, "_time", row.alias("_row"))
    kinds = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    folded = rows.groupBy(*keys).transformWithState(OrderedFold(step, start, [*keys, "_made"], idle_days), f"{kinds}, _made string", "append", "eventtime")
    lines = folded.select(*keys, F.explode(F.split("_made", "\n")).alias("_made"))
    names = [x.strip().split(" ") for x in made.split(",")]
    values = F.from_json("_made", "array<string>")
    return lines.select(*keys, values.alias("_made")).select(*keys, *[F.get("_made", F.lit(i)).cast(kind).alias(name) for i, (name, kind) in enumerate(names)])


def series_links(events: DataFrame, keys: list[str], max_days: int = 800, late: str = "1 day") -> DataFrame:
    """The event chains of operators.analytics.series_links over a stream (available_at, event_id, identity, closes). A key
    without an event for max_days is forgotten with its identities, so that a known identity doesn't hold for ever:
    that is where stream and batch differ."""

    def step(state: dict, row: dict) -> list[tuple]:
        at, event, identity = row["_at"], row["event_id"], row.get("identity")
        root, ambiguous = state["known"].get(identity) if identity is not None else None, False
        if root is None and identity is None:
            state["open"] = [x for x in state["open"] if at - x[1] <= max_days * DAY_MS * 1000]
            ambiguous = len(state["open"]) > 1
            root = state["open"][0][0] if len(state["open"]) == 1 else None
        root = event if root is None else root
        state["open"] = [x for x in state["open"] if x[0] != root]
        if not row.get("closes"):
            state["open"].append([root, at])
        if identity is not None:
            state["known"][identity] = root
        return [(event, root, ambiguous)]

    return ordered_fold(events, keys, "available_at", "event_id", ["event_id", "identity", "closes"], step, {"open": [], "known": {}}, "event_id long, root_event_id long, ambiguous boolean", late, max_days)


def running_balance(deltas: DataFrame, keys: list[str], late: str = "1 day", idle_days: int = 36_500) -> DataFrame:
    """The balances of operators.analytics.running_balance over a stream (ts, event_id, amount): null from the first unknown amount
    on, and whether none was below zero so far."""

    def step(state: dict, row: dict) -> list[tuple]:
        amount = row.get("amount")
        if amount is None:
            state["known"] = False
        if state["known"]:
            total = Decimal(state["total"]) + Decimal(amount)
            state["total"], state["good"] = str(total), state["good"] and total >= 0
        return [(row["event_id"], float(Decimal(state["total"])) if state["known"] else None, state["good"])]

    exact = deltas.withColumn("amount", F.col("amount").cast("string"))
    return ordered_fold(exact, keys, "ts", "event_id", ["event_id", "amount"], step, {"total": "0", "known": True, "good": True}, "event_id long, balance double, integrity boolean", late, idle_days)


def ended_tenures(deltas: DataFrame, single: tuple[str, ...] = ("chair",), late: str = "1 day", idle_days: int = 36_500) -> DataFrame:
    """The tenures of operators.extraction.role_tenures over a stream (company, person, role, action, at, event_id), each when it ends, with
    the time of its start and end in microseconds. Open ones are state, not output."""

    def step(state: dict, row: dict) -> list[tuple]:
        held, person, role, at = state["held"], row["person"], row.get("role"), row["_at"]
        ended = lambda x: (x[0], x[1], x[2], x[3], at, x[4])
        out = []
        if row["action"] in ("appoint", "acting"):
            out = [ended(x) for x in held if x[:2] == [person, role]]
            held[:] = [x for x in held if x[:2] != [person, role]]
            status = "acting" if row["action"] == "acting" else "held"
            if role in single and any(x[1] == role for x in held):
                status = "overlap"
                for x in held:
                    x[4] = "overlap" if x[1] == role else x[4]
            held.append([person, role, row["event_id"], at, status])
            return out
        mine = [x for x in held if x[0] == person and role in (None, x[1])]
        if len(mine) == 1:
            held.remove(mine[0])
            return [ended(mine[0])]
        for x in mine:
            x[4] = "ambiguous"
        return []

    made = "person long, role string, start_event long, start_us long, end_us long, status string"
    return ordered_fold(deltas, ["company"], "at", "event_id", ["person", "role", "action", "event_id"], step, {"held": []}, made, late, idle_days)
