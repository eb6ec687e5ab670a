"""Request routing: what to do with each message of a chat, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from affinis.functions import constants as C
from affinis.operators.ordered import ordered_parts, previous_value

IDLE, BY_CHANNEL, BY_DESCRIPTION = 0, 1, 2
BUCKETS = 1 << 12  # of chats, in the state of a stream
REQUEST = "chat_id bigint, request_id bigint, ts timestamp, text string"
ROUTED = "chat_id bigint, request_id bigint, state int, action string"


def _is(text: Column, menu: str) -> Column:
    # a menu text may end in one line break
    return (text == menu) | (text == menu + "\n")


def next_state(text: Column) -> Column:
    """The state a menu text sets; null when a message leaves the state as it is."""
    return (
        F.when(_is(text, C.BY_CHANNEL), BY_CHANNEL)
        .when(_is(text, C.BY_DESCRIPTION), BY_DESCRIPTION)
        .when(_is(text, C.RANDOM) | _is(text, C.HELP), IDLE)
    )


def action(text: Column, state: Column) -> Column:
    """First matching rule; ``state`` is the one before this message."""
    return (
        F.when(text.rlike(r"^/(start|help)(@\S+)?(\s|$)"), "help")
        .when(_is(text, C.BY_CHANNEL), "ask_channel")
        .when(_is(text, C.BY_DESCRIPTION), "ask_description")
        .when(_is(text, C.RANDOM), "random")
        .when(_is(text, C.HELP), "help")
        .when(state == BY_CHANNEL, "channel_lookup")
        .when(state == BY_DESCRIPTION, "description_lookup")
        .otherwise("not_understood")
    )


# actions that a text has whatever the state is, by the code that travels instead of the text
FIXED = ("help", "ask_channel", "ask_description", "random")


def _code(text: Column) -> Column:
    """0, or the place of the action in ``FIXED`` from 1."""
    free = action(text, F.lit(None).cast("int"))
    return F.coalesce(*(F.when(free == name, i + 1) for i, name in enumerate(FIXED)), F.lit(0))


def _named(code: Column, state: Column) -> Column:
    fixed = F.when(code > 0, F.element_at(F.array(*map(F.lit, FIXED)), F.greatest(code, F.lit(1))))
    return F.coalesce(fixed, action(F.lit(""), state))


def route(requests: DataFrame) -> DataFrame:
    """``(chat_id, request_id, state, action)`` for ``requests(chat_id, request_id, ts, text)``.

    The state before a message is the last one a menu text has set, so it needs no loop; a chat
    of any length is spread over partitions. Only ids, times and codes are written and shuffled.
    """
    order = ["ts", "request_id"]
    coded = requests.select(
        "chat_id", *order, _code(F.col("text")).alias("code"), next_state(F.col("text")).alias("next_state")
    )
    parts = ordered_parts(coded, ["chat_id"], order)
    seen = previous_value(parts, ["chat_id"], order, F.col("next_state"), "state")
    state = F.coalesce("state", F.lit(IDLE))
    return seen.select("chat_id", "request_id", state.alias("state"), _named(F.col("code"), state).alias("action"))


# the chats of a bucket: the one without an id, the id, the state, and until when it is known
KNOWN = np.dtype([("nobody", "?"), ("chat", "<i8"), ("state", "<i4"), ("until", "<i8")])
FOREVER = np.iinfo(np.int64).max


def _carry(
    key: tuple, batches: Iterator[pd.DataFrame], held: GroupState, idle_ms: int | None = None
) -> Iterator[pd.DataFrame]:
    known = np.frombuffer(held.get[0], KNOWN) if held.exists else np.empty(0, KNOWN)
    now = 0 if idle_ms is None else held.getCurrentWatermarkMs()
    if held.hasTimedOut:
        _hold(held, known[known["until"] >= now], now)
        return
    # only ids, times and codes: the rows of the chats of one bucket in one trigger
    rows = pd.concat(list(batches)).sort_values(["nobody", "chat_id", "ts", "unasked", "request_id"])
    nobody, chat = rows["nobody"].to_numpy(bool), rows["chat_id"].to_numpy(np.int64)
    first = np.append(True, (nobody[1:] != nobody[:-1]) | (chat[1:] != chat[:-1]))
    starts, group = np.flatnonzero(first), np.cumsum(first) - 1
    chats = list(zip(nobody[starts].tolist(), chat[starts].tolist()))
    before = {(x["nobody"].item(), x["chat"].item()): x["state"].item() for x in known}
    start = np.array([before.get(x, IDLE) for x in chats])
    # the last state that a row of the chat has set, the row itself included
    given = rows["next_state"].to_numpy(float)
    last = np.maximum.accumulate(np.where(np.isnan(given), -1, np.arange(len(rows))))
    after = np.where(last >= starts[group], given[last], start[group]).astype(np.int32)
    state = np.where(first, start[group], np.append(IDLE, after[:-1])).astype(np.int32)
    ends = np.append(starts[1:], len(rows)) - 1
    new = np.empty(len(chats), KNOWN)
    new["nobody"], new["chat"], new["state"], new["until"] = nobody[starts], chat[starts], after[ends], FOREVER
    if idle_ms is not None:
        at = rows["ts"].to_numpy("datetime64[ms]")[ends]
        new["until"] = np.where(np.isnat(at), now, at.astype(np.int64)) + idle_ms
    seen = set(chats)
    rest = [(x["nobody"].item(), x["chat"].item()) not in seen for x in known]
    _hold(held, np.concatenate([known[np.array(rest, bool) & (known["until"] >= now)], new]), now)
    yield pd.DataFrame(
        {
            "chat_id": chat,
            "nobody": nobody,
            "request_id": rows["request_id"].to_numpy(),
            "unasked": rows["unasked"].to_numpy(),
            "state": state,
            "code": rows["code"].to_numpy(),
        }
    )


def _hold(held: GroupState, known: np.ndarray, now: int) -> None:
    """Keep the chats, to be asked again when the first of them may be forgotten."""
    if not len(known):
        held.remove()
        return
    held.update((known.tobytes(),))
    until = int(known["until"].min())
    if until < FOREVER:
        held.setTimeoutTimestamp(max(until, now + 1))


def route_stream(
    requests: DataFrame, watermark: str | None = None, idle: timedelta = timedelta(days=30), buckets: int = BUCKETS
) -> DataFrame:
    """The streaming form of ``route``; the state of each chat survives between triggers.

    Bound a trigger with the source's ``maxFilesPerTrigger`` or an equal limit. With ``watermark``,
    requests later than that delay are dropped, and a chat is forgotten once the watermark is ``idle``
    beyond its last request; its next one starts from the idle state. Texts do not enter the state
    operator: the JVM turns each into two small codes. Chats are kept in ``buckets``, as a call for each chat of a
    trigger would cost more than its rows; a bucket takes 21 bytes a chat, and their number cannot change while a checkpoint is in use.
    """
    if watermark is not None:
        requests = requests.withWatermark("ts", watermark)
    rows = requests.select(
        F.pmod(F.xxhash64("chat_id"), F.lit(buckets)).alias("bucket"),
        F.coalesce("chat_id", F.lit(0)).cast("bigint").alias("chat_id"), F.col("chat_id").isNull().alias("nobody"),
        F.coalesce("request_id", F.lit(0)).cast("bigint").alias("request_id"), F.col("request_id").isNull().alias("unasked"),
        "ts", _code(F.col("text")).alias("code"), next_state(F.col("text")).alias("next_state"),
    )
    routed = rows.groupBy("bucket").applyInPandasWithState(
        _carry if watermark is None else partial(_carry, idle_ms=int(idle.total_seconds() * 1000)),
        outputStructType="chat_id bigint, nobody boolean, request_id bigint, unasked boolean, state int, code int",
        stateStructType="known binary",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout if watermark is None else GroupStateTimeout.EventTimeTimeout,
    )
    return routed.select(
        F.when(~F.col("nobody"), F.col("chat_id")).alias("chat_id"), F.when(~F.col("unasked"), F.col("request_id")).alias("request_id"),
        "state", _named(F.col("code"), F.col("state")).alias("action")
    )
