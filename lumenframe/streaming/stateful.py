"""Stateful stream processors: token buckets and state machines a key, with processing-time timeouts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def token_bucket(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """(user_id, event_id, allowed) of a stream (user_id, event_id, at in seconds): the state of a user is (tokens, last)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        for frame in frames:
            rows = frame.sort_values(["at", "event_id"])
            allowed = []
            for at in rows["at"]:
                tokens = min(burst, tokens + max(0.0, at - last) * rate) if last is not None else tokens
                last = at
                allowed.append(bool(tokens >= 1))
                tokens -= tokens >= 1
            yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "allowed": allowed})
        state.update((float(tokens), last))

    return requests.groupBy("user_id").applyInPandasWithState(
        run, "user_id long, event_id long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout
    )


def state_machine(events: DataFrame, transitions: Mapping[tuple[str, str], str], start: str, terminal: set[str]) -> DataFrame:
    """(user_id, state, n): the state of each user after a batch, over a stream (user_id, event_id, at, event_type); n counts the user's events so far.

    Files come in any order, and a batch may come in several frames, so an event can arrive after later
    ones: the state of a user holds all of its events, and each batch folds them in the order of at and event_id.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = [(at, i, kind) for frame in frames for at, i, kind in zip(frame["at"].tolist(), frame["event_id"].tolist(), frame["event_type"].tolist(), strict=True)]
        rows = sorted([*zip(*state.get, strict=True), *rows] if state.exists else rows, key=lambda r: (r[0] != r[0], r[0], r[1]))
        now = start
        for _, _, event in rows:
            if now in terminal:
                break
            now = transitions.get((now, event), now)
        state.update(tuple(list(x) for x in zip(*rows, strict=True)))
        yield pd.DataFrame({"user_id": [key[0]], "state": [now], "n": [len(rows)]})

    return events.groupBy("user_id").applyInPandasWithState(
        run, "user_id long, state string, n long", "at array<double>, event_id array<long>, event_type array<string>", "append", GroupStateTimeout.NoTimeout
    )
