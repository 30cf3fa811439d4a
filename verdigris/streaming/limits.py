"""Token buckets per key: in batches, and as a stateful stream operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def spend(times: list[float], tokens: float, last: float | None, rate: float) -> tuple[list[bool], float, float | None]:
    """Whether each request in time order finds a token; buckets hold ``rate`` and refill by it a minute."""
    out = []
    for t in times:
        if last is not None:
            tokens = min(rate, tokens + (t - last) * rate / 60)
        last = t
        out.append(tokens >= 1)
        if tokens >= 1:
            tokens -= 1
    return out, tokens, last


def allowed(requests: DataFrame, rate: float) -> DataFrame:
    """(key, id, allowed) from (key, id, seconds); a key's requests are gone through in time order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seconds", "id"])
        ok, _, _ = spend(rows["seconds"].tolist(), rate, None, rate)
        return pd.DataFrame({"key": rows["key"], "id": rows["id"], "allowed": ok})

    return requests.groupBy("key").applyInPandas(run, "key long, id long, allowed boolean")


def allowed_stream(requests: DataFrame, rate: float, idle_ms: int = 900_000) -> DataFrame:
    """The same over a stream; a key's state goes when it is idle."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (rate, None)
        rows = pd.concat(list(frames)).sort_values(["seconds", "id"])
        ok, tokens, last = spend(rows["seconds"].tolist(), tokens, last, rate)
        state.update((tokens, last))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"key": [key[0]] * len(ok), "id": rows["id"].tolist(), "allowed": ok})

    return requests.groupBy("key").applyInPandasWithState(step, "key long, id long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)
