"""Running a state machine over sessions, in batch and as a stream, with the same results."""

from __future__ import annotations

import functools
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from passagekit.runtime import ship_code
from passagekit.streaming.transitions import Newest


def _clean(row: dict) -> dict:
    return {k: (None if isinstance(v, float) and v != v else v) for k, v in row.items()}


def fold(df: DataFrame, make, key: str, order: list[str], schema: str) -> DataFrame:
    """Each session's rows in order through make()'s machine; rows come out with the columns of `schema`.

    Rows are partitioned by session and sorted, then streamed through one machine at a time: a task holds one
    bounded state, never a session's rows, so a session of any length needs no more memory."""
    ship_code(df.sparkSession)
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        machine, session, state, seen = make(), None, None, False
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                row = _clean(row)
                if not seen or row[key] != session:
                    if seen and hasattr(machine, "end"):
                        out += [{key: session, **r} for r in machine.end(state)]
                    session, state, seen = row[key], machine.start(), True
                state, rows = machine.step(state, row)
                out += rows
            yield pd.DataFrame(out, columns=names) if out else pd.DataFrame({n: [] for n in names})
        if seen and hasattr(machine, "end"):
            yield pd.DataFrame([{key: session, **r} for r in machine.end(state)], columns=names)

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def stream(df: DataFrame, make, key: str, order: list[str], schema: str, idle_ms: int | None = None) -> DataFrame:
    """The same machine over a streaming DataFrame: its state, as JSON, is Spark's, so it survives restarts.

    Rows of one trigger are put in order before they are folded; with idle_ms (and a watermark on df) a session
    that is silent for so long is flushed and forgotten."""
    ship_code(df.sparkSession)
    names = [c.strip().split()[0] for c in schema.split(",")]

    def step(k, batches, state: GroupState):
        machine = make()
        now = json.loads(state.get[0]) if state.exists else machine.start()
        if state.hasTimedOut:
            rows = machine.end(now) if hasattr(machine, "end") else []
            state.remove()
            yield pd.DataFrame([{key: k[0], **r} for r in rows], columns=names)
            return
        out = []
        for row in pd.concat(list(batches)).sort_values(order).to_dict("records"):
            now, rows = machine.step(now, _clean(row))
            out += rows
        state.update((json.dumps(now),))
        if idle_ms:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + idle_ms)
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.EventTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(step, schema, "state string", "append", timeout)


def latest_per_key(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Latest-wins: the row with the highest sequence number of each key, without gathering a key."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*others), seq).alias("_r")).select(*key, "_r.*")


def drop_stale(df: DataFrame, key: str, seq: str, order: list[str], schema: str, slack: int = 0) -> DataFrame:
    """Without the rows that arrive, in `order`, more than `slack` behind the newest sequence number of their key, which is state in a
    stream; rows of one trigger are put in order."""
    return (stream if df.isStreaming else fold)(df, functools.partial(Newest, seq, slack), key, order, schema)
