"""Movies whose frames arrive in any order: each is given on once, when all of its frames are there.

What is kept of a movie are its frames' numbers and paths, not their pixels, in Spark's state: it survives restarts by the query's checkpoint, and
frames that come twice count once. A movie that waits too long is given on as it is, marked as incomplete, and frames that come
after it was given on change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "movie string, frames int, complete boolean, missing array<int>, paths array<string>"
STATE = "t array<int>, paths array<string>, frames int, done boolean"


def assemble(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, patience: int) -> Iterator[pd.DataFrame]:
    """The state of one movie with what came of it, and its row if it is to be given on now."""
    held, frames, done = ({}, 0, False)
    if state.exists:
        t, paths, frames, done = state.get
        held = dict(zip(t, paths, strict=True))
    if not state.hasTimedOut:
        for rows in batches:
            frames = max(frames, int(rows["frames"].max()))
            for t, path in zip(rows["t"].tolist(), rows["path"].tolist(), strict=True):
                held[t] = min(path, held.get(t, path))
    missing = [t for t in range(frames) if t not in held]
    if done:
        return
    if missing and not state.hasTimedOut:
        order = sorted(held)
        state.update((order, [held[t] for t in order], frames, False))
        if patience:
            state.setTimeoutDuration(patience)
        return
    state.update(([], [], frames, True))  # what remains of a movie that was given on
    row = {"movie": key[0], "frames": frames, "complete": not missing, "missing": missing, "paths": [held[t] for t in range(frames) if t in held]}
    yield pd.DataFrame([row])


def complete_movies(stream: DataFrame, patience: int = 0) -> DataFrame:
    """(movie, frames, complete, missing, paths) of a stream of frames (movie, t from 0, frames, path): a row for each movie, when its `frames` frames are there.

    With `patience`, in milliseconds, movies of which nothing came for so long are given on without what is missing. Paths are
    in order of t; of a frame that came several times the first by name.
    """
    kept = stream.selectExpr("CAST(movie AS string) AS movie", "CAST(t AS int) AS t", "CAST(frames AS int) AS frames", "CAST(path AS string) AS path").where("movie IS NOT NULL AND t >= 0 AND t < frames AND path IS NOT NULL")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if patience else GroupStateTimeout.NoTimeout
    return kept.groupBy("movie").applyInPandasWithState(lambda key, batches, state: assemble(key, batches, state, patience), OUT, STATE, "append", timeout)
