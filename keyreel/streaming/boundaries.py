"""Debounced scene boundaries of a stream, with a fixed threshold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_boundaries(frames: DataFrame, threshold: float, debounce_ms: int = 650) -> DataFrame:
    """source_id, index, time_ms of accepted boundaries of a stream of source_id, index, time_ms,
    difference. A source's frames must come in order between micro-batches; within one they are
    sorted. The state of a source is the time of its last boundary, at first of its first frame."""

    def run(key, batches, state: GroupState):
        rows = pd.concat(list(batches)).sort_values("index")
        last = state.get[0] if state.exists else None
        out = []
        for i, t, d in zip(rows["index"], rows["time_ms"], rows["difference"]):
            if last is None:
                last = int(t)
            elif d >= threshold and t - last >= debounce_ms:
                last = int(t)
                out.append((key[0], int(i), int(t)))
        state.update((last,))
        yield pd.DataFrame(out, columns=["source_id", "index", "time_ms"])

    return frames.groupBy("source_id").applyInPandasWithState(run, "source_id string, index int, time_ms bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)
