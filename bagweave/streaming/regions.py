"""A stream of scored regions with a memory per protein: regions expire by age and the weakest leave when the budget is full."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "protein long, epoch long, held long, best double"


def memory(stream: DataFrame, expire: int = 5, budget: int = 64) -> DataFrame:
    """For each micro-batch and protein of (protein, epoch, score): the latest epoch, regions held and their best score.

    State is bounded: at most ``budget`` regions of a protein, none older than ``expire`` epochs.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epochs, scores = (list(x) for x in state.get) if state.exists else ([], [])
        for f in frames:
            epochs += f["epoch"].tolist()
            scores += f["score"].tolist()
        now = max(epochs)
        kept = sorted(((s, e) for s, e in zip(scores, epochs, strict=True) if now - e <= expire), reverse=True)[:budget]
        state.update(([e for _, e in kept], [s for s, _ in kept]))
        yield pd.DataFrame({"protein": [key[0]], "epoch": [now], "held": [len(kept)], "best": [kept[0][0]]})

    return stream.groupBy("protein").applyInPandasWithState(update, OUT, "epochs array<long>, scores array<double>", "update", GroupStateTimeout.NoTimeout)
