"""An extension for live traces: a, then b with neither a nor a forbidden label in between, over a stream of events.

Events of one graph must arrive in order of time within what a trigger reads; each batch is sorted by (at, id). The state of a graph is
the last a that still waits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "graph_id long, begin long, end long"


def follow(waiting: int | None, events: Sequence[tuple[int, str]], first: str, last: str, forbidden: Sequence[str]) -> tuple[int | None, list[tuple[int, int]]]:
    """The a that waits after the events, and the pairs found."""
    found = []
    for node, label in events:
        if label == first:
            waiting = node
        elif label == last:
            if waiting is not None:
                found.append((waiting, node))
            waiting = None
        elif label in forbidden:
            waiting = None
    return waiting, found


def sequences(events: DataFrame, first: str, last: str, forbidden: Sequence[str] = ()) -> DataFrame:
    """events: a stream of graph_id, node_id, label, at (any type that orders). graph_id, begin and end of each match, once it is complete."""

    def run(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        rows = pd.concat(list(frames)).sort_values(["at", "node_id"])
        waiting = state.get[0] if state.exists else None
        waiting, found = follow(waiting, list(zip(rows["node_id"].tolist(), rows["label"].tolist())), first, last, forbidden)
        if waiting is None:
            state.remove() if state.exists else None
        else:
            state.update((waiting,))
        yield pd.DataFrame({"graph_id": [key[0]] * len(found), "begin": [a for a, _ in found], "end": [b for _, b in found]})

    lean = events.select("graph_id", "node_id", "label", "at")
    return lean.groupBy("graph_id").applyInPandasWithState(run, OUTPUT, "waiting long", "append", GroupStateTimeout.NoTimeout)
