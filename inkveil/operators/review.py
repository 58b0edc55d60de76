"""The reviewer's manual list, kept as a log of what they did."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

ACTIONS = ("add", "undo", "remove", "clear")


def review_log(events: DataFrame, keys: Sequence[str] = ("doc_id",), order: Sequence[str] = ("seq",)) -> DataFrame:
    """The manual list that a log of events leaves: keys, n (from 1), the order columns of the add, text.

    ``add`` appends a text that is neither blank nor in the list, ``undo`` takes back the last add that is still in the
    list, ``remove`` takes out a text, ``clear`` all of them; other actions, and undoing or removing what is not there,
    do nothing. Events of one document are applied in ``order``, which has to tell them apart.

    Whether an event has an effect depends on all before it, so a document's log is one stream. Logs are sorted by
    shuffles and read batch by batch; a task keeps the live list of one document and never a log.
    """
    keys, order = list(keys), list(order)
    rows = events.select(*keys, *order, "action", "text").repartition(*keys).sortWithinPartitions(*keys, *order)
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*keys, *order)]
    schema = ", ".join([*kinds[: len(keys)], "n bigint", *kinds[len(keys) :], "text string"])
    return rows.mapInArrow(_replayed(len(keys), [*keys, "n", *order, "text"]), schema)


def _replayed(n_keys: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, live, kinds = None, {}, None

        def listed() -> list[tuple]:
            return [(*document, n + 1, *place, text) for n, (text, place) in enumerate(live.items())]

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

        for batch in batches:
            own = [f.type for f in batch.schema]
            kinds = [*own[:n_keys], pa.int64(), *own[n_keys:-2], pa.string()]
            done: list[tuple] = []
            for *row, action, text in zip(*(c.to_pylist() for c in batch.columns)):
                if tuple(row[:n_keys]) != document:
                    done += listed() if live else []
                    document, live = tuple(row[:n_keys]), {}
                if action == "add" and text and text.strip():
                    live.setdefault(text, row[n_keys:])
                elif action == "undo" and live:
                    live.popitem()  # the newest: a text that was taken out and added again stands last
                elif action == "remove":
                    live.pop(text, None)
                elif action == "clear":
                    live = {}
            if done:
                yield batch_of(done)
        if live:
            yield batch_of(listed())

    return run
