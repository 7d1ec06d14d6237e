"""Folding streams of answer fragments with state by fragment.

A stream's text is handed on as its fragments come in order: each output row
has the text from one fragment number up to the first gap, so nothing that was
handed on is kept or folded again. State holds the next number that is due, the
fragments that wait for one before them, and those that carry pieces of tool
calls, each under its own key: a trigger writes what is new. A stream ends with
its last fragment; then, or when none has come for patience_ms, its calls are
handed on and its state goes, that of an ended one but for a mark that lets
repeated fragments pass unheeded until patience_ms are over.

The state store must be RocksDB (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .folds import PATIENCE_MS, fold_event

#: The number of an ended stream.
_ENDED = -1


class _Fold(StatefulProcessor):
    def __init__(self, stream: str, seq: str, first: int, patience_ms: int | None):
        self.stream, self.seq, self.first, self.patience_ms = stream, seq, first, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "seq long")
        self.waiting = handle.getMapState("waiting", "seq long", "payload string")
        self.calls = handle.getMapState("calls", "seq long", "payload string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        due = self.due.get()[0] if self.due.exists() else self.first
        if due == _ENDED:
            for _ in rows:
                pass
            return
        new: dict[int, str] = {}
        for frame in rows:
            for n, payload in zip(frame[self.seq].tolist(), frame["payload"].tolist(), strict=True):
                if n >= due:
                    new.setdefault(int(n), payload)
        begin, text, ended = due, [], False
        while not ended:
            if due in new:
                payload = new.pop(due)
            elif self.waiting.containsKey((due,)):
                payload = self.waiting.getValue((due,))[0]
                self.waiting.removeKey((due,))
            else:
                break
            added, ended = self._event(due, payload)
            text.append(added)
            due += 1
        if ended:
            yield self._row(key, begin, "".join(text), True)
            self._clear()
            self.due.update((_ENDED,))
        else:
            for n, payload in new.items():
                if not self.waiting.containsKey((n,)):
                    self.waiting.updateValue((n,), (payload,))
            self.due.update((due,))
            if "".join(text):
                yield self._row(key, begin, "".join(text), False)
        self._wait(timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """What waits behind a gap is handed on without what is missing, and the stream's state goes."""
        due = self.due.get()[0] if self.due.exists() else self.first
        if due != _ENDED:
            text = "".join(self._event(n, p)[0] for n, p in sorted((k[0], v[0]) for k, v in self.waiting.iterator()))
            yield self._row(key, due, text, True)
        self._clear()
        self.due.clear()

    def close(self) -> None:
        pass

    def _event(self, n: int, payload: str) -> tuple[str, bool]:
        """The text that a fragment adds, and whether it is the last; one with pieces of calls is kept."""
        calls: dict[str, dict] = {}
        added, ended = fold_event(payload, calls, False)
        if calls:
            self.calls.updateValue((n,), (payload,))
        return added, ended

    def _row(self, key: Any, begin: int, text: str, last: bool) -> pd.DataFrame:
        calls: dict[str, dict] = {}
        if last:
            for _, payload in sorted((k[0], v[0]) for k, v in self.calls.iterator()):
                fold_event(payload, calls, False)
        return pd.DataFrame({self.stream: [key[0]], "from_seq": [begin], "text": [text], "calls": [json.dumps(calls) if last else None], "is_done": [last]})

    def _clear(self) -> None:
        self.waiting.clear()
        self.calls.clear()

    def _wait(self, timerValues: Any) -> None:
        if self.patience_ms is None:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)


def fold_fragments(fragments: DataFrame, stream: str = "stream_id", seq: str = "seq", first: int = 0, patience_ms: int | None = PATIENCE_MS) -> DataFrame:
    """(stream, from_seq, text, calls, is_done) of unbounded streams of fragments in either dialect.

    Texts of a stream joined in order of from_seq are its text; calls is JSON by
    index, once, in the row that is_done. Fragments are numbered from `first`;
    one that comes twice, or after its place was handed on, counts once. A query
    that is to end with its input takes None for patience_ms, and keeps its state.
    """
    kind = fragments.schema[stream].dataType.simpleString()
    rows = fragments.select(stream, seq, "payload").groupBy(stream)
    schema = f"{stream} {kind}, from_seq long, text string, calls string, is_done boolean"
    return rows.transformWithStateInPandas(_Fold(stream, seq, first, patience_ms), schema, "Update", "None" if patience_ms is None else "ProcessingTime")
