"""Session state as a stream (STM1-STM6, SNK8): the fold of ``operators.state`` with ``transformWithStateInPandas``.

A session is a key, a field a map entry. Writes of one trigger are folded in order of seq; a write whose seq is not above the
field's last is late and goes, so replays change nothing. A confirmed field takes no write (D19).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillframe.functions import values as V

OUTPUT = "session_id string, field_id string, seq long, value string, confidence double, status string"


def step(old: tuple | None, seq: int | None, value: object, confidence: float | None, confirm_from: float = 1.0) -> tuple | None:
    """The state (seq, value, confidence, status) after one write; None if the write changes nothing."""
    if seq is None or pd.isna(seq) or value is None or str(value).strip(" \t\n\r　") == "":
        return None
    if old is not None and (old[3] == "confirmed" or seq <= old[0]):
        return None
    c = V.USER_CONFIDENCE if confidence is None or pd.isna(confidence) else float(confidence)
    return int(seq), str(value), c, "confirmed" if c >= confirm_from else "filled"


class SessionProcessor(StatefulProcessor):
    def __init__(self, confirm_from: float = 1.0, idle_ms: int | None = None):
        self.confirm_from, self.idle_ms = confirm_from, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getMapState("fields", "field_id string", "seq long, value string, confidence double, status string", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        out = []
        for field_id, group in frame.sort_values("seq", kind="stable").groupby("field_id", sort=True):
            old = self.fields.getValue((field_id,)) if self.fields.containsKey((field_id,)) else None
            now = tuple(old) if old is not None else None
            for seq, value, confidence in zip(group["seq"], group["value"], group["confidence"]):
                now = step(now, seq, value, confidence, self.confirm_from) or now
            if now is not None and now != (tuple(old) if old is not None else None):
                self.fields.updateValue((field_id,), now)
                out.append((key[0], field_id, *now))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "field_id", "seq", "value", "confidence", "status"])

    def close(self) -> None:
        pass


def sessions(writes: DataFrame, confirm_from: float = 1.0, idle_ms: int | None = None) -> DataFrame:
    """A streaming (session_id, seq, field_id, value, confidence) to the changed fields of each trigger, in update mode.

    Needs the RocksDB state store. idle_ms lets state of idle fields expire.
    """
    return writes.groupBy("session_id").transformWithStateInPandas(SessionProcessor(confirm_from, idle_ms), OUTPUT, "Update", "none" if idle_ms is None else "processingTime")


def reference_fold(writes: list[tuple], confirm_from: float = 1.0) -> dict[tuple, tuple]:
    """The fold in plain Python over (session_id, seq, field_id, value, confidence): what the stream and the batch are tested against."""
    out: dict[tuple, tuple] = {}
    for session, seq, field, value, confidence in sorted(writes, key=lambda w: (w[0], w[2], w[1] is None, w[1] or 0)):
        now = step(out.get((session, field)), seq, value, confidence, confirm_from)
        if now is not None:
            out[session, field] = now
    return out
