"""Keyed state over a stream: the lines of each table's last kitchen ticket, changed by signed quantities as they come."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "device_id string, table_code string, document_id string, item_key string, before decimal(19,4), after decimal(19,4)"
STATE = "items array<struct<item_key:string,quantity:decimal(19,4)>>"


def table_lines(lines: DataFrame, pause: int = 7200, late: str = "7200 seconds") -> DataFrame:
    """Every change of a table's lines: ``(device_id, table_code, document_id, item_key, before, after)``.

    ``lines(device_id, table_code, document_id, type, time, item_key, quantity)`` as a stream. A kitchen ticket replaces the
    state, a change ticket adds to it; a line that comes to zero or less goes, a negative change of an unknown line is
    passed over. The state of a table without papers for ``pause`` seconds of event time is dropped.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = {k: q for k, q in state.get[0]} if state.exists else {}
        rows = pd.concat(list(parts)).sort_values(["time", "document_id"], kind="stable")
        out = []
        for doc, paper in rows.groupby("document_id", sort=False):
            fresh = paper["type"].iloc[0] == "KITCHEN_ORDER"
            now = {} if fresh else dict(held)
            for k, q in zip(paper["item_key"], paper["quantity"], strict=True):
                total = now.get(k, Decimal(0)) + q
                if total > 0:
                    now[k] = total
                else:
                    now.pop(k, None)
            out += [(*key, doc, k, held.get(k), now.get(k)) for k in sorted(held | now) if held.get(k) != now.get(k)]
            held = now
        state.update((sorted(held.items()),))
        state.setTimeoutTimestamp(max(int(rows["time"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + pause * 1000)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.replace("(19,4)", "").split(", ")])

    timed = lines.withColumn("quantity", F.col("quantity").cast("decimal(19,4)")).withWatermark("time", late)
    return timed.groupBy("device_id", "table_code").applyInPandasWithState(step, OUT, STATE, "append", "EventTimeTimeout")
