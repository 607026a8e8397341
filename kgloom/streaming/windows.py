"""Validity windows from a stream of page versions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_FACT = "head string, rel string, tail string, rStart string, rEnd string, tStart long, tEnd long"
_OPEN = "head array<string>, rel array<string>, tail array<string>, rStart array<string>, tStart array<long>, last long"


def closed_windows(versions: DataFrame) -> DataFrame:
    """The facts that each new version of a page closes, in append mode.

    ``versions``: (pid, rid, ts, ok, triples array<struct<head,rel,tail>>), in
    order of time per page from one micro-batch to the next; within a batch
    they are sorted. The state of a page is its open triples, so it grows with
    the page and not with its history. A version older than what the page has
    seen is ignored, since its windows have been given out; failed versions
    (not ok) are skipped.
    """

    def step(key, batches, state: GroupState):
        if state.exists:
            h, r, t, rs, ts, last = state.get
            held = {(a, b, c): (d, e) for a, b, c, d, e in zip(h, r, t, rs, ts)}
        else:
            held, last = {}, None
        rows = pd.concat(list(batches)).sort_values(["ts", "rid"], kind="stable")
        out = []
        for rid, ts, ok, triples in zip(rows["rid"], rows["ts"], rows["ok"], rows["triples"]):
            if not ok or (last is not None and ts < last):
                continue
            now = {(x["head"], x["rel"], x["tail"]) for x in (triples if triples is not None else [])}
            for x in [x for x in held if x not in now]:
                start, at = held.pop(x)
                out.append((*x, start, str(rid), at, int(ts)))
            for x in now:
                held.setdefault(x, (str(rid), int(ts)))
            last = int(ts)
        names = list(held)
        state.update(([x[0] for x in names], [x[1] for x in names], [x[2] for x in names], [held[x][0] for x in names], [held[x][1] for x in names], last))
        yield pd.DataFrame(out, columns=["head", "rel", "tail", "rStart", "rEnd", "tStart", "tEnd"])

    return versions.groupBy("pid").applyInPandasWithState(step, _FACT, _OPEN, "append", GroupStateTimeout.NoTimeout)


def change_counts(facts: DataFrame, time: str = "event_time", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, rel, changes) per tumbling window of event time; rows later than the watermark are dropped."""
    from pyspark.sql import functions as F

    counts = facts.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "rel").agg(F.count("*").alias("changes"))
    return counts.select(F.col("w.start").alias("start"), "rel", "changes")
