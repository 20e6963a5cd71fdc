"""Streams of execution events: windowed counts and per-run occurrence numbers, both by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "run_id string, definition_id string, id string, seq long, ts timestamp"
NUMBERED = "run_id string, definition_id string, id string, seq long, occurrence_index long, previous string"
_STATE = "names array<string>, numbers array<long>, last string, latest long, held array<struct<at:long,seq:long,definition_id:string,id:string>>"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as JSON lines that arrive in a folder."""
    return spark.readStream.schema(EVENT).json(folder)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(start, definition_id, n) of tumbling windows; events later than ``late`` are dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "definition_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "definition_id", "n")


def _numbering(silence: int):
    """Numbers the held rows that the watermark has passed; forgets a run after ``silence`` milliseconds."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts, last, latest, held = {}, None, 0, []
        if state.exists:
            names, numbers, last, latest, kept = state.get
            counts, held = dict(zip(names, numbers, strict=True)), [tuple(x) for x in kept]
        passed = state.getCurrentWatermarkMs()
        for pdf in [] if state.hasTimedOut else batches:
            at = pdf["ts"].astype("datetime64[ms]").astype("int64")
            # events under the watermark come too late: their place is numbered already
            held += [x for x in zip(at.tolist(), pdf["seq"].tolist(), pdf["definition_id"], pdf["id"], strict=True) if x[0] >= passed]
        held.sort(key=lambda x: (x[0], x[1], x[3]))
        ready = sum(x[0] < passed for x in held)
        rows = []
        for at, seq, definition, name in held[:ready]:
            n = counts.get(definition, 0)
            rows.append((key[0], definition, name, seq, n, last))
            counts[definition], last, latest = n + 1, name, at
        held = held[ready:]
        if not held and passed > latest + silence:
            if state.exists:
                state.remove()
        else:
            state.update((list(counts), list(counts.values()), last, latest, held))
            state.setTimeoutTimestamp(max(passed + 1, held[0][0] if held else latest + silence))
        yield pd.DataFrame(rows, columns=["run_id", "definition_id", "id", "seq", "occurrence_index", "previous"])

    return run


def numbered(events: DataFrame, late: str = "10 minutes", silence_ms: int = 86_400_000) -> DataFrame:
    """Occurrence index of each definition of a run and the run's previous event, by (ts, seq, id).

    The order of arrival does not matter: rows are held until the watermark (``late``
    behind the latest event) passes them; events that come later still are dropped.  State
    a run: its held rows, one counter a definition and the last id, until the run has been
    silent for ``silence_ms`` of event time.
    """
    marked = events.where("ts is not null").withWatermark("ts", late)
    return marked.groupBy("run_id").applyInPandasWithState(_numbering(silence_ms), NUMBERED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
