"""Server-sent events: frames from rows, and rows from the text of a stream."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP_ALIVE = ": keep-alive\n\n"


def frame(event: Column, data: Column) -> Column:
    """The text of one frame; ``data`` is JSON without line breaks."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def replay(events: DataFrame, key: str) -> DataFrame:
    """(key, stream): the whole stream of each finished sequence (key, seq, event, data), as it was sent."""
    rows = events.select(key, F.struct("seq", frame(F.col("event"), F.col("data")).alias("f")).alias("x"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["f"]), "").alias("stream"))


def keep_alives(events: DataFrame, key: str, at: str, seconds: int = 15) -> DataFrame:
    """(key, seq, n): how many keep-alive frames go before each event, one for every ``seconds`` of silence."""
    silence = F.col(at).cast("double") - F.lag(F.col(at).cast("double")).over(Window.partitionBy(key).orderBy("seq"))
    return events.select(key, "seq", F.greatest(F.lit(0), F.ceil(F.coalesce(silence, F.lit(0.0)) / seconds) - 1).cast("long").alias("n"))


def read_frames(lines: Iterable[str]) -> Iterator[tuple[str, object]]:
    """(event, data) of a stream's lines: comments are skipped, data lines of a frame belong together, a frame without data is none."""
    event, data = "message", []
    for line in [*lines, ""] if isinstance(lines, (list, tuple)) else _closed(lines):
        if line.startswith(":"):
            continue
        if line == "":
            if data:
                yield event, json.loads("\n".join(data))
            event, data = "message", []
        elif line.startswith("event:"):
            event = line[6:].strip()
        elif line.startswith("data:"):
            data.append(line[5:].lstrip())


def _closed(lines: Iterable[str]) -> Iterator[str]:
    yield from lines
    yield ""
