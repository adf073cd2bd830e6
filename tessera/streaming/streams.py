"""Structured Streaming: resumable sinks, tag parsers with state, event reconciliation, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.io import append_unseen


def resumable(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Writes each new key once, across restarts: every batch is met with what the sink holds."""
    return stream.writeStream.foreachBatch(lambda df, _: append_unseen(df, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unique_events(stream: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """At-least-once events, each once."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed(df: DataFrame, at: str, group: str, value: str, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and group, batch or stream."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return df.groupBy(w.alias("w"), group).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), group, "n", "total")


def sessions(df: DataFrame, at: str, user: str, gap: str = "30 minutes") -> DataFrame:
    s = df.groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(user, F.col("w.start").alias("start"), "n")


def latest_blocks(events: DataFrame) -> DataFrame:
    """Blocks that a store/remove/clear log leaves: of each block the last event wins, unless a clear came after it."""
    cleared = F.max(F.when(F.col("event_type") == "clear", F.col("seq")))
    last_clear = events.agg(F.coalesce(cleared, F.lit(-1)).alias("cleared"))
    last = events.where("event_type <> 'clear'").groupBy("block").agg(F.max_by("event_type", "seq").alias("event_type"), F.max("seq").alias("seq"))
    return last.crossJoin(F.broadcast(last_clear)).where("event_type = 'store' AND seq > cleared").select("block", "seq")


class TagParser:
    """Splits a growing text into reasoning and answer at an end tag that may arrive in pieces."""

    def __init__(self, start: str = "<think>", end: str = "</think>", buffer: str = "", inside: bool = True):
        self.start, self.end, self.buffer, self.inside = start, end, buffer, inside

    def feed(self, chunk: str) -> tuple[str, str]:
        """(reasoning, answer) that this chunk settles."""
        self.buffer += chunk
        if not self.inside:
            out, self.buffer = self.buffer, ""
            return "", out
        self.buffer = self.buffer.replace(self.start, "", 1)
        if self.end in self.buffer:
            reasoning, answer = self.buffer.split(self.end, 1)
            self.inside, self.buffer = False, ""
            return reasoning, answer.lstrip("\n")
        # what could still become a tag waits
        most = min(len(self.buffer), max(len(self.start), len(self.end)) - 1)
        keep = max((n for n in range(1, most + 1) if self.end.startswith(self.buffer[-n:]) or self.start.startswith(self.buffer[-n:])), default=0)
        out = self.buffer[: len(self.buffer) - keep]
        self.buffer = self.buffer[len(self.buffer) - keep :]
        return out, ""


def parse_tags(stream: DataFrame, id: str = "stream_id", order: str = "seq", chunk: str = "chunk") -> DataFrame:
    """(id, reasoning, answer) for each batch of chunks, the parser's state kept for each stream."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, inside = state.get if state.exists else ("", True)
        parser, reasoning, answer = TagParser(buffer=buffer, inside=inside), "", ""
        for c in pd.concat(list(parts)).sort_values(order)[chunk]:
            r, a = parser.feed(c)
            reasoning += r
            answer += a
        state.update((parser.buffer, parser.inside))
        yield pd.DataFrame({id: [key[0]], "reasoning": [reasoning], "answer": [answer]})

    return stream.groupBy(id).applyInPandasWithState(step, f"{id} long, reasoning string, answer string", "buffer string, inside boolean", "append", GroupStateTimeout.NoTimeout)
