"""Sentences from streams of tokens, with keyed state that outlives micro-batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_CLOSES = "A-Za-zА-Яа-яЄІЇєіїҐґ'\")\\]"
#: No token without any of these ends a sentence.
_SIGN = re.compile(r"[\n.!?]")
_STOP = re.compile(rf"\n|(?:\.\.\.|(?<=[{_CLOSES}])[?!.])(?=\s|\Z)")


def feed(held: str, token: str | None) -> tuple[list[str], str]:
    """Sentences complete once token is added to what is held, and what stays. An end of the text held so far counts as an
    end of the sentence, so the result depends on where tokens end. What was held has no end in it, so only its last two
    characters are looked at again."""
    at = max(0, len(held) - 2)
    held += token or ""
    out = []
    while m := _STOP.search(held, at):
        out.append(held[: m.end()])
        held, at = held[m.end() :], 0
    return out, held


def flush(held: str) -> list[str]:
    return [held] if held else []


SENTENCES = "stream_id string, seq int, part int, type string, sentence string"


class SentenceProcessor(StatefulProcessor):
    """One stream a key. Rows: stream_id, seq, type, token, is_end. What a row's event gives out carries its seq.

    Rows of type delta are buffered; is_end, or a type of stops, flushes; other types pass through after that.
    """

    def __init__(self, stops: tuple[str, ...] = ("content_block_stop", "message_stop"), idle_ms: int | None = None):
        self.stops, self.idle_ms = stops, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "held string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        state = self.held.get() if self.held.exists() else None
        held, out = (state[0] if state else "") or "", []
        for seq, kind, token, end in zip(pdf["seq"], pdf["type"], pdf["token"], pdf["is_end"], strict=True):
            given: list[tuple[str, str | None]] = []
            if kind == "delta" and isinstance(token, str):
                done, held = feed(held, token)
                given += [("delta", s) for s in done]
            if end or kind in self.stops:
                given += [("delta", s) for s in flush(held)]
                held = ""
            if kind != "delta":
                given.append((kind, None))
            out += [(key[0], int(seq), i, k, s) for i, (k, s) in enumerate(given)]
        self.held.update((held,))
        if self.idle_ms and held:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "seq", "part", "type", "sentence"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A stream idle for long gives out what is held, at seq -1."""
        if self.held.exists() and (held := self.held.get()[0]):
            self.held.update(("",))
            yield pd.DataFrame([(key[0], -1, 0, "delta", held)], columns=["stream_id", "seq", "part", "type", "sentence"])

    def close(self) -> None:
        pass


def sentences(stream: DataFrame, stops: tuple[str, ...] = ("content_block_stop", "message_stop"), idle_ms: int | None = None) -> DataFrame:
    """SENTENCES of a stream of (stream_id, seq, type, token, is_end); needs the RocksDB state store."""
    return stream.groupBy("stream_id").transformWithStateInPandas(SentenceProcessor(stops, idle_ms), outputStructType=SENTENCES, outputMode="append", timeMode="processingTime" if idle_ms else "none")


def rewritten(stream: DataFrame, rewrite: Callable[[Column], Column], stops: tuple[str, ...] = ("content_block_stop", "message_stop"), idle_ms: int | None = None) -> DataFrame:
    """The same with every sentence rewritten; a rewrite that gives null leaves it, events pass through."""
    return sentences(stream, stops, idle_ms).withColumn("sentence", F.coalesce(rewrite(F.col("sentence")), F.col("sentence")))


def replay(df: DataFrame, stops: tuple[str, ...] = ()) -> DataFrame:
    """stream_id, part, sentence of a finished table of tokens in one batch: each stream fed token by token, then flushed.

    For streams that are complete; gives what sentences() gives for the same tokens with is_end on the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # tokens come stream by stream: parts are what is held of the one that is open, and n its sentences so far
        open_, parts, n, begun = None, [], 0, False
        for batch in batches:
            rows: list[tuple[str | None, int, str]] = []
            for stream, token in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if stream != open_ or not begun:
                    rows += [(open_, n + i, s) for i, s in enumerate(flush("".join(parts)))]
                    open_, parts, n, begun = stream, [], 0, True
                if not token:
                    continue
                if not _SIGN.search(token):
                    parts.append(token)
                    continue
                done, held = feed("".join(parts), token)
                rows += [(stream, n + i, s) for i, s in enumerate(done)]
                n, parts = n + len(done), [held]
            yield _rows(rows)
        yield _rows([(open_, n + i, s) for i, s in enumerate(flush("".join(parts)))])

    d = df.select(F.col("stream_id").cast("string"), "token", "seq").repartition("stream_id").sortWithinPartitions("stream_id", F.col("seq").asc_nulls_last())
    return d.select("stream_id", "token").mapInArrow(run, "stream_id string, part int, sentence string")


def _rows(rows: list[tuple[str | None, int, str]]) -> pa.RecordBatch:
    ids, parts, texts = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(parts, pa.int32()), pa.array(texts, pa.string())], ["stream_id", "part", "sentence"])
