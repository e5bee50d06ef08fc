"""Structured Streaming: documents assembled from chunks, bytes decoded across chunks, page streams in windows."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftmark.functions.encoding import _MULTI, label_name, single_byte

CHUNKS = "doc_id long, seq long, chunk string, last boolean"


def assemble_chunks(chunks: DataFrame, timeout: str | None = None) -> DataFrame:
    """(doc_id, html) once the chunk marked ``last`` and all before it have come, whatever their order.

    The state of a document is its chunks so far; with a timeout (milliseconds) abandoned documents are let go."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seqs, texts, end = state.get if state.exists else ([], [], -1)
        held = dict(zip(seqs, texts))
        for frame in frames:
            for seq, text, last in zip(frame["seq"], frame["chunk"], frame["last"]):
                held[int(seq)] = text or ""
                if last:
                    end = int(seq)
        if end >= 0 and all(k in held for k in range(end + 1)):
            state.remove()
            yield pd.DataFrame({"doc_id": [key[0]], "html": ["".join(held[k] for k in range(end + 1))]})
        else:
            state.update((list(held), list(held.values()), end))
            if timeout:
                state.setTimeoutDuration(int(timeout))

    return chunks.groupBy("doc_id").applyInPandasWithState(step, "doc_id long, html string", "seqs array<long>, texts array<string>, end long", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout)


def decode_chunks(chunks: DataFrame, encoding: str) -> DataFrame:
    """(stream_id, seq, text) of binary chunks (stream_id, seq, data, last) that may split a character: the pending bytes are the state.
    Chunks of a micro-batch are taken in order of seq."""
    name = label_name(encoding)
    if name is None:
        raise ValueError(f"no encoding {encoding}")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        single = name not in _MULTI
        decoder = None if single else codecs.getincrementaldecoder(_MULTI[name])("replace")
        if decoder is not None and state.exists:
            decoder.setstate((bytes(state.get[0]), state.get[1]))
        out = []
        for data, last in zip(rows["data"], rows["last"]):
            out.append(bytes(data).decode("latin-1").translate(single_byte(name)) if single else decoder.decode(bytes(data), bool(last)))
        if rows["last"].any():
            state.remove()
        elif decoder is not None:
            pending, flag = decoder.getstate()
            state.update((pending, int(flag)))
        yield pd.DataFrame({"stream_id": key[0], "seq": rows["seq"], "text": out})

    return chunks.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, seq long, text string", "pending binary, flag long", "append", GroupStateTimeout.NoTimeout)


def normalize_chunks(chunks: DataFrame, form: str = "NFC") -> DataFrame:
    """(stream_id, seq, text) of string chunks in a normal form: what a later chunk could still combine with waits in the state."""
    import unicodedata as U

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        held = state.get[0] if state.exists else ""
        out = []
        for text, last in zip(rows["chunk"], rows["last"]):
            held += text or ""
            cut = len(held)
            if not last:  # everything from the last starter on may still change
                cut -= 1
                while cut > 0 and (U.combining(held[cut]) or "ᅡ" <= held[cut] <= "ᇿ"):
                    cut -= 1
                cut = max(cut, 0)
            out.append(U.normalize(form, held[:cut]))
            held = held[cut:]
        if rows["last"].any():
            state.remove()
        else:
            state.update((held,))
        yield pd.DataFrame({"stream_id": key[0], "seq": rows["seq"], "text": out})

    return chunks.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, seq long, text string", "held string", "append", GroupStateTimeout.NoTimeout)


def pages_per_window(events: DataFrame, ts: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling event-time windows behind a watermark (an addition; batch input works as well)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def first_seen(events: DataFrame, key: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Each key once within the watermark (an addition); once at all in a batch."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
