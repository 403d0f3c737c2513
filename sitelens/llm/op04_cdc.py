"""Substring de-duplication by content-defined chunks.

A gear hash over the last 32 bytes cuts texts where its high bits are zero, between a least and a greatest size, so that
cuts follow the content: after an insertion the cuts fall in step again. Chunks are counted by 128-bit digest; of a
digest's occurrences the first by (doc_id, hash of the text, start) is kept. A passage is a run of adjacent chunks that occur
elsewhere too; it counts from ``least_bytes`` on. A document is an id with a text: rows that repeat both are one document, rows
that repeat an id with another text are others (``k``, a hash of the text, tells them apart).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import stored
from sitelens.llm.wordhash import text_parts

#: Random numbers for bytes, from a rule: the same on every machine.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), 2024) for i in range(256)], np.uint32)
PLAN = (16, 5, 96)  # least size, bits of a cut, greatest size: chunks of about 48 bytes


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: sum of GEAR[byte i back] << i over 32 bytes, by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        # read before it is written: the right side is a copy
        h[step:] += h[:-step] << np.uint32(step)
    return h


def cuts(data: np.ndarray, least: int, bits: int, greatest: int) -> list[int]:
    """Ends of the chunks of one text."""
    n = len(data)
    if not n:
        return []
    marks = (np.nonzero(gear(data) >> np.uint32(32 - bits) == 0)[0] + 1).tolist()
    out, at = [], 0
    for m in marks:
        if m - at < least:
            continue
        while m - at > greatest:
            at += greatest
            out.append(at)
        if m - at >= least:
            at = m
            out.append(at)
    while n - at > greatest:
        at += greatest
        out.append(at)
    if at < n:
        out.append(n)
    return out


def _chunks(plan: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ks = batch.column(2).to_numpy(zero_copy_only=False)
            for first, data, bounds in text_parts(batch.column(1)):
                doc, key, start, length, high, low = [], [], [], [], [], []
                whole = data.tobytes()
                for i, (b, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    at = 0
                    for end in cuts(data[b:e], *plan):
                        d = xxhash.xxh3_128_intdigest(whole[b + at : b + end])
                        start.append(at)
                        length.append(end - at)
                        high.append((d >> 64) - (1 << 63))
                        low.append((d & (1 << 64) - 1) - (1 << 63))
                        at = end
                    new = len(start) - len(doc)
                    doc += [ids[first + i]] * new
                    key += [ks[first + i]] * new
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["doc_id", "k", "start", "length", "high", "low"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k"))


def chunks(docs: DataFrame, plan: tuple[int, int, int] = PLAN) -> DataFrame:
    """``doc_id``, ``k``, ``start`` and ``length`` in bytes, ``high`` and ``low`` halves of the digest, of each chunk."""
    return _keyed(docs).mapInArrow(_chunks(plan), "doc_id long, k long, start int, length int, high long, low long")


def repeated_spans(docs: DataFrame, least_bytes: int = 80, plan: tuple[int, int, int] = PLAN) -> DataFrame:
    """Passages of ``docs`` that occur elsewhere too.

    One row for each part of a passage: ``doc_id``, ``k``, ``run`` (the passage), ``start``, ``length`` (bytes of the UTF-8
    text), ``again`` (its first occurrence is elsewhere, so that it can go). Repeats within one document count. Rows that
    repeat an id and a text repeat nothing; null ids and null or empty texts give nothing; other columns are ignored; an
    empty table gives an empty result.
    """
    own, _ = stored(chunks(docs, plan), "chunks")
    at = F.struct("doc_id", "k", "start")
    # first a sum in each task, so that a chunk that most documents hold is a row a task; written, so that the join's
    # sides are dealt out for it alone and a hot chunk's rows can be split
    often, _ = stored(own.groupBy("high", "low").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first < last").drop("last"), "chunks-often")
    hits = own.join(often, ["high", "low"]).select("doc_id", "k", "start", "length", (at != F.col("first")).alias("again"))
    hits = stored(hits, "chunk-hits")[0].repartition("doc_id", "k").dropDuplicates(["doc_id", "k", "start"])
    end = F.col("start") + F.col("length")
    by_place = Window.partitionBy("doc_id", "k").orderBy("start")
    opens = F.when(F.col("start") > F.lag(end).over(by_place), 1).otherwise(0)
    turns = F.when(F.col("again") != F.lag("again").over(by_place), 1).otherwise(opens)
    runs = hits.withColumns({"opens": opens, "turns": turns}).withColumns({"run": F.sum("opens").over(by_place), "part": F.sum("turns").over(by_place)})
    parts = runs.groupBy("doc_id", "k", "run", "part").agg(F.min("start").alias("start"), F.sum("length").cast("int").alias("length"), F.first("again").alias("again"))
    whole = F.sum("length").over(Window.partitionBy("doc_id", "k", "run"))
    return parts.withColumn("passage_bytes", whole).where(F.col("passage_bytes") >= least_bytes).select("doc_id", "k", "run", "start", "length", "again")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, gone in zip(batch.column(1), batch.column(2), strict=True):
            data, at, kept = (text.as_py() or "").encode(), 0, []
            for span in sorted((x["start"], x["length"]) for x in gone.as_py()):
                kept.append(data[at : span[0]])
                at = max(at, span[0] + span[1])
            # a cut may fall inside a character; what is left of it goes
            out.append(b"".join([*kept, data[at:]]).decode(errors="ignore"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of the documents of ``spans`` without what occurred before."""
    gone = spans.where("again").groupBy("doc_id", "k").agg(F.collect_list(F.struct("start", "length")).alias("gone"))
    return _keyed(docs).join(gone, ["doc_id", "k"]).select("doc_id", "text", "gone").mapInArrow(_cut, "doc_id long, text string")


def repeated_documents(spans: DataFrame) -> DataFrame:
    """One row for each document with repeated passages: their number, bytes, bytes to remove, and the parts as start:length, ``-`` before what goes."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "length", "again"))), lambda x: F.concat(F.when(x["again"], F.lit("-")).otherwise(F.lit("")), x["start"].cast("string"), F.lit(":"), x["length"].cast("string"))), " ")
    found = spans.groupBy("doc_id", "k").agg(F.count_distinct("run").alias("n_passages"), F.sum("length").alias("repeated_bytes"), F.sum(F.when(F.col("again"), F.col("length")).otherwise(0)).alias("removed_bytes"), said.alias("spans"))
    return found.drop("k")
