"""Importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k.

Two models over hashed words and pairs of words are counted: of target text (labelled as of good quality and not toxic) and
of the raw corpus, each in buckets of its own. A bucket's log ratio is smoothed towards zero by the ``priors`` target
occurrences of its order: pairs are rare, and tell something only where they are many. ``log_ratio`` is the ratio of
the models for the whole text, the sum over its n-grams. What is sampled by, ``log_weight``, is the ratio for its least
likely run of ``window`` words, so that a short toxic passage isn't outweighed by the length of the rest (with no window it
is ``log_ratio``). To the log weight comes Gumbel noise, fixed by doc_id, and the documents with the k largest sums are the
sample. Without a k, k is how many documents exceed the border that separates held-out labels best.

Counts cover the whole corpus. Only labels are sampled: ``max_labels`` of them at most, those of least hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import stored, unused
from sitelens.llm.wordhash import mix, span_hashes, text_parts, word_spans

BITS = 21
#: Target occurrences by which words and pairs are smoothed.
PRIORS = (1.0, 32.0)
CHUNK = 1 << 12
#: Log ratios are kept as whole numbers of this part, so that sums don't depend on their order.
UNIT = 1 << 20
INSIDE = np.array([c > 32 for c in range(256)])


def buckets(data: np.ndarray, bounds: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the hashed word n-grams up to ``order`` in place of each word, and the first of each row.

    A bucket's remainder by ``order`` tells the length of its n-grams, less one; a row's first words stand for those they lack.
    """
    starts, ends, first = word_spans(data, bounds, INSIDE)
    h = span_hashes(data, starts, ends)
    if order > 1 and len(h):
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
        grams = [h]
        for n in range(1, order):
            joined = h.copy()
            for back in range(1, n + 1):
                joined[back:] = mix(joined[back:] * np.uint64(0x9E3779B97F4A7C15) + h[:-back])  # in this order: a pair isn't its reverse
            short = np.arange(len(h)) - first[row] < n
            joined[short] = h[short]
            grams.append(joined)
        h = np.stack(grams, 1).ravel()
        first = first * order
    own = (h >> np.uint64(64 - bits)).astype(np.int64)
    if order > 1:
        own += np.arange(len(own)) % order - own % order
        own -= np.where(own >= 1 << bits, order, 0)
    return own, first


def _count(order: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            good = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for at, data, bounds in text_parts(batch.column(0)):
                own, first = buckets(data, bounds, order, bits)
                np.add.at(raw, own, 1)
                own = own[np.repeat(good[at : at + len(bounds) - 1], np.diff(first))]
                np.add.at(target, own, 1)
        there = np.nonzero(raw)[0]
        for i in range(0, len(there), 100_000):
            part = there[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(raw[part]), pa.array(target[part])], ["bucket", "raw", "target"])

    return run


def label_sample(labels: DataFrame, max_labels: int, seed: int) -> DataFrame:
    """One row a labelled doc_id, ``max_labels`` at most: ``doc_id``, ``good``, ``fit`` (else held out). Null labels count as not good."""
    own = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)).alias("good"))
    order = F.xxhash64("doc_id", F.lit(seed))
    return own.groupBy("doc_id").agg(F.min("good").alias("good")).withColumn("order", order).orderBy("order").limit(max_labels).select("doc_id", "good", (F.pmod("order", F.lit(5)) > 0).alias("fit"))


class Model:
    """Log ratios by bucket, in units."""

    def __init__(self, ratios: np.ndarray, order: int, bits: int, window: int | None):
        self.ratios, self.order, self.bits, self.window = ratios, order, bits, window

    def log_weights(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The log ratio of each whole text, and that of its least likely window."""
        out, least = np.zeros(len(texts)), np.zeros(len(texts))
        window = (self.window or 0) * self.order
        for at, data, bounds in text_parts(texts):
            own, first = buckets(data, bounds, self.order, self.bits)
            total = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.ratios[own], dtype=np.int64)])
            start, end = first[:-1], first[1:]
            full = np.nonzero(end > start)[0]
            if not len(full):
                continue
            out[at + full] = (total[end] - total[start])[full] / UNIT
            if not window:
                continue
            row_end = np.repeat(end, end - start)
            row_start = np.repeat(start, end - start)
            place = np.arange(len(own))
            run = total[np.minimum(place + window, row_end)] - total[place]
            run[place > np.maximum(row_end - window, row_start)] = np.iinfo(np.int64).max
            least[at + full] = np.minimum.reduceat(run, start[full]) / UNIT
        return out, least if window else out


def fit(docs: DataFrame, sample: DataFrame, bits: int = BITS, window: int | None = 16, priors: tuple[float, ...] = PRIORS) -> Model:
    """Counts both models over all of ``docs``; the driver gets 2^bits numbers of four bytes, however large the corpus.

    As many orders of n-grams as ``priors``: with one, single words.
    """
    order = len(priors)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample.where("fit and good").select("doc_id", F.lit(True).alias("target"))), "doc_id", "left")
    counts = marked.select("text", "target").mapInArrow(_count(order, bits), "bucket int, raw long, target long")
    counts = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counts, _ = stored(counts, "ngrams")
    ratios = np.zeros(1 << bits, np.int32)
    totals = {r.o: (r.raw, r.target) for r in counts.groupBy((F.col("bucket") % order).alias("o")).agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()}
    if any(target for _, target in totals.values()):
        unit = F.lit(0)
        for o, (raw, target) in totals.items():
            log = F.log((F.col("target") + priors[o]) / (F.col("raw") * (target / raw) + priors[o]))
            unit = F.when(F.col("bucket") % order == o, F.round(log * UNIT).cast("int")).otherwise(unit)
        packed = counts.select((F.shiftright("bucket", 12)).alias("chunk"), F.struct(F.col("bucket").bitwiseAND(F.lit(CHUNK - 1)).alias("at"), unit.alias("ratio")).alias("x"))
        for row in packed.groupBy("chunk").agg(F.collect_list("x.at").alias("at"), F.collect_list("x.ratio").alias("ratio")).toLocalIterator():
            ratios[row.chunk * CHUNK + np.array(row.at)] = row.ratio
    return Model(ratios, order, bits, window)


def log_weights(docs: DataFrame, model: Model) -> Column:
    """A struct of ``log_ratio`` and ``log_weight``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("log_ratio double, log_weight double")
    def weigh(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x) for x in shared.value.log_weights(texts)], ["log_ratio", "log_weight"])

    return weigh(F.col("text").cast("string"))


def gumbel(seed: int) -> Column:
    """Standard Gumbel noise, the same for a doc_id in every run."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def border(scored: list[tuple[float, bool]], drop_cost: float = 5.0) -> float:
    """The border between held-out log weights with the least cost of errors; a good document lost costs ``drop_cost``.

    Of equal costs the lowest border; minus infinity without labels that tell anything.
    """
    if not any(g for _, g in scored) or all(g for _, g in scored):
        return float("-inf")
    rows = sorted(scored)
    cost = best = float(sum(not g for _, g in rows))
    at = float("-inf")
    for i, (x, good) in enumerate(rows):
        cost += drop_cost if good else -1.0
        after = rows[i + 1][0] if i + 1 < len(rows) else x + 1.0
        if after > x and cost < best:
            best, at = cost, (x + after) / 2
    return at


def weighed(docs: DataFrame, labels: DataFrame, max_labels: int = 100_000, temperature: float = 0.25, seed: int = 7, **model) -> tuple[DataFrame, float]:
    """``docs`` with ``log_ratio``, ``log_weight`` and ``sample_key``, and the border of the log weights.

    ``temperature`` scales the noise: one is sampling by the models' ratio, zero takes the k of most weight.
    """
    sample, _ = stored(label_sample(labels, max_labels, seed), "labels")
    own = fit(docs, sample, **model)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample.where("not fit")), "doc_id")
    scored = [(r.w, r.good) for r in held.select(log_weights(docs, own)["log_weight"].alias("w"), "good").collect()]
    both = unused(docs, "_weights")[0]
    out = docs.withColumn(both, log_weights(docs, own)).select("*", f"{both}.log_ratio", f"{both}.log_weight").drop(both)
    return out.withColumn("sample_key", F.col("log_weight") + F.lit(temperature) * gumbel(seed)), border(scored)


def top_k(keyed: DataFrame, k: int, key: str = "sample_key", tie: str = "doc_id") -> DataFrame:
    """The ``k`` rows of largest key, ties by smaller id: the k-th key is found by four counts of 16 bits of the keys each."""
    # keys as longs of the same order, to the billionth
    rank = unused(keyed, "_rank")[0]
    keyed = keyed.withColumn(rank, F.round(F.col(key) * 1e9).cast("long"))
    high = F.col(rank) + F.lit(1 << 62)
    left, prefix = k, None
    for step in range(4):
        shift = 48 - 16 * step
        part = keyed if prefix is None else keyed.where(F.shiftrightunsigned(high, shift + 16) == prefix)
        rows = sorted(((r.b, r.n) for r in part.groupBy(F.shiftrightunsigned(high, shift).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        for b, n in rows:
            if left <= n:
                prefix = b
                break
            left -= n
        else:
            return keyed.drop(rank)
    ties = keyed.where(high == prefix).orderBy(tie).limit(left)
    return keyed.where(high > prefix).unionByName(ties).drop(rank)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, **options) -> DataFrame:
    """The documents sampled, with ``log_ratio``, ``log_weight`` and ``sample_key`` after the columns of ``docs``.

    ``docs``: ``doc_id``, ``text``; ``labels``: ``doc_id``, ``quality``, ``toxic``. Texts that are null or empty weigh zero.
    Without labels of both kinds, and no ``k``, every document is in the sample. A doc_id labelled twice is a target if
    every label says so; rows that repeat an id have one noise, and rows that repeat its text too stay or go together
    unless ``k`` ends among them; a null doc_id has noise of its own and no label; other columns pass through; an empty
    table gives an empty one.
    """
    docs = docs.drop("log_ratio", "log_weight", "sample_key")
    keyed, at = weighed(docs, labels, **options)
    keyed, _ = stored(keyed, "keyed")
    if k is None:
        k = keyed.where(F.col("sample_key") > at).count() if at > float("-inf") else keyed.count()
    return top_k(keyed, k)
