"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and decoding by concatenating pieces.

Spark's regex splits each whole text into the pattern's matches inside the JVM. In Arrow batches the words are
dictionary-encoded, and the ranked merges are folded over the distinct ones only: words of one length form a matrix of
token ids, and each step of the fold merges the leftmost pair of least rank in every row at once. ``encode_words`` is the
same fold in Spark's higher-order functions over a table of distinct words, with a literal rank map.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = np.int32(2**31 - 1)
#: Longer words are merged one by one with a heap.
MATRIX_BYTES = 48


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def java_pattern(pattern: str) -> str:
    """The same matches in Java's syntax: character classes by Unicode's properties."""
    return f"(?U){pattern}"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Ranks in forms for whole arrays. ``pairs``: open addressing from two ids to the rank of their joined bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.top = max(ranks.values()) + 1
        self.pieces: list[bytes] = [b""] * self.top
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.words = pa.array(list(ranks), pa.binary())
        self.word_ranks = np.fromiter(ranks.values(), np.int32, len(ranks))
        found = [(ranks[p[:i]] * self.top + ranks[p[i:]], rank) for p, rank in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks]
        self.size = 1 << max(10, (4 * len(found)).bit_length())
        self.keys = np.full(self.size, -1, np.int64)
        self.values = np.full(self.size, NONE, np.int32)
        self.probes = 1
        keys, values = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        for key, value, at in zip(keys.tolist(), values.tolist(), self._slot(keys).tolist(), strict=True):
            n = 1
            while self.keys[at] >= 0:
                at, n = (at + 1) % self.size, n + 1
            self.keys[at], self.values[at] = key, value
            self.probes = max(self.probes, n)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - self.size.bit_length())).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.top + right
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], NONE)
        open_ = np.nonzero((self.keys[at] != keys) & (self.keys[at] >= 0))[0]
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) % self.size
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def merge_rows(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Folds the ranked merges over a matrix of byte ids; gives (row numbers, their final ids)."""
        rows = np.arange(len(ids))
        ranks = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(rows) and ids.shape[1] > 1:
            at = ranks.argmin(1)
            line = np.arange(len(rows))
            best = ranks[line, at]
            done = best == NONE
            if done.any():
                yield rows[done], ids[done]
                go = ~done
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
                line = np.arange(len(rows))
            if not len(rows):
                return
            ids[line, at] = best
            place = np.arange(ids.shape[1] - 1)[None, :]
            ids = np.take_along_axis(ids, place + (place > at[:, None]), 1)
            if ids.shape[1] == 1:
                break
            place = place[:, :-1]
            ranks = np.take_along_axis(ranks, place + (place >= at[:, None]), 1)
            left = np.nonzero(at > 0)[0]
            ranks[left, at[left] - 1] = self.pair_ranks(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.nonzero(at < ids.shape[1] - 1)[0]
            ranks[right, at[right]] = self.pair_ranks(ids[right, at[right]], ids[right, at[right] + 1])
        if len(rows):
            yield rows, ids

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges for one long word, in n log n steps."""
        ids = [int(x) for x in self.bytes[np.frombuffer(word, np.uint8)]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair_ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = rank, True, after[j]
            if after[i] < n:
                before[after[i]] = i
            for p in (before[i], i):
                if p >= 0 and after[p] < n:
                    q = after[p]
                    r = self.ranks.get(self.pieces[ids[p]] + self.pieces[ids[q]])
                    if r is not None:
                        heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return [x for x, dead in zip(ids, gone, strict=True) if not dead]

    def encode_distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length) of each word's ids in the flat array that comes third."""
        n = len(words)
        words = words.cast(pa.binary())
        known = pc.index_in(words, value_set=self.words)
        whole = pc.is_valid(known).to_numpy(zero_copy_only=False)
        length = whole.astype(np.int64)
        start = np.zeros(n, np.int64)
        start[whole] = np.arange(whole.sum())
        flat = [self.word_ranks[known.drop_null().to_numpy(zero_copy_only=False)]]
        total = int(whole.sum())
        rest = np.nonzero(~whole)[0]
        if len(rest):
            size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
            data = np.frombuffer(words.buffers()[2], np.uint8)
            for width in np.unique(size[rest]).tolist():
                own = rest[size[rest] == width]
                if width == 0:
                    continue
                if width > MATRIX_BYTES:
                    for w in own.tolist():
                        ids = self.merge_long(data[ends[w] : ends[w] + width].tobytes())
                        start[w], length[w] = total, len(ids)
                        flat.append(np.array(ids, np.int32))
                        total += len(ids)
                    continue
                for rows, ids in self.merge_rows(self.bytes[data[ends[own][:, None] + np.arange(width)]]):
                    start[own[rows]] = total + np.arange(len(rows)) * ids.shape[1]
                    length[own[rows]] = ids.shape[1]
                    flat.append(ids.ravel())
                    total += ids.size
        return start, length, np.concatenate(flat).astype(np.int32)

    def encode(self, words: pa.ListArray) -> list[np.ndarray]:
        """Ids of each document, given its words."""
        bounds = words.offsets.to_numpy().astype(np.int64)
        bounds, values = bounds - bounds[0], words.flatten()
        if not len(values):
            return [np.empty(0, np.int32)] * len(words)
        coded = values.dictionary_encode()
        start, length, flat = self.encode_distinct(coded.dictionary)
        at = coded.indices.to_numpy(zero_copy_only=False)
        out = []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            part = at[i:j]
            n = length[part]
            ends = np.cumsum(n)
            out.append(flat[np.repeat(start[part] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(read_ranks(path))


def _pack(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def _slices(batch: pa.RecordBatch, values: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about so many words, one row at least, so that memory doesn't follow the number of rows."""
    at, n = 0, batch.num_rows
    if not n:
        return
    bounds = batch.column(1).offsets.to_numpy()
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + values, "right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = to


def _round_trip(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in _slices(batch, 500_000):
                ids = own.encode(part.column(1))
                columns = [part.column(0), _pack([x.astype("<u4").tobytes() for x in ids])]
                names = ["doc_id", "ids"]
                if decoded:
                    columns.append(_pack([own.decode(x) for x in ids]))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            out = [own.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _pack(out)], ["doc_id", "decoded"])

    return run


def split_words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids``: the whole text's token ids as little-endian unsigned 32-bit integers.

    Each match of the pattern is encoded by itself; strings of special tokens are ordinary text. A null or empty text has
    no ids. Repeated rows give repeated rows; other columns are ignored; an empty table gives an empty one.
    """
    words = docs.select("doc_id", split_words(F.col("text"), pattern or default_pattern()).alias("words"))
    return words.mapInArrow(_round_trip(path or default_path(), False), f"doc_id {_kind(docs)}, ids binary")


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``decoded``, the bytes that the ids of ``encode`` stand for; null ids: no bytes."""
    return ids.select("doc_id", "ids").mapInArrow(_decode(path or default_path()), f"doc_id {_kind(ids)}, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``encode`` and ``decode`` in one pass: ``doc_id``, ``ids``, ``decoded``."""
    words = docs.select("doc_id", split_words(F.col("text"), pattern or default_pattern()).alias("words"))
    return words.mapInArrow(_round_trip(path or default_path(), True), f"doc_id {_kind(docs)}, ids binary, decoded binary")


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def digests(trip: DataFrame) -> DataFrame:
    return trip.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def encode_words(words: DataFrame, ranks: dict[bytes, int], column: str = "word") -> DataFrame:
    """The fold in higher-order functions: adds ``ids`` (array of int) to a table of words.

    The rank map is a literal: an array of small maps by the piece's hash, for Spark looks a map's keys up one by one.
    Bytes are written as the characters of the same number, so that pieces are strings.
    """
    import json

    slots = 1 << max(4, (len(ranks) // 4).bit_length())
    session = words.sparkSession
    rows = session.createDataFrame([(p.decode("latin-1"), r) for p, r in ranks.items()], "piece string, rank int").select("piece", "rank", F.pmod(F.xxhash64("piece"), F.lit(slots)).alias("slot")).collect()
    table: list[dict[str, int]] = [{} for _ in range(slots)]
    for row in rows:
        table[row.slot][row.piece] = row.rank
    literal = F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")

    def rank(piece: Column) -> Column:
        return F.element_at(F.element_at(literal, (F.pmod(F.xxhash64(piece), F.lit(slots)) + 1).cast("int")), piece)

    spelled = F.decode(F.encode(F.col(column), "UTF-8"), "ISO-8859-1")
    start = F.transform(F.sequence(F.lit(1), F.length(spelled)), lambda i: spelled.substr(i, F.lit(1)))

    def step(pieces: Column, _: Column) -> Column:
        pairs = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p, i: F.struct(F.coalesce(rank(F.concat(p, F.get(pieces, i + 1))), F.lit(int(NONE))).alias("rank"), i.alias("at")))
        best = F.array_min(pairs)
        merged = F.transform(F.array(best), lambda b: F.when(b["rank"] == int(NONE), pieces).otherwise(F.flatten(F.array(F.slice(pieces, F.lit(1), b["at"]), F.array(F.concat(F.get(pieces, b["at"]), F.get(pieces, b["at"] + 1))), F.slice(pieces, b["at"] + 3, F.size(pieces))))))
        return F.when(F.size(pieces) < 2, pieces).otherwise(F.get(merged, F.lit(0)))

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(spelled), F.lit(1))), start, step)
    whole = rank(spelled)
    ids = F.when(F.length(spelled) == 0, F.array().cast("array<int>")).when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(folded, rank))
    return words.withColumn("ids", ids)
