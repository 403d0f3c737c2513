"""SimHash near-duplicates through an inverted index on byte positions.

Two 64-bit fingerprints that differ in at most three bits agree in at least five of their eight bytes. The index lists
each distinct fingerprint under the 14 four-byte position sets of the Steiner system S(3,4,8): any five positions hold one
of them, so every link meets in some list, and unrelated fingerprints hardly ever do. A list's pairs are tallied by shared
positional bytes, kept from five on, and verified by their differing bits. Only spanning links leave a list.

Three bits are texts that are all but the same. To keep one of the texts that share 0.8 of their shingles (``keep_one``) the
same index stands on fingerprints of 512 bits: lists by 128 sets of three byte positions, a tally of shared bytes, then bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import settled, stored, unused
from sitelens.llm.components import connected_components
from sitelens.llm.wordhash import mix

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MAX_BITS = 3
MIN_SHARED = 8 - MAX_BITS


def position_sets() -> list[tuple[int, ...]]:
    """Fourteen sets of four byte positions; any five of the eight positions contain one of them."""
    halves = ((0, 1, 2, 3), (4, 5, 6, 7))
    colours = (((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2)))
    mixed = [(*a, *(4 + x for x in b)) for colour in colours for a in colour for b in colour]
    return [*halves, *mixed]


def shingle_hashes(data: bytes, width: int = 3, seed: int = 42) -> np.ndarray:
    words = data.translate(LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n < width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[i:j], seed) for i, j in pairs), np.uint64, n - width + 1)


def fingerprint(data: bytes, width: int = 3, block: int = 1 << 16) -> int:
    """A bit is set if it is set in over half of the shingles' hashes; no words: zero."""
    h = shingle_hashes(data, width)
    if not len(h):
        return 0
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), block):
        part = h[i : i + block].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(part, axis=1, bitorder="little")
        # rows are summed 255 at a time, as far as a byte can count
        whole = len(bits) // 255 * 255
        if whole:
            count += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
        count += bits[whole:].sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            prints = np.fromiter((fingerprint(x.as_buffer().to_pybytes(), width) if x.is_valid else 0 for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long with the same bits."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(width), "doc_id long, fp long")


class Sets:
    """Union-find over 0..n-1, fed with arrays of links; roots are the smallest members."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        p = self.parent
        while len(i):
            while not np.array_equal(up := p[p], p):
                p[:] = up
            a, b = p[i], p[j]
            far = a != b
            i, j, a, b = i[far], j[far], a[far], b[far]
            np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        p = self.parent
        while not np.array_equal(up := p[p], p):
            p[:] = up
        return p


def _bucket_links(prints: np.ndarray, free: tuple[int, ...], dense: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the fingerprints of one list. They agree outside the byte positions ``free``."""
    f = np.unique(prints)
    n = len(f)
    sets = Sets(n)
    if n <= dense:
        step = max(1, (1 << 20) // n)
        for at in range(0, n, step):
            x = f[at : at + step, None] ^ f[None, :]
            shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(2)
            i, j = np.nonzero((shared >= MIN_SHARED) & (np.bitwise_count(x) <= MAX_BITS))
            i += at
            sets.link(i[i < j], j[i < j])
    else:
        # a list of very many fingerprints: look up what one to three flipped bits of the free bytes give
        bits = [np.uint64(1) << np.uint64(8 * p + b) for p in free for b in range(8)]
        for k in range(1, MAX_BITS + 1):
            for chosen in combinations(bits, k):
                other = f ^ np.bitwise_or.reduce(np.array(chosen))
                at = np.minimum(np.searchsorted(f, other), n - 1)
                i = np.nonzero(f[at] == other)[0]
                sets.link(i, at[i])
    root = sets.roots()
    i = np.nonzero(root != np.arange(n))[0]
    return f[i], f[root[i]]


def _links(dense: int):
    free = [tuple(p for p in range(8) if p not in s) for s in position_sets()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.empty(0, np.int64), []
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if len(held_k) and len(key) and key[-1] == held_k[0]:  # the whole batch goes on with the held list
                held_f.append(fp)
                continue
            if len(held_k):
                fp = np.concatenate([*held_f, fp])
                key = np.concatenate([np.full(len(fp) - len(key), held_k[0]), key])
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield from _emit(key[:last], fp[:last], free, dense)
            held_k, held_f = key[last : last + 1], [fp[last:]]
        if held_f:
            f = np.concatenate(held_f)
            yield from _emit(np.full(len(f), held_k[0]), f, free, dense)

    return run


def _emit(key: np.ndarray, fp: np.ndarray, free: list, dense: int) -> Iterator[pa.RecordBatch]:
    edge = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0] if len(key) else np.empty(0, int)
    size = np.diff(np.r_[edge, len(key)])
    out = [_bucket_links(fp[s : s + n], free[int(key[s]) >> 32], dense) for s, n in zip(edge[size > 1].tolist(), size[size > 1].tolist(), strict=True)]
    out = [x for x in out if len(x[0])]
    if out:
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def fingerprint_links(prints: DataFrame, dense: int = 4096) -> DataFrame:
    """Links ``a``, ``b`` that connect whatever distinct fingerprints ``fp`` reach one another by steps of at most three bits."""

    def byte(p: int):
        return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))

    keys = [F.lit(k << 32) + sum((F.shiftleft(byte(p), 8 * i) for i, p in enumerate(s)), F.lit(0)) for k, s in enumerate(position_sets())]
    index = prints.select("fp").distinct().select(F.explode(F.array(*keys)).alias("key"), "fp")
    return index.repartition("key").sortWithinPartitions("key").mapInArrow(_links(dense), "a long, b long")


def simhash_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """Near-duplicate groups of ``docs`` (``doc_id``, ``text``): one row per input row.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest doc_id that links of at most three
    differing bits reach. Exact copies share a fingerprint and are one node, whatever their number. Null and empty texts
    have fingerprint zero and link like any other; a null doc_id gets a row and never names a component (it is null if no
    other id is in the group); repeated rows give repeated rows; other columns are ignored; an empty table gives no rows.
    """
    prints, _ = stored(fingerprints(docs, width), "simhash")
    return _grouped(prints).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _grouped(prints: DataFrame) -> DataFrame:
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots, _ = stored(connected_components(fingerprint_links(prints)), "roots")
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    low = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named, _ = stored(rooted.join(low, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp")


# --- texts that share four fifths of their shingles

#: Bytes of a wide fingerprint. At a similarity of 0.8 two texts differ in 15% of their bits (the angle between shingle sets
#: of cosine 2 x 0.8 / 1.8), so that 27% of the bytes are equal; of unrelated texts 0.4% are.
WIDE = 64
WIDE_BITS = round(WIDE * 8 * np.arccos(2 * 0.8 / 1.8) / np.pi)
#: Two texts within ``WIDE_BITS`` have 17 equal bytes or so; fewer than this is what unrelated ones have.
WIDE_SHARED = 6


def wide_sets() -> np.ndarray:
    """128 sets of three byte positions, no two with more than one in common: a similar pair holds 2.5 of them on average at 0.8, 9 at 0.9."""
    at = np.arange(WIDE)[:, None]
    return np.concatenate([(at + np.array(steps)) % WIDE for steps in ((0, 1, 9), (0, 5, 22))])


def wide_fingerprint(data: bytes, width: int = 5, block: int = 1 << 13) -> bytes:
    """As ``fingerprint``, with eight hashes made of a shingle's one."""
    h = shingle_hashes(data, width)
    count = np.zeros(WIDE * 8, np.int64)
    for i in range(0, len(h), block):
        part = mix(h[i : i + block, None] + np.arange(1, WIDE // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        bits = np.unpackbits(np.ascontiguousarray(part.astype("<u8")).view(np.uint8).reshape(len(part), WIDE), axis=1)
        whole = len(bits) // 255 * 255
        if whole:
            count += np.add.reduce(bits[:whole].reshape(-1, 255, WIDE * 8), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
        count += bits[whole:].sum(0, dtype=np.int64)
    return np.packbits(count * 2 > len(h)).tobytes()


def _wide(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            prints = [wide_fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", width) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k"), pa.array(prints, pa.binary())], ["doc_id", "k", "fp"])

    return run


def _wide_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = wide_sets()
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            fp = np.frombuffer(b"".join(x.as_py() for x in part.column(1)), np.uint8).reshape(-1, WIDE)[:, sets].astype(np.int64)
            keys = (np.arange(len(sets)) << 24) + (fp[:, :, 0] << 16) + (fp[:, :, 1] << 8) + fp[:, :, 2]
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), len(sets))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.ravel())], ["id", "key"])


def _near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of fingerprints that share enough bytes and differ in few enough bits."""
    x = a[:, None] ^ b[None, :]
    shared = (x.view(np.uint8).reshape(*x.shape[:2], WIDE) == 0).sum(2)
    return np.nonzero((shared >= WIDE_SHARED) & (np.bitwise_count(x).sum(2) <= WIDE_BITS))


def wide_links_of(prints: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the fingerprints of one list. Blocks of it meet the first one's, then only those not linked yet meet."""
    n = len(prints)
    sets = Sets(n)
    for at in range(0, n, block):  # each with the first: of a large family nearly all are one component then
        i, _ = _near(prints[at : at + block], prints[:1])
        sets.link(i + at, np.zeros(len(i), np.int64))
    root = sets.roots().copy()
    for at in range(0, n, block):
        for other in range(at, n, block):
            own, their = root[at : at + block], root[other : other + block]
            if own[0] == their[0] and (own == own[0]).all() and (their == own[0]).all():
                continue
            i, j = _near(prints[at : at + block], prints[other : other + block])
            sets.link(i + at, j + other)
            root = sets.roots().copy()
    i = np.nonzero(root != np.arange(n))[0]
    return i, root[i]


def _wide_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a list is taken once all of it is there."""
    key, ids, prints = None, [], []

    def linked() -> Iterator[pa.RecordBatch]:
        if len(ids) > 1:
            own = np.array(ids, np.int64)
            i, j = wide_links_of(np.frombuffer(b"".join(prints), np.uint64).reshape(-1, WIDE // 8))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(own[j])], ["a", "b"])

    for batch in batches:
        for k, i, fp in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if k != key:
                yield from linked()
                key, ids, prints = k, [], []
            ids.append(i)
            prints.append(fp)
    yield from linked()


def wide_links(nodes: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between ids of ``nodes`` (``id``, ``fp``) of similar texts."""
    index = nodes.select("id", "fp").mapInArrow(_wide_keys, "id long, key long").repartition("key")
    shared = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    # most keys are of one text alone: only the others' rows get their fingerprints
    lists, _ = stored(index.join(shared.hint("shuffle_hash"), "key"), "simhash-lists")
    rows = lists.join(nodes.select("id", "fp"), "id").select("key", "id", "fp")
    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_wide_lists, "a long, b long")


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """One document of each near-duplicate group, the first by (doc_id, hash of its text); rows without a doc_id stay.

    A document is an id with a text: rows that repeat both are one, of which one row stays; rows that repeat an id with
    another text are other documents. Texts are linked if their wide fingerprints differ in ``WIDE_BITS`` bits at most, what
    texts that share 0.8 of their shingles of ``width`` words differ in. Texts without a word are one group; other columns
    pass through; an empty table gives an empty one.
    """
    k = F.xxhash64(F.col("text").cast("string"))
    prints = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), k.alias("k"), F.col("text").cast("string").alias("text"))
    prints, _ = stored(prints.mapInArrow(_wide(width), "doc_id long, k long, fp binary"), "simhash")
    doc, key = unused(docs, "_doc", "_key")

    def firsts() -> DataFrame:
        nodes = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "k")).alias("least"))
        nodes, _ = stored(nodes.withColumn("id", F.monotonically_increasing_id()), "simhash-nodes")
        links, _ = stored(wide_links(nodes).distinct(), "simhash-links")
        roots, _ = stored(connected_components(links), "roots")
        rooted = nodes.join(roots.withColumnRenamed("node", "id"), "id", "left").select(F.coalesce("root", "id").alias("root"), "least")
        first = rooted.groupBy("root").agg(F.min("least").alias("first"))
        return first.select(F.col("first.doc_id").alias(doc), F.col("first.k").alias(key))

    kept = settled(firsts, "simhash-kept")
    same = (F.col("doc_id").cast("long") == F.col(doc)) & (k == F.col(key))
    out = docs.join(kept, same, "left_semi")
    # of rows that repeat an id and a text one stays: such documents are few, and only they are sorted out
    again, _ = stored(prints.groupBy(F.col("doc_id").alias(doc), F.col("k").alias(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "simhash-again")
    if not again.isEmpty():
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").withColumn(key, k).dropDuplicates(["doc_id", key]).drop(key))
    return out.unionByName(docs.where("doc_id is null")).select(*docs.columns)
