"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page_id; each shard is a range, written to gzip-per-record archives: a new file begins when the
compressed size is reached, headers and digests are regenerated, and each file is renamed from a temporary name once it
is whole. A task that runs again writes the same bytes under the same names. The manifest lists the files that count; the
reader takes nothing else.

Where a shard ends follows from the pages alone, not from the cluster or the input's files: bytes are counted by ranges of
page_id, ranges with too many bytes again by smaller ones, and neighbouring ranges are put together up to ``shard_bytes``.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import new_path, stored

DATE = "2020-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, sha256 string, first_page long, last_page long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, file string"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>"


def _head(fields: list[tuple[str, str]], body: bytes) -> bytes:
    fields = [*fields, ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + b"\r\n\r\n"


def _uri(url: str | None) -> str:
    """Without characters that would end a header line; percent signs stay readable."""
    return quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~-._")


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """A response, or with ``refers_to`` a revisit of that page's response."""
    digest = hashlib.sha256(payload).hexdigest()
    block = HTTP if refers_to is not None else HTTP + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, url, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if url is not None:
        fields.append(("X-Page-Url", quote(url, safe="/:")))
    if refers_to is not None:
        fields += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers_to, refers_url, digest)),
            ("WARC-Refers-To-Target-URI", _uri(refers_url)),
            ("WARC-Refers-To-Date", DATE),
            ("X-Refers-To-Page", str(refers_to)),
        ]
    return _head([*fields, ("Content-Type", "application/http; msgtype=response")], block)


def _info(name: str) -> bytes:
    body = b"software: sitelens\r\nformat: WARC File Format 1.1\r\n"
    return _head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name, "info")), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], body)


class _Shard:
    """The files of one shard."""

    def __init__(self, root: str, shard: int, attempt: int, roll: int):
        self.fs, self.root = _fs(root)
        self.shard, self.attempt, self.roll = shard, attempt, roll
        self.n, self.out, self.done = 0, None, []

    def write(self, page_id: int | None, record: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.n:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary/{self.shard}-{self.attempt}-{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.sha, self.size, self.records, self.first = hashlib.sha256(), 0, 0, None
            self._put(_info(self.name))
        self._put(record)
        self.records += 1
        self.first, self.last = page_id if self.first is None else self.first, page_id
        if self.size >= self.roll:
            self.close()

    def _put(self, record: bytes) -> None:
        data = gzip.compress(record, 6, mtime=0)
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            to = f"{self.root}/{self.name}"
            try:
                self.fs.move(self.temporary, to)
            except OSError:  # stores that don't move onto a file: an earlier attempt left the same bytes
                self.fs.delete_file(to)
                self.fs.move(self.temporary, to)
            self.done.append((self.name, self.records, self.size, self.sha.hexdigest(), self.first, self.last))
            self.n, self.out = self.n + 1, None


def _long(x) -> int | None:
    return None if pd.isna(x) else int(x)


def _writer(root: str, roll: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = TaskContext.get().taskAttemptId()
        done, shard = [], None
        mark, seen = {}, {}
        at = None
        for batch in batches:
            for number, page_id, kind, url, payload, digest, refers in zip(*(batch[c] for c in ("shard", "page_id", "kind", "url", "payload", "digest", "refers_to")), strict=True):
                if shard is None or shard.shard != number:
                    if shard is not None:
                        shard.close()
                        done += shard.done
                    shard = _Shard(root, number, attempt, roll)
                page = _long(page_id)
                if page != at:
                    at, mark, seen = page, {}, {}
                if kind == 0:
                    mark[digest] = (int(refers), url)
                    continue
                payload = bytes(payload)
                own = hashlib.sha256(payload).hexdigest()
                to = refers_url = None
                if page is not None and len(payload) >= least:
                    to, refers_url = mark.get(own, (page, seen[own]) if own in seen else (None, None))
                    seen.setdefault(own, url)
                shard.write(page, page_record(page, url, payload, to, refers_url))
        if shard is not None:
            shard.close()
            done += shard.done
        yield pd.DataFrame(done, columns=["file", "records", "bytes", "sha256", "first_page", "last_page"]).astype({"first_page": "Int64", "last_page": "Int64"})

    return run


def shard_starts(sizes: DataFrame, shard_bytes: int, bits: int = 16) -> list[int]:
    """First keys of the shards over ``key`` (long, not null) and ``bytes``: the same for the same rows, however they are dealt out.

    The driver gets 2^``bits`` sums, and as many again for each range that has more than a shard's bytes, as long as a
    range holds several keys. Neighbouring ranges are one shard up to ``shard_bytes``.
    """
    low, high = sizes.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return []
    ranges: list[tuple[int, int]] = []  # first key, bytes
    pending, shift = [low], max(0, (high - low).bit_length() - bits)
    while True:
        # of the keys in pending ranges; all of them at first
        start = F.lit(low) + F.shiftleft(F.shiftright(F.col("key") - low, shift), shift) if high - low < 1 << 63 else F.shiftleft(F.shiftright("key", shift), shift)
        own = sizes if pending == [low] and not ranges else sizes.join(F.broadcast(sizes.sparkSession.createDataFrame([(p,) for p in pending], "_p long")), F.col("_p") == parent)
        found = [(r.s, r.b) for r in own.groupBy(start.alias("s")).agg(F.sum("bytes").alias("b")).collect()]
        pending = [s for s, b in found if b > shard_bytes and shift]
        ranges += [(s, b) for s, b in found if not (b > shard_bytes and shift)]
        if not pending:
            break
        parent, shift = start, max(0, shift - bits)
    starts, held = [], None
    for s, b in sorted(ranges):
        if held is None or held + b > shard_bytes:
            starts.append(s)
            held = 0
        held += b
    return starts


def write_warc(pages: DataFrame, root: str, roll_bytes: int = 256 << 20, least_revisit: int = 100, shard_bytes: int = 16 << 20) -> DataFrame:
    """Writes ``pages`` (``page_id``, ``url``, ``html``) as archives under ``root``; returns the manifest.

    A null html is an empty payload; a null url is kept apart from an empty one. Of equal payloads of at least
    ``least_revisit`` bytes the one with the smallest page_id is a response and the others revisit it; a page_id that comes
    twice with one payload is a response, then a revisit of itself. Rows without a page_id are responses. Other columns
    are ignored; an empty table gives an empty manifest. ``shard_bytes`` of payload are a shard (a task's work) at most,
    unless one page_id has more; there are 100,000 shards at most, larger ones then.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(1).alias("kind"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    known = rows.where("page_id is not null")
    large = known.where(F.length("payload") >= least_revisit).select("page_id", "url", F.sha2("payload", 256).alias("digest"))
    first = large.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("to"), F.max("page_id").alias("last")).where("to.page_id < last").drop("last")
    marks = large.select("page_id", "digest").join(stored(first, "warc-first")[0], "digest").where("page_id > to.page_id").distinct()
    none = F.lit(None)
    # a mark tells its page, before its rows, which payload is elsewhere; its url is that of the response
    marks = marks.select("page_id", F.lit(0).alias("kind"), F.col("to.url").alias("url"), none.cast("binary").alias("payload"), "digest", F.col("to.page_id").alias("refers_to"))
    both = rows.withColumns({"digest": none.cast("string"), "refers_to": none.cast("long")}).unionByName(marks)

    sizes, _ = stored(known.select(F.col("page_id").alias("key"), (F.length("payload") + 512).cast("long").alias("bytes")), "warc-sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    starts = np.array(shard_starts(sizes, max(shard_bytes, total // 50_000)), np.int64)
    shared = spark.sparkContext.broadcast(starts)

    @F.arrow_udf("int")
    def shard_of(ids: pa.Array) -> pa.Array:
        """From one on by the shards' first pages; rows without a page_id are shard zero."""
        at = np.searchsorted(shared.value, ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "right")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, np.maximum(at, 1)), pa.int32())

    # rows without a page_id may be any number: they are dealt out by their payload, to as many shards as others have beside
    spread = max(1, min(len(starts), 1000))
    apart = F.pmod(F.xxhash64("url", "payload"), F.lit(spread)).cast("int")
    sharded = both.withColumn("shard", shard_of("page_id")).withColumn("shard", F.when(F.col("page_id").isNull(), -1 - apart).otherwise(F.col("shard")))
    sharded = sharded.withColumn("shard", F.when(F.col("shard") < 0, len(starts) - F.col("shard")).otherwise(F.col("shard")))
    tasks = max(1, min(2 * len(starts), 100_000))
    sorted_ = sharded.repartition(tasks, "shard").sortWithinPartitions("shard", "page_id", "kind", F.col("url").asc_nulls_first(), F.sha2("payload", 256))
    folder = pages.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_temporary")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    sorted_.mapInPandas(_writer(root, roll_bytes, least_revisit), MANIFEST).write.parquet(f"{root}/_manifest")
    fs.delete(folder, True)
    return spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")


def parse_members(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, one gzip member at a time; trailing newlines are checked."""
    unzip, data, record = zlib.decompressobj(31), b"", []
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                break
        record.append(unzip.decompress(data))
        data = unzip.unused_data
        if unzip.eof:
            whole = b"".join(record)
            head, _, rest = whole.partition(b"\r\n\r\n")
            fields = dict(re.findall(r"([^:\r\n]+): ([^\r\n]*)", head.decode().partition("\r\n")[2]))
            size = int(fields["Content-Length"])
            if not head.startswith(b"WARC/1.1") or rest[size:] != b"\r\n\r\n":
                raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
            yield fields, rest[:size]
            unzip, record = zlib.decompressobj(31), []
    if any(record):
        raise ValueError("the archive ends inside a record")


def read_file(fs, path: str) -> Iterator[dict]:
    with fs.open_input_stream(path, compression=None) as stream:
        for fields, block in parse_members(stream):
            kind = fields["WARC-Type"]
            if kind == "warcinfo":
                continue
            if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
                raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
            payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
            digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
            if payload is not None and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(fields["X-Payload-Length"])):
                raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
            yield {
                "page_id": int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None,
                "url": unquote(fields["X-Page-Url"]) if "X-Page-Url" in fields else None,
                "payload_bytes": int(fields["X-Payload-Length"]),
                "payload_digest": digest,
                "record_type": kind,
                "refers_to": int(fields["X-Refers-To-Page"]) if kind == "revisit" else None,
                "payload": payload,
                "file": path.rpartition("/")[2],
            }


def _reader(root: str, rows: int, keep: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = _fs(root)

        def frame(part: list[dict]) -> pd.DataFrame:
            return pd.DataFrame(part).astype({"page_id": "Int64", "refers_to": "Int64", "payload": object, "url": object})

        for batch in batches:
            for name in batch["file"]:
                part: list[dict] = []
                for record in read_file(fs, f"{top}/{name}"):
                    part.append(record if keep else record | {"payload": None})
                    if len(part) >= rows:
                        yield frame(part)
                        part = []
                if part:
                    yield frame(part)

    return run


def read_warc(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """The records of every file in the manifest of ``root``. Digests and lengths are checked on the way. A file is a task's work."""
    files = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest").select("file")
    return files.repartition(max(1, min(files.count(), 100_000))).mapInPandas(_reader(root, 256, payloads), RECORDS)


def archive_round_trip(pages: DataFrame, roll_bytes: int = 256 << 20) -> DataFrame:
    root = new_path(pages.sparkSession, "warc")
    write_warc(pages, root, roll_bytes)
    return read_warc(pages.sparkSession, root, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file")
