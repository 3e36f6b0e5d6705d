"""Web archives: pages into deterministic WARC shards, and back.

Shards are ranges of page ids with about equal records, cut at bounds that
follow from exact byte counts, so the same pages give the same files. Inside a
shard records are in id order; a file is closed once it has ``roll_bytes``
compressed, which a shard has several times over. A file is written under a
temporary name and renamed; the manifest, written last, says which files count.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import quoted, stage

# Bytes of the records of a shard: a share of the whole within these bounds.
LEAST_SHARD, MOST_SHARD, SHARDS = 16 << 20, 1 << 30, 1 << 10
# A file is closed at this share of its shard, so a shard that shrinks less than so many times has several.
ROLLS = 16
# What a record holds besides its payload, about.
HEAD_BYTES = 700
# Ranges of ids whose bytes are counted at first, and at least for one that is heavy.
RANGES, FINER = 1 << 14, 16
DATE = "1970-01-01T00:00:00Z"
_LEAST = -(1 << 63)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four characters for every five hex digits."""
    digest = F.sha1(payload)
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for i in range(8):
        value = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(digits), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _shard_bytes(total: int) -> int:
    return min(max(total // SHARDS, LEAST_SHARD), MOST_SHARD)


def _bounds(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """First ids of the shards after the first, from exact bytes by id range.

    All ranges that hold more than two shards are counted again in finer ones,
    together in one job, until none does. What comes to the driver at a time is
    a few numbers for each shard, and ``RANGES`` at first.
    """
    low, high = sizes.agg(F.min("_k"), F.max("_k")).first()
    if low is None:
        return []
    spark = sizes.sparkSession
    done, heavy = [], [(low, high, -(-(high - low + 1) // RANGES))]
    while heavy:
        firsts, lasts = np.array([h[0] for h in heavy], np.int64), np.array([h[1] for h in heavy], np.int64)
        shared = spark.sparkContext.broadcast((firsts, lasts, np.array([h[2] for h in heavy], np.uint64)))

        @F.pandas_udf("long")
        def range_of(k: pd.Series) -> pd.Series:
            """The first id of the finer range of an id; null outside the heavy ranges."""
            firsts, lasts, steps = shared.value
            ids = k.to_numpy(np.int64)
            at = np.searchsorted(firsts, ids, side="right") - 1
            inside = (at >= 0) & (ids <= lasts[at])
            # Unsigned, as a range may span more than half of all ids.
            start = firsts[at].view(np.uint64)
            start = start + (ids.view(np.uint64) - start) // steps[at] * steps[at]
            return pd.Series(start.view(np.int64)).astype("Int64").mask(~inside)

        rows = sizes.groupBy(range_of("_k").alias("a")).agg(F.sum("_bytes").alias("n")).where("a is not null").orderBy("a").collect()
        finer = []
        for first, n in rows:
            _, end, step = heavy[int(np.searchsorted(firsts, first, side="right")) - 1]
            last = min(first + step - 1, end)
            if n > 2 * shard_bytes and last > first:
                finer.append((first, last, -(-(last - first + 1) // max(FINER, 4 * n // shard_bytes))))
            else:
                done.append((first, n))
        heavy = finer

    bounds, held = [], 0
    for first, n in sorted(done):
        if held and held + n > shard_bytes:
            bounds.append(first)
            held = 0
        held += n
    return bounds


def _record(kind: str, page: int | None, url: str | None, digest: str, size: int, payload: bytes, refers: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + payload if kind == "response" else http
    name = lambda p: uuid.UUID(bytes=hashlib.sha1(f"{p}:{digest}".encode()).digest()[:16], version=5).urn
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{name(page)}>"),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if page is not None:
        fields.append(("X-Page-ID", page))
    if kind == "revisit":
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{name(refers)}>"), ("X-Refers-To-Page-ID", refers)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _place(folder: str) -> tuple[FileSystem, str]:
    """The file system of a folder, given as a URI or a local path, and its path there."""
    return FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")


class _Shard:
    """The open file of a shard; closes it under its final name when it is large enough."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.fs, self.root = _place(folder)
        self.shard, self.roll, self.turn, self.out, self.done = shard, roll_bytes, 0, None, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.temporary = f"{self.root}/.tmp-{self.shard:06d}-{self.turn:04d}-{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.digest = self.fs.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = pack.compress(record) + pack.flush()
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        name = f"part-{self.shard:06d}-{self.turn:04d}.warc.gz"
        self.fs.move(self.temporary, f"{self.root}/{name}")
        self.done.append((self.shard, self.turn, name, self.records, self.size, self.digest.hexdigest()))
        self.out, self.turn = None, self.turn + 1


_MANIFEST = "shard int, turn int, file string, records long, bytes long, sha256 string"


def write(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, shard_bytes: int | None = None, roll_bytes: int | None = None
) -> DataFrame:
    """Write ``pages`` below ``folder`` and return the manifest.

    Of records with equal payloads of at least ``least_bytes`` the one with the
    smallest id is the response, the others are revisits of it; rows that repeat
    that id with that payload are responses as well. A null page counts as an
    empty payload; a record without id comes first, revisits one with an id if
    there is one, and is a response otherwise. A null url gets no target. An
    empty table gives an empty manifest. Payloads are shuffled once; what a
    record refers to comes to the same task as a row of its own before it.
    A shard is a task of about ``shard_bytes`` of payloads and headers, by default
    a 1,024th of the whole between 16 MiB and 1 GiB; its files are closed at
    ``roll_bytes`` compressed, by default a sixteenth of that. What failed attempts left under
    temporary names is removed once the manifest is written.
    """
    spark = pages.sparkSession
    payload = F.coalesce(quoted(html), F.lit("")).cast("binary")
    key = F.coalesce(quoted(page_id).cast("long"), F.lit(_LEAST))
    read = pages.select(quoted(page_id).cast("long").alias("_page"), key.alias("_k"), quoted(url).alias("_url"), payload.alias("_payload"))
    read = read.withColumns({"_digest": base32_sha1(F.col("_payload")), "_bytes": F.octet_length("_payload").cast("long")})
    narrow = stage(read.select("_page", "_k", "_digest", "_bytes"), "page-digests")
    first = narrow.where(F.col("_bytes") >= least_bytes).groupBy("_digest").agg(F.min("_page").alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    refers = narrow.join(first, "_digest").where("_page is null or _page > _first").select("_k", "_digest", "_first").distinct()

    # Revisits count in full, as their payloads come to the shard's task as well.
    weighed = narrow.select("_k", (F.col("_bytes") + HEAD_BYTES).alias("_bytes"))
    if shard_bytes is None:
        shard_bytes = _shard_bytes(weighed.agg(F.sum("_bytes")).first()[0] or 0)
    roll_bytes = roll_bytes or -(-shard_bytes // ROLLS)
    bounds = spark.sparkContext.broadcast(np.array(_bounds(weighed, shard_bytes), np.int64))
    shards = len(bounds.value) + 1
    none = F.lit(None)
    rows = read.select("_k", "_page", "_url", "_digest", "_payload", none.cast("long").alias("_first"), F.lit(1).alias("_turn")).unionByName(
        refers.select("_k", none.cast("long").alias("_page"), none.cast("string").alias("_url"), "_digest", none.cast("binary").alias("_payload"), "_first", F.lit(0).alias("_turn"))
    )
    # Ids to shards: bounds are few (one per shard) and sorted.
    @F.pandas_udf("int")
    def shard_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, k.to_numpy(), side="right").astype(np.int32))

    rows = rows.withColumn("_shard", shard_of("_k")).repartitionById(shards, F.col("_shard")).sortWithinPartitions("_shard", "_k", "_turn", "_digest", "_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, known, at, done = None, {}, None, []
        for batch in batches:
            columns = (batch.column(c) for c in ("_shard", "_k", "_turn", "_digest", "_first", "_page", "_url", "_payload"))
            for shard, k, turn, digest, first, page, url, data in zip(*columns, strict=True):
                if out is None or out.shard != shard.as_py():
                    if out is not None:
                        out.close()
                        done += out.done
                    out = _Shard(folder, shard.as_py(), roll_bytes)
                if at != k.as_py():
                    at, known = k.as_py(), {}
                if turn.as_py() == 0:
                    known[digest.as_py()] = first.as_py()
                    continue
                value, target = data.as_py(), known.get(digest.as_py())
                kind = "response" if target is None else "revisit"
                out.add(_record(kind, page.as_py(), url.as_py(), digest.as_py(), len(value), value, target))
        if out is not None:
            out.close()
            done += out.done
        names = [c.split()[0] for c in _MANIFEST.split(", ")]
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
        values = list(zip(*done, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

    fs, root = _place(folder)
    fs.create_dir(root, recursive=True)
    rows.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/manifest")
    for left in fs.get_file_info(FileSelector(root)):
        if left.base_name.startswith(".tmp-"):
            fs.delete_file(left.path)
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _members(stream) -> Iterator[bytes]:
    """Decompressed records of a file, one at a time."""
    unpack, parts = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            parts.append(unpack.decompress(data))
            data = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the last record is cut off")


def _parsed(record: bytes) -> tuple:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length"))
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("X-Page-ID"), size, digest, kind, number("X-Refers-To-Page-ID"), fields.get("WARC-Target-URI"), payload if kind == "response" else None


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives that the manifest below ``folder`` lists.

    Digests and lengths are checked; a file that is cut off or altered fails
    the job. ``payload`` is null for revisits, and left out on request.
    """
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").select("file")
    files = manifest.repartition(max(1, manifest.count()))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"
    width = len(names) if payloads else len(names) - 1

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))[:width]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names[:width])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in _members(stream):
                        rows.append(_parsed(record))
                        held += len(record)
                        if held > 8 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return files.mapInArrow(run, ", ".join(schema.split(", ")[:width]))
