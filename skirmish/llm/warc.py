"""Deterministic sharded WARC archives.

Records are sorted by range of the identifier; each shard is written by one task, a gzip member per record, and a new
file begins when one has ``roll_bytes``.  The splitters are a hash sample of the identifiers, so the same table gives
the same files.  A task writes under names of its own attempt; when all have ended, the manifest names the files that
count, they are renamed, and the manifest is written last.  Readers see only what a manifest lists.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

END = b"\r\n"
_MANIFEST = "name string, temporary string, records long, bytes long, sha256 string"
_READ = ("page_id long, url string, record_type string, record_id string, payload binary, payload_bytes long, "
         "payload_digest string, refers_to long")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return pafs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page}:{digest}'.encode()).hexdigest()[:32])}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool,
           date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP header alone."""
    http = END.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8",
                     f"Content-Length: {len(payload)}".encode(), b"", b""])
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page, digest)),
              ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if url is not None:
        fields.append(("WARC-Target-URI", _clean(url)))
    if page is not None:
        fields.append(("WARC-Page-ID", str(page)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", _record_id(refers_to, digest)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + END + END


def parse(data: bytes) -> dict:
    """The fields of a record; raises ValueError when a digest or length does not fit."""
    head, _, rest = data.partition(END + END)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != END + END:
        raise ValueError("record is cut short")
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("block digest differs")
    http, _, payload = block.partition(END + END)
    stated = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    response = fields["WARC-Type"] == "response"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if response and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(stated["Content-Length"])):
        raise ValueError("payload digest differs")
    return {"page_id": int(fields["WARC-Page-ID"]) if "WARC-Page-ID" in fields else None,
            "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
            "record_id": fields["WARC-Record-ID"], "payload": payload if response else None,
            "payload_bytes": int(stated["Content-Length"]), "payload_digest": digest,
            "refers_to": int(fields["WARC-Refers-To-Page-ID"]) if not response else None}


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    left, unzip, parts = b"", zlib.decompressobj(31), []
    while data := left or stream.read(chunk):
        parts.append(unzip.decompress(data))
        left = unzip.unused_data
        if unzip.eof:
            yield b"".join(parts)
            unzip, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("archive is cut short")


class _Files:
    """Rolls the files of one shard."""

    def __init__(self, path: str, roll_bytes: int) -> None:
        self.fs, self.root = file_system(path)
        self.roll, self.stream = roll_bytes, None
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
        self.attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"

    def add(self, shard: int, data: bytes) -> Iterator[tuple]:
        if self.stream and shard != self.shard:
            yield self.close()
        if not self.stream:
            self.number = self.number + 1 if getattr(self, "shard", None) == shard else 0
            self.shard, self.count, self.size, self.digest = shard, 0, 0, hashlib.sha256()
            self.name = f"shard-{shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{self.attempt}"
            self.stream = self.fs.open_output_stream(f"{self.root}/{self.temporary}")
        self.stream.write(data)
        self.digest.update(data)
        self.count, self.size = self.count + 1, self.size + len(data)
        if self.size >= self.roll:
            yield self.close()

    def close(self) -> tuple:
        self.stream.close()
        self.stream = None
        return self.name, self.temporary, self.count, self.size, self.digest.hexdigest()


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)],
                                      [n for n, _ in fields])


def _splitters(pages: DataFrame, id_col: str, shards: int, per_shard: int = 16) -> np.ndarray:
    """Up to ``shards`` - 1 identifiers that deal the rows out evenly, by the rows of identifiers that have over half a
    shard and of a hash sample of about ``per_shard`` others per shard, which depend on the data alone."""
    total = pages.count()
    every = max(1, total // (per_shard * shards))
    counts = pages.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("rows"))
    hot = F.col("rows") * (2 * shards) > F.lit(max(total, 4 * shards))
    sampled = F.pmod(F.xxhash64(id_col), F.lit(every)) == 0
    found = (counts.where(hot | sampled).select(id_col, F.when(hot, F.col("rows")).otherwise(F.col("rows") * every).alias("rows"))
             .toPandas().sort_values(id_col))
    ids, upto = found[id_col].to_numpy(np.int64), found["rows"].cumsum().to_numpy(np.int64)
    if not len(ids):
        return ids
    return np.unique(ids[np.searchsorted(upto, upto[-1] * np.arange(1, shards) // shards, side="right")])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   revisit_from: int = 100, roll_bytes: int = 64 << 20, date: str = "2000-01-01T00:00:00Z",
                   level: int = 6) -> DataFrame:
    """Writes a record per row below ``path`` and returns the manifest (name, records, bytes, sha256).

    Of rows with equal payloads of at least ``revisit_from`` bytes those with the smallest identifier are responses,
    all others revisit it; rows with smaller payloads, and rows whose identifier is null, are responses.
    Null html is an empty payload, a null url has no field; other columns are not read.  An empty table gives a
    manifest without files.
    """
    spark = pages.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    html = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("payload"),
                        F.sha2(html, 256).alias("digest"))
    first = (rows.where((F.octet_length("payload") >= revisit_from) & F.col("id").isNotNull()).groupBy("digest")
             .agg(F.min("id").alias("first"), F.max("id").alias("last")).where(F.col("first") < F.col("last"))
             .select("digest", "first"))
    cuts = _splitters(rows, "id", shards)

    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="right").astype(np.int32))

    dealt = (rows.join(materialise(first, "warc-first"), "digest", "left")
             .withColumn("shard", shard(F.coalesce("id", F.lit(-1 << 63))))
             .repartition(shards, "shard").sortWithinPartitions("shard", "id", "digest"))

    def write(batches):
        files, done = _Files(path, roll_bytes), []
        for batch in batches:
            for digest, page, url, payload, first_, number in zip(*[
                    batch.column(c) for c in ("digest", "id", "url", "payload", "first", "shard")]):
                page, ref = page.as_py(), first_.as_py()
                revisit = ref is not None and page is not None and ref != page
                data = record(page, url.as_py(), payload.as_py(), digest.as_py(), ref, revisit, date)
                zipper = zlib.compressobj(level, zlib.DEFLATED, 31)
                done += files.add(number.as_py(), zipper.compress(data) + zipper.flush())
        if files.stream:
            done.append(files.close())
        yield _table(done, _MANIFEST)

    written = materialise(dealt.mapInArrow(write, _MANIFEST), "warc-written")

    def commit(batches):
        fs, root = file_system(path)
        for batch in batches:
            for row in batch.to_pylist():
                if fs.get_file_info(f"{root}/{row['temporary']}").type == pafs.FileType.File:
                    fs.move(f"{root}/{row['temporary']}", f"{root}/{row['name']}")
                if fs.get_file_info(f"{root}/{row['name']}").size != row["bytes"]:
                    raise OSError(f"{row['name']} is not what was written")
            yield batch

    committed = written.repartition("name").mapInArrow(commit, _MANIFEST).drop("temporary")
    committed.write.json(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, records long, bytes long, sha256 string").json(f"{path}/manifest")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives in the manifest below ``path``, a task per file; lengths and digests are checked."""

    def read(batches):
        fs, root = file_system(path)
        names = [x.split()[0] for x in _READ.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        found = parse(data)
                        if not payloads:
                            found["payload"] = None
                        rows.append(tuple(found[n] for n in names))
                        size += len(data) if payloads else 200
                        if size > 8 << 20:
                            yield _table(rows, _READ)
                            rows, size = [], 0
                if rows:
                    yield _table(rows, _READ)

    manifest = read_manifest(spark, path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("name").repartition(parts, "name").mapInArrow(read, _READ)
