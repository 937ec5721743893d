"""Media columns: texts kept as lossless 8-bit image samples in archive directories, read back by a Spark data source.

An archive is a run of members, each a fixed header (magic, media length, CRC-32, id, unpadded length) and a PNG.
The writer cuts archives and remembers where a member begins about every ``block_bytes``; the data source plans one
partition a block, so every byte range begins at a member. A member whose read or checksum fails is read again from
its own offset, alone.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from marginalia.llm.common import file_system, shared_path

ROW = 192  # bytes of an image row: 64 pixels of three 8-bit samples
_HEAD = struct.Struct("<4sBqQQI")  # magic, has id, id, unpadded bytes, media bytes, CRC-32 of the media
_MAGIC = b"MGM1"
_PNG = b"\x89PNG\r\n\x1a\n"  # fixed by the format
MEMBER_SCHEMA = "doc_id long, n_bytes long, archive string, offset long, media binary"
FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _head(doc_id: int | None, n: int, media: bytes) -> bytes:
    return _HEAD.pack(_MAGIC, doc_id is not None, doc_id or 0, n, len(media), zlib.crc32(media))


def pad(data: bytes) -> bytes:
    """Spaces up to a positive multiple of the row length."""
    return data + b" " * (-len(data) % ROW if data else ROW)


def encode_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)  # each row begins with filter type 0
    raw[:, 1:] = rows
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.data, 1)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """Samples of a PNG as ``encode_png`` writes it; ValueError where a chunk is damaged."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, rows = 8, [], 0
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            rows = struct.unpack_from(">II", body)[1]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(rows, ROW + 1)
    if raw[:, 0].any():
        raise ValueError("a row filter that this reader does not know")
    return raw[:, 1:].tobytes()


def write_archives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = 256 << 20, block_bytes: int = 16 << 20) -> str:
    """Store every text as a media member; returns the archive directory (in the shared folder).

    Each task writes files of its own under fresh names and reports them; ``_archives`` lists those of the tasks that
    succeeded, so files that a lost executor left behind are never read. Null texts are stored as empty ones.
    """
    spark = docs.sparkSession
    root = shared_path(spark, "media")

    def run(batches):
        fs, base = file_system(root)
        fs.create_dir(base, recursive=True)
        out = name = None
        size = members = 0
        blocks: list[int] = []

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "size": [size], "members": [members], "blocks": [blocks]}, schema=report)

        report = pa.schema([("archive", pa.string()), ("size", pa.int64()), ("members", pa.int64()), ("blocks", pa.list_(pa.int64()))])
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                media = encode_png(pad(data))
                if out is None:
                    name = f"{uuid.uuid4().hex}.mgm"
                    out, size, members, blocks = fs.open_output_stream(f"{base}/{name}"), 0, 0, []
                if not blocks or size - blocks[-1] >= block_bytes:
                    blocks.append(size)
                head = _head(doc_id, len(data), media)
                out.write(head)
                out.write(media)
                size += len(head) + len(media)
                members += 1
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    files = texts.mapInArrow(run, "archive string, size long, members long, blocks array<long>").collect()  # a row a file
    fs, base = file_system(root)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/_archives") as f:
        for r in files:
            f.write(json.dumps(r.asDict()).encode() + b"\n")
    return root


class Block(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.batch_bytes = int(options.get("batch_bytes", 8 << 20))
        self.tries = int(options.get("tries", 3))

    def partitions(self):
        """A byte range a block, from the directory's list; an empty directory has one empty range."""
        fs, base = file_system(self.root)
        with fs.open_input_stream(f"{base}/_archives") as f:
            files = [json.loads(x) for x in f.read().splitlines()]
        ranges = [Block(a["archive"], s, e) for a in files for s, e in zip(a["blocks"], [*a["blocks"][1:], a["size"]], strict=True)]
        return ranges or [Block("", 0, 0)]

    def _member(self, fs, path: str, at: int):
        """(id, unpadded length, media, next offset) of the member at ``at``; tried again by itself if that fails."""
        for left in reversed(range(self.tries)):
            try:
                with fs.open_input_file(path) as f:
                    f.seek(at)
                    return self._parse(f, at)
            except (OSError, ValueError, struct.error):
                if not left:
                    raise
        raise AssertionError

    def _parse(self, f, at: int):
        magic, has_id, doc_id, n, length, crc = _HEAD.unpack(f.read(_HEAD.size))
        if magic != _MAGIC:
            raise ValueError(f"no member at {at}")
        media = f.read(length)
        if len(media) != length or zlib.crc32(media) != crc:
            raise ValueError(f"damaged member at {at}")
        return doc_id if has_id else None, n, media, at + _HEAD.size + length

    def read(self, partition):
        if partition.end <= partition.start:
            return
        fs, base = file_system(self.root)
        path, at, rows, held = f"{base}/{partition.archive}", partition.start, [], 0
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary())])
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        with fs.open_input_file(path) as f:
            f.seek(at)
            while at < partition.end:
                try:
                    doc_id, n, media, then = self._parse(f, at)
                except (OSError, ValueError, struct.error):
                    doc_id, n, media, then = self._member(fs, path, at)
                    f.seek(then)
                rows.append((doc_id, n, partition.archive, at, media))
                held, at = held + len(media), then
                if held >= self.batch_bytes or len(rows) >= 5000:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(directory)``: a row a member."""

    @classmethod
    def name(cls):
        return "media_archives"

    def schema(self):
        return MEMBER_SCHEMA

    def reader(self, schema):
        return MediaReader(self.options)


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").load(root)


def feature(payload: bytes) -> str:
    """Rows, thousandths of the mean of each channel, and the counts of samples by eighth of the range."""
    x = np.frombuffer(payload, np.uint8)
    sums = x.reshape(-1, 3).sum(0, dtype=np.int64)
    means = ",".join(str(int(s) * 3000 // x.size) for s in sums)
    return f"rows={x.size // ROW};mean={means};hist={','.join(map(str, np.bincount(x >> 5, minlength=8)))}"


def media_features(members: DataFrame) -> DataFrame:
    """Checks and features of the stored media, a row a member. Equal texts give equal values."""

    def run(batches):
        for b in batches:
            rows = []
            for media in b.column(1).to_pylist():
                payload = decode_png(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [b.column(0), b.column(2), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in FEATURE_SCHEMA.split(", ")])

    return members.select("doc_id", "media", "n_bytes").mapInArrow(run, FEATURE_SCHEMA)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text as media, read the archives back and compute the features of what was read.

    A null text is an empty one (a row of spaces); null ids and repeated rows are kept as they are; an empty table
    gives no rows; columns other than the id and the text are left out.
    """
    return media_features(read_archives(docs.sparkSession, write_archives(docs, id_col, text_col)))
