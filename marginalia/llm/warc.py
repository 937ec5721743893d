"""WARC archives: a writer with revisit records and a Spark data source that reads headers before payloads.

Partitions are byte ranges that begin at records (the writer's list has them). Filters on record type and headers are
pushed into the source: a record whose headers fail them is skipped without touching its block.
"""

from __future__ import annotations

import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith

from marginalia.llm.common import file_system, shared_path, stored

SCHEMA = "record_type string, page_id long, target_uri string, payload_digest string, refers_to long, full_length long, payload binary"
#: Rows (digest, id) that may be broadcast: about 30 MB.
SENT_ROWS = 300_000
_URN = "urn:marginalia:page:"
#: Columns that come from headers alone, so that filters on them need no payload.
_HEADER_COLUMNS = ("record_type", "page_id", "target_uri", "payload_digest", "refers_to", "full_length")


def _record_id(page_id: int | None) -> str:
    """A record's name: that of its page, so that a revisit can refer to it; pages without an id have names of their own."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f'{_URN}{page_id}')}>"


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def classify(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Digest, record type and reference of every page.

    Of the pages with an equal payload of ``least`` bytes or more, the largest id is the response and the others revisit
    it. The largest id of a digest is aggregated before the shuffle. Digests that repeat are sent to the pages while they are
    few (``SENT_ROWS``); more of them meet the pages in a join that Spark can split where a payload is hot. Null html is an empty payload. Rows that repeat the largest id are responses too; where all ids of
    a payload are null, all are responses.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    p = p.withColumns({"payload_digest": F.sha1(F.encode("html", "UTF-8")), "full_length": F.octet_length("html").cast("long")})
    last = p.where(F.col("full_length") >= least).groupBy(F.col("payload_digest").alias("same")).agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
    last = stored(last.where("copies > 1").select("same", "keeper"), "warc-copies")
    if last.count() <= SENT_ROWS:
        last = F.broadcast(last)
    j = p.join(last, (p.payload_digest == last.same) & (p.full_length >= least), "left").drop("same")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return j.select("page_id", "url", "html", "payload_digest", "full_length", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("refers_to"))


def _record(page_id, url, html, digest, length, kind, refers_to) -> bytes:
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page: <{_URN}{page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-Page: <{_URN}{refers_to}>"]
    block = _http(length) if kind == "revisit" else _http(length) + html.encode()
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def write_warc(records: DataFrame, archive_bytes: int = 512 << 20, block_bytes: int = 32 << 20) -> str:
    """Write classified pages as WARC files of about ``archive_bytes``; returns the directory in the shared folder.

    Tasks write under fresh names and report what they wrote; ``_archives`` lists the files of the tasks that succeeded.
    """
    root = shared_path(records.sparkSession, "warc")

    def run(batches):
        fs, base = file_system(root)
        fs.create_dir(base, recursive=True)
        out = name = None
        size, blocks = 0, []
        info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: " + _record_id(None).encode() + b"\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: 20\r\n\r\nsoftware: marginalia\r\n\r\n"
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc"
                    out, size, blocks = fs.open_output_stream(f"{base}/{name}"), len(info), [0]
                    out.write(info)
                elif size - blocks[-1] >= block_bytes:
                    blocks.append(size)
                data = _record(*row)
                out.write(data)
                size += len(data)
                if size >= archive_bytes:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"archive": [name], "size": [size], "blocks": [blocks]})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "size": [size], "blocks": [blocks]})

    rows = records.select("page_id", "url", "html", "payload_digest", "full_length", "record_type", "refers_to")
    files = rows.mapInArrow(run, "archive string, size long, blocks array<long>").collect()  # a row a file
    fs, base = file_system(root)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/_archives") as f:
        for r in files:
            f.write(json.dumps(r.asDict()).encode() + b"\n")
    return root


class Block(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.want_payload = options.get("payload", "true").lower() == "true"
        self.batch_bytes = int(options.get("batch_bytes", 8 << 20))
        self.filters: list = []
        self.skipped = 0

    def pushFilters(self, filters):
        """Take the predicates on header columns that one record's headers decide; give the others back to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In | IsNull | IsNotNull | StringStartsWith) and len(f.attribute) == 1 and f.attribute[0] in _HEADER_COLUMNS:
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, head: dict) -> bool:
        for f in self.filters:
            v = head.get(f.attribute[0])
            ok = (
                v is None if isinstance(f, IsNull)
                else v is not None if isinstance(f, IsNotNull)
                else v is not None and (v == f.value if isinstance(f, EqualTo) else v in f.value if isinstance(f, In) else v.startswith(f.value))
            )
            if not ok:
                return False
        return True

    def partitions(self):
        fs, base = file_system(self.root)
        with fs.open_input_stream(f"{base}/_archives") as f:
            files = [json.loads(x) for x in f.read().splitlines()]
        ranges = [Block(a["archive"], s, e) for a in files for s, e in zip(a["blocks"], [*a["blocks"][1:], a["size"]], strict=True)]
        return ranges or [Block("", 0, 0)]

    @staticmethod
    def headers(data: bytes) -> dict:
        """Header columns of one record's header block."""
        h = dict(x.split(": ", 1) for x in data.decode().split("\r\n")[1:] if ": " in x)
        page = lambda k: int(h[k][len(_URN) + 1 : -1]) if k in h else None
        uri = h.get("WARC-Target-URI")
        return {
            "record_type": h.get("WARC-Type"), "page_id": page("X-Page"), "refers_to": page("X-Refers-Page"),
            "target_uri": None if uri is None else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), uri),
            "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:") if "WARC-Payload-Digest" in h else None,
            "full_length": int(h["X-Payload-Length"]) if "X-Payload-Length" in h else None, "length": int(h["Content-Length"]),
        }

    def read(self, partition):
        if partition.end <= partition.start:
            return
        fs, base = file_system(self.root)
        schema = pa.schema([("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("full_length", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        with fs.open_input_file(f"{base}/{partition.archive}") as raw:
            at, buf, start = partition.start, b"", partition.start  # buf holds the bytes from start on
            raw.seek(at)
            while at < partition.end:
                while (end := buf.find(b"\r\n\r\n", at - start)) < 0:
                    more = raw.read(1 << 20)
                    if not more:
                        raise ValueError(f"{partition.archive}: a record's headers end too soon at {at}")
                    buf, start = buf[at - start :] + more, at
                head = self.headers(buf[at - start : end])
                body = start + end + 4
                after = body + head["length"] + 4
                if self._wanted(head):
                    payload = None
                    if self.want_payload and head["record_type"] == "response":
                        while start + len(buf) < body + head["length"]:
                            more = raw.read(max(1 << 20, body + head["length"] - start - len(buf)))
                            if not more:
                                raise ValueError(f"{partition.archive}: a record's block ends too soon at {at}")
                            buf += more
                        block = buf[body - start : body - start + head["length"]]
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        held += len(payload)
                    rows.append((*(head[c] for c in _HEADER_COLUMNS[:1]), head["page_id"], head["target_uri"], head["payload_digest"], head["refers_to"], head["full_length"], payload))
                else:
                    self.skipped += 1
                at = after
                if at > start + len(buf):  # an unwanted block beyond the buffer is never read
                    raw.seek(at)
                    buf, start = b"", at
                if held >= self.batch_bytes or len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class WarcSource(DataSource):
    """``spark.read.format("warc_archives").load(directory)``: a row a record; option payload=false reads headers only."""

    @classmethod
    def name(cls):
        return "warc_archives"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def read_warc(spark: SparkSession, root: str, where: Column | None = None, payload: bool = True) -> DataFrame:
    """Records of an archive directory; ``where`` reaches the source as far as headers decide it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    df = spark.read.format("warc_archives").option("payload", str(payload).lower()).load(root)
    return df if where is None else df.where(where)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write every page, read the archives back, and describe each record by what was read.

    Responses are measured on the payload that was read; a revisit has none, so its length and digest are those that
    its headers state of the full payload. An empty table gives no rows; other columns are left out.
    """
    root = write_warc(classify(pages))
    r = read_warc(pages.sparkSession, root, F.col("record_type").isin("response", "revisit"))
    return r.select(
        "page_id", "target_uri",
        F.coalesce(F.octet_length("payload").cast("long"), F.col("full_length")).alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to",
    )
