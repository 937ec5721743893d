"""Stored answers of scholarly services as a Spark data source: pages of JSON, planned by an index, with pushed filters."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: What a stored answer tells, whatever service gave it; fields that a service doesn't know are null.
SCHEMA = (
    "request_id long, kind string, paper_id string, title string, authors array<string>, year int, venue string, citations long, doi string, url string, "
    "publication_type string, retracted boolean, attention double, refs array<struct<paper_id:string,title:string,year:int,citations:long,doi:string>>"
)
_ARROW = pa.schema([
    ("request_id", pa.int64()), ("kind", pa.string()), ("paper_id", pa.string()), ("title", pa.string()), ("authors", pa.list_(pa.string())), ("year", pa.int32()), ("venue", pa.string()),
    ("citations", pa.int64()), ("doi", pa.string()), ("url", pa.string()), ("publication_type", pa.string()), ("retracted", pa.bool_()), ("attention", pa.float64()),
    ("refs", pa.list_(pa.struct([("paper_id", pa.string()), ("title", pa.string()), ("year", pa.int32()), ("citations", pa.int64()), ("doi", pa.string())]))),
])


def _file_system(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


def write_pages(answers: DataFrame, root: str, pages: int = 8) -> str:
    """Store answers (request_id long, kind, status int, body JSON) as pages by ranges of ids, with an index of one line a page."""
    line = F.to_json(F.struct("request_id", "kind", "status", "body"))
    ranged = answers.repartitionByRange(pages, "request_id").sortWithinPartitions("request_id", "kind")
    ranged.select(line.alias("value")).write.text(f"{root}/pages")
    spark = answers.sparkSession
    at = F.get_json_object("value", "$.request_id").cast("long")
    stored = spark.read.text(f"{root}/pages").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("page"), at.alias("id"), F.get_json_object("value", "$.kind").alias("kind"))
    index = stored.groupBy("page").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.sort_array(F.collect_set("kind")).alias("kinds"), F.count("*").alias("answers"))
    index.select(F.to_json(F.struct(*index.columns)).alias("value")).coalesce(1).write.text(f"{root}/index")
    return root


def parsed(kind: str, body: str | None) -> dict | None:
    """The fields of one answer; None where it says nothing of a paper.

    ``paper`` is a paper with its numbers, ``references`` and ``citations`` are lists of papers at the other end,
    ``work`` is a publisher's record inside a message, ``attention`` a count of mentions. Papers of a list without an id
    are left out.
    """
    try:
        data = json.loads(body or "")
    except ValueError:
        return None
    if not isinstance(data, dict):
        return None
    if kind == "paper":
        ids = data.get("externalIds") or {}
        return {"paper_id": data.get("paperId"), "title": data.get("title") or "Unknown", "authors": [a.get("name", "") for a in data.get("authors") or []], "year": data.get("year"), "venue": data.get("venue"), "citations": data.get("citationCount") or 0, "doi": ids.get("DOI"), "url": data.get("url")}
    if kind in ("references", "citations"):
        side = "citedPaper" if kind == "references" else "citingPaper"
        ends = [p for x in data.get("data") or [] if (p := x.get(side)) and p.get("paperId")]
        return {"refs": [{"paper_id": p["paperId"], "title": p.get("title") or "Unknown", "year": p.get("year"), "citations": p.get("citationCount") or 0, "doi": (p.get("externalIds") or {}).get("DOI")} for p in ends]}
    if kind == "work":
        m = data.get("message") or {}
        date = ((m.get("issued") or {}).get("date-parts") or [[None]])[0]
        names = [" ".join(x for x in (a.get("given"), a.get("family")) if x) for a in m.get("author") or []]
        retracted = any(u.get("type") == "retraction" for u in m.get("update-to") or [])
        return {"title": (m.get("title") or [None])[0], "authors": names, "year": date[0] if date else None, "venue": (m.get("container-title") or [None])[0], "citations": m.get("is-referenced-by-count"), "doi": m.get("DOI"), "url": m.get("URL"), "publication_type": m.get("type"), "retracted": retracted}
    if kind == "attention":
        return {"doi": data.get("doi"), "title": data.get("title"), "attention": float(data.get("score") or 0.0)}
    return None


@dataclass
class Page(InputPartition):
    name: str


class PayloadReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root = options["path"].rstrip("/")
        self.filters: list = []
        self.pushed = 0

    def pushFilters(self, filters: list) -> Iterator:
        """Comparisons of request_id and kind are taken: they choose the pages, and the answers in them."""
        for f in filters:
            ordered = isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute == ("request_id",)
            if ordered or isinstance(f, EqualTo | In) and f.attribute == ("kind",):
                self.filters.append(f)
            else:
                yield f

    @staticmethod
    def _may_hold(f, page: dict) -> bool:
        values = f.value if isinstance(f, In) else [f.value]
        if f.attribute == ("kind",):
            return any(v in page["kinds"] for v in values)
        if isinstance(f, EqualTo | In):
            return any(v is not None and page["low"] <= v <= page["high"] for v in values)
        v = f.value
        return page["high"] > v if isinstance(f, GreaterThan) else page["high"] >= v if isinstance(f, GreaterThanOrEqual) else page["low"] < v if isinstance(f, LessThan) else page["low"] <= v

    @staticmethod
    def _holds(f, v) -> bool:
        if v is None:
            return False
        if isinstance(f, In):
            return v in f.value
        return v == f.value if isinstance(f, EqualTo) else v > f.value if isinstance(f, GreaterThan) else v >= f.value if isinstance(f, GreaterThanOrEqual) else v < f.value if isinstance(f, LessThan) else v <= f.value

    def partitions(self) -> list[Page]:
        """The pages whose range of ids and kinds can hold what the filters want: the index has a line a page."""
        fs, base = _file_system(self.root)
        from pyarrow.fs import FileSelector

        lines = []
        for info in fs.get_file_info(FileSelector(f"{base}/index")):
            if info.base_name.startswith("part-"):
                with fs.open_input_stream(info.path) as f:
                    lines += f.read().decode().splitlines()
        wanted = [p for p in map(json.loads, lines) if p.get("low") is not None and all(self._may_hold(f, p) for f in self.filters)]
        return [Page(p["page"]) for p in sorted(wanted, key=lambda p: p["low"])] or [Page("")]

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        if not page.name:
            return
        fs, base = _file_system(self.root)
        rows: list[dict] = []
        with fs.open_input_stream(f"{base}/pages/{page.name}") as f:
            for line in _lines(f):
                a = json.loads(line)
                if not all(self._holds(x, a.get(x.attribute[0])) for x in self.filters):
                    continue
                if a.get("status") != 200 or (fields := parsed(a.get("kind"), a.get("body"))) is None:
                    continue  # an error gives no row
                rows.append({"request_id": a.get("request_id"), "kind": a["kind"]} | fields)
                if len(rows) == 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _lines(f) -> Iterator[bytes]:
    """Lines of a stream, a megabyte at a time."""
    rest = b""
    while block := f.read(1 << 20):
        *lines, rest = (rest + block).split(b"\n")
        yield from lines
    if rest:
        yield rest


class PayloadSource(DataSource):
    """``spark.read.format("paper_payloads").load(root)``: one row for each stored answer that isn't an error."""

    @classmethod
    def name(cls) -> str:
        return "paper_payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PayloadReader:
        return PayloadReader(self.options)


def read_payloads(spark: SparkSession, root: str, where=None) -> DataFrame:
    """Rows of ``SCHEMA``; ``where`` reaches the pages as far as it compares request_id or kind."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PayloadSource)
    df = spark.read.format("paper_payloads").load(root)
    return df if where is None else df.where(where)


def citation_edges(payloads: DataFrame) -> DataFrame:
    """(src, dst) of distinct citations from reference and citation lists, by the request's id and the listed paper's."""
    refs = payloads.where(F.col("kind").isin("references", "citations")).select("kind", F.col("request_id").cast("string").alias("me"), F.explode("refs.paper_id").alias("other"))
    out = F.col("kind") == "references"
    return refs.select(F.when(out, F.col("me")).otherwise(F.col("other")).alias("src"), F.when(out, F.col("other")).otherwise(F.col("me")).alias("dst")).distinct()
