"""Paper listings and metadata from repository protocols, as parsers and tables; transport is a parameter."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlencode
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.runtime import durable, exists

_OAI = "{http://www.openarchives.org/OAI/2.0/}"
_ATOM = "{http://www.w3.org/2005/Atom}"
_ARXIV = "{http://arxiv.org/schemas/atom}"


def parse_listing(xml: bytes) -> tuple[list[str], str | None]:
    """Ids of a ListRecords response, deleted records left out, and its resumption token; nothing if it is no XML."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return [], None
    ids = []
    for record in root.iter(f"{_OAI}record"):
        header = record.find(f"{_OAI}header")
        if header is None or header.get("status") == "deleted":
            continue
        name = header.findtext(f"{_OAI}identifier", "").rsplit(":", 1)[-1]
        if name:
            ids.append(name)
    token = root.find(f".//{_OAI}resumptionToken")
    return ids, (token.text or "").strip() or None if token is not None else None


def listing(fetch: Callable[[str], bytes], endpoint: str, first: str = "", until: str = "", subset: str = "math", limit: int = 50_000, delay: float = 3.0) -> Iterator[str]:
    """Ids from an endpoint, page by page, with a pause between pages; fetch gets an address and gives its bytes."""
    args = {"verb": "ListRecords", "metadataPrefix": "arXiv", "set": subset} | ({"from": first} if first else {}) | ({"until": until} if until else {})
    given = 0
    while True:
        ids, token = parse_listing(fetch(f"{endpoint}?{urlencode(args)}"))
        for name in ids:
            if given >= limit:
                return
            given += 1
            yield name
        if not token:
            return
        args = {"verb": "ListRecords", "resumptionToken": token}
        time.sleep(delay)


_FEED = "arxiv_id string, title string, authors array<string>, subjects array<string>, abstract string, doi string, source string, ts long"


def parse_feed(xml: bytes, now: int) -> list[dict]:
    """Metadata records of an Atom feed; ids come without their version."""

    def text(node: ElementTree.Element, tag: str) -> str:
        return " ".join(node.findtext(tag, "").split())

    records = []
    for entry in ElementTree.fromstring(xml).iter(f"{_ATOM}entry"):
        people = [text(a, f"{_ATOM}name") for a in entry.iter(f"{_ATOM}author")]
        records.append(
            {
                "arxiv_id": re.sub(r"v\d+$", "", text(entry, f"{_ATOM}id").rsplit("/abs/", 1)[-1]),
                "title": text(entry, f"{_ATOM}title"),
                "authors": [name for name in people if name],
                "subjects": [c.get("term") for c in entry.iter(f"{_ATOM}category") if c.get("term")],
                "abstract": text(entry, f"{_ATOM}summary"),
                "doi": text(entry, f"{_ARXIV}doi") or None,
                "source": "arxiv",
                "ts": now,
            }
        )
    return records


def fetch_metadata(ids: DataFrame, fetch: Callable[[str], bytes], endpoint: str, batch: int = 20) -> DataFrame:
    """(asked, error, record) for ids (arxiv_id), fetched in batches by the executors: the record, or why there is none.

    Every id asked for comes out: with error null and its record, with "absent"
    if the answer lacks it, or with the failure of its batch.
    """
    wanted = ids.select("arxiv_id").where("arxiv_id is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(n, t) for n, t in zip(
            ("arxiv_id", "title", "authors", "subjects", "abstract", "doi", "source", "ts"),
            (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64()),
        )])
        for rows in batches:
            asked = rows.column("arxiv_id").to_pylist()
            for i in range(0, len(asked), batch):
                part = asked[i : i + batch]
                try:
                    found = parse_feed(fetch(f"{endpoint}?{urlencode({'id_list': ','.join(part), 'max_results': batch})}"), int(time.time()))
                    by, error = {r["arxiv_id"]: r for r in found}, "absent"
                except (OSError, ElementTree.ParseError) as e:
                    by, error = {}, f"{type(e).__name__}: {e}"[:200]
                got = [by.get(re.sub(r"v\d+$", "", a)) for a in part]
                errors = [None if r else error for r in got]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(errors, pa.string()), pa.array(got, kind)], names=["asked", "error", "record"])

    return wanted.mapInArrow(run, f"asked string, error string, record struct<{', '.join(c.replace(' ', ': ', 1) for c in _FEED.split(', '))}>")


def refresh_metadata(ids: DataFrame, cache: str, fetch: Callable[[str], bytes], endpoint: str, batch: int = 20) -> DataFrame:
    """Read-through and write-through: (asked, error) of the ids that the table at cache lacked; what was fetched is appended to it."""
    spark = ids.sparkSession
    wanted = ids.select(T.normal_id(F.col("arxiv_id")).alias("arxiv_id"))
    if exists(spark, cache):
        known = spark.read.parquet(cache).select(T.normal_id(F.col("arxiv_id")).alias("arxiv_id"))
        wanted = wanted.join(known, "arxiv_id", "left_anti")
    got = durable(fetch_metadata(wanted, fetch, endpoint, batch), "fetched-metadata")
    got.where("error is null").select("record.*").write.mode("append").parquet(cache)
    return got.select("asked", "error")


def download(ids: DataFrame, fetch: Callable[[str], bytes], address: Callable[[str], str], present: DataFrame | None = None) -> DataFrame:
    """(arxiv_id, path, status, content) of ids (arxiv_id), fetched by the executors: an archive table to be written and unpacked as it is.

    status is ok, skip for an id that present (arxiv_id) has, or err with the reason; only ok has content. A failure stops no other.
    """
    wanted = ids.select("arxiv_id").where("arxiv_id is not null").distinct()
    here = present.select("arxiv_id").distinct().withColumn("_here", F.lit(True)) if present is not None else None
    wanted = wanted.join(here, "arxiv_id", "left") if here is not None else wanted.withColumn("_here", F.lit(None).cast("boolean"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for name, have in zip(rows.column("arxiv_id").to_pylist(), rows.column("_here").to_pylist()):
                status, data = "skip", None
                if not have:
                    try:
                        status, data = "ok", fetch(address(name))
                    except OSError as e:
                        status = f"err:{getattr(e, 'code', type(e).__name__)}"
                path = f"{name.replace('/', '_')}.tar.gz"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], t) for x, t in ((name, pa.string()), (path, pa.string()), (status, pa.string()), (data, pa.binary()))], names=["arxiv_id", "path", "status", "content"]
                )

    return wanted.mapInArrow(run, "arxiv_id string, path string, status string, content binary")


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """(arxiv_id) of saved ListRecords responses, a file each, on any file system Spark knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(parse_listing(data)[0], pa.string())], names=["arxiv_id"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "arxiv_id string")


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of saved Atom feeds, a file each, with the time of the file; a file that is no XML gives nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ts in zip(batch.column("content").to_pylist(), batch.column("ts").to_pylist()):
                try:
                    records = parse_feed(data, ts)
                except ElementTree.ParseError:
                    continue
                cols = {n: [r[n] for r in records] for n in ("arxiv_id", "title", "authors", "subjects", "abstract", "doi", "source", "ts")}
                kinds = [pa.list_(pa.string()) if n in ("authors", "subjects") else pa.int64() if n == "ts" else pa.string() for n in cols]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols.values(), kinds)], names=list(cols))

    files = spark.read.format("binaryFile").load(path).select("content", F.unix_timestamp("modificationTime").alias("ts"))
    return files.mapInArrow(run, _FEED)
