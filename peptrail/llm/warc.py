"""Pages in WARC archives, found by an index: what is read is byte ranges of chosen records.

Every task writes archives of gzip members, one a record, and gives a row for each record: file, offset, length,
url and digest. These rows are the index, a table; a file that a lost task left is in no row and is never read.
A reader chooses records in the index, sorts their ranges by place, joins ranges that lie close to one read, and
takes the records out of it.

Of pages with equal payloads of at least LEAST_BYTES bytes, the one of the least id is a response; the others
are revisits, which refer to it and hold no payload. A revisit's payload is that of the response it refers to.

Defined results: null html is an empty payload; payloads below LEAST_BYTES are all responses. Rows of one id
and one payload are all responses if that id is the least, else all revisits. A null id is no least one: such
a page revisits one with an id, and is a response where there is none. A null url has no Target-URI; blanks and
control characters in one are percent-encoded in the archive, and kept in the index. Other columns are ignored.
An empty table has an empty index. Pages of any length are one record each.

Folders may be in any store that pyarrow.fs opens by its URI; executors write and read there, and nowhere else.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, prepare

#: Payloads below so many bytes are never revisited.
LEAST_BYTES = 100
#: An archive is closed beyond so many bytes; compression level of its members.
FILE_BYTES, LEVEL = 1 << 30, 3
#: Ranges at most GAP bytes apart become one read, of at most READ_BYTES or one record; a task reads about TASK_BYTES.
GAP, READ_BYTES, TASK_BYTES = 64 << 10, 8 << 20, 256 << 20
#: Groups with at least one row in so many are met by a broadcast; there are at most so many of them.
HOT_GROUPS = 1000
#: Revisits, of some hundred bytes each, that may be broadcast to the pages; beyond, pages are shuffled to them.
BROADCAST_ROWS = 200_000
#: The date of a record, where a caller gives none: the same pages give the same archive.
DATE = "1970-01-01T00:00:00Z"

#: Fixed values of the format.
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records -------------------------------------------------------------------------------------------------


def record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record: its headers (those with a value), its length, its block."""
    head = [VERSION, *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def page_record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, revisit: bool, date: str = DATE) -> bytes:
    """The record of a page; a revisit has the same HTTP head and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{'' if revisit else f'Content-Length: {len(payload)}{chr(13)}{chr(10)}'}\r\n".encode()
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("Page-Id", None if page_id is None else quote(str(page_id))),
    ]
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("Refers-To-Page-Id", quote(str(refers_to)))]
    return record(headers, http if revisit else http + payload)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    n = int(headers.get("content-length", -1))
    if not version.startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError("no record, or one of another length than it states")
    return headers, rest[:n]


def spans(ranges: Iterable[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of ranges (file, offset, length) in order that one read fetches."""
    run: list[tuple[str, int, int]] = []
    for file, offset, length in ranges:
        if run:
            end = run[-1][1] + run[-1][2]
            if run[-1][0] != file or offset - end > GAP or offset + length - run[0][1] > READ_BYTES:
                yield run
                run = []
        run.append((file, offset, length))
    if run:
        yield run


# --- writing -------------------------------------------------------------------------------------------------


def _place(spark: SparkSession, path: str) -> str:
    """The path as a URI, with the default store's scheme where it names none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows with groups, each known by unique keys and n, how many of the rows it meets.

    Groups of many rows, at most HOT_GROUPS, go to the rows; only the rows of the others are shuffled."""
    total = right.agg(F.sum("n")).first()[0] or 0
    hot, cold = right.where(F.col("n") * HOT_GROUPS >= total), right.where(F.col("n") * HOT_GROUPS < total)
    return left.join(F.broadcast(hot), keys).unionByName(left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to of every page."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", F.sha2("payload", 256))
    light = cut(rows.where(F.col("payload_bytes") >= LEAST_BYTES).select("page_id", "payload_digest"))
    groups = cut(light.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    revisits = met(light, groups, ["payload_digest"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = cut(revisits.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "refers_to").distinct())
    side = F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits
    joined = rows.join(side, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    again = F.col("_digest").isNotNull()
    kind = F.when(again, "revisit").otherwise("response")
    return joined.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")


class _Archive:
    """Archives that one task writes, one after the other."""

    def __init__(self, root: str):
        self.store, self.root = fs.FileSystem.from_uri(root)
        self.stream = None

    def add(self, raw: bytes) -> tuple[str, int, int]:
        if self.stream is None:
            self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.store.create_dir(self.root, recursive=True)
            self.stream = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self._put(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        place = (self.name, self.at, self._put(raw))
        if self.at > FILE_BYTES:
            self.close()
        return place

    def _put(self, raw: bytes) -> int:
        member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        data = member.compress(raw) + member.flush()
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def write(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write archives below path/archive and their index, a table, at path/index."""
    spark = pages.sparkSession
    prepare(spark)
    root = f"{_place(spark, path)}/archive"
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Archive(root)
        for batch in batches:
            places = []
            for page_id, url, payload, digest, again, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")), strict=True):
                places.append(archive.add(page_record(page_id, url, payload or b"", digest, refers_to, again == "revisit", date)))
            file, offset, length = zip(*places, strict=True) if places else ((), (), ())
            kept = [batch.column(c) for c in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")]
            yield pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), *kept], names=["file", "offset", "length", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        archive.close()

    index = decided(pages).withColumn("payload", F.col("payload").cast("binary")).mapInArrow(run, f"file string, offset bigint, length bigint, page_id {kind}, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind}")
    index.write.parquet(f"{path}/index")


# --- reading -------------------------------------------------------------------------------------------------


def fetch(spark: SparkSession, path: str, places: DataFrame, kind: str, payload: bool = False) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact of records at places (file, offset, length), from the archives.

    Bytes and digest are those of the payload that was read; a revisit has none, and its stated digest. intact:
    the stated digest is that of the payload."""
    root = f"{_place(spark, path)}/archive"
    text = "page_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, intact boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        name, source = None, None
        ranges = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for span in spans(ranges):
            if span[0][0] != name:
                name = span[0][0]
                source = store.open_input_file(f"{base}/{name}")
            first = span[0][1]
            data = memoryview(source.read_at(span[-1][1] + span[-1][2] - first, first))
            rows = []
            for _, offset, length in span:
                headers, block = parse(gzip.decompress(data[offset - first : offset - first + length]))
                again, stated = headers["warc-type"] == "revisit", headers["warc-payload-digest"].removeprefix("sha256:")
                body = None if again else block.partition(b"\r\n\r\n")[2]
                digest = stated if again else hashlib.sha256(body).hexdigest()
                rows.append((headers.get("page-id"), headers.get("warc-target-uri"), headers["warc-type"], headers.get("refers-to-page-id"), None if again else len(body), digest, digest == stated, body))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.bool_(), pa.binary()]
            names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact", "payload"]
            width = 8 if payload else 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:width], kinds, strict=False)], names=names[:width])

    total = places.agg(F.sum("length")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES + 1)
    ordered = places.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    out = ordered.mapInArrow(run, text + (", payload binary" if payload else ""))
    return out.withColumns({c: F.url_decode(c).cast(kind) for c in ("page_id", "refers_to")})


def read(spark: SparkSession, path: str, where: Column | None = None, payload: bool = False) -> DataFrame:
    """Chosen pages of the archives, all by default: page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact, and the payload on request.

    where: a condition on the index (page_id, url, payload_bytes, payload_digest, record_type, refers_to). The
    responses that chosen revisits refer to are read too, once each."""
    prepare(spark)
    index = spark.read.parquet(f"{path}/index")
    kind, key = dict(index.dtypes)["page_id"], ["refers_to", "payload_digest"]
    chosen = index if where is None else index.where(where)
    places = chosen.select("file", "offset", "length")
    if where is not None:
        wanted = chosen.where("record_type = 'revisit'").select(*key).distinct()
        targets = index.where("record_type = 'response'").withColumn("refers_to", F.col("page_id")).join(wanted, key, "left_semi")
        places = places.union(targets.select("file", "offset", "length")).distinct()
    found = fetch(spark, path, places, kind, payload)
    if not payload:
        found = cut(found)
    responses, revisits = found.where("record_type = 'response'"), found.where("record_type = 'revisit'")
    facts = responses.withColumn("refers_to", F.col("page_id")).select(*key, "payload_bytes", "intact", *["payload"] * payload).dropDuplicates(key)
    again = revisits.drop("payload_bytes", "intact", "payload")
    if payload:
        resolved = again.join(facts, key)
    else:
        resolved = met(again, cut(facts.join(again.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key)), key).drop("n")
    if where is not None:
        # Targets that were not chosen themselves go again.
        mine = chosen.where("record_type = 'response'").select("page_id", "payload_digest").distinct()
        on = responses["page_id"].eqNullSafe(mine["page_id"]) & (responses["payload_digest"] == mine["payload_digest"])
        responses = responses.join(mine, on, "left_semi")
    return responses.unionByName(resolved).select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact", *["payload"] * payload)
