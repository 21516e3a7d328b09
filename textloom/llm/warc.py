"""Web archives (WARC 1.1, one gzip member per record) and the merge of their indexes.

Tasks write archives of bounded size. Of equal payloads one is stored; the others are revisit records. Every
archive comes with a run in a file of its own: its captures sorted by URL key, time and id, in blocks. The runs are
merged to one index in global order: ranges of keys are dealt to tasks, and in each range the runs' segments go
through a k-way merge by a loser tree, which holds one block of each segment at a time. A task with more segments
than it may open merges some of them to longer runs in shared storage first, as external sorting does. The archives
are then read back record by record, digests are verified, and each record is matched with its entry in the
merged index.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, written
from .files import opened

#: An archive is closed after so many compressed bytes or records; bounds a run's memory.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 64_000_000, 50_000
#: Captures in a block of a run, and runs that a merge reads at once.
BLOCK, FAN_IN = 1000, 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A capture in a run and in the index; the first four are its key, and record ids are unique.
CAPTURE = pa.schema(
    [("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()), ("record_id", pa.string())]
    + [("run", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
KEY = 4
#: A run: its archive's name, and the key that each of its blocks begins with.
RUN = "run string, blocks array<struct<url_key:string,captured:long,page_id:long,record_id:string>>"
INDEX = (
    "url_key string, captured long, page_id long, record_id string, run string, offset long, length long, part int, place long"
)
READ = (
    "run string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
)


def url_key(url: str | None) -> str:
    """A sort key: the host's labels from the last on, then path and query; without scheme, user, www, default
    port and fragment. Null is the empty key."""
    rest = re.sub(r"#.*$", "", (url or "").strip(), flags=re.S)
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "", rest)
    host, slash, path = rest.partition("/")
    if "?" in host:
        host, _, query = host.partition("?")
        slash, path = "/", "?" + query
    host = re.sub(r":(80|443)$", "", host.rpartition("@")[2].lower())
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + ")" + (slash or "/") + path if rest else ""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(archive: str, offset: int) -> str:
    """Of each record its own, however often a page or payload is repeated."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{archive} {offset}')}"


def iso(seconds: int | None) -> str:
    return datetime.fromtimestamp(seconds or 0, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def uri_of(url: str | None) -> str | None:
    """A field's value keeps no control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None


def record(page_id, url, payload: bytes, captured, digest: str, first: tuple | None, uri: str, offset: int) -> bytes:
    """A response record, or a revisit record of another page, first: (page_id, url, captured)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first else http + payload
    first_id, first_url, first_captured = first or (None, None, None)
    fields = [
        ("WARC-Type", "revisit" if first else "response"),
        ("WARC-Record-ID", f"<{uri}>"),
        ("WARC-Date", iso(captured)),
        ("WARC-Target-URI", uri_of(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Offset", offset),
        ("X-Page-ID", page_id),
        ("WARC-Profile", PROFILE if first else None),
        ("WARC-Refers-To-Target-URI", uri_of(first_url)),
        ("WARC-Refers-To-Date", iso(first_captured) if first else None),
        ("X-Refers-To-Page-ID", first_id),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class LoserTree:
    """Merges sorted runs. Inner nodes keep the loser of their match, so each step replays one path to the root."""

    def __init__(self, runs: Iterable[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        k = len(self.runs)
        self.losers = [0] * max(k, 1)
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            won, lost = (a, b) if self.before(a, b) else (b, a)
            winners[node], self.losers[node] = won, lost
        self.winner = winners[1] if k > 1 else 0

    def before(self, a: int, b: int) -> bool:
        """Whether run a's head comes first; an ended run comes last, equal heads go by run."""
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def __iter__(self) -> Iterator:
        k = len(self.runs)
        while k and (head := self.heads[self.winner]) is not None:
            yield head
            run = self.winner
            self.heads[run] = next(self.runs[run], None)
            node = (run + k) // 2
            while node:
                if self.before(self.losers[node], run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def with_first_copies(pages: DataFrame, least_bytes: int) -> DataFrame:
    """pages (page_id, url, html, captured) with first: page_id, url and captured of the page with the smallest
    page_id that has an equal payload; null for that page itself.

    Only ids and digests meet by payload, so copies of one payload are no burden; pages are then joined to what was
    found by id and digest.
    """
    digest = F.sha1(F.encode("html", "utf-8"))
    known = pages.where((F.octet_length("html") >= least_bytes) & F.col("page_id").isNotNull())
    known = known.select(digest.alias("sha1"), F.struct("page_id", "url", "captured").alias("page"))
    firsts = known.groupBy("sha1").agg(F.min("page").alias("first"), F.max("page.page_id").alias("last"))
    firsts = firsts.where("first.page_id <> last").drop("last")
    revisits = known.join(firsts, "sha1").where("page.page_id <> first.page_id")
    revisits = revisits.select(F.col("page.page_id").alias("id"), F.col("sha1").alias("its_sha1"), "first")
    revisits = revisits.dropDuplicates(["id", "its_sha1"])
    here = (pages["page_id"] == revisits["id"]) & (digest == revisits["its_sha1"])
    return pages.join(revisits, here, "left").select("page_id", "url", "html", "captured", "first")


def batches_of(rows: Iterable[tuple], size: int) -> Iterator[list[tuple]]:
    rows = iter(rows)
    while some := list(itertools.islice(rows, size)):
        yield some


def capture_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(CAPTURE)  # noqa: B905
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, CAPTURE.types, strict=True)], schema=CAPTURE)


def store_run(uri: str, captures: Iterable[tuple], size: int) -> list[tuple]:
    """Writes captures that are in order to a run's file, so many in a block; the keys that its blocks begin with."""
    keys = []
    where, path = opened(uri)
    with where.open_output_stream(path) as out, pa.ipc.new_file(out, CAPTURE) as file:
        for rows in batches_of(captures, size):
            keys.append(rows[0][:KEY])
            file.write_batch(capture_batch(rows))
    return keys


def segment(uri: str, first: int, last: int, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """The captures of a run's blocks first..last whose keys are from low up to, not with, high. Reads block by block."""
    where, path = opened(uri)
    with where.open_input_file(path) as source, pa.ipc.open_file(source) as file:
        for k in range(first, last + 1):
            for row in zip(*(c.to_pylist() for c in file.get_batch(k).columns), strict=True):
                if high is not None and row[:KEY] >= high:
                    return
                if low is None or row[:KEY] >= low:
                    yield row


def write(pages: DataFrame, captured: Column, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes archives of pages (page_id, url, html), with a run beside each, and returns the list of the runs, stored.

    captured: seconds since 1970 (null: 0). A null html is the empty payload, a null url is left out. Of equal
    payloads of at least least_bytes bytes the one with the smallest page_id is a response and the others are
    revisits of it; rows that repeat that page_id are responses each, and so are rows without a page_id.
    Other columns are ignored. An empty table writes nothing.
    """
    where, path = opened(folder)
    where.create_dir(path, recursive=True)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), captured.cast("long").alias("captured"))
    rows = with_first_copies(rows, least_bytes).select(
        "page_id", "url", "html", "captured", F.col("first.page_id").alias("a"), F.col("first.url").alias("b"), F.col("first.captured").alias("c")
    )

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, run, name, offset = None, [], "", 0

        def closed() -> pa.RecordBatch:
            """Writes the finished archive's run: its captures in order."""
            out.close()
            run.sort()
            keys = [dict(zip(CAPTURE.names, key)) for key in store_run(f"{folder}/{name}.run", run, BLOCK)]  # noqa: B905
            blocks = pa.array([keys], pa.list_(pa.struct(list(CAPTURE)[:KEY])))
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), blocks], ["run", "blocks"])

        for batch in batches:
            for page_id, url, html, when, *first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, offset, run = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, []
                    target, target_path = opened(f"{folder}/{name}")
                    out = target.open_output_stream(target_path)
                payload = html.encode()
                uri = record_uri(name, offset)
                copied = tuple(first) if first[0] is not None else None
                data = gzipped(record(page_id, url, payload, when, base32_sha1(payload), copied, uri, offset))
                out.write(data)
                run.append((url_key(url), when or 0, -1 if page_id is None else page_id, uri, name, offset, len(data)))
                offset += len(data)
                if offset >= ARCHIVE_BYTES or len(run) >= ARCHIVE_RECORDS:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return written(rows.mapInArrow(archives, RUN), "runs")


def merged(runs: DataFrame, folder: str, fan_in: int = FAN_IN) -> DataFrame:
    """The index of all runs in global order: the columns of a capture, part, and place (in the part; parts follow
    each other). Stored. A URL key of any number of captures can span parts, as whole keys are dealt to ranges."""
    spark = runs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = CAPTURE.names[:KEY]
    fences = runs.select(F.explode("blocks").alias("block")).select("block.*").repartitionByRange(parts, *names)
    # One row for each range: the key that it begins with.
    lows = fences.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*names)).alias("low")).select("low.*")
    edges = sorted(tuple(r) for r in lows.collect())[1:]  # the first range begins before all keys
    shared = spark.sparkContext.broadcast(edges)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which blocks of each run can have captures of which range."""
        edges = shared.value
        for batch in batches:
            out = []
            for run, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = [tuple(b.values()) for b in blocks]
                for part in range(bisect.bisect_right(edges, keys[0]), len(edges) + 1):
                    first = max(bisect.bisect_right(keys, edges[part - 1]) - 1, 0) if part else 0
                    last = bisect.bisect_left(keys, edges[part]) - 1 if part < len(edges) else len(keys) - 1
                    if first <= last:
                        out.append((part, run, first, last))
            columns = list(zip(*out)) or [[]] * 4  # noqa: B905
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "run", "first", "last"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = shared.value
        rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        for part, here in itertools.groupby(rows, key=lambda r: r[0]):
            low, high = edges[part - 1] if part else None, edges[part] if part < len(edges) else None
            open_ = [(f"{folder}/{run}.run", first, last) for _, run, first, last in here]
            while len(open_) > fan_in:  # a pass of merges to longer runs
                longer = []
                for k in range(0, len(open_), fan_in):
                    uri = f"{folder}/{uuid.uuid4().hex}.run"
                    keys = store_run(uri, LoserTree(segment(*s, low, high) for s in open_[k : k + fan_in]), BLOCK)
                    longer.append((uri, 0, len(keys) - 1))
                open_ = longer
            at = 0
            for found in batches_of(LoserTree(segment(*s, low, high) for s in open_), 10 * BLOCK):
                batch = capture_batch(found)
                number = [pa.array([part] * len(found), pa.int32()), pa.array(range(at, at + len(found)), pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *number], [*CAPTURE.names, "part", "place"])
                at += len(found)

    listed = runs.mapInArrow(segments, "part int, run string, first int, last int")
    listed = listed.repartition(parts, "part").sortWithinPartitions("part", "run")
    return written(listed.mapInArrow(merge, INDEX), "index")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an open archive: their fields (names in lower case) and blocks."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut off")
        yield fields, block


def read(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the named archives (column run), verified: see READ."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                found: list[tuple] = []
                where, path = opened(f"{folder}/{name}")
                with where.open_input_stream(path) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for fields, block in parse(stream):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
                        if fields["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                            raise ValueError(f"{fields['warc-record-id']}: the payload doesn't match its digest")
                        number = lambda field: int(fields[field]) if field in fields else None  # noqa: B023, E731
                        found.append(
                            (name, number("x-offset"), number("x-page-id"), size, digest, fields["warc-type"])
                            + (number("x-refers-to-page-id"), fields.get("warc-target-uri"))
                        )
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)  # noqa: B905

    text, whole = pa.string(), pa.int64()
    names = [x.split()[0] for x in READ.split(", ")]
    schema = pa.schema(list(zip(names, [text, whole, whole, whole, text, text, whole, text], strict=True)))
    return archives.select("run").mapInArrow(rows, READ)


def archived(pages: DataFrame, captured: Column, least_bytes: int = 0) -> DataFrame:
    """Writes archives, merges their runs, reads the archives back: one row per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured and position, the place
    in the merged index. Nulls and repeated rows: see `write`.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    runs = write(pages, captured, folder, least_bytes)
    index = merged(runs, folder)
    sizes = index.groupBy("part").agg(F.count("*").alias("n"))
    # One row for each part of the index, so this window is small however large the index.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = index.join(F.broadcast(starts), "part").select(
        "run", "offset", "url_key", "captured", (F.col("start") + F.col("place")).alias("position")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One row for each archive, dealt out to as many tasks as there are; its records are not to be broadcast.
    names = runs.select("run").repartition(parts, "run")
    return read(spark, names, folder).join(placed.hint("merge"), ["run", "offset"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position"
    )
