"""Changeset dumps: XML files of many bzip2 streams, read and written by a data source whose unit is a stream.

    dumps.register(spark)
    rows.repartitionByRange("id").sortWithinPartitions("id").write.format("changesets").mode("append").save(path)
    dumps.write_index(spark, path, index)
    spark.read.format("changesets").option("index", index).load(path).filter("id between 100 and 200")

Paths are of file systems that pyarrow knows (file, s3, gs, hdfs) and that all executors reach.
"""

from __future__ import annotations

import bz2
import re
import uuid
import xml.etree.ElementTree as ET
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from xml.sax.saxutils import quoteattr

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession, Window as W, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..storage import stored

SCHEMA = "id long, created_at timestamp, closed_at timestamp, num_changes long, min_lon double, min_lat double, max_lon double, max_lat double, tags map<string,string>"
# The tags that are kept; names of users never are.
TAG_KEYS = (
    "comment",
    "source",
    "imagery_used",
    "created_by",
    "hashtags",
    "import",
    "bot",
    "mechanical",
    "StreetComplete:quest_type",
)
MAGIC = re.compile(rb"BZh[1-9]1AY&SY")
ELEMENT = re.compile(rb"<changeset\s+id=\"(\d+)\"")
HEAD, TAIL = b"<?xml version='1.0' encoding='UTF-8'?>\n<osm version=\"0.6\">\n", b"</osm>\n"
SCAN_BYTES = 64 << 20
"""Bytes of a file that a task searches for streams."""
TASK_BYTES = 32 << 20
"""Compressed bytes that a task reads, or one stream."""
STREAM_ROWS = 2_000


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a dump's files, by name: the file itself or those of a folder; names that begin with _ or . aren't."""
    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(at, info.size)]
    found = system.get_file_info(pafs.FileSelector(at))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "_.")


def _read(system: pafs.FileSystem, path: str, start: int, end: int) -> bytes:
    with system.open_input_file(path) as f:
        return f.read_at(end - start, start)


def _unpacked(data: bytes) -> bytes | None:
    """A stream's text, or null if it isn't a whole stream: the magic can occur inside of one."""
    try:
        d = bz2.BZ2Decompressor()
        out = d.decompress(data)
        return out if d.eof else None
    except OSError:
        return None


def streams(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, end, first_id, last_id): every bzip2 stream of a dump, and the changesets that begin in it (null: none does).

    Tasks search SCAN_BYTES of a file each for the magic; a place that a stream from there can't be read from is none. The list is one row
    a stream, some 1 MB of text each.
    """
    pieces = [(f, n, a) for f, n in files_of(path) for a in range(0, n, SCAN_BYTES)]
    if not pieces:
        return spark.createDataFrame([], "file string, start long, end long, first_id long, last_id long")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(path)
        for batch in batches:
            for file, size, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = _read(system, file, a, min(size, a + SCAN_BYTES + 9))
                at = [a + m.start() for m in MAGIC.finditer(data) if m.start() < SCAN_BYTES]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(at)), pa.array([size] * len(at), pa.int64()), pa.array(at, pa.int64())], names=["file", "size", "start"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(path)
        for batch in batches:
            rows = []
            for file, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, end = _whole_stream(system, file, start, size)
                if text is not None:
                    ids = ELEMENT.findall(text)
                    rows.append((file, start, end, int(ids[0]) if ids else None, int(ids[-1]) if ids else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), *[pa.int64()] * 4))], names=["file", "start", "end", "first_id", "last_id"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = spark.createDataFrame(pieces, "file string, size long, start long").repartition(max(1, min(n, len(pieces)))).mapInArrow(search, "file string, size long, start long")
    return starts.repartition(n, "file", "start").mapInArrow(first, "file string, start long, end long, first_id long, last_id long")


def _whole_stream(system: pafs.FileSystem, file: str, start: int, size: int) -> tuple[bytes | None, int]:
    """(text, end) of the stream that begins at start."""
    d, out, at = bz2.BZ2Decompressor(), [], start
    try:
        while not d.eof and at < size:
            data = _read(system, file, at, min(size, at + (1 << 20)))
            at += len(data)
            out.append(d.decompress(data))
    except OSError:
        return None, start
    return (b"".join(out), at - len(d.unused_data)) if d.eof else (None, start)


def write_index(spark: SparkSession, path: str, index: str) -> None:
    """Writes (file, first_id, last_id, spans, follower, dump_bytes), a row for each stream in which a changeset begins, sorted by place.

    spans are the stream and those after it in which none begins, as streams cut the text anywhere; follower is the next in which one does.
    last_id bounds the ids from first_id on: it is below the follower's first one, or null if a file's end leaves it open. dump_bytes
    tells another dump apart.
    """
    total = sum(n for _, n in files_of(path))
    along = W.partitionBy("file").orderBy("start")
    grouped = streams(spark, path).withColumn("nth", F.count("first_id").over(along)).filter("nth > 0")
    rows = grouped.groupBy("file", "nth").agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    after = W.partitionBy("file").orderBy("nth")
    last = F.coalesce(F.lead("first_id").over(after) - 1, F.when(F.size("spans") == 1, F.col("last")))
    rows = rows.withColumns({"last_id": last, "follower": F.lead(F.get("spans", 0)).over(after), "dump_bytes": F.lit(total).cast("long")}).drop("nth", "last")
    rows.repartitionByRange("file", "first_id").sortWithinPartitions("file", "first_id").write.parquet(index)


def first_change(text: bytes) -> tuple | None:
    """The row of one <changeset> element."""
    e = ET.fromstring(text)
    a = e.attrib

    def when(name: str) -> datetime | None:
        return datetime.fromisoformat(a[name].replace("Z", "+00:00")) if a.get(name) else None

    box = [float(a[k]) for k in ("min_lon", "min_lat", "max_lon", "max_lat")] if all(k in a for k in ("min_lon", "min_lat", "max_lon", "max_lat")) else [None] * 4
    tags = {t.get("k"): t.get("v") for t in e.iter("tag") if t.get("k") in TAG_KEYS}
    return int(a["id"]), when("created_at"), when("closed_at"), int(a["num_changes"]) if "num_changes" in a else None, *box, tags


@dataclass
class Streams(InputPartition):
    """Consecutive streams of one file, from the first changeset that begins in them to the first that begins in the follower."""

    file: str
    spans: list[tuple[int, int]]
    follower: tuple[int, int] | None


class ChangesetReader(DataSourceReader):
    """Partitions are streams; bounds of ids leave out streams that can't hold them, as ids rise through a file."""

    def __init__(self, options: dict):
        self.path, self.index = options["path"], options["index"]
        self.low, self.high, self.ids = int(options.get("from", -(2**63))), int(options.get("to", 2**63 - 1)), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            on_id = getattr(f, "attribute", None) == ("id",)
            if on_id and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            elif on_id and isinstance(f, In):
                wanted = {v for v in f.value if v is not None}
                self.ids = wanted if self.ids is None else self.ids & wanted
            elif on_id and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif on_id and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            yield f  # streams are skipped; rows are still filtered

    def partitions(self) -> list[InputPartition]:
        system, at = _open(self.index)
        # Only the index's rows that the bounds leave are read here; some 100 bytes for each MB of text.
        keep = (ds.field("first_id") <= self.high) & (ds.field("last_id").is_null() | (ds.field("last_id") >= self.low))
        index = ds.dataset(at, filesystem=system, format="parquet", exclude_invalid_files=False).to_table(filter=keep).to_pylist()
        if index and index[0]["dump_bytes"] != sum(n for _, n in files_of(self.path)):
            raise ValueError(f"the index {self.index} is of another dump")
        index.sort(key=lambda r: (r["file"], r["first_id"]))
        if self.ids is not None:
            wanted = sorted(self.ids)
            index = [r for r in index if bisect_left(wanted, r["first_id"]) < (len(wanted) if r["last_id"] is None else bisect_right(wanted, r["last_id"]))]
        out: list[InputPartition] = []
        for r in index:
            spans, follower = [(s["start"], s["end"]) for s in r["spans"]], r["follower"] and (r["follower"]["start"], r["follower"]["end"])
            last = out[-1] if out else None
            if last and last.file == r["file"] and last.follower == spans[0] and spans[-1][1] - last.spans[0][0] <= TASK_BYTES:
                last.spans, last.follower = [*last.spans, *spans], follower
            else:
                out.append(Streams(r["file"], spans, follower))
        return out or [Streams("", [], None)]

    def read(self, partition: Streams) -> Iterator[tuple]:
        system, _ = _open(self.path)
        held, begun = b"", False
        for span in [*partition.spans, *([partition.follower] if partition.follower else [])]:
            text = _unpacked(_read(system, partition.file, *span))
            if text is None:
                raise ValueError(f"{partition.file} has no stream at {span[0]}: it isn't the dump that was indexed")
            if not begun:
                text, begun = text[ELEMENT.search(text).start() :], True
            elif span == partition.follower:
                text = text[: ELEMENT.search(text).start()]
            held += text
            starts = [m.start() for m in ELEMENT.finditer(held)]
            for a, b in zip(starts, starts[1:], strict=False):
                yield first_change(held[a:b])
            held = held[starts[-1] :]
        if held:
            end = held.rfind(b"</osm>")
            yield first_change(held if end < 0 else held[:end])


@dataclass
class Written(WriterCommitMessage):
    file: str
    name: str


class ChangesetWriter(DataSourceWriter):
    """Each task writes one file of streams under a hidden name; only the commit shows them, so a failed or repeated task leaves nothing."""

    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("streamRows", STREAM_ROWS))
        self.job = uuid.uuid4().hex
        system, at = _open(self.path)
        system.create_dir(at, recursive=True)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        system, at = _open(self.path)
        hidden = f"{at}/_{self.job}-{part}-{uuid.uuid4().hex}"
        with system.open_output_stream(hidden, compression=None) as f:
            lines: list[bytes] = [HEAD]
            for n, row in enumerate(iterator, 1):
                lines.append(element(row))
                if n % self.rows == 0:
                    f.write(bz2.compress(b"".join(lines)))
                    lines = []
            f.write(bz2.compress(b"".join([*lines, TAIL])))
        return Written(hidden, f"{at}/part-{part:06d}-{self.job}.osm.bz2")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = _open(self.path)
        for m in messages:
            system.move(m.file, m.name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = _open(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.file)


def element(row: Row) -> bytes:
    """A row's <changeset> element."""
    values = {"id": row.id, "created_at": row.created_at, "closed_at": row.closed_at, "num_changes": row.num_changes, "min_lon": row.min_lon, "min_lat": row.min_lat, "max_lon": row.max_lon, "max_lat": row.max_lat}
    shown = {k: v.astimezone(timezone.utc).isoformat() if isinstance(v, datetime) else v for k, v in values.items() if v is not None}
    attrs = " ".join(f"{k}={quoteattr(str(v))}" for k, v in shown.items())
    tags = "".join(f'  <tag k={quoteattr(k)} v={quoteattr(v or "")}/>\n' for k, v in sorted((row.tags or {}).items()))
    return (f"<changeset {attrs}>\n{tags}</changeset>\n" if tags else f"<changeset {attrs}/>\n").encode()


class Changesets(DataSource):
    """Format "changesets". Reading: option index (see write_index), and optionally from and to, bounds of the ids. Writing: streamRows."""

    @classmethod
    def name(cls) -> str:
        return "changesets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ChangesetReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a dump is written once: use mode append into a new folder")
        return ChangesetWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark hand filters to Python sources."""
    spark.dataSource.register(Changesets)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def lookup(spark: SparkSession, path: str, index: str, ids: DataFrame) -> DataFrame:
    """The changesets with the ids (id), which may be as many as there are: only the streams that they begin in are read, by all tasks.

    A file's ids rise, files are of disjoint ranges. Ids and the streams' first ids are put in one order by a range sort; the last first
    id at or below an id is that of its stream. Partitions hand their last stream on by one row each.
    """
    table = spark.read.parquet(index)
    none = F.lit(None).cast(table.select(F.struct("file", "spans", "follower")).schema[0].dataType)
    marks = table.select(F.col("first_id").alias("id"), F.struct("file", "spans", "follower").alias("stream")).unionByName(ids.filter("id is not null").select(F.col("id").cast("long").alias("id"), none.alias("stream")).distinct())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(marks.repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.max_by("stream", F.when(F.col("stream").isNotNull(), F.col("id"))).alias("own"))
    before = ends.select("part", F.last("own", ignorenulls=True).over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    here = W.partitionBy("part").orderBy("id", F.col("stream").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = ranged.withColumn("at", F.last("stream", ignorenulls=True).over(here)).filter("stream is null").join(F.broadcast(before), "part", "left")
    wanted = found.select("id", F.coalesce("at", "before").alias("s")).filter("s is not null").groupBy("s").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # a stream's ids at most
    options = {"path": path, "index": index}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ChangesetReader(options)
        for batch in batches:
            for i in range(batch.num_rows):  # one stream's ids at a time
                row = batch.slice(i, 1).to_pylist()[0]
                file, spans, follower = row["s"]["file"], row["s"]["spans"], row["s"]["follower"]
                own = set(row["ids"])
                rows = [r for r in reader.read(Streams(file, [(x["start"], x["end"]) for x in spans], follower and (follower["start"], follower["end"]))) if r[0] in own]
                kinds = (pa.int64(), pa.timestamp("us", "UTC"), pa.timestamp("us", "UTC"), pa.int64(), *[pa.float64()] * 4, pa.map_(pa.string(), pa.string()))
                columns = [pa.array([list(r[i].items()) if isinstance(r[i], dict) else r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return wanted.repartition(parts, F.col("s.file"), F.col("s.spans")).mapInArrow(extract, SCHEMA)
