"""Connectors: log segments as a Spark data source read by byte ranges, in batches or as a stream, and feeds by kind.

``spark.read.format("log_segments")`` plans byte ranges of the segment files of a folder as partitions; a range owns the
lines that begin in it, so that ranges may cut lines anywhere. ``spark.readStream`` keeps, as its offset, how many bytes of
each file were read: a line is taken once it has its end. Paths may be of any file system that Arrow knows.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from worldlog.sources import feeds

RANGE_BYTES, CHUNK_BYTES, BATCH_LINES = 64 << 20, 1 << 20, 4_096
LINE_SCHEMA = "file string, offset long, line string, problem string"


@dataclass
class ByteRange(InputPartition):
    """Lines of ``path`` that begin at ``start`` or after it, before ``end``; ``whole`` says that the file ends there for good."""

    path: str
    start: int
    end: int
    whole: bool = True


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _segments(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the segment files in a folder, or of one file, by name; hidden files are none."""
    store, root = _open(path)
    found = store.get_file_info(root)
    if found.type == fs.FileType.File:
        return [(path, found.size)]
    rows = store.get_file_info(fs.FileSelector(root))
    prefix = path[: len(path) - len(root)] if path.endswith(root) else path.split(":", 1)[0] + "://"
    return sorted((prefix + f.path, f.size) for f in rows if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def _framed(raw: bytes, ended: bool) -> tuple[str | None, str | None]:
    """A line's text and what is wrong with its frame."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None, "NOT_UTF8"
    if not ended:
        return text, "TORN"
    return text, "CARRIAGE_RETURN" if "\r" in text else "EMPTY_LINE" if not text.strip() else None


def _lines(part: ByteRange) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, line, whether it is ended) of the lines that a range owns; no more than a line and a chunk are held."""
    store, path = _open(part.path)
    with store.open_input_file(path) as file:
        # a line that begins with the range has its predecessor's end just before it
        at = part.start - 1 if part.start else 0
        file.seek(at)
        held, skip = [], part.start > 0
        while chunk := file.read(CHUNK_BYTES):
            held.append(chunk)
            if b"\n" not in chunk:
                continue
            *ended, rest = b"".join(held).split(b"\n")
            held = [rest] if rest else []
            for piece in ended:
                if not skip and at >= part.end:
                    return
                if not skip:
                    yield at, piece, True
                skip = False
                at += len(piece) + 1
        if held and not skip and at < part.end and part.whole:
            yield at, b"".join(held), False


def _batches(part: ByteRange) -> Iterator[pa.RecordBatch]:
    names = ["file", "offset", "line", "problem"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    name, rows = part.path.rsplit("/", 1)[-1], []
    for offset, raw, ended in _lines(part):
        rows.append((name, offset, *_framed(raw, ended)))
        if len(rows) >= BATCH_LINES:
            yield batch(rows)
            rows = []
    if rows:
        yield batch(rows)


class LogSegments(DataSource):
    """Format ``log_segments``. Options: path, rangeBytes (64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "log_segments"

    def schema(self) -> str:
        return LINE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _SegmentReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _SegmentStream(self.options)


def _ranges(path: str, start: int, end: int, size: int, whole: bool) -> list[ByteRange]:
    return [ByteRange(path, at, min(end, at + size), whole) for at in range(start, end, size)]


class _SegmentReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        return [r for path, n in _segments(self.path) for r in _ranges(path, 0, n, self.size, True)] or [ByteRange(self.path, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition.end:
            yield from _batches(partition)


class _SegmentStream(DataSourceStreamReader):
    """Offsets are bytes read of each file, up to the end of its last whole line."""

    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("rangeBytes", RANGE_BYTES))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path, n in _segments(self.path):
            before = self.known.get(path, 0)
            if n < before:
                raise ValueError(f"{path} shrank from {before} to {n} bytes")
            if n > before:
                self.known[path] = self._ended(path, before, n)
        return {p: n for p, n in self.known.items() if n}

    @staticmethod
    def _ended(path: str, start: int, end: int) -> int:
        """Where the last whole line ends, looked for from the file's end on."""
        store, name = _open(path)
        with store.open_input_file(name) as file:
            while end > start:
                at = max(start, end - CHUNK_BYTES)
                file.seek(at)
                place = file.read(end - at).rfind(b"\n")
                if place >= 0:
                    return at + place + 1
                end = at
        return start

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        shrunk = [p for p in start if end.get(p, 0) < start[p]]
        if shrunk:
            raise ValueError(f"shorter than what was read of them: {shrunk}")
        return [r for p, n in sorted(end.items()) for r in _ranges(p, start.get(p, 0), n, self.size, False)] or [ByteRange(self.path, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition.end:
            yield from _batches(partition)


def _judged(lines: DataFrame) -> DataFrame:
    return lines.withColumn("problem", F.coalesce("problem", F.when(F.try_parse_json("line").isNull(), "INVALID_JSON")))


def segments(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, offset, line, problem of every line of a folder of segments.

    problem: NOT_UTF8 (the line is null), TORN (the file ends within it), CARRIAGE_RETURN, EMPTY_LINE, INVALID_JSON, or null. An
    empty folder has no lines; no line is left out.
    """
    spark.dataSource.register(LogSegments)
    return _judged(spark.read.format("log_segments").option("rangeBytes", range_bytes).load(path))


def segment_stream(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """As ``segments``, as a stream: each line once its end is there, bytes read before are not read again."""
    spark.dataSource.register(LogSegments)
    return _judged(spark.readStream.format("log_segments").option("rangeBytes", range_bytes).load(path))


# How feeds of these kinds are read.
KINDS = ("json", "csv", "geojson", "evidence")
_TRUE = ("true", "1", "yes")


def _csv_payload(body: str, types: dict[str, str]) -> str:
    rows = list(csv.DictReader(io.StringIO(body)))
    if not rows:
        raise ValueError("no data rows")
    if any(None in r or None in r.values() for r in rows):
        raise ValueError("row width does not match header")

    def typed(name: str, value: str) -> object:
        kind = types.get(name)
        if value == "" or kind is None:
            return value or None
        try:
            return float(value) if kind == "number" else int(value) if kind == "integer" else value.strip().lower() in _TRUE if kind == "boolean" else value
        except ValueError:
            return value  # the schema names it as mistyped

    return json.dumps({"rows": [{n: typed(n, v) for n, v in r.items()} for r in rows]}, allow_nan=False, ensure_ascii=False, separators=(",", ":"))


@dataclass(frozen=True)
class Connector:
    """One feed: the kind of its bodies, its schema, and the field that names an event, if any."""

    kind: str
    connector_id: str
    schema_id: str
    event_id_field: str | None = None
    #: Of CSV fields: their types by name.
    types: tuple[tuple[str, str], ...] = ()

    def payloads(self, captures: DataFrame) -> DataFrame:
        """payload_id, source_id, connector_id, schema_id, content_sha256, body (JSON; null with a problem), problem, idempotency_key.

        ``captures``: payload_id, source_id, body (text). A body that does not parse is kept with MALFORMED_PAYLOAD; null bodies
        are malformed. The key is of the event's id where the payload has one, else of the content.
        """
        rows = captures.select("payload_id", "source_id", F.col("body").alias("_raw"))
        read = self._csv(rows) if self.kind == "csv" else rows.withColumn("body", F.when(self._sound(F.col("_raw")), F.col("_raw")))
        event = F.try_variant_get(F.try_parse_json("body"), f"$.{self.event_id_field}", "string") if self.event_id_field else F.lit(None).cast("string")
        content = F.sha2(F.coalesce("_raw", F.lit("")), 256)
        of = lambda what, value: F.sha2(F.concat_ws("|", F.lit(self.connector_id), "source_id", F.lit(what), value), 256)
        return read.select(
            "payload_id", "source_id", F.lit(self.connector_id).alias("connector_id"), F.lit(self.schema_id).alias("schema_id"), content.alias("content_sha256"), "body",
            F.when(F.col("body").isNull(), "MALFORMED_PAYLOAD").alias("problem"), F.when(event.isNotNull(), of("event_id", event)).otherwise(of("content", content)).alias("idempotency_key"),
        )

    def _sound(self, body: Column) -> Column:
        sound = feeds.strict_json(body).isNull()
        if self.kind == "geojson":
            return sound & F.coalesce(F.try_variant_get(F.try_parse_json(body), "$.type", "string") == "FeatureCollection", F.lit(False))
        return sound

    def _csv(self, rows: DataFrame) -> DataFrame:
        types = dict(self.types)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for raw in batch.column("_raw").to_pylist():
                    try:
                        out.append(_csv_payload(raw or "", types))
                    except (ValueError, csv.Error):
                        out.append(None)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "body"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(read, f"{kinds}, body string")


def connector(kind: str, connector_id: str, schema_id: str, event_id_field: str | None = None, types: dict[str, str] | None = None) -> Connector:
    """The connector of a kind; an unknown kind is an error of the definition."""
    if kind not in KINDS:
        raise ValueError(f"unknown connector kind: {kind}")
    return Connector(kind, connector_id, schema_id, event_id_field, tuple((types or {}).items()))


def ingestions(payloads: DataFrame, order: str = "payload_id") -> DataFrame:
    """``payloads`` with ``duplicate_of``: the first payload of the same key by ``order``; null for the first itself."""
    first = payloads.groupBy("idempotency_key").agg(F.min(order).alias("_first"))
    met = payloads.join(first, "idempotency_key")
    return met.withColumn("duplicate_of", F.when(F.col(order) != F.col("_first"), F.col("_first"))).drop("_first")
