"""A table format as a data source written in Python: Parquet segments, listed by manifests that are written one for each commit.

Batch and stream, both read and written. A write's tasks make a segment each and tell its least and largest values; the commit
then lists them in the next manifest, so readers see all of a write or none of it. A task that fails deletes its segment, an abort
those of the tasks that had ended; what tasks leave that were killed is in no manifest, and `Store.clean` deletes it. A batch
read with the option `filters` leaves out segments that pushed filters rule out, and applies the filters to the others. A stream's offsets are numbers of
manifests. A stream's writes carry its name and the batch's number, so a batch that is repeated after a failure is committed once.

Writers have to take turns: two commits at the same time aren't told apart. The path is one that all executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import datasource as d
from pyspark.sql.types import StructType

STEP = 65_536  # rows of an Arrow batch


@dataclass
class Wrote(d.WriterCommitMessage):
    file: str
    rows: int
    bounds: dict = field(default_factory=dict)


class Store:
    """The files under a path."""

    def __init__(self, path: str) -> None:
        self.path = path

    def open(self) -> tuple[pfs.FileSystem, str]:
        fs, base = pfs.FileSystem.from_uri(self.path)
        return fs, base.rstrip("/")

    def manifests(self) -> list[dict]:
        fs, base = self.open()
        found = fs.get_file_info(pfs.FileSelector(f"{base}/manifests", allow_not_found=True))
        out = []
        for f in sorted(f.path for f in found if f.path.endswith(".json")):
            with fs.open_input_stream(f) as s:
                out.append(json.loads(s.read()))
        return out

    def commit(self, content: dict) -> None:
        """The next manifest: written under another name first, as a half of one is none."""
        fs, base = self.open()
        known = self.manifests()
        if content.get("stream") and any((m.get("stream"), m.get("batch")) == (content["stream"], content["batch"]) for m in known):
            self.delete([f["file"] for f in content["files"]])
            return
        fs.create_dir(f"{base}/manifests")
        place = f"{base}/manifests/{len(known):012d}.json"
        with fs.open_output_stream(f"{place}.part") as s:
            s.write(json.dumps(content).encode())
        fs.move(f"{place}.part", place)

    def delete(self, files: list[str]) -> None:
        fs, base = self.open()
        for f in files:
            fs.delete_file(f"{base}/data/{f}")

    def clean(self) -> int:
        """Deletes the segments that no manifest lists, and returns their number; not while anything is written."""
        fs, base = self.open()
        listed = {f["file"] for m in self.manifests() for f in m["files"]}
        found = fs.get_file_info(pfs.FileSelector(f"{base}/data", allow_not_found=True))
        gone = [f.base_name for f in found if f.base_name not in listed]
        self.delete(gone)
        return len(gone)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        """A task's segment; one that fails leaves nothing."""
        fs, base = self.open()
        fs.create_dir(f"{base}/data")
        name, rows, bounds, writer = f"{uuid.uuid4().hex}.parquet", 0, {}, None
        try:
            for batch in batches:
                writer = writer or pq.ParquetWriter(f"{base}/data/{name}", batch.schema, filesystem=fs)
                writer.write_batch(batch)
                rows += batch.num_rows
                for column, values in zip(batch.schema.names, batch.columns):
                    if (pa.types.is_integer(values.type) or pa.types.is_string(values.type)) and batch.num_rows > values.null_count:
                        low, high = pc.min_max(values).as_py().values()
                        now = bounds.get(column)
                        bounds[column] = [min(low, now[0]), max(high, now[1])] if now else [low, high]
        except BaseException:
            if writer:
                writer.close()
                self.delete([name])
            raise
        if writer:
            writer.close()
        return Wrote(name if writer else "", rows, bounds)


def listed(messages: Iterable[Wrote | None]) -> list[dict]:
    return [{"file": m.file, "rows": m.rows, "bounds": m.bounds} for m in messages if m is not None and m.file]


class Segments(d.DataSource):
    """Options: path; stream, the name under which a stream's batches are committed; filters, "true" to apply filters here. A frame
    loaded with it serves one query: Spark 4.1 keeps what a query has pushed down for the next one over the same frame, even
    if that has other filters. See register()."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    @property
    def store(self) -> Store:
        return Store(self.options["path"])

    def schema(self) -> StructType:
        known = self.store.manifests()
        if not known:
            raise ValueError(f"nothing was written to {self.options['path']}; give a schema")
        return StructType.fromJson(known[-1]["schema"])

    def reader(self, schema: StructType) -> SegmentsReader:
        filtered = str(self.options.get("filters", "false")).lower() == "true"
        return FilteredReader(self.store) if filtered else SegmentsReader(self.store)

    def writer(self, schema: StructType, overwrite: bool) -> SegmentsWriter:
        return SegmentsWriter(self.store, schema, overwrite)

    def streamReader(self, schema: StructType) -> SegmentsStream:
        return SegmentsStream(self.store)

    def streamWriter(self, schema: StructType, overwrite: bool) -> SegmentsStreamWriter:
        return SegmentsStreamWriter(self.store, schema, self.options["stream"])


def register(spark: SparkSession) -> None:
    """Makes format("segments") known to the session, and has it push filters down to sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Segments)


class SegmentsWriter(d.DataSourceArrowWriter):
    def __init__(self, store: Store, schema: StructType, overwrite: bool) -> None:
        self.store, self.kind, self.overwrite = store, schema.jsonValue(), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        return self.store.write(iterator)

    def commit(self, messages: list[Wrote | None]) -> None:
        self.store.commit({"files": listed(messages), "schema": self.kind, "replaces": self.overwrite})

    def abort(self, messages: list[Wrote | None]) -> None:
        self.store.delete([f["file"] for f in listed(messages)])


class SegmentsStreamWriter(d.DataSourceStreamArrowWriter):
    def __init__(self, store: Store, schema: StructType, stream: str) -> None:
        self.store, self.kind, self.stream = store, schema.jsonValue(), stream

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        return self.store.write(iterator)

    def commit(self, messages: list[Wrote | None], batchId: int) -> None:
        self.store.commit({"files": listed(messages), "schema": self.kind, "stream": self.stream, "batch": batchId})

    def abort(self, messages: list[Wrote | None], batchId: int) -> None:
        self.store.delete([f["file"] for f in listed(messages)])


class Segment(d.InputPartition):
    def __init__(self, file: str) -> None:
        self.file = file


#: How a pushed filter compares a column with its value, and whether a segment with these least and largest values can have such a row.
COMPARED = {
    d.EqualTo: (lambda c, v: c == v, lambda low, high, v: low <= v <= high),
    d.GreaterThan: (lambda c, v: c > v, lambda low, high, v: high > v),
    d.GreaterThanOrEqual: (lambda c, v: c >= v, lambda low, high, v: high >= v),
    d.LessThan: (lambda c, v: c < v, lambda low, high, v: low < v),
    d.LessThanOrEqual: (lambda c, v: c <= v, lambda low, high, v: low <= v),
}


def read_segment(store: Store, file: str, condition: pc.Expression | None = None) -> Iterator[pa.RecordBatch]:
    fs, base = store.open()
    yield from ds.dataset(f"{base}/data/{file}", filesystem=fs, format="parquet").scanner(filter=condition, batch_size=STEP).to_batches()


class SegmentsReader(d.DataSourceReader):
    def __init__(self, store: Store) -> None:
        self.store, self.kept = store, []

    def partitions(self) -> list[Segment]:
        files: list[dict] = []
        for m in self.store.manifests():
            files = m["files"] if m.get("replaces") else files + m["files"]
        can = lambda f: all(COMPARED[kind][1](*f["bounds"][c], v) for kind, c, v in self.kept if c in f["bounds"])
        return [Segment(f["file"]) for f in files if can(f)]

    def read(self, partition: Segment | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no segment
            return
        condition = None
        for kind, c, v in self.kept:
            one = COMPARED[kind][0](ds.field(c), v)
            condition = one if condition is None else condition & one
        yield from read_segment(self.store, partition.file, condition)


class FilteredReader(SegmentsReader):
    def pushFilters(self, filters: list[d.Filter]) -> Iterable[d.Filter]:
        """Comparisons of whole numbers and text are applied here; Spark applies the others."""
        for f in filters:
            simple = type(f) in COMPARED and len(f.attribute) == 1 and type(f.value) in (int, str)
            if simple:
                self.kept.append((type(f), f.attribute[0], f.value))
            else:
                yield f


class SegmentsStream(d.DataSourceStreamReader):
    def __init__(self, store: Store) -> None:
        self.store = store

    def initialOffset(self) -> dict:
        return {"manifests": 0}

    def latestOffset(self) -> dict:
        return {"manifests": len(self.store.manifests())}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return [Segment(f["file"]) for m in self.store.manifests()[start["manifests"] : end["manifests"]] for f in m["files"]]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        yield from read_segment(self.store, partition.file)

    def commit(self, end: dict) -> None:
        """Manifests stay, as other readers begin at the first one."""
