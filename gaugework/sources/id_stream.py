"""An append-only Parquet table as a stream in order of ids, with at most so many rows a batch.

An offset is the id of the last row admitted. The next batch ends at the id of the
``rows``-th row after it, which is found from the ids alone: row groups are taken in
order of their least id, by the statistics in the files' footers, and reading stops when no
further group can hold a smaller one. For a table that grows by its ids that is about
a batch's worth of ids. Footers are read once per file. The rows themselves are read by tasks, one
per row group that overlaps the batch.

A batch is a range of ids, so the same rows make it up whenever it is run again, and a
stream resumes after a restart where its checkpoint says. Rows that become visible with an id below
the offset are not seen, and rows of equal id are never parted. Rows without an id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "gaugework_by_id"
FIRST = -(2**63)

_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "smallint": pa.int16(),
    "double": pa.float64(),
    "float": pa.float32(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "timestamp": pa.timestamp("us", "UTC"),
    "timestamp_ntz": pa.timestamp("us"),
    "date": pa.date32(),
    "binary": pa.binary(),
}


@dataclass(frozen=True)
class RowGroup:
    """A row group and the ids that its file's footer says it holds."""

    file: str
    index: int
    low: int
    high: int


@dataclass
class Rows(InputPartition):
    """Rows of a row group with ids above ``after`` and up to ``upto``."""

    group: RowGroup | None
    after: int
    upto: int


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _row_groups(system: pafs.FileSystem, file: str, id_column: str) -> list[RowGroup]:
    with system.open_input_file(file) as source:
        footer = pq.ParquetFile(source).metadata
    at = footer.schema.names.index(id_column)
    found = []
    for i in range(footer.num_row_groups):
        known = footer.row_group(i).column(at).statistics
        told = known is not None and known.has_min_max
        # Without statistics a group may hold any id.
        found.append(RowGroup(file, i, known.min if told else FIRST, known.max if told else 2**63 - 1))
    return found


def _above(system: pafs.FileSystem, group: RowGroup, id_column: str, after: int) -> np.ndarray:
    with system.open_input_file(group.file) as source:
        ids = pq.ParquetFile(source).read_row_group(group.index, [id_column]).column(0)
    return ids.filter(pc.greater(ids, after)).drop_null().to_numpy().astype(np.int64)


class ByIdReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.id_column = options["path"], options["idcolumn"]
        self.rows, self.first = int(options["rows"]), int(options["after"])
        self.schema = schema
        self.at = self.first
        self.footers: dict[tuple[str, int], list[RowGroup]] = {}

    def _groups(self) -> list[RowGroup]:
        """Row groups of all files that are there now, footers of known ones from memory."""
        system, path = _system(self.path)
        info = system.get_file_info(path)
        files = [info] if info.type == pafs.FileType.File else system.get_file_info(
            pafs.FileSelector(path, recursive=True, allow_not_found=True)
        )
        known = {}
        for file in files:
            hidden = any(part.startswith(("_", ".")) for part in file.path[len(path) :].split("/"))
            if file.type == pafs.FileType.File and not hidden:
                key = file.path, file.size
                known[key] = self.footers.get(key) or _row_groups(system, file.path, self.id_column)
        self.footers = known
        return [group for groups in known.values() for group in groups]

    def initialOffset(self) -> dict:
        return {"id": self.first}

    def latestOffset(self) -> dict:
        """The id that the next batch ends at."""
        system, _ = _system(self.path)
        ids = np.empty(0, np.int64)
        for group in sorted((g for g in self._groups() if g.high > self.at), key=lambda g: g.low):
            if len(ids) >= self.rows and ids.max() < group.low:
                break
            ids = np.concatenate([ids, _above(system, group, self.id_column, self.at)])
            if len(ids) > self.rows:
                ids = np.partition(ids, self.rows - 1)[: self.rows]
        return {"id": int(ids.max()) if len(ids) else self.at}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        # Also called with both ends alike on a restart, which says where the stream is.
        self.at = end["id"]
        inside = [g for g in self._groups() if g.high > start["id"] and g.low <= end["id"]] if start != end else []
        return [Rows(g, start["id"], end["id"]) for g in inside] or [Rows(None, start["id"], end["id"])]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.group is None:
            return
        system, _ = _system(self.path)
        names = self.schema.names
        kinds = [_ARROW[field.dataType.simpleString()] for field in self.schema]
        with system.open_input_file(partition.group.file) as source:
            file = pq.ParquetFile(source)
            columns = list({*names, self.id_column})
            for batch in file.iter_batches(10_000, row_groups=[partition.group.index], columns=columns):
                ids = batch.column(self.id_column)
                inside = pc.and_(pc.greater(ids, partition.after), pc.less_equal(ids, partition.upto))
                batch = batch.filter(inside)
                if len(batch):
                    cast = [batch.column(name).cast(kind) for name, kind in zip(names, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(cast, names=names)

    def commit(self, end: dict) -> None:
        self.at = end["id"]


class ById(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def streamReader(self, schema: StructType) -> ByIdReader:
        return ByIdReader(self.options, schema)


def stream_by_id(
    spark: SparkSession, path: str, schema: StructType | str, rows: int, *, after: int = FIRST, id_column: str = "id"
) -> DataFrame:
    """The Parquet table at ``path`` as a stream, ``rows`` rows a batch in order of ``id_column``.

    ``after`` is the id to start after, at the first start of a checkpoint. The folder is read by
    the file systems that pyarrow knows. Run it with a ``poll`` time; to drain it, call
    ``processAllAvailable`` on the query and stop it (a trigger of what is available now
    would be one batch).
    """
    if rows < 1:
        raise ValueError("a batch has at least one row")
    spark.dataSource.register(ById)
    options = {"path": path, "idcolumn": id_column, "rows": str(rows), "after": str(after)}
    return spark.readStream.format(NAME).schema(schema).options(**options).load()
