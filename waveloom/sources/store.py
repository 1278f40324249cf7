"""Two Python data sources over a folder that all machines share.

``waveloom_series``: a table of series in chunks, each chunk a Parquet file with a zone (least and greatest value of each orderable column) in the
committed list. A read takes the filters that Spark pushes, and only chunks whose zone can hold a match are read, small ones together in a partition.

``waveloom_files``: rows (name, content) as a folder of files. Names that exist already refuse the whole write, unless overwriting.

Both write in two phases. A task writes into a folder of the job's own and reports what it wrote; the driver's commit makes that visible, by one rename of the
list (series) or by a rename a file and then the list (files). A failed task or job leaves nothing that a reader sees: files of attempts
that were not reported, and those of an aborted job, are deleted.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage)
from pyspark.sql.types import StructType

SERIES, FILES = "waveloom_series", "waveloom_files"
CHUNK_ROWS = 65_536
SINGLE = 100  # chunks that are read in a partition each
LIST, JOBS = "_committed.json", "_jobs"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs, at.rstrip("/")


def _read_list(fs: pafs.FileSystem, at: str) -> dict:
    if fs.get_file_info(f"{at}/{LIST}").type == pafs.FileType.NotFound:
        return {}
    with fs.open_input_stream(f"{at}/{LIST}") as f:
        return json.loads(f.read())


def _write_list(fs: pafs.FileSystem, at: str, job: str, value: dict) -> None:
    with fs.open_output_stream(f"{at}/{JOBS}/{job}.json") as f:
        f.write(json.dumps(value).encode())
    fs.move(f"{at}/{JOBS}/{job}.json", f"{at}/{LIST}")


def _drop(fs: pafs.FileSystem, folder: str) -> None:
    if fs.get_file_info(folder).type == pafs.FileType.Directory:
        fs.delete_dir(folder)


@dataclass
class Written(WriterCommitMessage):
    files: list


@dataclass
class Chunks(InputPartition):
    files: list


# ---------------------------------------------------------------- series

def _zone(batch: pa.Table) -> dict:
    """Least and greatest value of the columns that JSON can hold in order, and whether any is null."""
    zone = {}
    for name in batch.column_names:
        kind = batch.schema.field(name).type
        if pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind) or pa.types.is_large_string(kind):
            x = pc.min_max(batch[name]).as_py()
            if x["min"] == x["min"] and x["max"] == x["max"] and (not pa.types.is_floating(kind) or not pc.any(pc.is_nan(batch[name])).as_py()):
                zone[name] = [x["min"], x["max"]]
    return zone


def may_match(zone: dict, filters: list[tuple]) -> bool:
    """Whether a chunk of this zone can hold a row that meets all filters (column, operator, value); a column without a zone can hold anything."""
    for column, op, value in filters:
        if column not in zone:
            continue
        lo, hi = zone[column]
        if lo is None:
            return False  # nulls alone meet no comparison
        if not {"=": lambda: lo <= value <= hi, "in": lambda: any(lo <= v <= hi for v in value), ">": lambda: hi > value, ">=": lambda: hi >= value, "<": lambda: lo < value, "<=": lambda: lo <= value}[op]():
            return False
    return True


_OPS = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class SeriesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.filters = path, []

    def pushFilters(self, filters: list) -> Iterator:
        """Zones only leave chunks out, so Spark still tests every filter on the rows that are read."""
        for f in filters:
            op = _OPS.get(type(f))
            if op and len(f.attribute) == 1:
                value = list(f.value) if op == "in" else f.value
                if all(type(v) in (int, float, str) for v in (value if op == "in" else [value])):
                    self.filters.append((f.attribute[0], op, value))
            yield f

    def partitions(self) -> list[Chunks]:
        """Chunks in the list's order, one each up to SINGLE; of more, small ones together: a task for each would cost far more than its rows."""
        held = [c for c in _read_list(*_open(self.path)).get("chunks", []) if may_match(c["zone"], self.filters)]
        most = 0 if len(held) <= SINGLE else min(CHUNK_ROWS, sum(c["rows"] for c in held) // SINGLE)
        found, rows = [], CHUNK_ROWS
        for c in held:
            if rows + c["rows"] > most:
                found.append(Chunks([]))
                rows = 0
            found[-1].files.append(c["file"])
            rows += c["rows"]
        return found

    def read(self, partition: Chunks | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one partition where there is none
            return
        fs, at = _open(self.path)
        for file in partition.files:
            with fs.open_input_file(f"{at}/{file}") as f:
                yield from pq.ParquetFile(f).iter_batches()


class SeriesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, rows: int):
        self.path, self.schema, self.overwrite, self.rows, self.job = path, schema, overwrite, rows, uuid.uuid4().hex
        fs, at = _open(path)
        fs.create_dir(f"{at}/{JOBS}/{self.job}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = _open(self.path)
        made, held, n = [], [], 0

        def put(table: pa.Table) -> None:
            file = f"{JOBS}/{self.job}/{uuid.uuid4().hex}.parquet"
            with fs.open_output_stream(f"{at}/{file}") as f:
                pq.write_table(table, f)
            made.append({"file": file, "rows": table.num_rows, "zone": _zone(table)})

        for batch in iterator:
            while batch.num_rows:
                part = batch.slice(0, self.rows - n)
                held, n, batch = [*held, part], n + part.num_rows, batch.slice(part.num_rows)
                if n == self.rows:
                    put(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            put(pa.Table.from_batches(held))
        return Written(made)

    def commit(self, messages: list[Written]) -> None:
        fs, at = _open(self.path)
        new = [c for m in messages if m is not None for c in m.files]
        told = {c["file"] for c in new}
        for info in fs.get_file_info(pafs.FileSelector(f"{at}/{JOBS}/{self.job}")):
            if f"{JOBS}/{self.job}/{info.base_name}" not in told:
                fs.delete_file(info.path)  # of an attempt that was lost or came second
        before = _read_list(fs, at)
        if before and not self.overwrite and before["schema"] != self.schema.jsonValue():
            _drop(fs, f"{at}/{JOBS}/{self.job}")
            raise ValueError(f"{self.path} holds series of another schema")
        kept = [] if self.overwrite else before.get("chunks", [])
        _write_list(fs, at, self.job, {"schema": self.schema.jsonValue(), "chunks": kept + new})
        for folder in {c["file"].rsplit("/", 1)[0] for c in before.get("chunks", [])} if self.overwrite else ():
            _drop(fs, f"{at}/{folder}")

    def abort(self, messages: list[Written]) -> None:
        fs, at = _open(self.path)
        _drop(fs, f"{at}/{JOBS}/{self.job}")


class SeriesSource(DataSource):
    """Options: path, and rows (of a chunk)."""

    @classmethod
    def name(cls) -> str:
        return SERIES

    def schema(self) -> StructType:
        held = _read_list(*_open(self.options["path"]))
        if not held:
            raise ValueError(f"{self.options['path']} holds no committed series")
        return StructType.fromJson(held["schema"])

    def reader(self, schema: StructType) -> SeriesReader:
        return SeriesReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> SeriesWriter:
        return SeriesWriter(self.options["path"], schema, overwrite, int(self.options.get("rows", CHUNK_ROWS)))


# ---------------------------------------------------------------- files

class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        fs, at = _open(path)
        fs.create_dir(f"{at}/{JOBS}/{self.job}")

    def write(self, iterator: Iterator) -> Written:
        fs, at = _open(self.path)
        made = []
        for row in iterator:
            if not row["name"] or "/" in row["name"] or row["name"].startswith((".", "_")):
                raise ValueError(f"not a file name: {row['name']!r}")
            staged, content = f"{JOBS}/{self.job}/{uuid.uuid4().hex}", row["content"]
            with fs.open_output_stream(f"{at}/{staged}") as f:
                f.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            made.append((row["name"], staged))
        return Written(made)

    def commit(self, messages: list[Written]) -> None:
        fs, at = _open(self.path)
        files = [x for m in messages if m is not None for x in m.files]
        names = Counter(name for name, _ in files)  # a short row a file is all that the driver gets
        there = {i.base_name for i in fs.get_file_info(pafs.FileSelector(at)) if i.type == pafs.FileType.File}
        twice = {name for name, n in names.items() if n > 1}
        clash = sorted(twice or (set() if self.overwrite else names.keys() & there))
        if clash:
            self.abort(messages)
            raise FileExistsError(f"{self.path}: {', '.join(clash[:5])}" + " and more" * (len(clash) > 5))
        for name, staged in files:
            fs.move(f"{at}/{staged}", f"{at}/{name}")
        _write_list(fs, at, self.job, {"files": sorted({*names, *_read_list(fs, at).get("files", [])})})
        _drop(fs, f"{at}/{JOBS}/{self.job}")

    abort = SeriesWriter.abort


class FilesSource(DataSource):
    """Rows (name string, content binary or string) as files of a folder. Option: path."""

    @classmethod
    def name(cls) -> str:
        return FILES

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if {"name", "content"} - set(schema.fieldNames()):
            raise ValueError("files need the columns name and content")
        return FilesWriter(self.options["path"], overwrite)


# ---------------------------------------------------------------- use

def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(SeriesSource)
    spark.dataSource.register(FilesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def write_series(df: DataFrame, path: str, *order: str, rows: int = CHUNK_ROWS, overwrite: bool = False) -> None:
    """df as chunks sorted by ``order`` within ranges of it, so that zones are narrow."""
    registered(df.sparkSession)
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    dealt.write.format(SERIES).option("path", path).option("rows", rows).mode("overwrite" if overwrite else "append").save()


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return registered(spark).read.format(SERIES).option("path", path).load()


def write_files(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """df (name, content) as files; without overwrite a name that is there already refuses the whole write."""
    registered(df.sparkSession)
    df.select("name", "content").write.format(FILES).option("path", path).mode("overwrite" if overwrite else "append").save()
