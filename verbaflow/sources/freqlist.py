"""Frequency lists as a source and a sink: spark.read.format("freqlist"), df.write.format("freqlist").

A list is a file, or a folder of them, of lines `rank frequency word`; lines of another form, such as those above a list, are
no entries. Files are read in ranges of bytes, each by a task of its own. Of a list in its own order, filters on rank and
frequency let a task end early.

A write is all or nothing: tasks write files beside the list that readers don't look at, and their messages tell the driver
their names. Only when all have ended well does it move them to their places and write what the list holds in sum to a file
`_totals`; else it removes them.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "rank int, freq decimal(12,2), word string"
ENTRY = re.compile(r"(\d+) (\d+(?:\.\d+)?) (\S+)\s*\Z")
#: What Python takes for white space, of which a word has none, as a pattern of Arrow's.
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Bytes that one task reads, if the option split_bytes says nothing else.
SPLIT_BYTES = 32 << 20
_TESTS = {EqualTo: lambda x, y: x == y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y}
_PLACE = {"rank": 0, "freq": 1, "word": 2}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    path: str
    n: int
    total: str


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split, self.in_order = options["path"], int(options.get("split_bytes", SPLIT_BYTES)), options.get("in_order", "false").lower() == "true"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a column with a value are done here."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _PLACE and f.value is not None:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Range]:
        store, path = _store(self.path)
        info = store.get_file_info(path)
        files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", "."))]
        return [Range(f.path, low, min(low + self.split, f.size)) for f in sorted(files, key=lambda f: f.path) for low in range(0, f.size, self.split)]

    def read(self, partition: Range | None) -> Iterator[tuple]:
        """The entries of lines that begin inside the range."""
        if partition is None:  # no files
            return
        tests = [(_PLACE[f.attribute[0]], _TESTS[type(f)], f.value) for f in self.filters]
        ends = [(place, test, value) for (place, test, value), f in zip(tests, self.filters, strict=True) if (place == 0 and isinstance(f, LessThan | LessThanOrEqual)) or (place == 1 and isinstance(f, GreaterThan | GreaterThanOrEqual))]
        with _store(self.path)[0].open_input_file(partition.path) as raw, io.BufferedReader(raw, 1 << 20) as file:
            file.seek(max(0, partition.start - 1))
            if partition.start:
                file.readline()  # the rest of the line before, or just its end
            while file.tell() < partition.stop and (line := file.readline()):
                found = ENTRY.match(line.decode(errors="replace"))
                if not found:
                    continue
                entry = int(found[1]), Decimal(found[2]).quantize(Decimal("0.01")), found[3]
                if all(test(entry[place], value) for place, test, value in tests):
                    yield entry
                elif self.in_order and any(not test(entry[place], value) for place, test, value in ends):
                    return


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        store, path = _store(self.path)
        part = TaskContext.get().partitionId()
        name = f"{path}/_writing-{self.job}/part-{part:05d}-{uuid.uuid4().hex}"
        store.create_dir(name.rpartition("/")[0])
        n, total = 0, Decimal(0)
        with store.open_output_stream(name) as out:
            for batch in iterator:
                rank, freq, word = (batch.column(batch.schema.get_field_index(c)) for c in _PLACE)
                word = word.cast(pa.string())
                bad = pc.or_(pc.match_substring_regex(word, BLANK), pc.equal(word, ""))
                bad = pc.or_(pc.or_(pc.is_null(rank), pc.is_null(freq)), pc.fill_null(bad, True))
                if pc.any(bad).as_py():
                    raise ValueError(f"no entry of a list: {batch.filter(bad).slice(0, 1).to_pylist()[0]}")
                if batch.num_rows:
                    lines = pc.binary_join_element_wise(rank.cast(pa.string()), freq.cast(pa.string()), word, " ")
                    out.write(("\n".join(lines.to_pylist()) + "\n").encode())
                    n, total = n + batch.num_rows, total + pc.sum(freq.cast(pa.decimal128(38, 2))).as_py()
        return Written(name, n, str(total))

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        done = [m for m in messages if m is not None]
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if old.is_file:
                    store.delete_file(old.path)
        for m in done:
            store.move(m.path, f"{path}/{m.path.rpartition('/')[2]}")
        store.create_dir(path)
        with store.open_output_stream(f"{path}/_totals") as out:
            out.write(json.dumps({"n": sum(m.n for m in done), "total": str(sum((Decimal(m.total) for m in done), Decimal(0)))}).encode())
        self._clear(store, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store: fs.FileSystem, path: str) -> None:
        folder = f"{path}/_writing-{self.job}"
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class FrequencyListSource(DataSource):
    """Options: path; split_bytes; in_order, true if every file is sorted as lists are, so that reading may end early."""

    @classmethod
    def name(cls) -> str:
        return "freqlist"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        if {f.name for f in schema.fields} != set(_PLACE):
            raise ValueError(f"a list has the columns {SCHEMA}")
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters reach it."""
    spark.dataSource.register(FrequencyListSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
