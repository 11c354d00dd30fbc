"""The report's files: one CSV file for each of its tables, with ';', a byte order mark and CRLF, as spreadsheets read them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from corpusmill.functions.text import csv_cell

LINES = "name string, place array<bigint>, line string"
BOM, END = b"\xef\xbb\xbf", b"\r\n"
#: Bytes that are copied at once.
PIECE = 1 << 20


def cell(c: Column) -> Column:
    """As csv_cell, in quotes where the text has a separator, a quote or a line end; NULL is empty."""
    c = F.coalesce(csv_cell(c), F.lit(""))
    return F.when(c.rlike("[;\"\\r\\n]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def lines(rows: DataFrame, name: str, columns: dict[str, Column], place: list[Column]) -> DataFrame:
    """LINES of a table: a header of the columns' titles, then its rows, which are written in the order of place (numbers, NULL first)."""
    spark = rows.sparkSession
    head = spark.range(1).select(F.lit(name).alias("name"), F.array(F.lit(None).cast("bigint")).alias("place"), F.concat_ws(";", *[cell(F.lit(x)) for x in columns]).alias("line"))
    body = rows.select(F.lit(name).alias("name"), F.array(F.lit(1).cast("bigint"), *[p.cast("bigint") for p in place]).alias("place"), F.concat_ws(";", *[cell(c.cast("string")) for c in columns.values()]).alias("line"))
    return head.union(body)


@dataclass
class Parts(WriterCommitMessage):
    """The part files of one task: (table, place of the first line, path)."""

    files: list[tuple[str, list, str]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.parts = path.rstrip("/"), overwrite, f"{path.rstrip('/')}/_parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Parts:
        files: list[tuple[str, list, str]] = []
        out = None
        try:
            for row in iterator:
                if not files or files[-1][0] != row.name:
                    if out:
                        out.close()
                    store, folder = fs.FileSystem.from_uri(self.parts)
                    store.create_dir(folder, recursive=True)
                    part = f"{folder}/{uuid.uuid4().hex}"
                    out = store.open_output_stream(part)
                    files.append((row.name, [-(1 << 63) if p is None else p for p in row.place], part))
                out.write(row.line.encode() + END)
        finally:
            if out:
                out.close()
        return Parts(files)

    def commit(self, messages: list[Parts | None]) -> None:
        """Puts the parts of each table together; a table's file is in place when it is whole."""
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        every = sorted(f for m in messages if m for f in m.files)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(folder)):
                if old.base_name.endswith(".csv"):
                    store.delete_file(old.path)
        for name in dict.fromkeys(f[0] for f in every):
            whole = f"{folder}/_{uuid.uuid4().hex}"
            with store.open_output_stream(whole) as out:
                out.write(BOM)
                for part in (f[2] for f in every if f[0] == name):
                    with store.open_input_stream(part) as part_of:
                        while piece := part_of.read(PIECE):
                            out.write(piece)
            store.move(whole, f"{folder}/{name}.csv")
        self._clear(store)

    def abort(self, messages: list[Parts | None]) -> None:
        self._clear(fs.FileSystem.from_uri(self.path)[0])

    def _clear(self, store: fs.FileSystem) -> None:
        folder = fs.FileSystem.from_uri(self.parts)[1]
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


class ReportFiles(DataSource):
    """Rows of LINES, dealt in ranges and sorted, to files <path>/<name>.csv; path is a URI that pyarrow's file systems open."""

    @classmethod
    def name(cls) -> str:
        return "report_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def write(rows: DataFrame, path: str) -> None:
    """Writes LINES as the files of a report in place of those there. A run that fails leaves the files as they were."""
    spark = rows.sparkSession
    spark.dataSource.register(ReportFiles)
    ordered = rows.select("name", "place", "line").repartitionByRange("name", "place").sortWithinPartitions("name", "place")
    ordered.write.format("report_files").mode("overwrite").save(path)
