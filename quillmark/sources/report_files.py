"""A sink for one file a document: format ``report_files`` with rows (name, body).

A task writes to a folder of its own below ``_staging``; when all tasks have ended well the driver renames these folders, one a task, so that a reader sees the files of
the whole run or none. A run that is given up leaves nothing visible: ``abort``
removes its staging, and what a straggling task writes after that stays below ``_staging``, where no reader looks. Files are named by ``name``, quoted, with the option
``suffix``; a null name is ``null``, a null body an empty file, and of equal names in one task the last stays. ``path`` may be any URI that Arrow's file systems read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: its folder and how many files."""

    folder: str
    files: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class ReportWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.suffix, self.overwrite, self.run = options["path"], options.get("suffix", ".json"), overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Staged:
        store, base = _opened(self.path)
        folder, files = f"{base}/_staging/{self.run}/{uuid.uuid4().hex}", 0
        store.create_dir(folder, recursive=True)
        for row in rows:
            name = "null" if row["name"] is None else quote(str(row["name"]), safe=" ").replace(".", "%2E", 1) if str(row["name"])[:1] == "." else quote(str(row["name"]), safe=" ")
            with store.open_output_stream(f"{folder}/{name}{self.suffix}") as out:
                out.write((row["body"] or "").encode())
            files += 1
        return Staged(folder, files)

    def commit(self, messages: list[Staged | None]) -> None:
        store, base = _opened(self.path)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(base)):
                if old.base_name.startswith("part-"):
                    store.delete_dir(old.path)
        for k, staged in enumerate(m for m in messages if m is not None and m.files):
            store.move(staged.folder, f"{base}/part-{self.run}-{k:06}")
        self._clear(store, base)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, store: fs.FileSystem, base: str) -> None:
        if store.get_file_info(f"{base}/_staging/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/_staging/{self.run}")


class ReportFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report_files"

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options, overwrite)


def write_report_files(reports: DataFrame, path: str, name: str = "doc_id", body: str = "report", suffix: str = ".json", mode: str = "append") -> None:
    """One file for each row of ``sinks.reports``."""
    reports.sparkSession.dataSource.register(ReportFiles)
    rows = reports.selectExpr(f"cast({name} as string) name", f"cast({body} as string) body")
    rows.write.format("report_files").mode(mode).option("path", path).option("suffix", suffix).save()
