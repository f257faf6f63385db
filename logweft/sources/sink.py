"""A sink whose files appear together: tasks write attempts, the commit publishes them.

``logsink`` writes ``csv``, ``jsonl`` or ``parquet`` of log rows, ``parts``: rows (file, line) to a part of each of these files, in an encoding,
``joined``: rows (file, part) to files of these names, each the bytes of its parts, and ``zipped``: rows (file, entry, part) to archives whose
entries are deflated from the bytes of their parts. A
task writes into a folder of attempts, under a name of its own; only the attempts of the tasks that Spark counts are renamed into place,
and the rest goes with the folder. So a killed or repeated task leaves nothing, and a failed job leaves what was there before.
Rows keep their order within a partition and files are named by partition, so rows that were sorted by range are in order from
file to file. ``about`` (JSON) becomes footer key-values of each Parquet file, else a companion file ``_metadata.json``.
"""

from __future__ import annotations

import codecs
import json
import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

ATTEMPTS = "_attempts"
#: What stands between an archive and its entry in the names of parts.
INSIDE = "/_entry_/"
#: Lines of a file that one task sorts and writes, and bytes that are copied at a time.
PART_LINES, COPIED = 200_000, 8 << 20
#: Marks of encodings.
MARKS = {"utf-16-le": codecs.BOM_UTF16_LE, "utf-16-be": codecs.BOM_UTF16_BE, "utf-8-sig": codecs.BOM_UTF8}


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Written(WriterCommitMessage):
    """(attempt, name in the folder) of each file of a task."""

    files: list


class SinkWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.kind, self.encoding, self.overwrite = options["path"], options["kind"], options.get("encoding", "utf-8"), overwrite
        self.about = json.loads(options.get("about", "{}"))
        self.header = options.get("header")
        self.attempts = f"{ATTEMPTS}-{uuid.uuid4().hex}"
        self.suffix = "" if overwrite else f"-{uuid.uuid4().hex[:8]}"  # files that are added have names of their own

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, folder = filesystem(self.path)
        system.create_dir(f"{folder}/{self.attempts}")
        task = TaskContext.get().partitionId()
        attempt = f"{folder}/{self.attempts}/{uuid.uuid4().hex}"
        write = {"parts": self.parts, "joined": self.joined, "zipped": self.zipped, "parquet": self.parquet}.get(self.kind, self.text)
        return Written(write(system, batches, attempt, task))

    def text(self, system, batches, attempt: str, task: int) -> list:
        """Rows (value) as lines; the first file has the header."""
        with system.open_output_stream(attempt) as out:
            if task == 0 and self.header:
                out.write((self.header + "\n").encode())
            for batch in batches:
                out.write("".join(f"{x}\n" for x in batch.column("value").to_pylist()).encode())
        return [(attempt, f"part-{task:05d}{self.suffix}.{self.kind}")]

    def parquet(self, system, batches, attempt: str, task: int) -> list:
        writer = None
        for batch in batches:
            writer = writer or pq.ParquetWriter(attempt, batch.schema, filesystem=system, compression="zstd")
            writer.write_batch(batch)
        if writer is None:
            return []
        writer.add_key_value_metadata({k: str(v) for k, v in self.about.items()})
        writer.close()
        return [(attempt, f"part-{task:05d}{self.suffix}.parquet")]

    def parts(self, system, batches, attempt: str, task: int) -> list:
        """Rows (file, line), those of a file one after the other, to this task's part of each file."""
        encoding = self.encoding.removesuffix("-sig")
        found = self.named_files(system, batches, attempt, "line", b"", lambda out, lines: out.write("".join(f"{x}\n" for x in lines).encode(encoding)))
        return [(a, f"{name}/{task:06d}") for a, name in found]

    def joined(self, system, batches, attempt: str, task: int) -> list:
        """Rows (file, part), those of a file in order, to files of these names; bytes are copied as they are."""

        def copy(out, parts) -> None:
            for part in parts:
                with system.open_input_stream(part) as source:
                    while data := source.read(COPIED):
                        out.write(data)

        return self.named_files(system, batches, attempt, "part", MARKS.get(self.encoding, b""), copy)

    def zipped(self, system, batches, attempt: str, task: int) -> list:
        """Rows (file, entry, part), those of an entry one after the other, to archives; an entry is deflated as its parts are read."""
        rows = ((file, entry, part) for batch in batches for file, entry, part in zip(*(batch.column(c).to_pylist() for c in ("file", "entry", "part")), strict=True))
        found = []
        for name, of_file in groupby(rows, itemgetter(0)):
            found.append((f"{attempt}-{len(found)}", name))
            with system.open_output_stream(found[-1][0]) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                for entry, of_entry in groupby(of_file, itemgetter(1)):
                    info = zipfile.ZipInfo(entry)
                    info.compress_type = zipfile.ZIP_DEFLATED
                    with archive.open(info, "w", force_zip64=True) as inside:
                        for _, _, part in of_entry:
                            with system.open_input_stream(part) as source:
                                while data := source.read(COPIED):
                                    inside.write(data)
        return found

    def named_files(self, system, batches, attempt: str, column: str, mark: bytes, put) -> list:
        out, name, found = None, None, []
        for batch in batches:
            for file, rows in groupby(zip(batch.column("file").to_pylist(), batch.column(column).to_pylist(), strict=True), itemgetter(0)):
                if file != name:
                    if out:
                        out.close()
                    name, found = file, [*found, (f"{attempt}-{len(found)}", file)]
                    out = system.open_output_stream(found[-1][0])
                    out.write(mark)
                put(out, (x for _, x in rows))
        if out:
            out.close()
        if len({f for _, f in found}) < len(found):
            raise ValueError("the rows of a file don't stand together")
        return found

    def commit(self, messages) -> None:
        system, folder = filesystem(self.path)
        files = [f for m in messages if m for f in m.files]
        if len({name for _, name in files}) < len(files):
            self.abort(messages)
            raise ValueError("two tasks wrote a file of one name")
        before = system.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if self.overwrite else []
        for attempt, name in files:
            if "/" in name:
                system.create_dir(f"{folder}/{name.rpartition('/')[0]}")
            system.move(attempt, f"{folder}/{name}")
        now = {name.split("/")[0] for _, name in files}
        for old in before:
            if old.base_name not in now and not old.base_name.startswith(ATTEMPTS):
                (system.delete_dir if old.type == pafs.FileType.Directory else system.delete_file)(old.path)
        if self.about and self.kind != "parquet":
            with system.open_output_stream(f"{folder}/_metadata.json") as out:
                out.write(json.dumps(self.about, indent=1).encode())
        self.clear(system, folder)

    def abort(self, messages) -> None:
        self.clear(*filesystem(self.path))

    def clear(self, system, folder: str) -> None:
        if system.get_file_info(f"{folder}/{self.attempts}").type == pafs.FileType.Directory:
            system.delete_dir(f"{folder}/{self.attempts}")


class LogSink(DataSource):
    @classmethod
    def name(cls):
        return "logsink"

    def writer(self, schema, overwrite):
        return SinkWriter(self.options, overwrite)


def write_sink(rows: DataFrame, path: str, mode: str = "overwrite", **options: str) -> None:
    """Writes the rows; ``append`` adds files, ``overwrite`` replaces what the folder has."""
    rows.sparkSession.dataSource.register(LogSink)
    rows.write.format("logsink").mode(mode).options(path=path, **options).save()


def write_lines(rows: DataFrame, path: str, order: str, encoding: str = "utf-8") -> None:
    """(file, ``order``, line) as text files. Ranges of lines are sorted and written as parts by tasks of their own, so a task's memory doesn't
    grow with its file; then the parts' bytes are put together, a file by one task."""
    put_together(rows, path, order, encoding, "joined")


def write_archives(rows: DataFrame, path: str, order: str, encoding: str = "utf-8") -> None:
    """(file, entry, ``order``, line) as archives of text entries, as ``write_lines`` writes files."""
    put_together(rows.withColumn("file", F.concat("file", F.lit(INSIDE), "entry")), path, order, encoding, "zipped")


def put_together(rows: DataFrame, path: str, order: str, encoding: str, kind: str) -> None:
    system, folder = filesystem(path)
    inner = f"{ATTEMPTS}-parts-{uuid.uuid4().hex}"
    some = rows.select("file", order, "line")
    ranges = some.repartitionByRange(1 + some.count() // PART_LINES, "file", order).sortWithinPartitions("file", order)
    write_sink(ranges.select("file", "line"), f"{path}/{inner}", mode="append", kind="parts", encoding=encoding)
    try:
        root = f"{folder}/{inner}"
        found = [f.path for f in system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if f.type == pafs.FileType.File]
        if found:
            names = [f[len(root) + 1 :].rpartition("/")[0] for f in found]
            split = [name.partition(INSIDE) for name in names] if kind == "zipped" else [(name, "", "") for name in names]
            parts = pa.table({"file": [x[0] for x in split], "entry": [x[2] for x in split], "part": found})  # names only
            parts = rows.sparkSession.createDataFrame(parts).repartition(len({x[0] for x in split}), "file")
            parts = parts.sortWithinPartitions("file", "entry", "part")  # by number, so that small rows of many bytes aren't coalesced
            write_sink(parts if kind == "zipped" else parts.drop("entry"), path, mode="append", kind=kind, encoding=encoding)
    finally:
        if system.get_file_info(f"{folder}/{inner}").type == pafs.FileType.Directory:
            system.delete_dir(f"{folder}/{inner}")
