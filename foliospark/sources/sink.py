"""Data sources of the engine: a sink whose tasks write files, and a reader of bibliographies.

    rows.select("target", "content").write.format("foliospark_files").mode("append").save(folder)
    spark.read.format("foliospark_bib").load(folder or file)

Tasks write below a folder of their own beside the targets; when all are done the driver moves the files to their places by name, without their
contents, and the folder goes. A task that fails, or runs twice, leaves nothing behind: only files of tasks that were committed are moved. The folder
has to be one that driver and executors share; file systems are those of pyarrow. register() makes both formats known to a session.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of bibliographies that one task reads, unless a file has more.
PART = 32 << 20


def opened(path: str):
    """File system and path of a URI or a local path."""
    import os

    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{os.path.abspath(path)}")


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = path, names, overwrite
        self.pending = f".pending-{uuid.uuid4().hex}"
        system, root = opened(path)
        system.create_dir(f"{root}/{self.pending}", recursive=True)

    def write(self, iterator: Iterator) -> Written:
        system, root = opened(self.path)
        folder, files, made = f"{root}/{self.pending}/{uuid.uuid4().hex}", [], set()
        target, content = self.names.index("target"), self.names.index("content")
        for row in iterator:
            name, body = row[target], row[content]
            if name is None or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"{name} is no file below the folder")
            # step by step, so that a task which outlives its job can't make the job's folder again
            for at in [len(folder), *(len(folder) + 1 + i for i, c in enumerate(name) if c == "/")]:
                if (inner := f"{folder}/{name}"[:at]) not in made:
                    system.create_dir(inner, recursive=False)
                    made.add(inner)
            with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(body.encode() if isinstance(body, str) else bytes(body or b""))
            files.append(name)
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        if self.overwrite:
            for found in system.get_file_info(_below(root)):
                if found.base_name != self.pending:
                    (system.delete_dir if found.is_file is False else system.delete_file)(found.path)
        made = set()
        for m in filter(None, messages):
            for name in m.files:
                folder = f"{root}/{name}".rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                system.move(f"{m.folder}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = opened(self.path)
        gone = f"{root}/.gone-{self.pending}"
        if system.get_file_info(f"{root}/{self.pending}").type == fs.FileType.Directory:
            system.move(f"{root}/{self.pending}", gone)  # tasks that still run find no folder from here on
            system.delete_dir(gone)


def _below(root: str, recursive: bool = False):
    from pyarrow import fs

    return fs.FileSelector(root, allow_not_found=True, recursive=recursive)


class Files(DataSource):
    """Rows with target (a path below the folder) and content (text or bytes) as files."""

    @classmethod
    def name(cls) -> str:
        return "foliospark_files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        names = [f.name for f in schema.fields]
        if not {"target", "content"} <= set(names):
            raise ValueError("rows need target and content")
        return FileWriter(self.options["path"], names, overwrite)


class BibReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, root = opened(self.path)
        found = system.get_file_info(root)
        files = [found] if found.is_file else sorted((f for f in system.get_file_info(_below(root, True)) if f.is_file and f.path.endswith(".bib")), key=lambda f: f.path)
        parts, size = [[]], 0
        for f in files:
            if parts[-1] and size + f.size > PART:
                parts.append([])
                size = 0
            parts[-1].append(f.path)
            size += f.size
        return [InputPartition(p) for p in parts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from ..kernels.bibtex import parse_bib

        system, _ = opened(self.path)
        for path in partition.value:
            try:
                with system.open_input_stream(path, compression=None) as f:
                    for row in parse_bib(f.read().decode()):
                        yield (path, *row, None)
            except Exception as e:  # noqa: BLE001  one faulty file becomes an error row
                yield (path, *[None] * 6, f"{type(e).__name__}: {e}")


class Bibliographies(DataSource):
    """path, seq, key, type, name, kind, value, error of every field of BibTeX files, as corpus.bib_fields() has them."""

    @classmethod
    def name(cls) -> str:
        return "foliospark_bib"

    def schema(self) -> str:
        from ..operators.corpus import FIELDS

        return FIELDS

    def reader(self, schema) -> BibReader:
        return BibReader(self.options["path"])


def register(spark: SparkSession) -> None:
    for source in (Files, Bibliographies):
        spark.dataSource.register(source)
