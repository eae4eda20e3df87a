"""Models as files, one each: a sink with a commit protocol.

A task writes its files into a folder of its own attempt, under ``_temporary`` of the target. Only when all tasks are done does
the driver move the folders of the attempts that count into place, one move a task, and write ``_SUCCESS``; what failed,
repeated or lost tasks left goes with ``_temporary``. Readers thus see all files of a job or none. File names are the rows'
keys, escaped, so no key leaves the folder, and don't begin like hidden ones; keys that stand twice in a task get ``~2``, ``~3`` …
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "model_files"
#: Bytes of a key in a file name; longer ones are cut and told apart by number.
MOST_NAME = 180
#: Bytes of texts that a reader hands on at once.
BATCH = 4 << 20


@dataclass
class Written(WriterCommitMessage):
    folder: str = ""
    files: int = 0
    skipped: int = 0


def _target(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or of a plain path the local one, and the path in it."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class ModelWriter(DataSourceArrowWriter):
    path: str
    key: str
    column: str
    suffix: str
    overwrite: bool
    run: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def temporary(self) -> str:
        return f"{_target(self.path)[1].rstrip('/')}/_temporary/{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _ = _target(self.path)
        done, seen = Written(f"{self.temporary}/{uuid.uuid4().hex}"), {}
        for batch in iterator:
            for key, text in zip(batch.column(self.key).to_pylist(), batch.column(self.column).to_pylist(), strict=True):
                if key is None or text is None:
                    done.skipped += 1
                    continue
                if not done.files:
                    system.create_dir(done.folder, recursive=True)
                name = quote(str(key), safe=" -_.").lstrip("._")[:MOST_NAME] or "unnamed"
                seen[name] = seen.get(name, 0) + 1
                again = "" if seen[name] == 1 else f"~{seen[name]}"
                with system.open_output_stream(f"{done.folder}/{name}{again}{self.suffix}", compression=None) as out:
                    out.write(text.encode())
                done.files += 1
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _target(self.path)
        root = root.rstrip("/")
        old = [x.path for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.base_name.startswith("part-") or x.base_name == "_SUCCESS"] if self.overwrite else []
        for part, m in enumerate(m for m in messages if m is not None and m.files):
            system.move(m.folder, f"{root}/part-{part:05d}-{self.run}")
        for path in old:
            system.delete_file(path) if path.endswith("_SUCCESS") else system.delete_dir(path)
        self.abort(messages)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(b"")

    def abort(self, messages: list[Written | None]) -> None:
        """Removes what attempts of this job left; other jobs' attempts stay."""
        system, root = _target(self.path)
        if system.get_file_info(self.temporary).type == fs.FileType.Directory:
            system.delete_dir(self.temporary)
        above = f"{root.rstrip('/')}/_temporary"
        if system.get_file_info(above).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(above)):
            system.delete_dir(above)


@dataclass
class Folder(InputPartition):
    path: str


@dataclass
class ModelReader(DataSourceReader):
    """A task reads the files that a task wrote: the driver lists folders, never files."""

    path: str
    suffix: str

    def partitions(self) -> list[Folder]:
        system, root = _target(self.path)
        return [Folder(x.path) for x in sorted(system.get_file_info(fs.FileSelector(root.rstrip("/"))), key=lambda x: x.path) if x.base_name.startswith("part-")]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        system, _ = _target(self.path)
        sources, texts, size = [], [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(texts, pa.string())], names=["source", "xml"])
        for file in system.get_file_info(fs.FileSelector(partition.path)):
            if not file.path.endswith(self.suffix):
                continue
            with system.open_input_stream(file.path, compression=None) as stream:
                texts.append(stream.read().decode())
            sources.append(file.path)
            size += file.size
            if size >= BATCH:
                yield pack()
                sources, texts, size = [], [], 0
        if sources:
            yield pack()


class ModelFiles(DataSource):
    """``df.write.format("model_files").option("key", …).option("column", …).mode("append").save(path)`` and
    ``spark.read.format("model_files").load(path)``, ``source, xml``"""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "source string, xml string"

    def reader(self, schema: StructType) -> ModelReader:
        return ModelReader(self.options["path"], self.options.get("suffix", ".xml"))

    def writer(self, schema: StructType, overwrite: bool) -> ModelWriter:
        o = self.options
        return ModelWriter(o["path"], o.get("key", "pathway_id"), o.get("column", "xml"), o.get("suffix", ".xml"), overwrite)


def write(documents: DataFrame, folder: str, key: str = "pathway_id", column: str = "xml", suffix: str = ".xml", mode: str = "append") -> None:
    """A file for each row with a key and a text, in a folder a task; ``mode`` is ``append`` or ``overwrite``."""
    documents.sparkSession.dataSource.register(ModelFiles)
    documents.select(key, column).write.format(NAME).option("key", key).option("column", column).option("suffix", suffix).mode(mode).save(folder)


def read(spark: SparkSession, folder: str, suffix: str = ".xml") -> DataFrame:
    """``source, xml``: the files that :func:`write` left, those of a folder in a task. A general reader would plan a split for
    every few files."""
    spark.dataSource.register(ModelFiles)
    return spark.read.format(NAME).option("suffix", suffix).load(folder)
