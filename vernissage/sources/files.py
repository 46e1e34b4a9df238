"""Data sources for raw files and prediction archives, written by the tasks themselves.

Every attempt of a task writes into a folder of its own. The commit then writes a
manifest with the folders of the attempts that count, and only these are read, so
a repeated or lost attempt neither doubles nor drops rows, and no folder has to be
renamed. A path has one writer at a time; any file system pyarrow can open will do.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST = "committed.json"
ROWS_PER_ARCHIVE = 65_536


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path and the path inside it."""
    if path.startswith("file:"):
        path = urlsplit(path).path
    system, root = fs.FileSystem.from_uri(path)
    return system, root.rstrip("/")


def committed(path: str) -> list[str]:
    """Names of the folders below a path that count; one for every task that wrote rows."""
    system, root = opened(path)
    if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound:
        return []
    with system.open_input_stream(f"{root}/{MANIFEST}") as manifest:
        return json.loads(manifest.read())


def committed_folders(path: str) -> list[str]:
    return [f"{path.rstrip('/')}/{folder}" for folder in committed(path)]


@dataclass
class Part(WriterCommitMessage):
    """What one attempt wrote."""

    folder: str
    rows: int


class FolderWriter(DataSourceArrowWriter):
    """Writer whose tasks fill one folder each; subclasses say how with `fill`."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def fill(self, system: fs.FileSystem, folder: str, batches: Iterator[pa.RecordBatch]) -> int:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, root = opened(self.path)
        folder = f"part-{uuid.uuid4().hex}"
        system.create_dir(f"{root}/{folder}", recursive=True)
        return Part(folder, self.fill(system, f"{root}/{folder}", iterator))

    def commit(self, messages: list[Part | None]) -> None:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        kept = [] if self.overwrite else committed(self.path)
        kept += [m.folder for m in messages if m is not None and m.rows]
        draft = f"{root}/draft-{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as manifest:
            manifest.write(json.dumps(kept).encode())
        system.move(draft, f"{root}/{MANIFEST}")
        listed = set(kept)
        for found in system.get_file_info(fs.FileSelector(root)):
            if found.base_name.startswith("part-") and found.base_name not in listed:
                system.delete_dir(found.path)

    def abort(self, messages: list[Part | None]) -> None:
        system, root = opened(self.path)
        for m in messages:
            if m is not None:
                system.delete_dir(f"{root}/{m.folder}")


class RawFileWriter(FolderWriter):
    """One file per row (name, content); a row without content writes none."""

    def fill(self, system: fs.FileSystem, folder: str, batches: Iterator[pa.RecordBatch]) -> int:
        names: set[str] = set()
        for batch in batches:
            for name, content in zip(*(batch.column(c).to_pylist() for c in ("name", "content")), strict=True):
                if content is None:
                    continue
                if not name or "/" in name:
                    raise ValueError(f"not a file name: {name!r}")
                if name in names:
                    raise ValueError(f"two files of one task are called {name!r}")
                names.add(name)
                with system.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content)
        return len(names)


class RawFiles(DataSource):
    """Sink for rows (name, content); the folders are read with Spark's own file sources."""

    @classmethod
    def name(cls) -> str:
        return "raw_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> RawFileWriter:
        return RawFileWriter(self.options["path"], overwrite)


class ArchiveWriter(FolderWriter):
    """Archives of at most `rows` rows: an array of ids and a matrix of their numbers."""

    def __init__(self, path: str, overwrite: bool, rows: int) -> None:
        super().__init__(path, overwrite)
        self.rows = rows

    def fill(self, system: fs.FileSystem, folder: str, batches: Iterator[pa.RecordBatch]) -> int:
        held: list[pa.RecordBatch] = []
        n_held = n_files = n_rows = 0

        def flush() -> None:
            nonlocal n_files
            table = pa.Table.from_batches(held).combine_chunks()
            out = io.BytesIO()
            np.savez(out, ids=_ids(table.column("id")), probs=_matrix(table.column("probs")))
            with system.open_output_stream(f"{folder}/{n_files:06d}.npz") as file:
                file.write(out.getbuffer())
            n_files += 1
            held.clear()

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, self.rows - n_held)
                held.append(piece)
                at, n_held, n_rows = at + piece.num_rows, n_held + piece.num_rows, n_rows + piece.num_rows
                if n_held == self.rows:
                    flush()
                    n_held = 0
        if n_held:
            flush()
        return n_rows


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    if column.null_count:
        raise ValueError("an archive has no place for rows without id")
    values = column.to_numpy()
    return values.astype(str) if values.dtype == object else values


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    lengths = lists.value_lengths()
    if lists.null_count or len(lengths.unique()) != 1:
        raise ValueError("the arrays of an archive are of one length and never null")
    numbers = lists.flatten()
    if numbers.null_count:
        raise ValueError("the arrays of an archive hold no nulls")
    return numbers.to_numpy(zero_copy_only=False).reshape(len(lists), -1)


@dataclass
class Archive(InputPartition):
    path: str


class ArchiveReader(DataSourceReader):
    """One task per archive file."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Archive]:
        system, root = opened(self.path)
        found = [f.path for folder in committed(self.path) for f in system.get_file_info(fs.FileSelector(f"{root}/{folder}"))]
        return [Archive(path) for path in sorted(found)] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as file, np.load(file, allow_pickle=False) as archive:
            ids, probs = archive["ids"], np.ascontiguousarray(archive["probs"], dtype=np.float64)
        ends = pa.array(np.arange(len(ids) + 1) * probs.shape[1], pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(probs.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["id", "probs"])


class PredictionArchive(DataSource):
    """Rows (id, probs) in archives of numpy arrays; give the schema when the ids are no long numbers."""

    @classmethod
    def name(cls) -> str:
        return "prediction_archive"

    def schema(self) -> str:
        return "id long, probs array<double>"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite, int(self.options.get("rows", ROWS_PER_ARCHIVE)))


def write_files(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One file per row (name, content) below a path."""
    files.sparkSession.dataSource.register(RawFiles)
    files.select("name", "content").write.format(RawFiles.name()).mode(mode).save(path)


def write_archive(df: DataFrame, path: str, mode: str = "overwrite", rows: int = ROWS_PER_ARCHIVE) -> None:
    """Probability arrays keyed by id as archives of at most `rows` rows, which bounds what a task holds."""
    df.sparkSession.dataSource.register(PredictionArchive)
    df.select("id", "probs").write.format(PredictionArchive.name()).option("rows", rows).mode(mode).save(path)


def read_archive(spark: SparkSession, path: str, schema: str = "id long, probs array<double>") -> DataFrame:
    spark.dataSource.register(PredictionArchive)
    return spark.read.format(PredictionArchive.name()).schema(schema).load(path)
