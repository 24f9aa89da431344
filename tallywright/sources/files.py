"""Whole files in tasks: which of a column of paths exist, what they hold, and
writing a file per row. Paths are plain ones or URIs of a file system that pyarrow
opens; folders must be shared by the executors."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

BATCH_BYTES = 8 << 20


@lru_cache(maxsize=64)
def _opened(root: str) -> fs.FileSystem:
    return fs.LocalFileSystem() if root in ("", "file:") else fs.FileSystem.from_uri(root)[0]


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path and the path inside it."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*:)(//[^/]*)?(/.*)$", path)
    if scheme is None:
        return _opened(""), path
    if scheme[1] == "file:":
        return _opened("file:"), scheme[3]
    system = _opened(scheme[1] + (scheme[2] or "//") + "/")
    return system, fs.FileSystem.from_uri(path)[1]


def is_file(path: str | None) -> bool:
    if not path:
        return False
    system, inside = located(path)
    return system.get_file_info(inside).type == fs.FileType.File


def _types(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)


def with_existence(df: DataFrame, path: str, name: str = "exists") -> DataFrame:
    """``df`` with a column that says whether ``path`` is a file; a null path isn't."""

    def run(batches):
        for batch in batches:
            found = pa.array([is_file(p) for p in batch.column(path).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    return df.mapInArrow(run, f"{_types(df)}, `{name}` boolean")


def with_content(df: DataFrame, path: str, name: str = "content") -> DataFrame:
    """``df`` with the bytes of the file at ``path``, null where there is none. Rows go
    on after some megabytes, so a batch of large files isn't held as one."""

    def read(place: str | None) -> bytes | None:
        if not is_file(place):
            return None
        system, inside = located(place)
        with system.open_input_stream(inside) as stream:
            return stream.read()

    def run(batches):
        for batch in batches:
            lo, held, size = 0, [], 0
            for i, place in enumerate(batch.column(path).to_pylist()):
                held.append(read(place))
                size += len(held[-1] or b"")
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(lo, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*batch.schema.names, name])
                    lo, held, size = i + 1, [], 0

    return df.mapInArrow(run, f"{_types(df)}, `{name}` binary")


def write_files(df: DataFrame, path: str, content: str) -> int:
    """Write a file per row and return their number. A file appears whole: it is
    written under another name and then moved, so a task that runs again, or twice
    at once, leaves the same files."""

    def run(batches):
        import os

        for batch in batches:
            for place, data in zip(batch.column(path).to_pylist(), batch.column(content).to_pylist(), strict=True):
                system, inside = located(place)
                system.create_dir(inside.rsplit("/", 1)[0], recursive=True)
                draft = f"{inside}.{os.getpid()}-{os.urandom(6).hex()}.part"
                with system.open_output_stream(draft) as stream:
                    stream.write(data.encode() if isinstance(data, str) else data or b"")
                system.move(draft, inside)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return df.select(path, content).mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0
