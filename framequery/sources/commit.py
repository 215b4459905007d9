"""Files that tasks write aside and the driver moves into place: what a failed or repeated attempt wrote is never seen."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql.datasource import WriterCommitMessage

from framequery.sources.ser import list_sizes, open_path


def opened(path: str) -> BinaryIO:
    """A new file to write, with the folders above it."""
    system, inner = open_path(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (where it lies, its name) of each file."""

    files: list[tuple[str, str]]


class FileCommit:
    """Names of a job's files, their commit and abort. Only names pass through the driver; a file is moved, not copied."""

    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite = path.rstrip("/"), suffix, overwrite
        self.aside = f"{self.path}/_writing-{uuid.uuid4().hex}"

    def attempt(self) -> str:
        """A folder of its own for each attempt of a task, made with its first file."""
        return f"{self.aside}/{uuid.uuid4().hex}"

    @contextmanager
    def file(self, folder: str, name: str) -> Iterator[BinaryIO]:
        with opened(f"{folder}/{name}") as f:
            yield f

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        twice = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
        system, inner = open_path(self.path)
        system.create_dir(inner, recursive=True)
        there = {p.rsplit("/", 1)[-1]: p for p, _ in list_sizes(self.path, self.suffix)}
        taken = twice or ([] if self.overwrite else sorted(there.keys() & set(names)))
        if taken:
            self.abort(messages)
            raise ValueError(f"{taken[0]} was written twice, or is there already")
        for name, old in there.items() if self.overwrite else ():
            if name not in names:
                system.delete_file(open_path(old)[1])
        for source, name in files:
            target = open_path(f"{self.path}/{name}")[1]
            if self.overwrite and name in there:
                system.delete_file(target)
            system.move(open_path(source)[1], target)
        self._clear(system)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(open_path(self.path)[0])

    def _clear(self, system: fs.FileSystem) -> None:
        inner = open_path(self.aside)[1]
        if system.get_file_info(inner).type == fs.FileType.Directory:
            system.delete_dir(inner)
