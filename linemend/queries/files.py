"""Files that tasks of a query write by themselves, as input of the operators that read such files."""

from __future__ import annotations

import zipfile

from pyarrow import fs


def store_of(target: str):
    """(file system, path) on any file system Arrow knows."""
    target = target.removeprefix("file:")
    return fs.FileSystem.from_uri(target) if "://" in target else (fs.LocalFileSystem(), target)


def writable(target: str):
    """A byte stream to a new file."""
    store, inner = store_of(target)
    store.create_dir(inner.rsplit("/", 1)[0])
    return store.open_output_stream(inner)


def move(target: str, to: str) -> None:
    store, inner = store_of(target)
    store.move(inner, store_of(to)[1])


class ArchiveWriter:
    """A zip archive of one text member. It gets its name when it is closed, so a task that runs twice
    leaves one whole archive."""

    def __init__(self, target: str, attempt: str):
        self.target, self.attempt = target, f"{target}.{attempt}"
        self.raw = writable(self.attempt)
        self.archive = zipfile.ZipFile(self.raw, "w", zipfile.ZIP_DEFLATED)
        self.member = self.archive.open("mart.txt", "w", force_zip64=True)

    def write(self, lines: list[str]) -> None:
        self.member.write("".join(f"{line}\n" for line in lines).encode())

    def close(self) -> None:
        for part in (self.member, self.archive, self.raw):
            part.close()
        move(self.attempt, self.target)
